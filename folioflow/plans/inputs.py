"""Inputs of the queries, made from the tables by expressions that DuckDB evaluates alike (the SQL of each stands beside it)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES = """lines AS (
  SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents)"""


def by_turn(column: str, *cases: str | Column) -> Column:
    """One of several expressions, by a number modulo their count."""
    out = F.expr(cases[-1]) if isinstance(cases[-1], str) else cases[-1]
    for k in reversed(range(len(cases) - 1)):
        out = F.when(F.col(column) % len(cases) == k, F.expr(cases[k])).otherwise(out)
    return out


MARKED_CASES = ("line", "concat('• ', line)", "concat(line, ' cut-')", "concat('ated ', line)", "''", "concat('12) ', line)", "concat('* ', line)", "concat('#', line)", "concat('·', line)")
SIZE_CASES = ("11.0", "11.2", "13.9", "18.0", "NULL", "11.0", "24.1")


def marked_lines(docs: DataFrame) -> DataFrame:
    """doc, pos, text, size: lines as a PDF's text layer might hold them; blank ones stand before a document's lines, not in their place."""
    blank, line = MARKED_CASES.index("''"), F.array(by_turn("pos", *MARKED_CASES))
    texts = F.when(F.col("pos") % len(MARKED_CASES) == blank, F.array(F.lit(""), F.col("line"))).otherwise(line)
    rows = lines_of(docs).select("doc", F.col("pos").alias("at"), by_turn("pos", *SIZE_CASES).cast("double").alias("size"), F.posexplode(texts).alias("k", "text"))
    return rows.select("doc", (F.col("at") * 2 + F.col("k")).alias("pos"), "text", "size")


def turns_sql(column: str, cases: tuple[str, ...]) -> str:
    return f"CASE {column} % {len(cases)} " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(cases)) + " END"


MARKED = f"""{LINES}, lists AS (
  SELECT doc, pos, CAST({turns_sql("pos", SIZE_CASES)} AS DOUBLE) AS size, CASE WHEN pos % {len(MARKED_CASES)} = {MARKED_CASES.index("''")} THEN ['', line] ELSE [{turns_sql("pos", MARKED_CASES)}] END AS l FROM lines),
marked AS (SELECT doc, pos * 2 + generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS text, size FROM lists)"""

#: Every line in full; blank lines, fences and separators stand between the lines.
WHOLE_CASES = (
    "concat('# ', line)", r"concat('\n', line)", "line", "concat('- ', line)", "concat('- [x] ', line)", "concat('2. ', line)", "concat('> ', line)", r"concat('```python\n', line)",
    "concat('x = 1 # ', line)", r"concat(line, '\n```')", r"concat('| a | ', line, ' |\n|---|:-:|')", "concat('| b | ', line, ' |')", "concat('| **', line, '** | `c` |')", r"concat('\n', line)",
    "concat('### ', line, ' #')", "concat('see [', line, '](http://x.y/z) *now*')",
)


def markdown_documents(docs: DataFrame) -> DataFrame:
    """doc, source: documents with every kind of block."""
    rows = lines_of(docs).select("doc", "pos", by_turn("pos", *WHOLE_CASES).alias("out"))
    return rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), "\n").alias("source"))


def conversation_pages(turns: DataFrame) -> DataFrame:
    """doc, page, pos, text: a page for each turn with a running head and foot."""
    lines = F.concat(F.array(F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"))), F.split(F.coalesce("text", F.lit("")), "\n"), F.array(F.concat(F.lit("Page "), F.col("turn").cast("string"))))
    return turns.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.posexplode(lines).alias("pos", "text"))


PAGES = """paged AS (
  SELECT conv_id AS doc, turn AS page, list_concat(list_concat(['Conversation ' || conv_id], string_split(coalesce(text, ''), chr(10))), ['Page ' || turn]) AS l FROM conversations),
page_lines AS (SELECT doc, page, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos FROM paged)"""


def part_tables(parts: DataFrame) -> DataFrame:
    """doc, pos, text: a pipe table for each part, of varied alignment, with escaped pipes and ragged rows."""
    head = F.concat(F.lit("| name | brand | "), F.col("p_type"), F.lit(" |"))
    separator = by_turn("p_partkey", "'|---|:-:|--:|'", "'--- | :-- | :-:'", "'| :-: |---|---|'")
    row = by_turn("p_size", "concat('| ', p_name, ' | ', p_brand, ' | ', p_size, ' |')", "concat(p_name, ' | x |')", "concat('|', p_name, '||é ', p_size, '|')")
    return parts.select(F.col("p_partkey").alias("doc"), F.posexplode(F.array(head, separator, row, F.lit("| é | | |"))).alias("pos", "text"))


PARTS = """tables AS (
  SELECT p_partkey AS doc, ['| name | brand | ' || p_type || ' |',
    CASE p_partkey % 3 WHEN 0 THEN '|---|:-:|--:|' WHEN 1 THEN '--- | :-- | :-:' ELSE '| :-: |---|---|' END,
    CASE p_size % 3 WHEN 0 THEN '| ' || p_name || ' | ' || p_brand || ' | ' || p_size || ' |' WHEN 1 THEN p_name || ' | x |' ELSE '|' || p_name || '||é ' || p_size || '|' END,
    '| é | | |'] AS l FROM part),
table_lines AS (SELECT doc, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos FROM tables)"""


#: Pieces of code in each language, with a part's name in them.
SNIPPETS = (
    ("Swift", "let x: Int = {k} // {n}"), ("ts", "const a = `{n}` /* {n} */ + 0xFx_1"), ("py", "def {b}(self): # {n}"), ("zsh", "if cd {n} # 'x"), ("json", '{{"{n}": true, "n": {k}.5}}'),
    ("scss", "@media /* {n} */ not '{b}'"), ("klingon", "let {n} = 1"), ("Rust", "return Name{k} 'open"),
)


def code_snippets(parts: DataFrame) -> DataFrame:
    """doc, language, text: a piece of code for each part."""
    turn, key = F.col("p_partkey") % len(SNIPPETS), F.col("p_partkey").cast("string")
    out, language = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (name, code) in enumerate(SNIPPETS):
        filled = F.replace(F.replace(F.replace(F.lit(code.replace("{{", "{").replace("}}", "}")), F.lit("{n}"), F.col("p_name")), F.lit("{b}"), F.col("p_brand")), F.lit("{k}"), key)
        out, language = F.when(turn == k, filled).otherwise(out), F.when(turn == k, name).otherwise(language)
    return parts.select(F.col("p_partkey").alias("doc"), language.alias("language"), out.alias("text"))


def ranges(docs: DataFrame, width: int, step: int, shift: int) -> DataFrame:
    """doc, loc, len: ranges over a document by arithmetic, touching, overlapping and empty ones among them."""
    n = F.greatest(F.lit(0), F.floor(F.coalesce("n_chars", F.lit(0)) / step) - 1)
    return docs.select(F.col("doc_id").alias("doc"), F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long"))).alias("k")).select("doc", (F.col("k") * step + shift + (F.col("doc") + F.col("k")) % 7).alias("loc"), ((F.col("doc") + F.col("k")) % (width + 1)).alias("len"), "k")


def ranges_sql(name: str, width: int, step: int, shift: int) -> str:
    return f"""{name} AS (
  SELECT doc, k * {step} + {shift} + (doc + k) % 7 AS loc, (doc + k) % {width + 1} AS len, k FROM (
    SELECT doc_id AS doc, unnest(range(0, CAST(greatest(0, floor(coalesce(n_chars, 0) / {step}) - 1) AS BIGINT) + 1)) AS k FROM documents))"""
