"""Queries of nested structure, inline marks and places. Their SQL doesn't read Markdown: it knows what was put together.

Documents are made of the tables' values and marks around them, so what must come out follows from the same values: places
from the lengths of the pieces, HTML from the nesting they were written in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.operators import inlines, offsets, ranges, rendering
from folioflow.operators.structure import structure
from folioflow.plans import inputs
from folioflow.plans.inputs import table
from folioflow.plans.markdown_sql import lit, utf16
from folioflow.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


#: What stands in a document for each order of a customer, by turns; {k} is its number in the list, {i} the blanks that stand for it, {o}, {p}, {s} and {d} are values of the order.
ORDERS = (
    "> {k}. order **{o}** is `` {s}`{p} ``\n> lazily *on _{d}_*",
    "> {k}. first *a **{o}** c*\n> {i}- [x] done {s}\n> {i}- [ ] open\n>\n> {i}second {p}\n>\n> {i}~~~SQL\n> {i}select {o}\n> {i}  -- {p}\n> {i}~~~",
    "> {k}. > quoted {p}\n> {i}> - deep [link](x_({o}) \"t\")\n> {i}>\n> {i}>       code {d}",
    "> {k}.\n> {i}after &amp; {o}\\*",
)
#: The same as HTML.
MADE = (
    '<li>order <strong>{o}</strong> is <code>{s}`{p}</code>\nlazily <em>on <em>{d}</em></em></li>\n',
    '<li><p>first <em>a <strong>{o}</strong> c</em></p>\n<ul class="task-list">\n<li class="task-item"><input type="checkbox" disabled checked> done {s}</li>\n'
    '<li class="task-item"><input type="checkbox" disabled> open</li>\n</ul>\n<p>second {p}</p>\n<pre><code class="language-sql">select {o}\n  -- {p}</code></pre>\n</li>\n',
    '<li><blockquote>\n<p>quoted {p}</p>\n<ul>\n<li><p>deep <a href="x_({o})" title="t">link</a></p>\n<pre><code>code {d}</code></pre>\n</li>\n</ul>\n</blockquote>\n</li>\n',
    "<li>after &amp; {o}*</li>\n",
)
#: And as plain text.
SAID = (
    "> {k}. order {o} is {s}`{p}\n>    lazily on {d}\n\n",
    "> {k}. first a {o} c\n\n>    [x] done {s}\n\n>    [ ] open\n\n\n>    second {p}\n\n>        select {o}\n>          -- {p}\n\n",
    "> > {k}. quoted {p}\n\n> >    •  deep link (x_({o}))\n\n> >           code {d}\n\n",
    "> {k}. after & {o}*\n\n",
)
VALUES = {"{k}": "CAST(nth AS VARCHAR)", "{o}": "CAST(o_orderkey AS VARCHAR)", "{p}": "o_orderpriority", "{s}": "o_orderstatus", "{d}": "strftime(o_orderdate, '%d %m %Y')", "{i}": "repeat(' ', length(CAST(nth AS VARCHAR)) + 2)"}


def filled(pattern: str) -> str:
    """SQL that puts an order's values into a pattern."""
    out = lit(pattern)
    for name, value in VALUES.items():
        out = f"replace({out}, '{name}', {value})" if name in pattern else out
    return out


def ordered(patterns: tuple[str, ...]) -> str:
    return "CASE o_orderkey % 4 " + " ".join(f"WHEN {k} THEN {filled(x)}" for k, x in enumerate(patterns)) + " END"


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, source: for each customer a quote with a heading and the list of its orders, numbered from 7, and a table behind it."""
    orders = table(spark, sf_dir, "orders")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) + 6
    values = {"{k}": nth.cast("string"), "{o}": F.col("o_orderkey").cast("string"), "{p}": F.col("o_orderpriority"), "{s}": F.col("o_orderstatus"), "{d}": F.date_format("o_orderdate", "dd MM yyyy"), "{i}": F.repeat(F.lit(" "), F.length(nth.cast("string")) + 2)}
    numbered = orders.withColumns({f"__{n[1:-1]}": v for n, v in values.items()})

    def text_of(pattern: str):
        out = F.lit(pattern)
        for name in values:
            out = F.replace(out, F.lit(name), F.col(f"__{name[1:-1]}")) if name in pattern else out
        return out

    turn = F.col("o_orderkey") % 4
    items = F.when(turn == 0, text_of(ORDERS[0])).when(turn == 1, text_of(ORDERS[1])).when(turn == 2, text_of(ORDERS[2])).otherwise(text_of(ORDERS[3]))
    lists = numbered.withColumn("item", items).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "item"))), lambda x: x["item"]), "\n").alias("items"))
    head, tail = F.concat(F.lit("> ## "), "c_name", F.lit(" *"), "c_mktsegment", F.lit("*\n>\n")), F.concat(F.lit("\n\n| a | b |\n|:-|-|\n| **"), "c_name", F.lit("** | x\\|y |"))
    made = table(spark, sf_dir, "customer").join(lists.hint("merge"), "c_custkey", "left")
    return made.select(F.col("c_custkey").alias("doc"), F.concat(head, F.coalesce("items", F.lit("")), tail).alias("source"))


NUMBERED = "WITH numbered AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 6 AS nth FROM orders)"


@query(rf"""{NUMBERED}, lists AS (SELECT o_custkey, string_agg({ordered(MADE)}, '' ORDER BY o_orderkey) AS items FROM numbered GROUP BY o_custkey)
SELECT c_custkey AS doc, '<blockquote>' || chr(10) || '<h2 id="' || replace(lower(c_name), '#', '-') || '-' || lower(c_mktsegment) || '">' || c_name || ' <em>' || c_mktsegment || '</em></h2>' || chr(10)
  || coalesce('<ol start="7">' || chr(10) || items || '</ol>' || chr(10), '') || '</blockquote>' || chr(10)
  || replace(replace('<table>@<thead>@<tr>@<th style="text-align:left">a</th>@<th>b</th>@</tr>@</thead>@<tbody>@<tr>@<td style="text-align:left"><strong>#</strong></td>@<td>x|y</td>@</tr>@</tbody>@</table>@', '@', chr(10)), '<strong>#', '<strong>' || c_name) AS data
FROM customer LEFT JOIN lists ON c_custkey = o_custkey""")
def nested_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.rendered(nested_documents(spark, sf_dir), "html")


@query(rf"""{NUMBERED}, lists AS (SELECT o_custkey, string_agg({ordered(SAID)}, '' ORDER BY o_orderkey) AS items FROM numbered GROUP BY o_custkey)
SELECT c_custkey AS doc, '> ' || c_name || ' ' || c_mktsegment || chr(10) || '> ' || repeat('-', length(c_name || ' ' || c_mktsegment)) || chr(10) || chr(10) || coalesce(items || chr(10), '')
  || rtrim('a' || repeat(' ', length(c_name) - 1) || '  b') || chr(10) || repeat('─', length(c_name)) || '  ───' || chr(10) || c_name || '  x|y' || chr(10) AS data
FROM customer LEFT JOIN lists ON c_custkey = o_custkey""")
def nested_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.rendered(nested_documents(spark, sf_dir), "text")


#: What an order gives as blocks: kind, quotes and items it stands in, whether it begins an item, and the lines it takes.
BLOCKS_OF = (
    "[('paragraph', 1, 1, true, 2)]",
    "[('paragraph', 1, 1, true, 1), ('paragraph', 1, 2, true, 1), ('paragraph', 1, 2, true, 1), ('paragraph', 1, 1, false, 1), ('code', 1, 1, false, 4)]",
    "[('paragraph', 2, 1, true, 1), ('paragraph', 2, 2, true, 1), ('code', 2, 2, false, 1)]",
    "[('paragraph', 1, 1, true, 1)]",
)


@query(f"""{NUMBERED}, pieces AS (
  SELECT o_custkey AS doc, o_orderkey, unnest(b) AS u, generate_subscripts(b, 1) AS ord FROM (SELECT *, CASE o_orderkey % 4 {" ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(BLOCKS_OF))} END AS b FROM numbered)),
blocks AS (
  SELECT c_custkey AS doc, -1 AS o, 0 AS ord, ('heading', 1, 0, false, 1) AS u FROM customer UNION ALL SELECT doc, o_orderkey, ord, u FROM pieces
  UNION ALL SELECT c_custkey, 9223372036854775807, 0, ('table', 0, 0, false, 3) FROM customer)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY o, ord) AS INTEGER) AS block, u[1] AS kind, CAST(u[2] AS INTEGER) AS quote_depth, CAST(u[3] AS INTEGER) AS list_depth, u[4] AS is_item_start, CAST(u[5] AS INTEGER) AS n_lines FROM blocks""")
def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("path", lambda n: n["kind"] == kind))
    found = structure(nested_documents(spark, sf_dir), ("block", "kind", "n_lines", "path", "leads"), inline=False)
    return found.select("doc", "block", "kind", count("quote").alias("quote_depth"), count("item").alias("list_depth"), F.col("leads").alias("is_item_start"), "n_lines")


#: Pieces of a document for each part, with what each is: a delimiter's kind, or none. Lines are in an item in a quote.
PIECES = (
    ("> - ", ""), ("**", "strong"), ("{name} ", ""), ("*", "em"), ("{brand}", ""), ("*", "em"), ("**", "strong"), (" 😀 ", ""), ("``", "code"), (" {type}`x ", ""), ("``", "code"), ("\n>   ", ""), ("[", "a"), ("~~", "del"),
    ("{size}", ""), ("~~", "del"), (" &amp; *k", ""), ('](u_{key} "t")', "a"), (" ", ""), ("_", "em"), ("é", ""), ("_", "em"), (" 2 * 3*", ""), (" snake_case_x ", ""), ("<", "a"), ("http://h/{key}", ""), (">", "a"),
    ("\n\n| ", ""), ("*", "em"), ("{name}", ""), ("*", "em"), (" | ![alt {size}](p.png) |\n|-|-|\n| ", ""), ("~~", "del"), ("{brand}\\|", ""), ("~~", "del"), (" | ", ""), ("***", ""), (" x |", ""),
)
PART = {"{name}": "p_name", "{brand}": "p_brand", "{type}": "p_type", "{size}": "p_size", "{key}": "p_partkey"}
#: Marked stretches: first and last piece, and their traits.
STRETCHES = ((1, 6, 1), (3, 5, 3), (8, 10, 8), (12, 17, 16), (13, 15, 20), (19, 21, 2), (24, 26, 16), (28, 30, 3), (29, 29, 3), (32, 34, 4))


def part_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("".join(x for x, _ in PIECES))
    for name, column in PART.items():
        text = F.replace(text, F.lit(name), F.col(column).cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), text.alias("source"))


def piece_sql(text: str) -> str:
    out = lit(text)
    for name, column in PART.items():
        out = f"replace({out}, '{name}', CAST({column} AS VARCHAR))" if name in text else out
    return out


PLACES = f"""WITH pieces AS (SELECT p_partkey AS doc, unnest([{", ".join(piece_sql(x) for x, _ in PIECES)}]) AS txt, unnest(range({len(PIECES)})) AS k, unnest([{", ".join(lit(kind) for _, kind in PIECES)}]) AS kind FROM part),
places AS (SELECT doc, k, kind, CAST(coalesce(sum({utf16("txt")}) OVER (PARTITION BY doc ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS loc, CAST({utf16("txt")} AS BIGINT) AS len FROM pieces)"""


@query(f"{PLACES} SELECT doc, loc, len, kind FROM places WHERE kind <> ''")
def inline_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inlines.delimiters(structure(part_documents(spark, sf_dir), inlines.MARKED))


#: The image stands within a longer piece, 3 units in, and is all of it but the rest of the head's row and the separator's.
SPANS = f"""{PLACES}, stretches AS (SELECT unnest([{", ".join(str(a) for a, _, _ in STRETCHES)}]) AS a, unnest([{", ".join(str(b) for _, b, _ in STRETCHES)}]) AS b, unnest([{", ".join(str(t) for _, _, t in STRETCHES)}]) AS traits),
spans AS (
  SELECT x.doc, x.loc, y.loc + y.len - x.loc AS len, traits FROM stretches JOIN places x ON x.k = a JOIN places y ON y.doc = x.doc AND y.k = b
  UNION ALL SELECT doc, loc + 3, len - {len(" | ") + len(" |") + len(chr(10)) * 2 + len("|-|-|") + len("| ")}, 9 FROM places WHERE k = 31)"""


@query(f"{SPANS} SELECT doc, loc, len, traits FROM spans")
def inline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inlines.spans(structure(part_documents(spark, sf_dir), inlines.MARKED)).select("doc", "loc", "len", "traits")


@query(f"""{SPANS}, cuts AS (SELECT doc, loc AS cut FROM spans UNION SELECT doc, loc + len FROM spans),
cells AS (SELECT doc, cut AS loc, lead(cut) OVER (PARTITION BY doc ORDER BY cut) - cut AS len FROM cuts)
SELECT c.doc, c.loc, c.len, CAST(bit_or(s.traits) AS INTEGER) AS traits FROM cells c JOIN spans s ON s.doc = c.doc AND s.loc <= c.loc AND s.loc + s.len >= c.loc + c.len WHERE c.len > 0 GROUP BY c.doc, c.loc, c.len""")
def trait_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.segments(inlines.spans(structure(part_documents(spark, sf_dir), inlines.MARKED)))


TRAITED = f"WITH {inputs.ranges_sql('small', 30, 40, 0)}, {inputs.ranges_sql('large', 90, 70, 5)}, spans AS (SELECT doc, loc, len, k % 32 AS traits FROM small UNION ALL SELECT doc, loc, len, k * 7 % 32 FROM large)"


@query(f"""{TRAITED}, kept AS (SELECT * FROM spans WHERE len > 0), cuts AS (SELECT doc, loc AS cut FROM kept UNION SELECT doc, loc + len FROM kept),
cells AS (SELECT doc, cut AS loc, lead(cut) OVER (PARTITION BY doc ORDER BY cut) - cut AS len FROM cuts)
SELECT * FROM (SELECT c.doc, c.loc, c.len, CAST(bit_or(s.traits) AS INTEGER) AS traits FROM cells c JOIN kept s ON s.doc = c.doc AND s.loc <= c.loc AND s.loc + s.len >= c.loc + c.len WHERE c.len > 0 GROUP BY c.doc, c.loc, c.len) WHERE traits > 0""")
def overlapping_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small, large = inputs.ranges(docs, 30, 40, 0), inputs.ranges(docs, 90, 70, 5)
    spans = small.select("doc", "loc", "len", (F.col("k") % 32).cast("int").alias("traits")).unionByName(large.select("doc", "loc", "len", (F.col("k") * 7 % 32).cast("int").alias("traits")))
    return ranges.segments(spans)


CHANGES = ", ".join((inputs.ranges_sql("blocks", 30, 40, 0), inputs.ranges_sql("selections", 12, 170, 20)))


@query(f"""WITH {CHANGES}, layout AS (SELECT DISTINCT doc, loc, len FROM blocks),
active AS (SELECT s.doc, s.k, b.loc, b.len FROM selections s JOIN layout b ON s.doc = b.doc AND b.loc <= s.loc + s.len AND s.loc <= b.loc + b.len)
SELECT doc, k AS seq, loc, len, 1 AS change FROM active a WHERE NOT EXISTS (SELECT 1 FROM active p WHERE p.doc = a.doc AND p.k = a.k - 1 AND p.loc = a.loc AND p.len = a.len)
UNION ALL
SELECT a.doc, a.k + 1, a.loc, a.len, -1 FROM active a JOIN selections s ON s.doc = a.doc AND s.k = a.k + 1 WHERE NOT EXISTS (SELECT 1 FROM active n WHERE n.doc = a.doc AND n.k = a.k + 1 AND n.loc = a.loc AND n.len = a.len)""")
def reveal_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    selections = inputs.ranges(docs, 12, 170, 20).select("doc", F.col("k").alias("seq"), "loc", "len")
    return ranges.reveal_changes(selections, inputs.ranges(docs, 30, 40, 0))


#: Characters of documents with the places before and behind each, by lines.
CHARACTERS = f"""rows AS (SELECT doc_id AS doc, text, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc, line, line_text, {utf16("text")} AS length, count(*) OVER (PARTITION BY doc) AS n_lines, coalesce(sum({utf16("line_text")} + 1) OVER (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS loc FROM rows),
chars AS (SELECT doc, line, unnest(string_split(line_text, '')) AS c, generate_subscripts(string_split(line_text, ''), 1) AS i FROM sized WHERE line_text <> ''),
ends AS (
  SELECT doc, line, sum(strlen(c)) OVER w AS bytes, sum({utf16("c")}) OVER w AS units FROM chars WINDOW w AS (PARTITION BY doc, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT doc, line, 0, 0 FROM sized)"""


@query(f"""WITH {CHARACTERS}, asked AS (
  SELECT doc_id AS doc, unnest(range(0, len(string_split(text, chr(10))) + 3)) AS line FROM documents WHERE text IS NOT NULL),
positions AS (SELECT doc, line, (doc * 7 + line * 13) % 90 AS col FROM asked),
held AS (SELECT p.doc, p.line, p.col, s.line AS at_line, s.loc, s.length, greatest(p.col - 1, 0) AS b, strlen(s.line_text) AS all_bytes, {utf16("s.line_text")} AS all_units FROM positions p JOIN sized s ON s.doc = p.doc AND s.line = greatest(1, least(p.line, s.n_lines))),
found AS (SELECT h.*, e.units FROM held h ASOF JOIN ends e ON h.doc = e.doc AND h.at_line = e.line AND h.b >= e.bytes)
SELECT doc, line, col AS "column", CAST(least(loc + CASE WHEN all_bytes = all_units THEN b ELSE units END, length) AS BIGINT) AS unit FROM found""")
def source_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("text").alias("source"))
    asked = docs.where("source IS NOT NULL").select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.size(F.split("source", "\n")).cast("long") + 2)).alias("line"))
    return offsets.to_units(asked.withColumn("column", (F.col("doc") * 7 + F.col("line") * 13) % 90), offsets.line_index(docs))


@query(f"""WITH {CHARACTERS}, {inputs.ranges_sql("marks", 4, 23, 3)}, points AS (SELECT doc, k, loc AS place FROM marks JOIN (SELECT DISTINCT doc FROM sized) USING (doc)),
lined AS (SELECT p.doc, p.k, p.place, s.line, s.loc, s.length, s.line_text FROM points p ASOF JOIN sized s ON p.doc = s.doc AND p.place >= s.loc),
held AS (SELECT *, least(least(place, length) - loc, {utf16("line_text")}) AS inside FROM lined),
found AS (SELECT h.*, e.bytes FROM held h ASOF JOIN ends e ON h.doc = e.doc AND h.line = e.line AND h.inside >= e.units)
SELECT f.doc, k, place AS "at", CAST(f.line AS INTEGER) AS line, CAST(bytes + 1 AS INTEGER) AS "column", CAST(f.loc AS BIGINT) AS line_loc, CAST(greatest(0, coalesce(n.loc - 1, f.length) - f.loc) AS BIGINT) AS line_len
FROM found f LEFT JOIN sized n ON n.doc = f.doc AND n.line = f.line + 1""")
def source_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    points = inputs.ranges(docs, 4, 23, 3).select("doc", "k", F.col("loc").alias("at"))
    return offsets.to_positions(points, offsets.line_index(docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("source"))))


#: A heading around characters of the private range, tags, references and escapes.
AWKWARD = ("\ue001script\ue002 {t}\ue02a\ue0ff", "&lt;b&gt; &amp;amp; {t} \\<i\\>", "<b onclick='x'>{t}</b>", "`<i>` {t} \ue03c\ue03e")


@query(f"""SELECT c_custkey AS doc, '<p>' || CASE c_custkey % 4 WHEN 0 THEN {lit(AWKWARD[0].split("{t}")[0])} || c_name || {lit(AWKWARD[0].split("{t}")[1])}
  WHEN 1 THEN '&lt;b&gt; &amp;amp; ' || c_name || ' &lt;i&gt;' WHEN 2 THEN '&lt;b onclick=''x''&gt;' || c_name || '&lt;/b&gt;' ELSE '<code>&lt;i&gt;</code> ' || c_name || {lit(AWKWARD[3].split("{t}")[1])} END || '</p>' || chr(10) AS data FROM customer""")
def safe_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of others, without raw HTML."""
    turn = F.col("c_custkey") % 4
    parts = [x.split("{t}") for x in AWKWARD]
    shown = [F.concat(F.lit(a), "c_name", F.lit(b)) for a, b in parts]
    source = F.when(turn == 0, shown[0]).when(turn == 1, shown[1]).when(turn == 2, shown[2]).otherwise(shown[3])
    return rendering.rendered(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), source.alias("source")), "html", raw_html=False)


PICTURES = """WITH shown AS (SELECT '/d' || (p_partkey // 20) || '/a.md' AS doc, CASE p_partkey % 5 WHEN 0 THEN 'x/' || (p_size % 3) || '.png' WHEN 1 THEN '../d' || (p_partkey // 20) || '/x/./' || (p_size % 3) || '.png' WHEN 2 THEN '/shared/' || (p_size % 7) || '.gif' WHEN 3 THEN 'http://h/x.png' ELSE 'none.png' END AS source, p_partkey AS pos FROM part),
resolved AS (SELECT DISTINCT doc, source, CASE WHEN source LIKE 'x/%' THEN split_part(doc, '/a.md', 1) || '/' || source WHEN source LIKE '../%' THEN split_part(doc, '/a.md', 1) || '/x/' || split_part(source, '/', 5) WHEN source LIKE '/shared%' THEN source END AS path FROM shown),
stored AS (SELECT DISTINCT path, CASE WHEN path LIKE '%.png' THEN 100 * (1 + CAST(left(right(path, 5), 1) AS BIGINT)) ELSE 1200 END AS w, 50 AS h FROM resolved WHERE path IS NOT NULL),
ranked AS (SELECT r.doc, r.source, r.path, w, h, dense_rank() OVER (PARTITION BY r.doc ORDER BY r.path) AS n FROM resolved r JOIN stored s ON r.path = s.path)"""


@query(f"""{PICTURES} SELECT doc, source, 'image' || n || right(path, 4) AS name, 'picture' || n AS relation, CASE WHEN path LIKE '%.png' THEN 'image/png' ELSE 'image/gif' END AS mime,
  CAST(greatest(1, round(w * 9525 * least(1.0e0, 5943600 / (w * 9525.0e0)))) AS BIGINT) AS cx, CAST(greatest(1, round(h * 9525 * least(1.0e0, 5943600 / (w * 9525.0e0)))) AS BIGINT) AS cy FROM ranked""")
def placed_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures that documents show, with the files they are found in and their place and size in a Word document."""
    docs, stored = picture_documents(spark, sf_dir)
    return files.placed_pictures(docs, stored).drop("content")


def picture_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents that show pictures, and the stored files, which hold headers only."""
    folder = F.floor(F.col("p_partkey") / 20).cast("string")
    size = F.col("p_size").cast("int")
    third, seventh = (size % 3).cast("string"), (size % 7).cast("string")
    turn = F.col("p_partkey") % 5
    near, shared = F.concat(F.lit("x/"), third, F.lit(".png")), F.concat(F.lit("/shared/"), seventh, F.lit(".gif"))
    source = F.when(turn == 0, near).when(turn == 1, F.concat(F.lit("../d"), folder, F.lit("/x/./"), third, F.lit(".png"))).when(turn == 2, shared).when(turn == 3, "http://h/x.png").otherwise("none.png")
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("/d"), folder, F.lit("/a.md")).alias("doc"), "p_partkey", source.alias("src"), F.when(turn.isin(0, 1), F.concat(F.lit("/d"), folder, F.lit("/x/"), third, F.lit(".png"))).when(turn == 2, shared).alias("path"))
    line = F.concat(F.lit("- see ![a *b*]("), "src", F.lit(")"))
    docs = parts.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n").alias("source"))
    wide = lambda n, bytes_: F.lpad(F.hex(n), 2 * bytes_, "0")
    number = F.substring("path", -5, 1).try_cast("long")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide(100 * (1 + number), 4), wide(F.lit(50), 4))
    gif = F.lit("474946383961" + "B004" + "3200")
    stored = parts.where("path IS NOT NULL").select("path").distinct().select("path", F.unhex(F.when(F.col("path").endswith("png"), png).otherwise(gif)).alias("content"))
    return docs, stored
