"""Queries of files, pictures, pages, selections and events. Their SQL knows what the inputs were made of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import geometry, text
from folioflow.operators import find, offsets, ranges, rendering
from folioflow.operators.inlines import MARKED, images
from folioflow.operators.structure import structure
from folioflow.plans import inputs
from folioflow.plans import structure_queries as nested
from folioflow.plans.inputs import table
from folioflow.sources import files
from folioflow.sources.shared import fresh_folder
from folioflow.streaming import edits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 1 THEN p_name || ' é' END AS strict, p_name || ' é' AS loose, CASE WHEN p_partkey % 3 = 1 THEN 'unreadableFile' END AS error_code FROM part""")
def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in UTF-8 and, every third one, in Latin-1."""
    said = F.concat("p_name", F.lit(" é"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 1, F.encode(said, "ISO-8859-1")).otherwise(F.encode(said, "UTF-8")).alias("content"))
    strict = files.decoded(F.col("content"))
    return rows.select("p_partkey", strict.alias("strict"), files.decoded(F.col("content"), "latin1").alias("loose"), F.when(strict.isNull(), "unreadableFile").alias("error_code"))


@query(f"""{nested.PICTURES}, bytes AS (SELECT path, unhex('89504E470D0A1A0A0000000D49484452' || lpad(hex(100 * (1 + CAST(left(right(path, 5), 1) AS BIGINT))), 8, '0') || '00000032') AS content FROM stored WHERE path LIKE '%.png')
SELECT s.doc, s.source AS src, CASE WHEN s.source LIKE 'x/%' THEN 'data:image/png;base64,' || base64(content) ELSE s.source END AS href, count(*) AS shown
FROM shown s LEFT JOIN resolved r ON r.doc = s.doc AND r.source = s.source LEFT JOIN bytes b ON b.path = r.path GROUP BY s.doc, s.source, content""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of documents as pages show them: files below the document's folder inlined, all others as they are."""
    docs, stored = nested.picture_documents(spark, sf_dir)
    shown = images(structure(docs, MARKED)).select("doc", "src")
    return files.inlined_images(shown, stored).groupBy("doc", "src", "href").agg(F.count("*").alias("shown"))


def number(value: Column, n_bytes: int, little: bool) -> Column:
    """A number as hexadecimal digits of so many bytes."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * n_bytes, "0")
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in (reversed(range(n_bytes)) if little else range(n_bytes))))


@query("SELECT p_partkey, CASE p_partkey % 7 WHEN 6 THEN NULL ELSE CAST(p_size * 7 AS INTEGER) END AS width, CASE p_partkey % 7 WHEN 6 THEN NULL ELSE CAST(p_partkey % 900 + 1 AS INTEGER) END AS height FROM part")
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from the headers of PNG, GIF, BMP (one upside down), JPEG and TIFF files, and of one that is no picture."""
    wide, high = F.col("p_size") * 7, F.col("p_partkey") % 900 + 1
    big, little = lambda x, n: number(x, n, False), lambda x, n: number(x, n, True)
    kinds = (
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(wide, 4), big(high, 4)),
        F.concat(F.lit("474946383961"), little(wide, 2), little(high, 2)),
        F.concat(F.lit("424D" + "00" * 16), little(wide, 4), little((1 << 32) - high, 4)),
        F.concat(F.lit("FFD8FFE00010" + "00" * 14 + "FFC0001108"), big(high, 2), big(wide, 2), F.lit("00" * 12)),
        F.concat(F.lit("49492A00080000000200" + "0001030001000000"), little(wide, 2), F.lit("0000" + "0101040001000000"), little(high, 4)),
        F.concat(F.lit("424D" + "00" * 16), little(wide, 4), little(high, 4)),
        F.lit("25504446"),
    )
    content = F.lit(None).cast("binary")
    for k, kind in enumerate(kinds):
        content = F.when(F.col("p_partkey") % 7 == k, F.unhex(kind)).otherwise(content)
    return files.image_sizes(table(spark, sf_dir, "part").select("p_partkey", content.alias("content"))).select("p_partkey", "width", "height")


INNER = nested.SQL["nested_html"]


@query(f"""SELECT doc, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset="utf-8"><title>' || c_name || ' ' || c_mktsegment || '</title><style>:root{{--ink:#111;}}</style></head><body>' || chr(10) || data || '</body></html>' || chr(10) AS data
FROM ({INNER}) JOIN customer ON doc = c_custkey""")
def standalone_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a theme, named by their first heading."""
    return files.Converter({"ink": "#111"}).pages(nested.nested_documents(spark, sf_dir))


@query("""
WITH known AS (SELECT DISTINCT 'graph ' || c_mktsegment || ' ' || c_nationkey AS source FROM customer WHERE length(c_mktsegment || c_nationkey) % 3 <> 0)
SELECT c_custkey AS doc, coalesce('<figure class="diagram"><svg>' || source || '</svg></figure>', '<pre><code class="language-mermaid">graph ' || c_mktsegment || ' ' || c_nationkey || '</code></pre>')
  || chr(10) || '<ul>' || chr(10) || '<li>' || coalesce('<figure class="diagram"><svg>' || source || '</svg></figure>', '<pre><code class="language-mermaid">graph ' || c_mktsegment || ' ' || c_nationkey || '</code></pre>') || chr(10) || '</li>' || chr(10) || '</ul>' || chr(10) AS data
FROM customer LEFT JOIN known ON source = 'graph ' || c_mktsegment || ' ' || c_nationkey""")
def drawn_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with diagrams by themselves and in an item: drawn ones are figures, others code."""
    graph = F.concat(F.lit("graph "), "c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), graph.alias("graph"), F.length(F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))).alias("size"))
    drawn = rows.where("size % 3 <> 0").select(F.col("graph").alias("source")).distinct().withColumn("svg", F.concat(F.lit("<svg>"), "source", F.lit("</svg>")))
    source = F.concat(F.lit("```mermaid\n"), "graph", F.lit("\n```\n- ~~~Mermaid\n  "), "graph", F.lit("\n  ~~~\n"))
    return rendering.rendered(rows.select("doc", source.alias("source")), "html", diagrams=drawn)


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '😀 **' || p_name || '** x' WHEN 1 THEN 'é ' || p_name || ' x' WHEN 2 THEN 'é ' || p_name || ' x' ELSE p_name || '****' END AS wrapped,
  '[' || p_name || '](' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END || ')' AS link, CASE WHEN p_size % 3 = 0 THEN '[ ]' ELSE '[x]' END AS toggled FROM part""")
def edited_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks set around a selection and taken away again, links made of one, and boxes toggled."""
    turn, size = F.col("p_partkey") % 4, F.length("p_name")
    source = F.when(turn == 0, F.concat(F.lit("😀 "), "p_name", F.lit(" x"))).when(turn == 3, F.col("p_name")).otherwise(F.concat(F.lit("é **"), "p_name", F.lit("** x")))
    loc = F.when(turn == 0, 3).when(turn == 1, 4).when(turn == 2, 2).otherwise(size)
    length = F.when(turn == 2, size + 4).when(turn == 3, 0).otherwise(size)
    box = F.when(F.col("p_size") % 3 == 0, F.when(F.col("p_size") % 2 == 0, "[x]").otherwise("[X]")).otherwise("[ ]")
    return table(spark, sf_dir, "part").select("p_partkey", text.wrapped(source, loc, length, "**").alias("wrapped"), text.link(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))).alias("link"), text.toggled_checkbox(box).alias("toggled"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_partkey % 256 / 255.0e0 END AS red, CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 2 = 0 THEN 1.0e0 ELSE p_size / 255.0e0 END AS alpha,
  CASE p_partkey % 3 WHEN 0 THEN '~/' || p_brand WHEN 1 THEN '~' ELSE '/home/mean' END AS folder, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name || '+' || p_size END AS decoded,
  CASE p_partkey % 4 WHEN 0 THEN '/d/' || p_brand WHEN 1 THEN '/' || p_brand WHEN 2 THEN NULL ELSE '/d/e/' || p_brand || ' x' END AS path, p_partkey % 4 = 2 AS has_scheme, crc FROM (
  SELECT *, xor(list_reduce(list_transform(string_split(p_brand, ''), lambda x: ascii(x)::BIGINT),
    lambda v, x: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda w, i: CASE WHEN w & 1 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END, xor(v, x)), 4294967295::BIGINT), 4294967295) AS crc FROM part)""")
def colours_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours by their digits, folders below the home folder, percent escapes, sources as paths, and checksums."""
    key, size = F.col("p_partkey"), F.col("p_size")
    alpha = F.when(key % 2 == 0, "").otherwise(F.lpad(F.hex(size.cast("long")), 2, "0"))
    colour = F.when(key % 5 == 4, "red").otherwise(F.concat(F.lit("#"), F.lpad(F.hex(key % 256), 2, "0"), F.lit("00aa"), alpha))
    path = F.when(key % 3 == 0, F.concat(F.lit("/home/me/"), "p_brand", F.lit("/x.md"))).when(key % 3 == 1, "/home/me/x").otherwise("/home/mean/x")
    escaped = F.concat(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+"), size.cast("string"), F.when(size % 4 == 0, "%zz").otherwise(""))
    source = F.when(key % 4 == 0, F.concat(F.lit("../e/../"), "p_brand")).when(key % 4 == 1, F.concat(F.lit("../../../"), "p_brand")).when(key % 4 == 2, F.concat(F.lit("https://h/"), "p_brand")).otherwise(F.concat(F.lit("./"), "p_brand", F.lit("%20x")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.hex_channel(colour, 0).alias("red"), text.hex_channel(colour, 3).alias("alpha"), text.short_directory(path, "/home/me").alias("folder"), text.percent_decoded(escaped).alias("decoded"),
        files.resolved_path(F.lit("/d/e"), source).alias("path"), text.has_scheme(source).alias("has_scheme"), F.crc32(F.col("p_brand").cast("binary")).alias("crc"),
    )


@query("""
WITH gaps AS (SELECT *, ts >= lag(ts) OVER w + INTERVAL 30 MINUTE AS pause FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
bursts AS (SELECT *, sum(CAST(coalesce(pause, true) AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM gaps)
SELECT user_id AS doc, arg_max(event_type, event_id) AS source, count(*) AS edits, max(ts) + INTERVAL 30 MINUTE AS settled_at FROM bursts GROUP BY user_id, burst""")
def settled_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits: the last one of each burst, which half an hour without one ends."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("seq"), F.col("event_type").alias("source"), "ts")
    return edits.settled_edits(rows, "30 minutes")


@query("SELECT user_id AS import_id, max(greatest(0.0e0, least(1.0e0, value / 20))) AS fraction, max(greatest(0.0e0, least(1.0e0, value / 20))) >= 1 AS done FROM events GROUP BY user_id")
def held_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.import_progress(table(spark, sf_dir, "events").select(F.col("user_id").alias("import_id"), (F.col("value") / 20).alias("fraction")))


@query("""SELECT conv_id, turn, CAST(greatest(1, turn - 1) AS BIGINT) AS unit, CAST(greatest(1, turn - 2) AS BIGINT) AS total, greatest(0.0e0, least(1.0e0, (turn - 1) / 3.0e0)) AS fraction FROM conversations""")
def clamped_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    unit, total, fraction = geometry.clamped_progress(turn - 1, turn - 2, (turn - 1) / F.lit(3.0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", unit.cast("long").alias("unit"), total.cast("long").alias("total"), fraction.alias("fraction"))


ARTWORKS = f"WITH {inputs.ranges_sql('artworks', 30, 40, 0)}, {inputs.ranges_sql('selections', 12, 170, 20)}, {inputs.ranges_sql('marks', 4, 23, 3)}, drawn AS (SELECT doc, loc, len, k FROM artworks WHERE k % 3 = 0)"


@query(f"{ARTWORKS} SELECT doc, loc, len FROM drawn r WHERE NOT EXISTS (SELECT 1 FROM selections o WHERE o.doc = r.doc AND r.loc < o.loc + o.len AND o.loc < r.loc + r.len)")
def artworks_at_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, images and diagrams that no active range overlaps."""
    docs = table(spark, sf_dir, "documents")
    return ranges.not_overlapping(inputs.ranges(docs, 30, 40, 0).where("k % 3 = 0"), inputs.ranges(docs, 12, 170, 20)).select("doc", "loc", "len")


@query(f"{ARTWORKS} SELECT m.doc, m.k, m.loc AS at_place, d.loc AS artwork, CASE WHEN m.loc < d.loc + d.len THEN d.len END AS held FROM marks m ASOF LEFT JOIN drawn d ON m.doc = d.doc AND m.loc >= d.loc")
def artworks_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each place the last artwork that begins at or before it, and its length where it holds the place."""
    docs = table(spark, sf_dir, "documents")
    points = inputs.ranges(docs, 4, 23, 3).select("doc", "k", F.col("loc").alias("at"))
    found = offsets.last_start(points, inputs.ranges(docs, 30, 40, 0).where("k % 3 = 0").select("doc", "loc", "len"), ["loc", "len"])
    return found.select("doc", "k", F.col("at").alias("at_place"), F.col("loc").alias("artwork"), F.when(F.col("at") < F.col("loc") + F.col("len"), F.col("len")).alias("held"))


@query(f"{nested.PLACES} SELECT doc, string_agg(txt, '' ORDER BY k) AS data FROM pieces GROUP BY doc")
def passed_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.convert_text(nested.part_documents(spark, sf_dir), "markdown")


NEEDLES = ("the", "tion", "Une ", "zu ver")


@query(f"""WITH needles AS (SELECT unnest({list(NEEDLES)}) AS needle)
SELECT doc_id, needle, CAST(instr(lower(text), lower(needle)) AS INTEGER) AS first_at, CAST((length(lower(text)) - length(replace(lower(text), lower(needle), ''))) // length(needle) AS BIGINT) AS hits
FROM documents, needles WHERE contains(lower(text), lower(needle))""")
def indexed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts found by way of an index of trigrams."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_folder(spark, "trigrams")
    find.build_index(docs, path)
    return find.find_any(docs, path, list(NEEDLES)).select("doc_id", "needle", "first_at", "hits")
