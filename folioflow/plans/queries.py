"""Registered queries over the tables, and the same in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import geometry, text
from folioflow.operators import assemble, code, fragments, markdown, pages, ranges, recents, rendering, tables, word
from folioflow.plans import file_queries, inputs, markdown_sql, structure_queries
from folioflow.plans.inputs import table
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


@query("""
SELECT doc_id, words, CAST(length(text) AS BIGINT) AS characters, minutes,
  CASE WHEN words = 1 THEN '1 word' ELSE format('{:,}', words) || ' words' END AS words_text,
  CASE WHEN words = 0 THEN 'No words yet' ELSE CASE WHEN words = 1 THEN '1 word' ELSE format('{:,}', words) || ' words' END || ' · ' || minutes || ' min' END AS reading_text
FROM (SELECT *, CAST(CASE WHEN words = 0 THEN 0 ELSE greatest(1, round(words / 200.0e0)) END AS BIGINT) AS minutes FROM (
  SELECT doc_id, text, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words FROM documents))
""")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.word_count(F.col("text"))
    return table(spark, sf_dir, "documents").withColumn("words", words).select("doc_id", "words", text.utf16_length(F.col("text")).alias("characters"), text.reading_minutes(F.col("words")).alias("minutes"), text.words_text(F.col("words")).alias("words_text"), text.reading_text(F.col("words")).alias("reading_text"))


@query("""
SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS html,
  md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS attribute,
  md5(regexp_replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'), '[\\x00-\\x08\\x0B-\\x1F]', '', 'g')) AS xml
FROM pages
""")
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_escape(html)).alias("html"), F.md5(text.attribute_escape(html)).alias("attribute"), F.md5(text.xml_escape(html)).alias("xml"))


@query("""
SELECT page_id, title, trim(regexp_replace(lower(title), '[^\\p{L}\\p{M}\\p{N}]+', '-', 'g'), '-') AS slug
FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
""")
def heading_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), text.slug(title).alias("slug"))


@query("""
SELECT page_id, ext, CASE WHEN ext IN ('md','markdown','mdown','mkd','mdtext','text','txt') THEN 'markdown' WHEN ext = 'pdf' THEN 'pdf'
  WHEN ext IN ('png','jpg','jpeg','heic','heif','tiff','tif','gif','bmp','webp') THEN 'image' END AS kind,
  CASE ext WHEN 'png' THEN 'image/png' WHEN 'jpeg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime,
  regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') || '.html' AS suggested_name
FROM (SELECT page_id, path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM (
  SELECT page_id, url || '/doc.v1.' || CASE page_id % 5 WHEN 0 THEN 'MD' WHEN 1 THEN 'pdf' WHEN 2 THEN 'png' WHEN 3 THEN 'Jpeg' ELSE 'zip' END AS path FROM pages))
""")
def input_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("url", F.lit("/doc.v1."), inputs.by_turn("page_id", "'MD'", "'pdf'", "'png'", "'Jpeg'", "'zip'"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("ext", text.extension(F.col("path")))
    return rows.select("page_id", "ext", files.input_kind(F.col("path")).alias("kind"), files.mime_type(F.col("ext")).alias("mime"), text.suggested_name(F.col("path"), "html").alias("suggested_name"))


@query(f"""
WITH {inputs.PAGES}, edged AS (
  SELECT *, min(CASE WHEN trim(text) <> '' THEN pos END) OVER w AS a, max(CASE WHEN trim(text) <> '' THEN pos END) OVER w AS b,
    regexp_replace(regexp_replace(trim(text), '\\d+', '#', 'g'), '\\s+', ' ', 'g') AS norm FROM page_lines WINDOW w AS (PARTITION BY doc, page)),
pages_of AS (SELECT doc, count(DISTINCT page) AS pages FROM page_lines GROUP BY doc),
heads AS (
  SELECT e.doc, norm FROM edged e JOIN pages_of USING (doc) WHERE a <> b AND pos IN (a, b) AND length_grapheme(trim(text)) <= 80 AND norm <> '' AND pages >= 3
  GROUP BY e.doc, norm, pages HAVING count(DISTINCT page) >= greatest(2, round(pages * 0.6e0)))
SELECT doc, page, pos, text FROM edged e WHERE NOT (a <> b AND pos IN (a, b) AND EXISTS (SELECT 1 FROM heads h WHERE h.doc = e.doc AND h.norm = e.norm))
UNION ALL SELECT DISTINCT doc, page, NULL, '' FROM page_lines
""")
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.without_running_heads(inputs.conversation_pages(table(spark, sf_dir, "conversations"))).withColumn("pos", F.col("pos").cast("long"))


LADDER = f"""{inputs.MARKED}, sized AS (
  SELECT doc, round(size * 2) / 2 AS half, sum(length_grapheme(text)) AS weight, count(*) AS n FROM marked WHERE size IS NOT NULL AND trim(text, chr(32) || chr(9)) <> '' GROUP BY doc, half),
body AS (SELECT doc, arg_max(half, (weight, -half)) AS body FROM sized GROUP BY doc HAVING sum(n) >= 3),
ladder AS (
  SELECT * FROM (SELECT doc, half, dense_rank() OVER (PARTITION BY doc ORDER BY half DESC) AS level FROM sized JOIN body USING (doc) WHERE half > body * 1.12e0) WHERE level <= 2)"""


@query(f"WITH {LADDER} SELECT doc, half AS size, CAST(level AS INTEGER) AS level FROM ladder")
def heading_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.heading_ladder(inputs.marked_lines(table(spark, sf_dir, "documents")))


CLASSES = f"""{LADDER}, classed AS (
  SELECT m.doc, pos, text, trim(text, chr(32) || chr(9)) AS t, l.level FROM marked m LEFT JOIN ladder l ON m.doc = l.doc AND round(m.size * 2) / 2 = l.half),
kinds AS (
  SELECT *, CASE WHEN t = '' THEN 'blank' WHEN level IS NOT NULL AND length_grapheme(t) < 120 THEN 'heading'
    WHEN regexp_matches(t, '^(?:[•·▪◦‣–—*-] |[•·▪◦‣])') THEN 'bullet' WHEN regexp_matches(t, '^\\d{{1,3}}[.)]\\s+.+$') THEN 'ordered' ELSE 'body' END AS kind FROM classed),
contents AS (
  SELECT *, CASE kind WHEN 'bullet' THEN trim(regexp_extract(t, '^(?:[•·▪◦‣–—*-] |[•·▪◦‣])(.*)$', 1), chr(32) || chr(9))
    WHEN 'ordered' THEN regexp_extract(t, '^(\\d{{1,3}})[.)]\\s+(.+)$', 2) WHEN 'blank' THEN NULL ELSE text END AS content,
    CASE WHEN kind = 'ordered' THEN CAST(regexp_extract(t, '^(\\d{{1,3}})', 1) AS INTEGER) END AS number FROM kinds)"""


@query(f"WITH {CLASSES} SELECT doc, CAST(pos AS INTEGER) AS pos, kind, CASE WHEN kind = 'heading' THEN CAST(level AS INTEGER) END AS level, number, content FROM contents")
def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.classified(inputs.marked_lines(table(spark, sf_dir, "documents"))).select("doc", "pos", "kind", "level", "number", "content")


@query(f"""
WITH {CLASSES}, outs AS (
  SELECT *, CASE WHEN kind = 'body' THEN regexp_replace(regexp_replace(text, '([*_`\\\\])', '\\\\\\1', 'g'), '^([#>|])', '\\\\\\1') ELSE regexp_replace(content, '([*_`\\\\])', '\\\\\\1', 'g') END AS o FROM contents),
befores AS (SELECT *, CASE WHEN lag(kind) OVER w = 'body' THEN lag(o) OVER w END AS before FROM outs WINDOW w AS (PARTITION BY doc ORDER BY pos)),
joins AS (
  SELECT *, kind = 'body' AND coalesce(before LIKE '%-' AND before NOT LIKE '%--', false) AS hyphen,
    kind = 'body' AND coalesce(regexp_matches(trim(before, chr(32) || chr(9)), '[^.!?:;]$') OR trim(before, chr(32) || chr(9)) <> '' AND regexp_matches(o, '^\\p{{Ll}}'), false) AS goes FROM befores),
placed AS (
  SELECT *, sum(CASE WHEN hyphen OR goes THEN 0 ELSE 1 END) OVER w AS block, coalesce(lead(hyphen) OVER w, false) AS cut,
    CASE kind WHEN 'heading' THEN repeat('#', CAST(level AS INTEGER)) || ' ' WHEN 'bullet' THEN '- ' WHEN 'ordered' THEN number || '. ' ELSE '' END || o AS out
  FROM joins WINDOW w AS (PARTITION BY doc ORDER BY pos)),
pieces AS (
  SELECT doc, block, pos, CASE WHEN hyphen OR NOT goes THEN '' ELSE ' ' END || CASE WHEN cut THEN left(out, length(out) - 1) ELSE out END AS piece FROM placed WHERE kind <> 'blank'),
blocks AS (SELECT doc, block, trim(string_agg(piece, '' ORDER BY pos), chr(32) || chr(9)) AS text FROM pieces GROUP BY doc, block)
SELECT doc, md5(string_agg(text, chr(10) || chr(10) ORDER BY block) || chr(10)) AS markdown FROM blocks WHERE text <> '' GROUP BY doc
""")
def assembled_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.assembled(inputs.marked_lines(table(spark, sf_dir, "documents"))).select("doc", F.md5("markdown").alias("markdown"))


FRAGMENTS = """fragments AS (
  SELECT l_orderkey AS doc, l_linenumber AS frag, 'p' || l_partkey AS text, l_quantity AS x, CAST(l_suppkey % 10 * 12 + l_linenumber AS DOUBLE) AS y, l_extendedprice / 1000 AS w, 8.0 + l_linenumber % 4 AS h FROM lineitem),
ordered AS (SELECT *, y + h / 2 AS middle FROM fragments),
marks AS (
  SELECT *, CASE WHEN abs(lag(middle) OVER w - middle) < greatest(lag(h) OVER w, h) * 0.5e0 THEN 0 ELSE 1 END AS new FROM ordered WINDOW w AS (PARTITION BY doc ORDER BY middle DESC, x, frag)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY middle DESC, x, frag ROWS UNBOUNDED PRECEDING) AS row FROM marks),
boxes AS (SELECT doc, row, string_agg(text, ' ' ORDER BY x, frag, text) AS text, min(y) AS bottom, max(y + h) AS top FROM numbered GROUP BY doc, row),
medians AS (SELECT doc, list_sort(list(top - bottom))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM boxes GROUP BY doc)"""


@query(f"""WITH {FRAGMENTS}
SELECT doc, CAST(row AS BIGINT) AS row, coalesce(median > 0 AND lag(bottom) OVER (PARTITION BY doc ORDER BY row) - top > median * 0.9e0, false) AS blank_before, text FROM boxes JOIN medians USING (doc)""")
def fragment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("frag"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"), F.col("l_quantity").alias("x"),
        (F.col("l_suppkey") % 10 * 12 + F.col("l_linenumber")).cast("double").alias("y"), (F.col("l_extendedprice") / 1000).alias("w"), (8.0 + F.col("l_linenumber") % 4).alias("h"),
    )
    return fragments.fragment_lines(rows)


@query("""
WITH runs AS (SELECT l_orderkey AS doc, CAST(l_suppkey % 3 AS BIGINT) AS line, CAST(l_partkey % 4 + 9 AS DOUBLE) AS size, l_returnflag = 'R' AS bold, CAST(l_quantity AS BIGINT) AS chars FROM lineitem),
sizes AS (SELECT doc, line, size, sum(chars) AS n, sum(CASE WHEN bold THEN chars ELSE 0 END) AS b FROM runs GROUP BY doc, line, size)
SELECT doc, line, arg_max(size, (n, -size)) AS size, sum(b) * 2 > sum(n) AS is_bold FROM sizes GROUP BY doc, line
""")
def dominant_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 3).alias("line"), (F.col("l_partkey") % 4 + 9).cast("double").alias("size"), (F.col("l_returnflag") == "R").alias("bold"), F.col("l_quantity").cast("long").alias("chars"))
    return fragments.dominant_runs(runs)


CELLS = f"""{inputs.PARTS}, heads AS (
  SELECT doc, list_transform(string_split(regexp_replace(trim(text), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x)) AS s FROM table_lines WHERE pos = 1),
split AS (SELECT doc, CASE WHEN pos > 1 THEN pos - 1 ELSE 0 END AS row, list_transform(string_split(text, '|'), lambda x: trim(x, chr(32) || chr(9))) AS c FROM table_lines WHERE pos <> 1),
kept AS (SELECT doc, row, list_filter(c, lambda x, i: x <> '' OR (i > 1 AND i < len(c))) AS c FROM split),
cells AS (SELECT doc, row, unnest(c) AS text, generate_subscripts(c, 1) - 1 AS col FROM kept),
aligned AS (
  SELECT cells.*, CASE WHEN s[col + 1] LIKE ':%:' THEN 'center' WHEN s[col + 1] LIKE ':%' THEN 'left' WHEN s[col + 1] LIKE '%:' THEN 'right' ELSE 'none' END AS alignment FROM cells JOIN heads USING (doc))"""


@query(f"WITH {CELLS} SELECT doc, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, text, alignment, row = 0 AS is_header FROM aligned")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table_cells(inputs.part_tables(table(spark, sf_dir, "part")))


@query(f"""
WITH {CELLS}, widths AS (SELECT doc, col, max(length_grapheme(text)) AS chars FROM aligned GROUP BY doc, col),
scaled AS (SELECT *, sum(chars * 8.0e0 + 24) OVER (PARTITION BY doc) AS wanted FROM widths),
fitted AS (SELECT *, CASE WHEN wanted <= 720 THEN 1.0e0 WHEN wanted * 0.94e0 <= 720 THEN 0.94e0 WHEN wanted * 0.88e0 <= 720 THEN 0.88e0 ELSE 1.0e0 END AS scale FROM scaled)
SELECT doc, CAST(col AS INTEGER) AS col, CAST(chars AS BIGINT) AS chars, round(chars * 8.0e0 * scale + 24, 6) AS width,
  round(least(12000.0e0, sum(chars * 8.0e0 * scale + 24) OVER (PARTITION BY doc ORDER BY col)), 6) AS boundary, scale FROM fitted
""")
def column_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.column_boundaries(tables.table_cells(inputs.part_tables(table(spark, sf_dir, "part"))))
    return out.withColumn("width", F.round("width", 6)).withColumn("boundary", F.round("boundary", 6))


RANGES = ", ".join((inputs.ranges_sql("blocks", 30, 40, 0), inputs.ranges_sql("selections", 12, 170, 20), inputs.ranges_sql("markers", 4, 23, 3)))
MARKS = """marks AS (SELECT doc, loc, len, CASE k % 4 WHEN 0 THEN 'hidden' WHEN 1 THEN 'bullet' WHEN 2 THEN 'hidden' ELSE 'checkbox' END AS presentation FROM markers),
active AS (SELECT doc, loc, len FROM blocks b WHERE EXISTS (SELECT 1 FROM selections s WHERE s.doc = b.doc AND b.loc <= s.loc + s.len AND s.loc <= b.loc + b.len))"""
OVERLAP = "r.loc < o.loc + o.len AND o.loc < r.loc + r.len"


def _marks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    active = ranges.active_blocks(inputs.ranges(docs, 30, 40, 0).select("doc", "loc", "len"), inputs.ranges(docs, 12, 170, 20))
    shown = inputs.by_turn("k", "'hidden'", "'bullet'", "'hidden'", "'checkbox'")
    return inputs.ranges(docs, 4, 23, 3).select("doc", "loc", "len", shown.alias("presentation")), active


@query(f"WITH {RANGES}, {MARKS} SELECT doc, loc, len FROM active")
def active_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir)[1]


@query(f"""WITH {RANGES}, {MARKS} SELECT doc, loc, len, presentation FROM marks r WHERE presentation = 'hidden' AND NOT EXISTS (
  SELECT 1 FROM active o WHERE o.doc = r.doc AND ({OVERLAP} OR r.loc >= o.loc AND r.loc < o.loc + o.len))""")
def concealed_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.concealed_markers(*_marks(spark, sf_dir))


@query(f"""WITH {RANGES}, {MARKS} SELECT doc, loc, len, presentation FROM marks r WHERE presentation IN ('bullet', 'checkbox') AND NOT EXISTS (
  SELECT 1 FROM active o WHERE o.doc = r.doc AND {OVERLAP})""")
def painted_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.painted_markers(*_marks(spark, sf_dir))


@query(f"""WITH {RANGES} SELECT doc, loc, len FROM blocks r WHERE EXISTS (SELECT 1 FROM selections o WHERE o.doc = r.doc AND {OVERLAP})""")
def visible_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ranges.overlapping(inputs.ranges(docs, 30, 40, 0), inputs.ranges(docs, 12, 170, 20)).select("doc", "loc", "len")


@query(f"""WITH {RANGES} SELECT m.doc, m.loc AS at, b.loc AS range_loc, b.len AS range_len FROM markers m JOIN blocks b ON m.doc = b.doc AND m.loc >= b.loc AND m.loc < b.loc + b.len""")
def points_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ranges.containing(inputs.ranges(docs, 4, 23, 3).select("doc", F.col("loc").alias("at")), inputs.ranges(docs, 30, 40, 0))


SEEN = f"""last_seen AS (SELECT user_id, max(ts) AS mtime, min(event_id) AS arrival_ord FROM events GROUP BY user_id),
newest AS (SELECT max(ts) AS now FROM events),
seen AS (SELECT CASE user_id % 5 WHEN 0 THEN '/tmp/' ELSE '/home/me/' END || 'u' || user_id || '.md' AS path, user_id, mtime, arrival_ord, user_id % 7 <> 0 AS file_exists FROM last_seen),
stamps AS (SELECT '/home/me/u' || user_id || '.md' AS path, mtime - INTERVAL 30 HOUR AS opened FROM last_seen WHERE user_id % 3 = 0),
shown AS (SELECT seen.path, arrival_ord, coalesce(opened, mtime) AS t FROM seen LEFT JOIN stamps USING (path) WHERE file_exists AND NOT starts_with(seen.path, '/tmp/'))"""


@query(f"""WITH {SEEN}
SELECT path, CASE WHEN CAST(t AS DATE) = CAST(now AS DATE) THEN 'Today' ELSE 'Earlier' END AS section,
  CASE WHEN CAST(t AS DATE) = CAST(now AS DATE) THEN strftime(t, '%H:%M') WHEN CAST(t AS DATE) = CAST(now AS DATE) - 1 THEN 'Yesterday'
    WHEN year(t) = year(now) THEN strftime(t, '%m-%d') ELSE strftime(t, '%Y-%m-%d') END AS label, arrival_ord FROM shown, newest""")
def recents_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max("ts").alias("mtime"), F.min("event_id").alias("arrival_ord"))
    now = events.agg(F.max("ts")).scalar()
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".md"))
    seen = last.select(F.concat(F.when(F.col("user_id") % 5 == 0, "/tmp/").otherwise("/home/me/"), name).alias("path"), "mtime", "arrival_ord", (F.col("user_id") % 7 != 0).alias("file_exists"))
    stamps = last.where("user_id % 3 = 0").select(F.concat(F.lit("/home/me/"), name).alias("path"), F.expr("mtime - INTERVAL 30 HOURS").alias("opened"))
    return recents.recents_sections(seen, stamps, now)


@query("""
WITH counted AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS unit, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
SELECT conv_id, turn, CAST(unit AS INTEGER) AS unit, total, round((1 - 0.05e0) * (unit - 1) / total, 9) AS fraction,
  CASE WHEN total > 1 THEN 'Reading page ' || unit || ' of ' || total ELSE 'Reading' END AS text FROM counted
""")
def import_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = Window.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(conv.orderBy("turn")).alias("unit"), F.count("*").over(conv).alias("total"))
    unit, total = F.col("unit"), F.col("total")
    return rows.select("conv_id", "turn", "unit", "total", F.round(geometry.unit_fraction(unit, total), 9).alias("fraction"), geometry.progress_text(F.lit("Reading"), unit, total).alias("text"))


@query("""
WITH sized AS (SELECT p_partkey, CAST(p_size * 37 AS DOUBLE) AS w, CAST(p_partkey % 900 + 1 AS DOUBLE) AS h, CAST(p_size * 11 AS DOUBLE) AS available, p_size % 8 AS level FROM part),
scaled AS (SELECT *, least(least(1.0e0, greatest(available, 80.0e0) / w), 420.0e0 / h) AS scale, least(1.0e0, 5943600 / (w * 9525)) AS emu FROM sized)
SELECT p_partkey, round(scale, 9) AS scale, CAST(greatest(1, round(w * 9525 * emu)) AS BIGINT) AS emu_width, CAST(greatest(1, round(h * 9525 * emu)) AS BIGINT) AS emu_height,
  CAST(floor(9360 / greatest(level, 1)) AS BIGINT) AS twips, round(16.0e0 * [1.9e0, 1.55e0, 1.3e0, 1.15e0, 1.0e0, 0.92e0][greatest(1, least(6, level))], 9) AS points,
  CASE WHEN level <= 1 THEN 10.0e0 ELSE 22.0e0 + 12.0e0 * (level - 2) END AS indent,
  least(720.0e0, greatest(120.0e0, available - 48)) AS text_width, w > greatest(120.0e0, available - 48) + 1 AS overflows FROM scaled
""")
def layout_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 37).cast("double").alias("w"), (F.col("p_partkey") % 900 + 1).cast("double").alias("h"), (F.col("p_size") * 11).cast("double").alias("available"), (F.col("p_size") % 8).alias("level"))
    w, h, level = F.col("w"), F.col("h"), F.col("level")
    wide, high = geometry.emu_size(w, h)
    width, over = geometry.text_width(F.col("available"), F.lit(720.0), w)
    return rows.select("p_partkey", F.round(geometry.image_scale(w, h, F.col("available")), 9).alias("scale"), wide.alias("emu_width"), high.alias("emu_height"), geometry.column_twips(level).alias("twips"), F.round(geometry.heading_points(level), 9).alias("points"), geometry.outline_indent(level).alias("indent"), width.alias("text_width"), over.alias("overflows"))


@query("""
WITH diagrams AS (SELECT c_custkey, 'graph ' || c_mktsegment || ' ' || c_nationkey AS source FROM customer),
known AS (SELECT DISTINCT source, '<svg>' || source || '</svg>' AS svg FROM diagrams WHERE length(source) % 3 <> 0)
SELECT c_custkey, coalesce('<figure class="diagram">' || svg || '</figure>', '<pre><code class="language-mermaid">' || d.source || '</code></pre>') AS html,
  'data:image/svg+xml;base64,' || base64(encode(coalesce(svg, ''))) AS href FROM diagrams d LEFT JOIN known USING (source)
""")
def diagram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    diagrams = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("graph "), "c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string")).alias("source"))
    known = diagrams.select("source").distinct().where(F.length("source") % 3 != 0).withColumn("svg", F.concat(F.lit("<svg>"), "source", F.lit("</svg>")))
    figure = F.concat(F.lit('<figure class="diagram">'), "svg", F.lit("</figure>"))
    plain = F.concat(F.lit('<pre><code class="language-mermaid">'), "source", F.lit("</code></pre>"))
    return diagrams.join(known, "source", "left").select("c_custkey", F.coalesce(figure, plain).alias("html"), text.data_uri(F.lit("image/svg+xml"), F.encode(F.coalesce("svg", F.lit("")), "UTF-8")).alias("href"))


@query("""
WITH lines AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '- ' || p_name WHEN 1 THEN '  * [x] ' || p_name WHEN 2 THEN p_size || '. ' || p_name WHEN 3 THEN p_name WHEN 4 THEN '3) ' WHEN 5 THEN '- [ ] ' ELSE '+ ' || p_name END AS line FROM part)
SELECT p_partkey, regexp_matches(line, '^\\s*([-*+]|\\d{1,9}[.)])\\s') AS is_item,
  CASE p_partkey % 7 WHEN 0 THEN chr(10) || '- ' WHEN 1 THEN chr(10) || '  * [ ] ' WHEN 2 THEN chr(10) || (CAST(regexp_extract(line, '^(\\d+)', 1) AS BIGINT) + 1) || '. ' WHEN 3 THEN NULL WHEN 4 THEN '' WHEN 5 THEN '' ELSE chr(10) || '+ ' END AS continued,
  '  ' || line AS indented, regexp_replace(line, '^ {1,2}', '') AS outdented FROM lines
""")
def list_editing(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = inputs.by_turn("p_partkey", "concat('- ', p_name)", "concat('  * [x] ', p_name)", "concat(p_size, '. ', p_name)", "p_name", "'3) '", "'- [ ] '", "concat('+ ', p_name)")
    rows = table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
    x = F.col("line")
    return rows.select("p_partkey", text.is_list_item(x).alias("is_item"), text.continued_list(x).alias("continued"), text.indented(x, 2).alias("indented"), text.indented(x, -2).alias("outdented"))


@query(markdown_sql.BLOCKS_QUERY)
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.blocks(inputs.markdown_documents(table(spark, sf_dir, "documents")))


@query(f"WITH RECURSIVE {markdown_sql.BLOCKS} SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY loc) - 1 AS ord, level, text AS title FROM trimmed WHERE kind = 'heading' AND text <> ''")
def markdown_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.outline(markdown.blocks(inputs.markdown_documents(table(spark, sf_dir, "documents"))))
    return found.select("doc", F.col("ord").cast("long").alias("ord"), "level", "title")




@query(markdown_sql.ANCHORS)
def heading_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.outline(markdown.blocks(inputs.markdown_documents(table(spark, sf_dir, "documents")))).select("doc", "loc", "anchor")


@query(markdown_sql.TITLES)
def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.titles(inputs.markdown_documents(table(spark, sf_dir, "documents")))


@query(markdown_sql.TASK_LISTS)
def list_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.with_lists(markdown.blocks(inputs.markdown_documents(table(spark, sf_dir, "documents")))).where("is_item")
    return found.select("doc", "block", "depth", "new_list", F.col("start").alias("first_number"), F.col("nth").cast("long").alias("nth"), F.col("any_box").alias("is_task_list"))


@query(markdown_sql.MARKERS)
def markdown_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.markers(inputs.markdown_documents(table(spark, sf_dir, "documents")))


@query(markdown_sql.HTML)
def markdown_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.rendered(inputs.markdown_documents(table(spark, sf_dir, "documents")), "html")


@query(markdown_sql.TEXT)
def markdown_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.rendered(inputs.markdown_documents(table(spark, sf_dir, "documents")), "text")


@query(markdown_sql.tokens_query("SELECT p_partkey AS doc, 'python' AS language, CAST(0 AS BIGINT) AS start, 'def f_' || p_partkey || '(x):  # ' || p_name || chr(10) || '    return ' || chr(39) || p_brand || chr(39) || ' + Name(0x1F, 12.5)' || chr(10) AS text FROM part", "doc, CAST(ord AS INTEGER) AS ord, loc, len, token, lexeme"))
def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("def f_"), F.col("p_partkey").cast("string"), F.lit("(x):  # "), "p_name", F.lit("\n    return '"), "p_brand", F.lit("' + Name(0x1F, 12.5)\n"))
    return code.code_tokens(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), source.alias("text")), "python")


@query(markdown_sql.tokens_query(markdown_sql.SNIPPETS, "doc, language, CAST(ord AS INTEGER) AS ord, loc, len, token, lexeme"))
def code_tokens_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.tokens_by_language(inputs.code_snippets(table(spark, sf_dir, "part")))


@query(markdown_sql.FENCED_TOKENS)
def fenced_code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.fenced_tokens(inputs.markdown_documents(table(spark, sf_dir, "documents")))


@query("SELECT page_id, CAST(strlen(html) AS BIGINT) AS n_bytes, CAST(length_grapheme(html) AS BIGINT) AS graphemes FROM pages")
def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length("html").cast("long").alias("n_bytes"), text.grapheme_length(F.col("html")).alias("graphemes"))


@query(f"""
WITH {CELLS}, wide AS (SELECT *, length_grapheme(text) AS size, max(length_grapheme(text)) OVER (PARTITION BY doc, col) AS wide FROM aligned),
rows AS (SELECT doc, row, rtrim(string_agg(text || repeat(' ', wide - size), '  ' ORDER BY col)) AS line, string_agg(repeat('─', wide), '  ' ORDER BY col) AS rule FROM wide GROUP BY doc, row)
SELECT doc, string_agg(CASE WHEN row = 0 THEN line || chr(10) || rule ELSE line END, chr(10) ORDER BY row) AS text FROM rows GROUP BY doc
""")
def text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.text_tables(tables.table_cells(inputs.part_tables(table(spark, sf_dir, "part"))))


@query()
def markdown_to_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word.to_word(inputs.markdown_documents(table(spark, sf_dir, "documents")))


@query("""
WITH sized AS (SELECT p_partkey, CAST(p_partkey AS BIGINT) * p_partkey * p_partkey * p_size * p_size * (p_size % 3) AS n, p_size / 50.0e0 AS fraction, p_partkey % 9 + 1 AS i, p_size % 5 AS c, p_retailprice / 7.0e0 * pow(10.0e0, p_size % 17 - 9) AS x FROM part),
shown AS (SELECT *, CASE WHEN n <= 0 THEN '' WHEN n = 1 THEN '1 byte' WHEN n < 1000 THEN n || ' bytes' WHEN n < 1e6 THEN format('{:,}', CAST(floor(n / 1e3 + 0.5e0) AS BIGINT)) || ' kB'
  WHEN n < 1e9 THEN rtrim(rtrim(format('{:,.1f}', floor(n / 1e5 + 0.5e0) / 10), '0'), '.') || ' MB' WHEN n < 1e12 THEN rtrim(rtrim(format('{:,.2f}', floor(n / 1e7 + 0.5e0) / 100), '0'), '.') || ' GB'
  WHEN n < 1e15 THEN rtrim(rtrim(format('{:,.2f}', floor(n / 1e10 + 0.5e0) / 100), '0'), '.') || ' TB' ELSE rtrim(rtrim(format('{:,.2f}', floor(n / 1e13 + 0.5e0) / 100), '0'), '.') || ' PB' END AS size_text FROM sized)
SELECT p_partkey, size_text, 'a.pdf' || CASE WHEN size_text = '' THEN '' ELSE ' · ' || size_text END AS title, CAST(round(fraction * 100) AS BIGINT) || '%' AS percent,
  CASE WHEN c > 1 THEN 'File ' || i || ' of ' || c END AS queue, CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS VARCHAR) ELSE printf('%g', x) END AS number FROM shown
""")
def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sizes of large keys are beyond a long
    key, size = F.col("p_partkey").cast("decimal(38,0)"), F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", (key * key * key * size * size * (size % 3)).alias("n"), (size / 50.0).alias("fraction"), (F.col("p_partkey") % 9 + 1).alias("i"), (size % 5).alias("c"), (F.col("p_retailprice") / 7.0 * F.pow(F.lit(10.0), size % 17 - 9)).alias("x"))
    return rows.select("p_partkey", text.size_text(F.col("n")).alias("size_text"), text.title_text(F.lit("a.pdf"), F.col("n")).alias("title"), text.percent_text(F.col("fraction")).alias("percent"), text.queue_text(F.col("i"), F.col("c")).alias("queue"), text.number_text(F.col("x")).alias("number"))


@query(f"""
WITH {CELLS}, widths AS (SELECT doc, col, max(length_grapheme(text)) AS chars FROM aligned GROUP BY doc, col),
scaled AS (SELECT *, sum(chars * 8.0e0 + 24) OVER (PARTITION BY doc) AS wanted FROM widths),
fitted AS (SELECT *, CASE WHEN wanted <= 720 THEN 1.0e0 WHEN wanted * 0.94e0 <= 720 THEN 0.94e0 WHEN wanted * 0.88e0 <= 720 THEN 0.88e0 ELSE 1.0e0 END AS scale FROM scaled),
wide AS (SELECT doc, col, chars * 8.0e0 * scale + 24 AS width, sum(chars * 8.0e0 * scale + 24) OVER (PARTITION BY doc) AS whole FROM fitted),
stretched AS (SELECT doc, col, CASE WHEN whole > 0 AND 600 > whole THEN width * 600 / whole ELSE width END AS width FROM wide),
edges AS (SELECT doc, col + 1 AS k, least(12000.0e0, sum(width) OVER (PARTITION BY doc ORDER BY col)) AS boundary FROM stretched UNION ALL SELECT DISTINCT doc, 0, 0.0e0 FROM stretched),
piped AS (SELECT doc, pos, string_split(text, '|') AS c FROM table_lines),
pipes AS (SELECT doc, pos, c, unnest(range(1, len(c))) AS nth FROM piped),
placed AS (SELECT doc, pos, list_sum(list_transform(c[1:nth], lambda x: length(x) + 1)) - 1 AS loc, nth - 1 + CASE WHEN trim(c[1]) = '' THEN 0 ELSE 1 END AS k FROM pipes)
SELECT doc, CAST(pos AS INTEGER) AS pos, CAST(loc AS BIGINT) AS loc, round(boundary, 6) AS boundary, round(greatest(boundary - loc * 8.0e0, 6.0e0), 6) AS gap FROM placed JOIN edges USING (doc, k)
""")
def table_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.part_tables(table(spark, sf_dir, "part"))
    grid = tables.column_boundaries(tables.table_cells(lines))
    natural = F.sum("width").over(Window.partitionBy("doc"))
    upto = Window.partitionBy("doc").orderBy("col")
    edges = grid.withColumn("width", geometry.stretched(F.col("width"), natural, F.lit(600.0))).select("doc", "col", F.least(F.lit(geometry.GRID_WIDTH), F.sum("width").over(upto)).alias("boundary"))
    found = tables.delimiter_targets(lines, edges)
    return found.select("doc", "pos", "loc", F.round("boundary", 6).alias("boundary"), F.round(geometry.delimiter_gap(F.col("boundary"), F.col("loc") * 8.0), 6).alias("gap"))


@query(f"""
WITH {CELLS}, widths AS (SELECT doc, col, max(length_grapheme(text)) * 8.0e0 + 24 AS width FROM aligned GROUP BY doc, col), whole AS (SELECT doc, sum(width) AS width FROM widths GROUP BY doc)
SELECT doc % 10 AS shelf, round(max(width), 6) AS widest, round(CASE WHEN max(width) > 500 THEN 500.0e0 ELSE max(width) END, 6) AS fitted_width, round(CASE WHEN max(width) > 500 THEN 300.0e0 * 500 / max(width) ELSE 300.0e0 END, 6) AS fitted_height FROM whole GROUP BY shelf
""")
def widest_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = tables.column_boundaries(tables.table_cells(inputs.part_tables(table(spark, sf_dir, "part"))), available=1e9)
    widest = grid.groupBy("doc").agg(F.sum("width").alias("width")).groupBy((F.col("doc") % 10).alias("shelf")).agg(F.max("width").alias("width"))
    wide, high = geometry.fitted(F.col("width"), F.lit(300.0), F.lit(500.0))
    return widest.select("shelf", F.round("width", 6).alias("widest"), F.round(wide, 6).alias("fitted_width"), F.round(high, 6).alias("fitted_height"))


@query(f"""
WITH {RANGES}, {MARKS}, hidden AS (SELECT doc, loc, len FROM marks r WHERE presentation = 'hidden' AND NOT EXISTS (
  SELECT 1 FROM active o WHERE o.doc = r.doc AND ({OVERLAP} OR r.loc >= o.loc AND r.loc < o.loc + o.len))),
pipes AS (SELECT DISTINCT doc, loc FROM markers WHERE k % 3 = 0)
SELECT * FROM (
  SELECT doc, loc, len FROM hidden WHERE NOT EXISTS (SELECT 1 FROM pipes p WHERE p.doc = hidden.doc AND p.loc = hidden.loc)
  UNION ALL SELECT doc, loc, len FROM selections WHERE k % 2 = 0
  UNION ALL SELECT doc, loc + 1, len - 1 FROM blocks WHERE k % 5 = 0 AND len > 1) WHERE len > 0
""")
def concealed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hidden = ranges.concealed_markers(*_marks(spark, sf_dir))
    return ranges.concealed_set(hidden, inputs.ranges(docs, 4, 23, 3).where("k % 3 = 0"), inputs.ranges(docs, 12, 170, 20).where("k % 2 = 0"), inputs.ranges(docs, 30, 40, 0).where("k % 5 = 0"))


@query(f"""
WITH {RANGES}, {MARKS}, boxes AS (SELECT doc, loc, len FROM marks WHERE presentation = 'checkbox'), points AS (SELECT DISTINCT doc, loc AS at FROM selections UNION SELECT doc, loc + len FROM boxes),
hits AS (SELECT p.doc, p.at, min({{'l': b.loc, 'n': b.len}}) AS r FROM points p JOIN boxes b ON p.doc = b.doc AND p.at >= b.loc AND p.at <= b.loc + b.len GROUP BY p.doc, p.at)
SELECT doc, hits.at, r.l AS range_loc, r.n AS range_len FROM hits
""")
def checkbox_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _marks(spark, sf_dir)[0].where("presentation = 'checkbox'")
    points = inputs.ranges(table(spark, sf_dir, "documents"), 12, 170, 20).select("doc", F.col("loc").alias("at")).union(boxes.select("doc", F.col("loc") + F.col("len"))).distinct()
    return ranges.first_holding(points, boxes)


@query(f"""
WITH {RANGES}, spans AS (SELECT doc, loc, 1 AS traits FROM blocks UNION ALL SELECT doc, loc, CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 6 END FROM markers UNION ALL SELECT doc, loc, 8 FROM selections)
SELECT doc, loc, bit_or(CAST(traits AS INTEGER)) AS traits FROM spans GROUP BY doc, loc
""")
def trait_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    spans = inputs.ranges(docs, 30, 40, 0).select("doc", "loc", F.lit(1).alias("traits"))
    spans = spans.union(inputs.ranges(docs, 4, 23, 3).select("doc", "loc", inputs.by_turn("k", "2", "4", "6"))).union(inputs.ranges(docs, 12, 170, 20).select("doc", "loc", F.lit(8)))
    return ranges.trait_unions(spans)


@query(f"""
WITH {RANGES}, sized AS (SELECT doc, loc, len, coalesce(n_chars, 0) AS n FROM (SELECT doc, loc, len FROM blocks UNION ALL SELECT doc, loc, len FROM markers) JOIN documents ON doc = doc_id),
held AS (SELECT doc, least(greatest(loc - 5, 0), n) AS loc, least(len, n - least(greatest(loc - 5, 0), n)) AS len FROM sized),
ends AS (SELECT *, coalesce(max(loc + len) OVER (PARTITION BY doc ORDER BY loc, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM held)
SELECT doc, loc, len, count(*) AS n FROM ends WHERE loc >= upto GROUP BY doc, loc, len
""")
def ranges_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    both = inputs.ranges(docs, 30, 40, 0).unionByName(inputs.ranges(docs, 4, 23, 3))
    # ranges pack so well that partitions put together by their bytes would hold too many rows to sort
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = docs.select(F.col("doc_id").alias("doc"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    sized = both.repartition(tasks, "doc").join(sizes.repartition(tasks, "doc").hint("merge"), "doc")
    loc, length = ranges.clamped(F.col("loc") - 5, F.col("len"), F.col("n"))
    return ranges.in_order(sized.select("doc", loc.alias("loc"), length.alias("len"))).groupBy("doc", "loc", "len").agg(F.count("*").alias("n"))


@query("""
WITH paths AS (SELECT page_id, url || '/f.' || CASE page_id % 6 WHEN 0 THEN 'md' WHEN 1 THEN 'PDF' WHEN 2 THEN 'png' WHEN 3 THEN 'Jpeg' WHEN 4 THEN 'zip' ELSE 'txt' END AS path FROM pages),
kinds AS (SELECT *, CASE page_id % 6 WHEN 0 THEN 'markdown' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' WHEN 3 THEN 'image' WHEN 4 THEN NULL ELSE 'markdown' END AS kind FROM paths)
SELECT page_id, kind, output, kind <> 'markdown' AS is_converted FROM kinds, (VALUES ('markdown'), ('word'), ('html'), ('text')) o(output) WHERE kind IS NOT NULL AND NOT (kind = 'markdown' AND output = 'markdown')
""")
def output_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("url", F.lit("/f."), inputs.by_turn("page_id", "'md'", "'PDF'", "'png'", "'Jpeg'", "'zip'", "'txt'"))
    return files.output_choices(table(spark, sf_dir, "pages").select("page_id", path.alias("path"))).select("page_id", "kind", "output", "is_converted")


MEDIA = """images AS (SELECT p_partkey // 20 AS doc, p_partkey AS pos, CASE p_partkey % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'svg' WHEN 3 THEN 'gif' WHEN 4 THEN 'webp' WHEN 5 THEN 'tif' ELSE 'bmp' END AS ext FROM part),
held AS (SELECT doc, pos, lower(ext) AS ext, CASE lower(ext) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'gif' THEN 'image/gif' WHEN 'tif' THEN 'image/tiff' WHEN 'bmp' THEN 'image/bmp' END AS mime FROM images WHERE ext NOT IN ('svg', 'webp')),
media AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS ord FROM held)"""


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = inputs.by_turn("p_partkey", "'png'", "'JPG'", "'svg'", "'gif'", "'webp'", "'tif'", "'bmp'")
    return table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).alias("doc"), F.col("p_partkey").alias("pos"), F.concat(F.lit("a/b."), ext).alias("src"))


@query(f"WITH {MEDIA} SELECT doc, CAST(ord AS INTEGER) AS ord, 'image' || ord || '.' || ext AS name, 'rId' || (ord + 2) AS relation, CAST(ord AS INTEGER) AS drawing, mime FROM media")
def word_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.word_media(_images(spark, sf_dir))


@query(f"WITH {MEDIA} SELECT doc, string_agg(DISTINCT ext || '=' || mime, ';' ORDER BY ext || '=' || mime) AS types FROM media GROUP BY doc")
def word_content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.content_types(files.word_media(_images(spark, sf_dir)))


RECOGNIZED = """written AS (SELECT conv_id AS doc, turn AS page, CASE WHEN turn % 3 = 0 OR conv_id % 11 = 0 THEN '  ' ELSE coalesce(text, '') END AS text FROM conversations),
recognized AS (SELECT conv_id AS doc, turn AS page, 'scan ' || turn AS text FROM conversations WHERE conv_id % 11 <> 0),
pages_of AS (SELECT doc, page, bool_or(trim(text) <> '') AS own FROM written GROUP BY doc, page),
shown AS (SELECT w.* FROM written w JOIN pages_of p ON w.doc = p.doc AND w.page = p.page WHERE own UNION ALL SELECT r.* FROM recognized r WHERE NOT EXISTS (SELECT 1 FROM pages_of p WHERE p.doc = r.doc AND p.page = r.page AND own))"""


def _recognized(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    blank = (F.col("turn") % 3 == 0) | (F.col("conv_id") % 11 == 0)
    written = turns.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.when(blank, "  ").otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    recognized = turns.where("conv_id % 11 <> 0").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.concat(F.lit("scan "), F.col("turn").cast("string")).alias("text"))
    return pages.with_recognized(written, recognized)


@query(f"WITH {RECOGNIZED} SELECT doc, page, text FROM shown")
def recognized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recognized(spark, sf_dir)


@query(f"""WITH {RECOGNIZED}, made AS (SELECT doc, count(*) AS n FROM shown WHERE trim(text) <> '' GROUP BY doc)
SELECT d.doc, CASE WHEN n IS NOT NULL THEN n || ' pages' END AS markdown, CASE WHEN n IS NULL THEN 'noTextFound' END AS error_code FROM (SELECT DISTINCT conv_id AS doc FROM conversations) d LEFT JOIN made USING (doc)""")
def imported_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _recognized(spark, sf_dir).where(F.trim("text") != "").groupBy("doc").agg(F.concat(F.count("*").cast("string"), F.lit(" pages")).alias("markdown"))
    return pages.checked_text(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc")).distinct(), made)


@query(f"WITH {SEEN}, known AS (SELECT path FROM seen WHERE user_id % 2 = 0 UNION SELECT path FROM stamps WHERE path LIKE '%5%') SELECT path, EXISTS (SELECT 1 FROM stamps s WHERE s.path = known.path) AS has_stamp FROM known")
def known_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").select("user_id").distinct()
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".md"))
    seen = last.where("user_id % 2 = 0").select(F.concat(F.when(F.col("user_id") % 5 == 0, "/tmp/").otherwise("/home/me/"), name).alias("path"))
    stamps = last.where("user_id % 3 = 0").select(F.concat(F.lit("/home/me/"), name).alias("path"))
    known = recents.known_paths(seen, stamps.where(F.col("path").contains("5")))
    kept = recents.pruned_stamps(stamps, known).withColumn("has_stamp", F.lit(True))
    return known.join(kept, "path", "left").select("path", F.coalesce("has_stamp", F.lit(False)).alias("has_stamp"))


@query("SELECT doc_id, CAST(coalesce(instr(lower(text), 'the'), 0) AS INTEGER) AS first_at, CAST(coalesce((length(text) - length(replace(lower(text), 'the', ''))) // 3, 0) AS BIGINT) AS hits FROM documents WHERE contains(lower(text), 'the')")
def text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.found(table(spark, sf_dir, "documents"), "the").select("doc_id", "first_at", "hits")


QUERIES |= structure_queries.QUERIES | file_queries.QUERIES
SQL |= structure_queries.SQL | file_queries.SQL
