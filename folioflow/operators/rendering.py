"""HTML and plain text of Markdown, from the blocks and inline pieces of `structure`.

A block's inline pieces become text by one expression each. A document's blocks then meet in one row, where each opens the
containers that the block before it does not stand in and closes those that the next one doesn't. A document is thus
shuffled twice, whole and by blocks, whatever its marks, and made once; its row is as long as what is made of it. A join adds drawn
diagrams.

Cases: null and empty sources give empty texts; the same doc twice is rendered once for each, of all their lines; without
raw_html no tag of a source is left one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import attribute_escape, grapheme_length, html_escape
from folioflow.operators import code, tables
from folioflow.operators.structure import structure


#: Columns of blocks that HTML and text are made from.
RENDERED = ("block", "kind", "level", "language", "n_lines", "path", "leads", "anchor", "pieces", "verbatim")


def joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def piece_html(p: Column, raw_html: bool) -> Column:
    title = F.when(p["title"].isNotNull(), F.concat(F.lit(' title="'), attribute_escape(p["title"]), F.lit('"'))).otherwise("")
    link = attribute_escape(F.coalesce(p["link"], F.lit("")))
    return (
        F.when(p["kind"].isin("text", "code"), html_escape(p["text"]))
        .when(p["kind"] == "soft", "\n")
        .when((p["kind"] == "open") & (p["tag"] == "a"), F.concat(F.lit('<a href="'), link, F.lit('"'), title, F.lit(">")))
        .when(p["kind"] == "open", F.concat(F.lit("<"), p["tag"], F.lit(">")))
        .when(p["kind"] == "close", F.concat(F.lit("</"), p["tag"], F.lit(">")))
        .when(p["kind"] == "break", "<br>\n")
        .when(p["kind"] == "image", F.concat(F.lit('<img src="'), link, F.lit('" alt="'), attribute_escape(p["text"]), F.lit('"'), title, F.lit(">")))
        .otherwise(p["text"] if raw_html else html_escape(p["text"]))
    )


def piece_text(p: Column) -> Column:
    """Links show their target behind the words, unless it is the same; images their description and source; tags nothing."""
    told = F.array_join(F.filter(F.array(p["text"], p["link"]), lambda x: x != ""), " — ")
    return (
        F.when(p["kind"].isin("text", "code"), p["text"])
        .when(p["kind"].isin("soft", "break"), "\n")
        .when((p["kind"] == "close") & (p["tag"] == "a") & (p["link"] != "") & (p["link"] != p["text"]), F.concat(F.lit(" ("), p["link"], F.lit(")")))
        .when((p["kind"] == "image") & (told != ""), F.concat(F.lit("[image: "), told, F.lit("]")))
        .otherwise("")
    )


def with_inlines(found: DataFrame, shown: Callable[[Column], Column]) -> DataFrame:
    """Blocks with inline, the text of headings and paragraphs, and cells, the rows of tables, as shown says of each piece."""
    units = F.transform("pieces", lambda unit: joined(F.transform(unit, shown)))
    rows = found.withColumn("units", units)
    wide = (F.size("units") / F.greatest(F.lit(1), F.col("n_lines") - 1)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("n_lines") - 2), lambda k: F.slice("units", k * wide + 1, wide))
    return rows.withColumn("inline", F.coalesce(F.get("units", F.lit(0)), F.lit(""))).withColumn("cells", F.when(F.col("kind") == "table", cells)).drop("units", "pieces")


def table_html() -> Column:
    """thead and tbody of cells, with each column's alignment in sides."""
    rows = F.col("cells")
    aligned = lambda i: F.when(F.get("sides", i).isin("left", "center", "right"), F.concat(F.lit(' style="text-align:'), F.get("sides", i), F.lit('"'))).otherwise("")
    row = lambda r, tag: F.concat(F.lit("<tr>\n"), joined(F.transform(r, lambda c, i: F.concat(F.lit(f"<{tag}"), aligned(i), F.lit(">"), c, F.lit(f"</{tag}>\n")))), F.lit("</tr>\n"))
    body = joined(F.transform(F.slice(rows, 2, F.greatest(F.lit(0), F.size(rows) - 1)), lambda r: row(r, "td")))
    return F.concat(F.lit("<table>\n<thead>\n"), row(F.element_at(rows, 1), "th"), F.lit("</thead>\n"), F.when(F.size(rows) > 1, F.concat(F.lit("<tbody>\n"), body, F.lit("</tbody>\n"))).otherwise(""), F.lit("</table>\n"))


def block_html(raw_html: bool) -> Column:
    """HTML of a block by itself; svg is a drawn diagram."""
    level, inline = F.col("level").cast("string"), F.col("inline")
    language = F.when(F.coalesce("language", F.lit("")) == "", "").otherwise(F.concat(F.lit(' class="language-'), attribute_escape(F.col("language")), F.lit('"')))
    html = F.concat(F.col("verbatim"), F.lit("\n")) if raw_html else F.concat(F.lit("<p>"), html_escape(F.col("verbatim")), F.lit("\n</p>\n"))
    return (
        F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, F.lit(' id="'), attribute_escape(F.col("anchor")), F.lit('">'), inline, F.lit("</h"), level, F.lit(">\n")))
        .when((F.col("kind") == "code") & F.col("svg").isNotNull(), F.concat(F.lit('<figure class="diagram">'), F.col("svg"), F.lit("</figure>\n")))
        .when(F.col("kind") == "code", F.concat(F.lit("<pre><code"), language, F.lit(">"), code.highlighted(F.col("verbatim"), F.col("language")), F.lit("</code></pre>\n")))
        .when(F.col("kind") == "rule", "<hr>\n")
        .when(F.col("kind") == "table", table_html())
        .when(F.col("kind") == "html", html)
        .when(F.col("kind") == "empty", "")
        .otherwise(inline)
    )


def widest() -> Column:
    """The length of each column's widest cell."""
    return F.transform(F.element_at("cells", 1), lambda _, i: F.array_max(F.transform("cells", lambda r: grapheme_length(F.get(r, i)))))


def text_table() -> Column:
    """Columns of cells padded to their widest one (wide), two blanks apart, a rule under the header."""
    rows = F.col("cells")
    line = lambda r: F.regexp_replace(F.array_join(F.transform(r, lambda c, i: F.concat(c, F.repeat(F.lit(" "), (F.get("wide", i) - grapheme_length(c)).cast("int")))), "  "), " +$", "")
    rule = F.array_join(F.transform("wide", lambda n: F.repeat(F.lit("─"), n.cast("int"))), "  ")
    return F.array_join(F.transform(rows, lambda r, i: F.when(i == 0, F.concat(line(r), F.lit("\n"), rule)).otherwise(line(r))), "\n")


def block_text() -> Column:
    """Plain text of a block by itself, without blank lines around it."""
    inline = F.col("inline")
    rule = lambda c: F.concat(inline, F.lit("\n"), F.repeat(F.lit(c), F.greatest(F.lit(3), grapheme_length(inline)).cast("int")))
    return (
        F.when((F.col("kind") == "heading") & (F.col("level") == 1), rule("="))
        .when((F.col("kind") == "heading") & (F.col("level") == 2), rule("-"))
        .when(F.col("kind") == "code", prefixed(F.col("verbatim"), F.lit("    "), F.lit("    ")))
        .when(F.col("kind") == "rule", F.repeat(F.lit("─"), F.lit(40)))
        .when(F.col("kind") == "table", text_table())
        .otherwise(inline)
    )


def prefixed(text: Column, first: Column, rest: Column) -> Column:
    """Prefixes before the first and all other lines; empty lines stay empty."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.when(x == "", "").when(i == 0, F.concat(first, x)).otherwise(F.concat(rest, x))), "\n")


def with_neighbours(blocks: Column) -> Column:
    """Each of a document's blocks as b, with the containers it opens and those it closes, innermost first, and whether it is all its item holds."""
    ids = lambda b: F.transform(F.coalesce(b["path"], F.array().cast("array<struct<id:int,kind:string,start:bigint,nth:int,checked:boolean>>")), lambda n: n["id"])

    def one(b: Column, i: Column) -> Column:
        before, after = ids(F.get(blocks, i - 1)), ids(F.get(blocks, i + 1))
        shared = lambda others: F.size(F.array_intersect(ids(b), others))
        deep = F.size(b["path"])
        opens, closes = F.slice(b["path"], shared(before) + 1, deep), F.reverse(F.slice(b["path"], shared(after) + 1, deep))
        own = F.element_at(b["path"], -1)
        alone = F.when(deep > 0, (own["kind"] == "item") & ~F.array_contains(before, own["id"]) & ~F.array_contains(after, own["id"])).otherwise(False)
        return F.struct(b.alias("b"), opens.alias("opens"), closes.alias("closes"), alone.alias("alone"))

    return F.transform(blocks, one)


def task_lists(blocks: Column) -> Column:
    """Ids of the lists that have a box at one of their items."""
    boxed = lambda path: F.filter(F.transform(path, lambda n, i: F.when(n["checked"].isNotNull(), F.get(path, i - 1)["id"])), lambda x: x.isNotNull())
    return F.array_distinct(F.flatten(F.transform(blocks, lambda b: boxed(b["path"]))))


def container_html(n: Column) -> Column:
    box = F.when(n["checked"], '<li class="task-item"><input type="checkbox" disabled checked> ').otherwise('<li class="task-item"><input type="checkbox" disabled> ')
    return (
        F.when(n["kind"] == "quote", "<blockquote>\n")
        .when(n["kind"] == "item", F.when(n["checked"].isNull(), "<li>").otherwise(box))
        .when(n["kind"] == "ul", F.when(F.array_contains("boxed", n["id"]), '<ul class="task-list">\n').otherwise("<ul>\n"))
        .otherwise(F.when(n["start"] == 1, "<ol>\n").otherwise(F.concat(F.lit('<ol start="'), n["start"].cast("string"), F.lit('">\n'))))
    )


def ended_html(n: Column) -> Column:
    return F.when(n["kind"] == "quote", "</blockquote>\n").when(n["kind"] == "item", "</li>\n").when(n["kind"] == "ul", "</ul>\n").otherwise("</ol>\n")


def document_html(x: Column) -> Column:
    """A block among its neighbours: the only paragraph of an item stands there without a tag of its own."""
    b = x["b"]
    out = F.when(b["kind"] != "paragraph", b["out"]).when(x["alone"], b["out"]).otherwise(F.concat(F.lit("<p>"), b["out"], F.lit("</p>\n")))
    return F.concat(joined(F.transform(x["opens"], container_html)), out, joined(F.transform(x["closes"], ended_html)))


def document_text(x: Column) -> Column:
    """A block with the marks of its quotes and items before its lines, and the blank lines behind it.

    The first text of an item follows the item's mark. A block that ends its list is followed by one more blank line.
    """
    b = x["b"]
    count = lambda kind: F.size(F.filter(b["path"], lambda n: n["kind"] == kind))
    quote, deep = F.repeat(F.lit("> "), count("quote")), count("item")
    steps = lambda n: F.repeat(F.lit("   "), F.greatest(F.lit(0), n))
    held = F.filter(b["path"], lambda n: n["kind"].isin("item", "ul", "ol"))
    item, of = F.element_at(held, -1), F.get(held, F.size(held) - 2)
    mark = F.when(deep == 0, "").when(item["checked"], "[x] ").when(item["checked"].isNotNull(), "[ ] ").when(of["kind"] == "ol", F.concat((of["start"] + item["nth"]).cast("string"), F.lit(". "))).otherwise("•  ")
    bare = (b["kind"].isin("html", "empty")) | (b["out"] == "")
    lone = F.concat(quote, steps(deep - 1), F.rtrim(mark))
    first = F.when(b["leads"], F.concat(quote, steps(deep - 1), mark)).otherwise(F.concat(quote, steps(deep)))
    body = F.when(~bare, prefixed(b["out"], first, F.concat(quote, steps(deep)))).when(x["alone"] & (deep > 0), lone)
    last = F.element_at(F.filter(x["closes"], lambda n: n["kind"] != "quote"), -1)["kind"]
    ends = F.when(F.size(F.filter(x["closes"], lambda n: n["kind"] != "quote")) > 0, last.isin("ul", "ol")).otherwise(False)
    return F.when(body.isNull(), F.when(ends, "\n").otherwise("")).otherwise(F.concat(body, F.when(ends, "\n\n\n").otherwise("\n\n")))


def copies() -> Column:
    """How many rows of docs a group of blocks with ends is of."""
    return F.count_if(F.col("block").isNull()).alias("copies")


def each_copy(made: DataFrame, *columns: str) -> DataFrame:
    """A row for each of the copies of a document."""
    return made.select("doc", *columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc", *columns)


def rendered(docs: DataFrame, to: str, raw_html: bool = True, diagrams: DataFrame | None = None) -> DataFrame:
    """doc, data: docs (doc, source) as markdown, html or plain text. diagrams (source, svg) holds drawn diagrams by their source, each once."""
    if to == "markdown":
        return docs.select("doc", F.col("source").alias("data"))
    if to not in ("html", "text"):
        raise ValueError(f"unknown format {to!r}")
    found = structure(docs, RENDERED, ends=True)
    if to == "html":
        rows = with_inlines(found, lambda p: piece_html(p, raw_html)).withColumn("sides", F.when(F.col("kind") == "table", tables.alignments(F.col("verbatim"))))
        if diagrams is None:
            rows = rows.withColumn("svg", F.lit(None).cast("string"))
        else:
            drawn = diagrams.select(F.col("source").alias("verbatim"), "svg", F.lit("mermaid").alias("language"))
            rows = rows.join(drawn, ["verbatim", "language"], "left")
        parts = rows.withColumn("out", block_html(raw_html))
    else:
        rows = with_inlines(found, piece_text)
        parts = rows.withColumn("wide", F.when(F.col("kind") == "table", widest())).withColumn("out", block_text())
    shown_of = F.when(F.col("block").isNotNull(), F.struct("block", "kind", "out", "path", "leads"))
    made = parts.groupBy("doc").agg(F.array_sort(F.collect_list(shown_of)).alias("blocks"), copies())
    if to == "html":
        made = made.withColumn("boxed", task_lists(F.col("blocks")))
    shown = joined(F.transform(with_neighbours(F.col("blocks")), document_html if to == "html" else document_text))
    made = made.select("doc", shown.alias("data"), "copies")
    if to == "text":
        # blank lines at the edges go, the indent of a first code block stays
        made = made.withColumn("data", F.regexp_replace("data", r"^\n+|[\n \t]+\z", "")).withColumn("data", F.when(F.col("data") == "", "").otherwise(F.concat("data", F.lit("\n"))))
    return each_copy(made, "data")


def titles(docs: DataFrame) -> DataFrame:
    """doc, title: the first heading of docs (doc, source), else Untitled."""
    found = with_inlines(structure(docs, ("block", "kind", "n_lines", "pieces"), kinds=("heading",), to_title=True, ends=True), piece_text)
    firsts = found.groupBy("doc").agg(F.min_by("inline", F.when(F.col("inline") != "", F.col("block"))).alias("title"), copies())
    return each_copy(firsts.withColumn("title", F.coalesce("title", F.lit("Untitled"))), "title")
