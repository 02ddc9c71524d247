"""Markdown as relations: lines, blocks, outline and markers, by line rules, windows and one fold of fences.

Blocks are found line by line: fences, headings (also underlined ones), rules, quotes, list items, tables, raw HTML and
paragraphs. A line of text goes on with the item, quote, table or HTML before it until a blank line. Blocks within items and
quotes are not followed: these are the flat blocks of an editor's lines. `structure` follows them.

A window by document holds one document's lines; no step gathers more than a document's fence lines in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import slug, unique_anchors, utf16_length

FENCE = r"^ {0,3}(`{3,}|~{3,})[ \t]*([^` \t]*)[^`]*$"
ITEM = r"^([ \t]*)([-*+]|\d{1,9}[.)])(?:[ \t]+(?:\[([ xX])\][ \t]+)?(.*))?$"
SEPARATOR = r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$"
HEADING = r"^ {0,3}(#{1,6})(?:[ \t]|$)"
RULE = r"^ {0,3}(?:-[ \t]*-[ \t]*-[- \t]*|\*[ \t]*\*[ \t]*\*[* \t]*|_[ \t]*_[ \t]*_[_ \t]*)$"
UNDERLINE = r"^ {0,3}(=+|-+)[ \t]*$"
QUOTE = r"^((?: {0,3}> ?)+)"
HTML = r"^ {0,3}</?[A-Za-z!]"
#: How deep items are nested by their indents.
LEVELS = 8


def source_lines(docs: DataFrame) -> DataFrame:
    """doc, pos, loc (UTF-16 offset of the line), len, text of docs (doc, source); line ends are LF or CRLF."""
    rows = docs.select("doc", F.posexplode(F.split("source", "\n")).alias("pos", "raw"))
    before = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    text = F.regexp_replace("raw", "\r$", "")
    return rows.select("doc", "pos", F.coalesce(F.sum(utf16_length(F.col("raw")) + 1).over(before), F.lit(0)).alias("loc"), utf16_length(text).alias("len"), text.alias("text"))


def fence_roles(lines: DataFrame) -> DataFrame:
    """lines with role: open or close where a fence begins or ends, else null.

    A fence ends with the next line of its own mark, as long at least, that names no language. A document's fence lines are
    folded in order; the state is the open mark and a letter for each line so far.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    mark = F.regexp_extract("text", FENCE, 1)
    shown = lines.withColumn("mark", mark).withColumn("nth", F.sum((mark != "").cast("int")).over(order))
    found = shown.where("mark <> ''").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "mark", (F.regexp_extract("text", FENCE, 2) == "").alias("bare")))).alias("fences"))

    def step(state: Column, x: Column) -> Column:
        is_open = state["mark"] != ""
        closes = is_open & x["bare"] & F.startswith(x["mark"], state["mark"])
        return F.struct(
            F.when(~is_open, x["mark"]).when(closes, "").otherwise(state["mark"]).alias("mark"),
            F.concat(state["roles"], F.when(~is_open, "o").when(closes, "c").otherwise("-")).alias("roles"),
        )

    roles = found.select("doc", F.aggregate("fences", F.struct(F.lit("").alias("mark"), F.lit("").alias("roles")), step)["roles"].alias("roles"))
    letter = F.when(F.col("mark") != "", F.substring(F.col("roles"), F.col("nth").cast("int"), F.lit(1)))
    return shown.join(roles.hint("merge"), "doc", "left").withColumn("role", F.when(letter == "o", "open").when(letter == "c", "close")).drop("mark", "nth", "roles")


def line_kinds(lines: DataFrame) -> DataFrame:
    """lines with kind, level, language, quote_depth, item parts, the number of the block they belong to, and whether a quote goes on from the line before."""
    order = Window.partitionBy("doc").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    text = F.col("text")
    inside = F.sum((F.col("role") == "open").cast("int")).over(order) > F.coalesce(F.sum((F.col("role") == "close").cast("int")).over(before), F.lit(0))
    rows = fence_roles(lines).withColumn("inside", F.coalesce(inside, F.lit(False)))
    following = F.lead("text").over(order)
    # a head has as many cells as its separator; pipes at the edges and escaped ones part none
    cells = lambda x: F.size(F.split(F.regexp_replace(F.trim(F.replace(x, F.lit("\\|"), F.lit(""))), r"^\||\|$", ""), r"\|"))
    heads_table = text.contains("|") & ~text.rlike(SEPARATOR) & F.coalesce(following.rlike(SEPARATOR) & following.contains("|") & (cells(text) == cells(following)), F.lit(False))
    first = (
        F.when(F.col("inside"), "code")
        .when(text.rlike(r"^[ \t]*$"), "blank")
        .when(text.rlike(HEADING), "heading")
        .when(text.rlike(RULE), "rule")
        .when(text.rlike(QUOTE), "quote")
        .when(text.rlike(ITEM), "item")
        .when(heads_table, "table")
        .when(text.rlike(HTML), "html")
        .otherwise("paragraph")
    )
    rows = rows.withColumn("first_kind", first)
    # a line of text goes on with what began before it
    last = F.last(F.when(F.col("first_kind") != "paragraph", F.col("first_kind")), ignorenulls=True).over(before)
    rows = rows.withColumn("lazy", (F.col("first_kind") == "paragraph") & F.coalesce(last.isin("item", "quote", "table", "html"), F.lit(False)))
    rows = rows.withColumn("resolved", F.when(F.col("lazy"), last).otherwise(F.col("first_kind")))
    under = text.rlike(UNDERLINE) & (F.lag("resolved").over(order) == "paragraph") & ~F.col("inside")
    rows = rows.withColumn("kind", F.when(F.coalesce(under, F.lit(False)), "underline").otherwise(F.col("resolved")))
    depth = F.when((F.col("kind") == "quote") & ~F.col("lazy"), F.length(F.regexp_replace(F.regexp_extract("text", QUOTE, 1), "[^>]", ""))).otherwise(0)
    quoted = F.regexp_replace("text", QUOTE, "")
    unindented = F.regexp_replace("text", r"^[ \t]+", "")
    item = lambda k: F.when((F.col("kind") == "item") & ~F.col("lazy"), F.regexp_extract("text", ITEM, k))
    content = (
        F.when((F.col("kind") == "item") & ~F.col("lazy"), item(4))
        .when((F.col("kind") == "quote") & ~F.col("lazy"), quoted)
        .when(F.col("kind") == "heading", F.regexp_replace("text", r"^ {0,3}#+[ \t]*|[ \t]+#*[ \t]*$", ""))
        .when(F.col("lazy") & (F.col("kind") != "html") | (F.col("kind") == "paragraph"), unindented)
        .otherwise(text)
    )
    rows = rows.withColumn("quote_depth", depth).withColumn("content", content)
    prior = lambda c: F.lag(c).over(order)
    goes_on = (
        F.when(F.col("kind") == "underline", True)
        .when(F.col("kind") != prior("kind"), False)
        .when(F.col("kind") == "code", (F.coalesce("role", F.lit("")) != "open") & (F.coalesce(prior("role"), F.lit("")) != "close"))
        .when(F.col("kind") == "quote", F.col("lazy") | (F.col("quote_depth") == prior("quote_depth")) & (F.trim("content") != "") & (F.trim(prior("content")) != ""))
        .when(F.col("kind") == "item", F.col("lazy"))
        .otherwise(F.col("kind").isin("table", "html", "paragraph"))
    )
    return (
        rows.withColumn("block", F.sum((~F.coalesce(goes_on, F.lit(False))).cast("int")).over(order))
        .withColumn("quote_goes_on", F.coalesce((F.col("kind") == "quote") & (prior("kind") == "quote"), F.lit(False)))
        .withColumn("level", F.when(F.col("kind") == "heading", F.length(F.regexp_extract("text", HEADING, 1))).when(F.col("kind") == "underline", F.when(text.contains("="), 1).otherwise(2)))
        .withColumn("language", F.when(F.col("role") == "open", F.lower(F.regexp_extract("text", FENCE, 2))))
        .withColumn("indent", F.length(item(1)))
        .withColumn("marker", item(2))
        .withColumn("checked", F.when(item(3) != "", item(3) != " "))
        .drop("inside", "first_kind", "resolved")
    )


def blocks(docs: DataFrame) -> DataFrame:
    """doc, block, kind, level, language, loc, len, quote_depth, quote_goes_on, indent, is_item_start, marker, checked, n_lines, text."""
    rows = line_kinds(source_lines(docs)).where("kind <> 'blank'")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role").isNull() & (F.col("kind") != "underline"), F.struct("pos", "content")))), lambda x: x["content"]), "\n")
    kind = F.when(F.max(F.col("kind") == "underline"), "heading").otherwise(F.min("kind"))
    return (
        rows.groupBy("doc", "block")
        .agg(
            kind.alias("kind"), F.max("level").alias("level"), F.max("language").alias("language"), F.min("loc").alias("loc"), (F.max(F.col("loc") + F.col("len")) - F.min("loc")).alias("len"),
            F.max("quote_depth").alias("quote_depth"), F.min_by("quote_goes_on", "pos").alias("quote_goes_on"), F.max("indent").alias("indent"), (F.min("kind") == "item").alias("is_item_start"),
            F.max("marker").alias("marker"), F.max("checked").alias("checked"), F.count("*").alias("n_lines"), F.when(F.min("kind") == "code", body).otherwise(F.regexp_replace(body, r"[ \t]+\z", "")).alias("text"),
        )
    )


def with_anchors(heads: DataFrame) -> DataFrame:
    """heads (doc, loc, title, ...) with ord and anchor, unique within a document.

    The n-th heading of a slug is numbered by a window. Only where two of a document's anchors would be the same, as `a-2` may
    be a title too, are they given out one by one.
    """
    rows = heads.withColumn("slug", slug(F.col("title")))
    nth = F.row_number().over(Window.partitionBy("doc", "slug").orderBy("loc"))
    numbered = rows.withColumn("nth", nth).withColumn("anchor", F.when(F.col("nth") > 1, F.concat("slug", F.lit("-"), F.col("nth").cast("string"))).when(F.col("slug") == "", "section").otherwise(F.col("slug")))
    gathered = numbered.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("loc", "slug", "anchor", F.struct(*(c for c in heads.columns if c not in ("doc", "loc"))).alias("head")))).alias("heads"))
    named = F.transform("heads", lambda h: h["anchor"])
    told = gathered.withColumn("anchors", F.when(F.size(F.array_distinct(named)) < F.size("heads"), unique_anchors(F.transform("heads", lambda h: h["slug"]))).otherwise(named))
    return told.select("doc", "anchors", F.posexplode("heads").alias("ord", "h")).select("doc", "h.loc", "ord", F.get("anchors", "ord").alias("anchor"), "h.head.*")


def outline(found: DataFrame) -> DataFrame:
    """doc, ord, level, title, anchor, loc of the headings of blocks that have a title."""
    heads = found.where("kind = 'heading' AND text <> ''").select("doc", "loc", "level", F.col("text").alias("title"))
    return with_anchors(heads).select("doc", "ord", "level", "title", "anchor", "loc")


def markers(docs: DataFrame) -> DataFrame:
    """doc, loc, len, presentation of the marks at lines: hidden (#, >, fence lines, underlines), bullet, checkbox, dimmed (numbers).

    A task's bullet is hidden up to its box; none is empty.
    """
    rows = line_kinds(source_lines(docs)).where("kind IN ('heading', 'underline', 'quote', 'item') AND NOT lazy OR role IS NOT NULL")
    lead = (
        F.when(F.col("role").isNotNull() | (F.col("kind") == "underline"), F.col("text"))
        .when(F.col("kind") == "heading", F.regexp_extract("text", r"^( {0,3}#+[ \t]*)", 1))
        .when(F.col("kind") == "quote", F.regexp_extract("text", QUOTE, 1))
        .otherwise(F.regexp_extract("text", r"^([ \t]*(?:[-*+]|\d{1,9}[.)])(?:[ \t]|$))", 1))
    )
    box = F.regexp_extract("text", r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(\[[ xX]\])", 1)
    prefix = F.regexp_extract("text", r"^([ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+)\[[ xX]\]", 1)
    is_item, part = F.col("kind") == "item", lambda loc, n, shown: F.struct(loc.cast("long").alias("loc"), n.cast("long").alias("len"), F.lit(shown).alias("presentation"))
    size = utf16_length(lead)
    found = (
        F.when(is_item & F.col("checked").isNotNull(), F.array(part(F.col("loc"), F.length(prefix), "hidden"), part(F.col("loc") + F.length(prefix), F.length(box), "checkbox")))
        .when(is_item & F.col("marker").rlike("^[0-9]"), F.array(part(F.col("loc"), size, "dimmed")))
        .when(is_item, F.array(part(F.col("loc"), size, "bullet")))
        .otherwise(F.array(part(F.col("loc"), size, "hidden")))
    )
    return rows.select("doc", F.explode(found).alias("m")).select("doc", "m.loc", "m.len", "m.presentation").where("len > 0")


def with_lists(found: DataFrame) -> DataFrame:
    """blocks with the structure of lists: depth, next_depth, run_ends, new_list, lists (mark of the open list at each depth), start, nth, any_box.

    A run is a row of items without another block between them. An item stands one deeper for every two blanks more than the
    run's first, LEVELS at most. A list goes on while its mark (-, *, +, . or )) stays.
    """
    order = Window.partitionBy("doc").orderBy("block")
    item = F.col("kind") == "item"
    starts = item & F.coalesce(F.lag("kind").over(order) != "item", F.lit(True))
    rows = found.withColumn("is_item", item).withColumn("run", F.sum(starts.cast("int")).over(order))
    run = Window.partitionBy("doc", "run", "is_item").orderBy("block")
    depth = F.least(F.lit(LEVELS), F.greatest(F.lit(1), F.floor((F.col("indent") - F.first("indent").over(run)) / 2).cast("int") + 1))
    rows = rows.withColumn("depth", F.when(item, depth)).withColumn("mark", F.substring("marker", -1, 1))
    upto = [F.last(F.when(F.col("depth") == k, F.col("mark")), ignorenulls=True).over(run) for k in range(1, LEVELS + 1)]
    rows = rows.withColumn("lists", F.array(*(F.coalesce(x, F.lit("-")) for x in upto)))
    last_depth, last_lists = F.coalesce(F.lag("depth").over(run), F.lit(0)), F.lag("lists").over(run)
    rows = rows.withColumn("last_depth", last_depth).withColumn("last_lists", last_lists)
    new = (F.col("depth") > F.col("last_depth")) | (F.element_at("last_lists", F.col("depth")) != F.col("mark"))
    rows = rows.withColumn("new_list", F.when(F.col("is_item"), new)).withColumn("next_depth", F.coalesce(F.lead("depth").over(run), F.lit(0)))
    rows = rows.withColumn("next_new", F.lead("new_list").over(run))
    level = Window.partitionBy("doc", "run", "is_item", "depth").orderBy("block")
    rows = rows.withColumn("list_id", F.sum(F.col("new_list").cast("int")).over(level))
    one = Window.partitionBy("doc", "run", "is_item", "depth", "list_id")
    number = F.regexp_extract("marker", r"^(\d+)", 1).try_cast("long")
    return (
        rows.withColumn("start", F.first(number).over(one.orderBy("block")))
        .withColumn("nth", F.row_number().over(one.orderBy("block")) - 1)
        .withColumn("any_box", F.max(F.col("checked").isNotNull()).over(one))
    )
