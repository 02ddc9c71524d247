"""Markdown from positioned lines: heading sizes, line classes, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import escape_inline, escape_line, grapheme_length, trim_blanks

HEADING_LEVELS = 2
LARGER = 1.12
LONGEST_HEADING = 120
LEAST_SIZED = 3
#: Marks of list items: with a blank after them, or glyphs that need none. Fixed values.
BULLET = r"^(?:[•·▪◦‣–—*-] |[•·▪◦‣])(.*)$"
ORDERED = r"^(\d{1,3})[.)](?U:\s)+(.+)$"


def half_points(size: Column) -> Column:
    return F.round(size * 2) / 2


def heading_ladder(lines: DataFrame) -> DataFrame:
    """doc, size, level: the largest sizes over body size; body size covers the most characters, the smaller of equal ones."""
    sized = lines.where("size IS NOT NULL").where(trim_blanks(F.col("text")) != "").select("doc", half_points(F.col("size")).alias("size"), grapheme_length(F.col("text")).alias("chars"))
    weights = sized.groupBy("doc", "size").agg(F.sum("chars").alias("weight"), F.count("*").alias("n"))
    body = weights.groupBy("doc").agg(F.max_by("size", F.struct("weight", -F.col("size"))).alias("body"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_SIZED)
    larger = weights.join(body.select("doc", "body"), "doc").where(F.col("size") > F.col("body") * LARGER)
    return larger.select("doc", "size", F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("size"))).alias("level")).where(F.col("level") <= HEADING_LEVELS)


def classified(lines: DataFrame) -> DataFrame:
    """lines (doc, pos, text, size) with kind (blank, heading, bullet, ordered, body), level, number and content."""
    trimmed = trim_blanks(F.col("text"))
    levels = heading_ladder(lines).withColumnRenamed("size", "half")
    bullet, number = F.regexp_extract(trimmed, BULLET, 0) != "", F.regexp_extract(trimmed, ORDERED, 1)
    kind = (
        F.when(trimmed == "", "blank")
        .when(F.col("level").isNotNull() & (grapheme_length(trimmed) < LONGEST_HEADING), "heading")
        .when(bullet, "bullet")
        .when(number != "", "ordered")
        .otherwise("body")
    )
    return (
        lines.withColumn("half", half_points(F.col("size")))
        .join(levels, ["doc", "half"], "left")
        .withColumn("kind", kind)
        .withColumn("level", F.when(F.col("kind") == "heading", F.col("level")))
        .withColumn("number", F.when(F.col("kind") == "ordered", number.cast("int")))
        .withColumn("content", F.when(F.col("kind") == "bullet", trim_blanks(F.regexp_extract(trimmed, BULLET, 1))).when(F.col("kind") == "ordered", F.regexp_extract(trimmed, ORDERED, 2)).when(F.col("kind") != "blank", F.col("text")))
        .drop("half")
    )


def assembled(lines: DataFrame) -> DataFrame:
    """doc, markdown: blocks parted by empty lines.

    A body line goes on the paragraph before it unless that ends a sentence and the line does not begin in lower case; after
    a hyphen, but not a double one, it joins without a blank and the hyphen goes.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    rows = classified(lines).withColumn("out", F.when(F.col("kind") == "body", escape_line(F.col("text"))).otherwise(escape_inline(F.col("content"))))
    before = F.when(F.lag("kind").over(order) == "body", F.lag("out").over(order))
    rows = rows.withColumn("before", before)
    hyphen = F.col("before").endswith("-") & ~F.col("before").endswith("--")
    goes_on = trim_blanks(F.col("before")).rlike("[^.!?:;]$") | (trim_blanks(F.col("before")) != "") & F.col("out").rlike(r"^\p{Ll}")
    new = ~((F.col("kind") == "body") & F.coalesce(hyphen | goes_on, F.lit(False)))
    mark = F.when(F.col("kind") == "heading", F.concat(F.expr("repeat('#', level)"), F.lit(" "))).when(F.col("kind") == "bullet", "- ").when(F.col("kind") == "ordered", F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("")
    rows = (
        rows.withColumn("joins", F.coalesce(hyphen, F.lit(False)) & (F.col("kind") == "body"))
        .withColumn("block", F.sum(new.cast("int")).over(order))
        .withColumn("out", F.concat(mark, F.col("out")))
        .withColumn("cut", F.coalesce(F.lead("joins").over(order), F.lit(False)))
        .where("kind <> 'blank'")
        .withColumn("piece", F.concat(F.when(F.col("joins") | new, "").otherwise(" "), F.when(F.col("cut"), F.expr("left(out, length(out) - 1)")).otherwise(F.col("out"))))
    )
    blocks = rows.groupBy("doc", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("text"))
    blocks = blocks.withColumn("text", trim_blanks(F.col("text"))).where("text <> ''")
    return blocks.groupBy("doc").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("markdown"))
