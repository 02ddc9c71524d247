"""Places in documents: lines and byte columns to UTF-16 units and back, by joins on lines and sorted merges.

A line's start is found for a place by one sorted pass over the places and starts of a document, so the work grows with both
and not with what a line spans. Lines end at LF, and a CR before it is none of their content.

Cases: lines and columns out of range are held to the document; a column within a character counts as its start; in a line
without other characters than ASCII a column beyond its end runs on into the document; null places give null; documents
without rows in the index give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import utf16_length


def last_start(points: DataFrame, starts: DataFrame, kept: list[str]) -> DataFrame:
    """points (doc, at, ...) with the kept columns of the last row of starts (doc, loc, ...) at or before each; nulls where there is none."""
    marks = starts.select("doc", F.col("loc").alias("__at"), F.lit(0).alias("__turn"), F.struct("loc", *(c for c in kept if c != "loc")).alias("__start"))
    both = points.withColumns({"__at": F.col("at"), "__turn": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    upto = Window.partitionBy("doc").orderBy(F.col("__at").asc_nulls_first(), "__turn").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__start", ignorenulls=True).over(upto)).where("__turn = 1")
    return found.select(*points.columns, *(F.when(F.col("at").isNotNull(), F.col(f"__found.{c}")).alias(c) for c in kept))


def line_index(docs: DataFrame) -> DataFrame:
    """doc, line (from 1), n_lines, loc (UTF-16 units before it), length (of the document), text of docs (doc, source)."""
    rows = docs.where("source IS NOT NULL").select("doc", utf16_length(F.col("source")).alias("length"), F.posexplode(F.split("source", "\n")).alias("k", "raw"))
    before = Window.partitionBy("doc").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    loc = F.coalesce(F.sum(utf16_length(F.col("raw")) + 1).over(before), F.lit(0))
    return rows.select("doc", (F.col("k") + 1).alias("line"), F.count("*").over(Window.partitionBy("doc")).alias("n_lines"), loc.alias("loc"), "length", F.regexp_replace("raw", "\r$", "").alias("text"))


def units_before(text: Column, n_bytes: Column) -> Column:
    """UTF-16 units of the characters of a text that end within its first bytes."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), n_bytes.cast("int")), "ISO-8859-1")
    single = F.regexp_count(head, F.lit("[\x01-\x7f]|\\x00|[\xc0-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}"))
    return single + 2 * F.regexp_count(head, F.lit("[\xf0-\xf7][\x80-\xbf]{3}"))


def to_units(positions: DataFrame, index: DataFrame) -> DataFrame:
    """positions (doc, line, column, ...), both from 1 and columns in UTF-8 bytes, with unit, the place in UTF-16 units."""
    ends = index.where("line = n_lines").select("doc", F.col("n_lines").alias("__n"))
    held = positions.join(ends.hint("merge"), "doc").withColumn("__line", F.greatest(F.lit(1), F.least("line", "__n")))
    lines = index.select("doc", F.col("line").alias("__line"), "loc", "length", "text")
    n_bytes = F.greatest(F.lit(0), F.col("column") - 1)
    wide = F.octet_length("text") != utf16_length(F.col("text"))
    within = F.when(wide, units_before(F.col("text"), F.least(n_bytes, F.octet_length("text")))).otherwise(n_bytes)
    unit = F.when(F.col("column").isNotNull() & F.col("line").isNotNull(), F.least(F.col("loc") + within, F.col("length")))
    return held.join(lines.hint("merge"), ["doc", "__line"]).withColumn("unit", unit).select(*positions.columns, "unit")


def to_positions(points: DataFrame, index: DataFrame) -> DataFrame:
    """points (doc, at, ...), in UTF-16 units, with line and column (from 1, in UTF-8 bytes) and the range of their line (line_loc, line_len).

    A place within a pair of units is the pair's start; one in a line's end is behind its text.
    """
    found = last_start(points, index, ["line", "n_lines", "loc", "length", "text"])
    inside = F.least(F.greatest(F.lit(0), F.least("at", "length") - F.col("loc")), utf16_length(F.col("text")))
    # a high surrogate alone is not decoded
    head = F.encode(F.col("text"), "UTF-16BE")
    cut = F.substring(head, F.lit(1), (2 * inside).cast("int"))
    whole = F.when(F.conv(F.hex(F.substring(head, (2 * inside - 1).cast("int"), F.lit(1))), 16, 10).between(0xD8, 0xDB) & (inside > 0), F.substring(cut, F.lit(1), (2 * inside - 2).cast("int"))).otherwise(cut)
    column = F.octet_length(F.decode(whole, "UTF-16BE")) + 1
    rows = found.where("line IS NOT NULL OR at IS NULL").withColumn("column", column)
    nexts = index.select("doc", (F.col("line") - 1).alias("line"), F.col("loc").alias("next_loc"))
    ended = rows.join(nexts.hint("merge"), ["doc", "line"], "left")
    size = F.greatest(F.lit(0), F.coalesce(F.col("next_loc") - 1, F.col("length")) - F.col("loc"))
    return ended.select(*points.columns, "line", "column", F.col("loc").alias("line_loc"), size.alias("line_len"))
