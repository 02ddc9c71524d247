"""Running heads: short lines at the edges of pages that repeat on most pages of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import grapheme_length, normalized_line, trim_blanks

LEAST_PAGES = 3
LONGEST_HEAD = 80
SHARE_OF_PAGES = 0.6


def without_running_heads(lines: DataFrame) -> DataFrame:
    """lines (doc, page, pos, text) without running heads, and an empty line (pos null) after each page.

    Only the first and last non-empty line of a page can be a head, and only where they differ; documents of fewer than
    LEAST_PAGES pages keep all lines. Everything is grouped by document and normalised line; no page meets another.
    """
    page = Window.partitionBy("doc", "page")
    full = trim_blanks(F.col("text")) != ""
    edged = (
        lines.withColumn("first", F.min(F.when(full, F.col("pos"))).over(page))
        .withColumn("last", F.max(F.when(full, F.col("pos"))).over(page))
        .withColumn("edge", F.col("first").isNotNull() & (F.col("first") != F.col("last")) & F.col("pos").isin(F.col("first"), F.col("last")))
        .withColumn("norm", normalized_line(F.col("text")))
    )
    pages = lines.select("doc", "page").distinct()
    counted = pages.groupBy("doc").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    heads = (
        edged.where("edge AND norm <> ''")
        .where(grapheme_length(trim_blanks(F.col("text"))) <= LONGEST_HEAD)
        .select("doc", "page", "norm")
        .distinct()
        .groupBy("doc", "norm")
        .agg(F.count("*").alias("n"))
        .join(counted, "doc")
        .where(F.col("n") >= F.greatest(F.lit(2), F.round(F.col("pages") * SHARE_OF_PAGES)))
        .select("doc", "norm", F.lit(True).alias("edge"))
    )
    kept = edged.join(heads, ["doc", "norm", "edge"], "left_anti").select("doc", "page", "pos", "text")
    return kept.unionByName(pages.select("doc", "page", F.lit(None).cast("int").alias("pos"), F.lit("").alias("text")))


def with_recognized(lines: DataFrame, recognized: DataFrame) -> DataFrame:
    """lines (doc, page, pos, text, ...) with the recognized lines of pages that have no text of their own in their place."""
    written = lines.groupBy("doc", "page").agg(F.max(F.trim("text") != "").alias("written")).where("written").select("doc", "page")
    return lines.join(written, ["doc", "page"], "left_semi").unionByName(recognized.join(written, ["doc", "page"], "left_anti"), allowMissingColumns=True)


def checked_text(docs: DataFrame, made: DataFrame) -> DataFrame:
    """docs (doc) with made's markdown, or the error noTextFound where it has none but white space."""
    found = docs.select("doc").join(made.select("doc", "markdown"), "doc", "left")
    empty = F.coalesce(F.regexp_replace("markdown", r"\s", ""), F.lit("")) == ""
    return found.select("doc", F.when(~empty, F.col("markdown")).alias("markdown"), F.when(empty, "noTextFound").alias("error_code"))
