"""Lines from recognised text fragments: rows of overlapping fragments, and blank lines where rows stand apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAME_ROW = 0.5
BLANK_GAP = 0.9


def fragment_rows(fragments: DataFrame) -> DataFrame:
    """doc, row, text, and the union of the boxes, for fragments (doc, frag, text, x, y, w, h; origin at the bottom left).

    From top to bottom, a fragment stays on the row of the one before it if their middles are closer than half the greater
    height; within a row fragments go from left to right.
    """
    order = Window.partitionBy("doc").orderBy(F.desc("middle"), "x", "frag")
    near = F.abs(F.lag("middle").over(order) - F.col("middle")) < F.greatest(F.lag("h").over(order), F.col("h")) * SAME_ROW
    placed = fragments.withColumn("middle", F.col("y") + F.col("h") / 2).withColumn("new", (~F.coalesce(near, F.lit(False))).cast("int"))
    rows = placed.withColumn("row", F.sum("new").over(order))
    return rows.groupBy("doc", "row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "frag", "text"))), lambda f: f["text"]), " ").alias("text"),
        F.min("x").alias("left"), F.min("y").alias("bottom"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("top"),
    )


def fragment_lines(fragments: DataFrame) -> DataFrame:
    """doc, row, blank_before, text: a blank line where the gap to the row above exceeds 0.9 of the upper median height."""
    rows = fragment_rows(fragments)
    height = F.element_at(F.array_sort(F.collect_list(F.col("top") - F.col("bottom"))), (F.floor(F.count("*") / 2) + 1).cast("int"))
    medians = rows.groupBy("doc").agg(height.alias("median"))
    gap = F.lag("bottom").over(Window.partitionBy("doc").orderBy("row")) - F.col("top")
    return rows.join(medians.hint("merge"), "doc").select("doc", "row", F.coalesce((F.col("median") > 0) & (gap > F.col("median") * BLANK_GAP), F.lit(False)).alias("blank_before"), "text")


def dominant_runs(runs: DataFrame) -> DataFrame:
    """doc, line, size, is_bold from runs (doc, line, size, bold, chars): the size of most characters (the smaller of equal
    ones), and bold where more than half of them are."""
    by_size = runs.groupBy("doc", "line", "size").agg(F.sum("chars").alias("n"), F.sum(F.when(F.col("bold"), F.col("chars")).otherwise(0)).alias("b"))
    return by_size.groupBy("doc", "line").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("size"), (F.sum("b") * 2 > F.sum("n")).alias("is_bold"))
