"""Pipe tables: cells, alignments, widths and grid lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import geometry
from folioflow.functions.text import grapheme_length

#: A pipe that no backslash escapes.
PIPE = r"(?<!\\)\|"


def alignments(line: Column) -> Column:
    """none, left, right or center for each column of a separator line; null if it isn't one."""
    body = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    cells = F.transform(F.split(body, r"\|"), lambda x: F.trim(x))
    sound = line.rlike(r"^[|:\- ]+$") & F.forall(cells, lambda x: x.rlike("^:?-+:?$"))
    kind = lambda x: F.when(x.startswith(":") & x.endswith(":"), "center").when(x.startswith(":"), "left").when(x.endswith(":"), "right").otherwise("none")
    return F.when(sound, F.transform(cells, kind))


def cells(line: Column) -> Column:
    """Trimmed cells; empty ones at the edges, before a first and after a last pipe, are none."""
    parts = F.transform(F.split(line, PIPE), lambda x: F.regexp_replace(x, r"^[ \t]+|[ \t]+$", ""))
    return F.filter(parts, lambda x, i: (x != "") | ((i > 0) & (i < F.size(parts) - 1)))


def table_cells(lines: DataFrame) -> DataFrame:
    """doc, row, col, text, alignment, is_header for lines (doc, pos, text) of which the second is a separator."""
    order = Window.partitionBy("doc").orderBy("pos")
    found = lines.withColumn("row", F.row_number().over(order) - 1)
    heads = found.where("row = 1").select("doc", alignments(F.col("text")).alias("kinds")).where("kinds IS NOT NULL")
    # Spark takes exploded rows for as few as those they come from, and would send them to the driver
    rows = found.where("row <> 1").join(heads.hint("merge"), "doc").select("doc", F.when(F.col("row") > 1, F.col("row") - 1).otherwise(0).alias("row"), "kinds", F.posexplode(cells(F.col("text"))).alias("col", "text"))
    return rows.select("doc", "row", "col", "text", F.coalesce(F.get("kinds", "col"), F.lit("none")).alias("alignment"), (F.col("row") == 0).alias("is_header"))


def column_boundaries(found: DataFrame, unit: float = 8.0, available: float = 720.0) -> DataFrame:
    """doc, col, width, boundary, scale of table_cells: the widest cell and its gutter, summed up to the guard.

    The grid takes the first scale at which the table fits.
    """
    widths = found.groupBy("doc", "col").agg(F.max(grapheme_length(F.col("text"))).alias("chars")).withColumn("natural", F.col("chars") * unit + geometry.GUTTER)
    whole = widths.withColumn("scale", geometry.grid_scale(F.sum("natural").over(Window.partitionBy("doc")), F.lit(available)))
    width = F.col("chars") * unit * F.col("scale") + geometry.GUTTER
    upto = Window.partitionBy("doc").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return whole.withColumn("width", width).select("doc", "col", "chars", "width", F.least(F.lit(geometry.GRID_WIDTH), F.sum("width").over(upto)).alias("boundary"), "scale")


def delimiter_targets(lines: DataFrame, boundaries: DataFrame) -> DataFrame:
    """doc, pos, loc, boundary for each pipe of lines (doc, pos, text): where it ends in the grid of column_boundaries.

    loc counts from the start of the line. The first pipe of a row that opens with one stands at 0; pipes beyond the grid have none.
    """
    parts = lines.select("doc", "pos", F.col("text"), F.posexplode(F.split("text", PIPE)).alias("k", "part"))
    row = Window.partitionBy("doc", "pos").orderBy("k")
    pipes = (
        parts.withColumn("loc", F.sum(F.length("part") + 1).over(row) - 1)
        .withColumn("opens", F.trim(F.first("part").over(row)) == "")
        .withColumn("last", F.lead("k").over(row).isNull())
        .where("NOT last")
        .withColumn("at", F.col("k") + F.when(F.col("opens"), 0).otherwise(1))
    )
    edges = boundaries.select("doc", (F.col("col") + 1).alias("at"), "boundary").unionByName(boundaries.select("doc", F.lit(0).alias("at"), F.lit(0.0).alias("boundary")).distinct())
    return pipes.join(edges.hint("merge"), ["doc", "at"]).select("doc", "pos", "loc", "boundary")


def text_tables(found: DataFrame) -> DataFrame:
    """doc, text of table_cells: columns padded to their widest cell, two blanks apart, a rule under the header."""
    size = grapheme_length(F.col("text"))
    wide = found.withColumn("size", size).withColumn("wide", F.max("size").over(Window.partitionBy("doc", "col")))
    padded = F.concat("text", F.expr("repeat(' ', cast(wide - size as int))"))
    rows = wide.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct("col", padded.alias("cell"), "wide"))).alias("cells"))
    line = F.regexp_replace(F.array_join(F.transform("cells", lambda c: c["cell"]), "  "), " +$", "")
    rule = F.array_join(F.transform("cells", lambda c: F.array_join(F.array_repeat(F.lit("─"), c["wide"].cast("int")), "")), "  ")
    lines = rows.withColumn("line", F.when(F.col("row") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line))
    return lines.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))
