"""Interval joins within documents: what a selection touches, what is concealed, painted or visible.

Ranges are (doc, loc, len) in whole units. Whether a range meets any other is told by a sweep: both sides of a document
are sorted together, and the furthest end so far is kept, so the work grows with the ranges and not with their pairs.
Pairs are joined by document and stretch of units. Null documents, places and lengths meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Units of a stretch, by which points and ranges are joined.
STRETCH = 256


def _met(ranges: DataFrame, others: DataFrame, until: Column, inclusive: bool = False) -> DataFrame:
    """ranges with __met: whether another one of the document starts before `until` (or at it) and ends after loc (or at it)."""
    spots = others.where("doc IS NOT NULL AND loc IS NOT NULL AND len IS NOT NULL").select(
        "doc", F.col("loc").alias("__at"), F.lit(0 if inclusive else 2).alias("__turn"), (F.col("loc") + F.col("len")).alias("__end")
    )
    both = ranges.withColumns({"__at": until, "__turn": F.lit(1)}).unionByName(spots, allowMissingColumns=True)
    before = Window.partitionBy("doc").orderBy("__at", "__turn").rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.max("__end").over(before)
    met = furthest >= F.col("loc") if inclusive else furthest > F.col("loc")
    known = F.col("doc").isNotNull() & F.col("__at").isNotNull()
    return both.withColumn("__met", F.coalesce(known & met, F.lit(False))).where("__turn = 1").select(*ranges.columns, "__met")


def _end() -> Column:
    return F.col("loc") + F.col("len")


def active_blocks(blocks: DataFrame, selections: DataFrame) -> DataFrame:
    """Inclusive: blocks that share a unit with a selection or meet one at an end."""
    return _met(blocks, selections, _end(), inclusive=True).where("__met").drop("__met")


def overlapping(ranges: DataFrame, others: DataFrame) -> DataFrame:
    """Strict: ranges that start before another's end and end after its start."""
    return _met(ranges, others, _end()).where("__met").drop("__met")


def not_overlapping(ranges: DataFrame, others: DataFrame) -> DataFrame:
    return _met(ranges, others, _end()).where("NOT __met").drop("__met")


def concealed_markers(markers: DataFrame, active: DataFrame) -> DataFrame:
    """Hidden markers that no active block overlaps and whose start lies in none; an empty marker counts as one unit for that."""
    until = F.col("loc") + F.when(F.col("len") > 1, F.col("len")).otherwise(1)
    return _met(markers.where("presentation = 'hidden'"), active, until).where("NOT __met").drop("__met")


def painted_markers(markers: DataFrame, active: DataFrame) -> DataFrame:
    return not_overlapping(markers.where("presentation IN ('bullet', 'checkbox')"), active)


def clamped(loc: Column, length: Column, total: Column) -> tuple[Column, Column]:
    """A range held to a text of total units."""
    at = F.least(F.greatest(loc, F.lit(0)), total)
    return at, F.least(length, total - at)


def concealed_set(hidden: DataFrame, pipes: DataFrame, separators: DataFrame, artworks: DataFrame) -> DataFrame:
    """doc, loc, len of what an editor hides: markers but those at pipes, tables' separator lines, and artworks from their second unit on.

    All have doc, loc and len. What two of them hide stands there twice; empty ranges are dropped.
    """
    kept = hidden.join(pipes.select("doc", "loc").distinct(), ["doc", "loc"], "left_anti").select("doc", "loc", "len")
    tails = artworks.where("len > 1").select("doc", (F.col("loc") + 1).alias("loc"), (F.col("len") - 1).alias("len"))
    return kept.unionByName(separators.select("doc", "loc", "len")).unionByName(tails).where("len > 0")


def first_holding(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each point (doc, at) with the first range (range_loc, range_len) that holds it or ends at it."""
    reached = ranges.select("doc", "loc", (F.col("len") + 1).alias("len"))
    found = containing(points, reached).groupBy("doc", "at").agg(F.min(F.struct("range_loc", "range_len")).alias("r"))
    return found.select("doc", "at", "r.range_loc", (F.col("r.range_len") - 1).alias("range_len"))


def trait_unions(spans: DataFrame) -> DataFrame:
    """doc, loc, traits: the bits of all spans (doc, loc, traits) that begin at a place, united."""
    return spans.groupBy("doc", "loc").agg(F.bit_or("traits").alias("traits"))


def segments(spans: DataFrame, bits: int = 5) -> DataFrame:
    """doc, loc, len, traits: spans (doc, loc, len, traits) cut at every place where one begins or ends, with the bits of all that cover a piece.

    A sweep counts each bit's open spans over a document's places, so overlapping spans are never paired. Pieces that no bit
    covers are left out, and so are empty spans and nulls.
    """
    kept = spans.where("len > 0 AND doc IS NOT NULL AND loc IS NOT NULL AND traits IS NOT NULL")
    edges = kept.select("doc", "traits", F.explode(F.array(F.struct(F.col("loc").alias("at"), F.lit(1).alias("step")), F.struct(_end().alias("at"), F.lit(-1).alias("step")))).alias("e"))
    steps = [F.sum(F.col("e.step") * F.shiftright("traits", b).bitwiseAND(1)).alias(f"__{b}") for b in range(bits)]
    places = edges.groupBy("doc", F.col("e.at").alias("loc")).agg(*steps)
    order = Window.partitionBy("doc").orderBy("loc")
    open_bits = [F.when(F.sum(f"__{b}").over(order) > 0, F.lit(1 << b)).otherwise(0) for b in range(bits)]
    traits = open_bits[0]
    for x in open_bits[1:]:
        traits = traits + x
    return places.select("doc", "loc", (F.lead("loc").over(order) - F.col("loc")).alias("len"), traits.alias("traits")).where("traits > 0")


def touched(selections: DataFrame, layout: DataFrame) -> DataFrame:
    """selections (doc, loc, len, ...) with each block (block_loc, block_len) of layout (doc, loc, len) that shares a unit with one or meets it at an end.

    Both are joined by document and the stretches they reach into; a pair is told in the first stretch that holds both.
    """
    stretch = lambda x: F.floor(x / STRETCH)
    spread = lambda df: df.withColumn("__stretch", F.explode(F.sequence(stretch(F.col("loc")), stretch(_end()))))
    blocks = spread(layout.where("loc IS NOT NULL AND len >= 0").select("doc", "loc", "len").distinct()).select("doc", "__stretch", F.col("loc").alias("block_loc"), F.col("len").alias("block_len"))
    pairs = spread(selections.where("loc IS NOT NULL AND len >= 0")).join(blocks, ["doc", "__stretch"])
    met = (F.col("block_loc") <= _end()) & (F.col("block_loc") + F.col("block_len") >= F.col("loc"))
    first = F.col("__stretch") == F.greatest(stretch(F.col("loc")), stretch(F.col("block_loc")))
    return pairs.where(met & first).drop("__stretch")


def reveal_changes(selections: DataFrame, layout: DataFrame) -> DataFrame:
    """doc, seq, loc, len, change (1 or -1): the blocks that become active, and those that no longer are, with each selection (doc, seq, loc, len).

    A block enters where the selection before doesn't touch it, and leaves with the first one that doesn't, if there is one.
    `streaming.reveal` does the same for a stream. Changes up to a selection, added up, are its active blocks.
    """
    order = Window.partitionBy("doc").orderBy("seq")
    ranked = selections.select("doc", "seq", "loc", "len", F.row_number().over(order).alias("nth"))
    by_block = Window.partitionBy("doc", "block_loc", "block_len").orderBy("nth")
    near = lambda c, step: F.coalesce(c.over(by_block) == F.col("nth") + step, F.lit(False))
    active = touched(ranked, layout).withColumns({"goes_on": near(F.lag("nth"), -1), "stays": near(F.lead("nth"), 1)})
    enters = active.where("NOT goes_on").select("doc", "seq", F.col("block_loc").alias("loc"), F.col("block_len").alias("len"), F.lit(1).alias("change"))
    nexts = ranked.select("doc", F.col("nth").alias("left_at"), F.col("seq").alias("left_seq"))
    leaves = active.where("NOT stays").withColumn("left_at", F.col("nth") + 1).join(nexts, ["doc", "left_at"])
    return enters.unionByName(leaves.select("doc", F.col("left_seq").alias("seq"), F.col("block_loc").alias("loc"), F.col("block_len").alias("len"), F.lit(-1).alias("change")))


def in_order(spans: DataFrame) -> DataFrame:
    """spans (doc, loc, len) without those that begin before the end of an earlier one."""
    before = Window.partitionBy("doc").orderBy("loc", "len").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("__end", F.coalesce(F.max(_end()).over(before), F.lit(0))).where("loc >= __end").drop("__end")


def containing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each point (doc, at) with the range (range_loc, range_len) that holds it."""
    stretch = lambda x: F.floor(x / STRETCH)
    held = ranges.where("len > 0").withColumn("stretch", F.explode(F.sequence(stretch(F.col("loc")), stretch(_end() - 1))))
    inside = (F.col("p.at") >= F.col("r.loc")) & (F.col("p.at") < F.col("r.loc") + F.col("r.len"))
    same = (F.col("p.doc") == F.col("r.doc")) & (stretch(F.col("p.at")) == F.col("r.stretch"))
    return points.alias("p").join(held.alias("r"), same & inside).select("p.*", F.col("r.loc").alias("range_loc"), F.col("r.len").alias("range_len"))
