"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by the pattern of sources they belong to. Words flow from patterns to the sources' quotas: a
pattern's first pass over its documents costs nothing, each further pass one more, so costs are convex and repeats come
last. The network holds one node for each pattern and source, whatever the number of documents. Patterns that share no source,
not even by way of others, don't touch each other's flows: the network falls into its connected parts, and each is solved by
itself, in a task. A part of one source has a closed form and needs none, so any number of sources that no document
shares is a grouped sum. Then each pattern's documents are taken in a seeded order, whole, until its flow is met.

Targets fill like water: the level at which sources take their weight's share, those that reach their most are set aside and the
level rises, until none does. Each round is a grouped sum over the sources.

Cases: a null or empty text has size 0 and nothing is taken of it; null sources form one source, last in order; rows with
one id and text share a place in the order and are taken alike, each of them counts; documents without any source are not taken (target null); an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from folioflow.llm.common import stage
from folioflow.llm.components import connected_components
from folioflow.llm.merkle_manifest import ranked

WORD = r"[^\x20\x09-\x0D]+"
#: Fineness of the seeded order's histogram; only the one bucket where a pattern's flow ends is ordered row by row.
BUCKETS = 4096


def source_targets(sources: DataFrame, weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """sources (nth, size) with target and quota: weights repeat by nth and share a multiple of all sizes; no target is over most times its size, the excess is reshared.

    Sums by weight come to the driver, never a source; levels are exact fractions.
    """
    turn = (F.col("nth") % len(weights)).cast("int")
    total = int(sources.agg(F.coalesce(F.sum(F.col("size").cast("decimal(38,0)")), F.lit(0))).first()[0])
    limits, targets = [0] * len(weights), [Fraction(0)] * len(weights)
    limit_of = lambda: F.element_at(F.array(*map(F.lit, limits)), turn + 1)
    while True:
        # sources below their limit are set aside with all they may have
        aside = F.col("size") < limit_of()
        sums = sources.groupBy(turn.alias("turn")).agg(F.sum(F.when(aside, F.col("size").cast("decimal(38,0)")).otherwise(0)).alias("held"), F.count_if(~aside).alias("open")).collect()
        weight = sum(weights[r.turn] * r.open for r in sums)
        if not weight:
            break
        level = (share * total - sum(most * int(r.held) for r in sums)) / weight
        targets = [level * w for w in weights]
        after = [max(old, -(-t.numerator // (t.denominator * most))) for t, old in zip(targets, limits, strict=True)]
        if after == limits:
            break
        limits = after
    shares = F.element_at(F.array(*(F.lit(float(t)) for t in targets)), turn + 1)
    rounded = F.element_at(F.array(*(F.lit(round(t)).cast("long") for t in targets)), turn + 1)
    aside = F.col("size") < limit_of()
    return sources.withColumn("target", F.when(aside, (most * F.col("size")).cast("double")).otherwise(shares)).withColumn("quota", F.when(aside, most * F.col("size")).otherwise(rounded))


def route(patterns: Sequence[tuple[int, Sequence[int]]], quotas: Sequence[int], passes: int) -> list[dict[int, int]]:
    """Words that each pattern (size, sources) gives each source: a flow that fills the quotas as far as possible at least cost.

    Costs lie on the arcs into the patterns only, so a path costs what its first arc costs: passes are opened in turn, and
    within a pass any maximum flow is cheapest. Each is found by shortest augmenting paths.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(s, 0) for _, s in patterns]
    into: list[list[int]] = [[] for _ in quotas]
    for p, (_, sources) in enumerate(patterns):
        for s in sources:
            into[s].append(p)
    free = list(quotas)
    for _ in range(passes):
        left = [size for size, _ in patterns]
        for p, (_, sources) in enumerate(patterns):
            for s in sources:
                n = min(left[p], free[s])
                flow[p][s] += n
                left[p] -= n
                free[s] -= n
        while path := augmenting(patterns, flow, into, left, free):
            start, steps, end = path
            n = min([left[start], free[end], *(flow[p][s] for _, s, p in steps)])
            p = start
            for _, s, back in steps:
                flow[p][s] += n
                flow[back][s] -= n
                p = back
            flow[p][end] += n
            left[start] -= n
            free[end] -= n
    return flow


def augmenting(patterns: Sequence[tuple[int, Sequence[int]]], flow: list[dict[int, int]], into: list[list[int]], left: list[int], free: list[int]) -> tuple[int, list[tuple[int, int, int]], int] | None:
    """A shortest path from a pattern with words left, by way of patterns that give way, to a source with room."""
    came: dict[int, tuple[int, int, int] | None] = {p: None for p, n in enumerate(left) if n}
    queue, seen = deque(came), set()
    while queue:
        p = queue.popleft()
        for s in patterns[p][1]:
            if free[s]:
                steps, at = [], p
                while came[at] is not None:
                    steps.append(came[at])
                    at = came[at][0]
                return at, steps[::-1], s
            if s in seen:
                continue
            seen.add(s)
            for q in into[s]:
                if q not in came and flow[q][s]:
                    came[q] = (p, s, q)
                    queue.append(q)
    return None


def patterned(docs: DataFrame, members: str, id_col: str, text_col: str, seed: int) -> DataFrame:
    """docs with __size, __members, __pattern, __place (the seeded order's key, hexadecimal) and __bucket (its first digits)."""
    names = F.array_sort(F.array_distinct(F.coalesce(F.expr(members), F.array().cast("array<string>"))))
    return (
        docs.withColumn("__size", F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn("__members", names)
        .withColumn("__pattern", F.concat_ws("\x01", F.transform("__members", lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("-")))))
        .withColumn("__place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(text_col))))
        .withColumn("__bucket", F.conv(F.substring("__place", 1, 3), 16, 10).cast("int"))
    )


def numbered_sources(patterns: DataFrame) -> DataFrame:
    """source and its number in the order of code points, null last (nth), with its size; from patterns (members, size)."""
    told = patterns.select(F.explode("members").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("size"))
    # null sorts last
    keyed = told.select(F.lit("").alias("tree"), F.col("source").isNull().alias("none"), "source", "size")
    return ranked(keyed, ["none", "source"], "mix-sources").select("source", F.col("pos").alias("nth"), "size")


def pattern_flows(patterns: DataFrame, sources: DataFrame, passes: int) -> DataFrame:
    """__pattern, size, flow, source_size and target (of its first source) for patterns (__pattern, members, size).

    Connected parts of several sources are solved in a task each: a row a pattern, and the quotas of its sources.
    """
    arcs = patterns.select("__pattern", "size", F.size("members").alias("several"), F.posexplode("members").alias("at", "source"))
    named = sources.select(F.col("source").alias("name"), "nth", F.col("size").alias("source_size"), "target", "quota")
    held = stage(arcs.join(named, F.col("source").eqNullSafe(F.col("name"))).select("__pattern", "size", "several", "at", "nth", "quota", "source_size", "target"), "mix-arcs")
    firsts = held.where("at = 0").select("__pattern", "size", "source_size", "target", "several", "nth", "quota")
    joint = held.where("several > 1")
    if joint.isEmpty():
        return firsts.select("__pattern", "size", F.least("quota", passes * F.col("size")).alias("flow"), "source_size", "target")
    first = joint.where("at = 0").select("__pattern", F.col("nth").alias("a"))
    parts = stage(connected_components(joint.where("at > 0").select("__pattern", F.col("nth").alias("b")).join(first, "__pattern").select("a", "b").distinct()), "mix-parts")
    linked = held.join(parts, F.col("nth") == F.col("node")).select("component", "__pattern", "size", "at", "nth", "quota")

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(rows["nth"].unique().tolist())
        place, quotas = {s: i for i, s in enumerate(names)}, [0] * len(names)
        for s, q in zip(rows["nth"], rows["quota"], strict=True):
            quotas[place[s]] = int(q)
        found = [(p, int(g["size"].iloc[0]), [place[s] for s in g.sort_values("at")["nth"]]) for p, g in rows.sort_values("__pattern").groupby("__pattern", sort=True)]
        flows = route([(n, members) for _, n, members in found], quotas, passes)
        return pd.DataFrame({"__pattern": [p for p, *_ in found], "__flow": [sum(f.values()) for f in flows]})

    joined = linked.groupBy("component").applyInPandas(solve, "__pattern string, __flow long")
    alone = F.least("quota", passes * F.col("size"))
    return firsts.join(joined, "__pattern", "left").select("__pattern", "size", F.coalesce("__flow", alone).alias("flow"), "source_size", "target")


def with_cuts(sized: DataFrame, flows: DataFrame) -> DataFrame:
    """flows with the passes that all documents of a pattern make (__passes), and the last place in the order that makes one more (__last).

    Documents make flow // size passes, and one more as long as the running total stays nearest the rest. A histogram of
    the order finds the bucket where the rest ends; only its rows are summed one by one.
    """
    plan = flows.where("size > 0").select("__pattern", "source_size", "target", F.expr("flow div size").alias("__passes"), F.expr("flow % size").alias("__rest"))
    upto = Window.partitionBy("__pattern").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    words = sized.groupBy("__pattern", "__bucket").agg(F.sum("__size").alias("__words")).withColumn("__before", F.coalesce(F.sum("__words").over(upto), F.lit(0)))
    rests = plan.select("__pattern", "__rest")
    edge = words.join(rests, "__pattern").where("__before <= __rest AND __rest < __before + __words").select("__pattern", F.col("__bucket").alias("__end"), "__before", "__rest")
    edge = stage(edge, "mix-edges")
    inside = Window.partitionBy("__pattern").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        sized.join(edge, (sized["__pattern"] == edge["__pattern"]) & (F.col("__bucket") == F.col("__end")))
        .groupBy(edge["__pattern"], "__place", "__before", "__rest")
        .agg(F.sum("__size").alias("__words"))
        .withColumn("__run", F.col("__before") + F.coalesce(F.sum("__words").over(inside), F.lit(0)))
        .where("2 * __run + __words <= 2 * __rest")
        .groupBy("__pattern")
        .agg(F.max("__place").alias("__found"))
    )
    # where no row of the last bucket fits, the order's last place is the end of the bucket before
    ends = edge.select("__pattern", "__end").join(last, "__pattern", "left").select("__pattern", F.coalesce("__found", F.lower(F.lpad(F.hex("__end"), 3, "0"))).alias("__last"))
    rest = flows.where("size = 0").select("__pattern", "source_size", "target", F.lit(0).cast("long").alias("__passes"), F.lit("").alias("__last"))
    return plan.join(ends, "__pattern", "left").select("__pattern", "source_size", "target", "__passes", F.coalesce("__last", F.lit("")).alias("__last")).unionByName(rest)


def plan_mix(docs: DataFrame, members: str, id_col: str, text_col: str, weights: Sequence[int], share: Fraction, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The patterns' plan (a row a pattern), and the documents' sizes as staged."""
    given = docs.select(F.col(id_col), F.col(text_col), F.expr(members).alias("__given"))
    sized = stage(patterned(given, "__given", id_col, text_col, seed).select(F.col(id_col).alias("doc_id"), "__size", "__members", "__pattern", "__place", "__bucket"), "mix-sizes")
    patterns = stage(sized.groupBy("__pattern").agg(F.first("__members").alias("members"), F.sum("__size").alias("size")), "mix-patterns")
    sources = stage(source_targets(numbered_sources(patterns), weights, share, most), "mix-targets")
    flows = stage(pattern_flows(patterns.where(F.size("members") > 0), sources, most), "mix-flows")
    none = patterns.where(F.size("members") == 0).select("__pattern", F.lit(None).cast("long").alias("source_size"), F.lit(None).cast("double").alias("target"), F.lit(0).cast("long").alias("__passes"), F.lit("").alias("__last"))
    return stage(with_cuts(sized, flows).unionByName(none), "mix-plan"), sized


#: How often a document is taken, from its pattern's plan.
COPIES = "CASE WHEN __size = 0 THEN 0 ELSE __passes + CAST(__place <= __last AS INT) END"


def mix(docs: DataFrame, members: str = "array(source)", id_col: str = "doc_id", text_col: str = "text", weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 0) -> DataFrame:
    """Mix documents to weighted targets; members is an SQL expression for the array of sources a document belongs to.

    Returns doc_id, size, source_size and target (of its first source), taken.
    """
    plan, sized = plan_mix(docs, members, id_col, text_col, weights, share, most, seed)
    return sized.join(plan, "__pattern").select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.expr(COPIES)).alias("taken"))


def mixed_documents(docs: DataFrame, members: str = "array(source)", id_col: str = "doc_id", text_col: str = "text", weights: Sequence[int] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 0) -> DataFrame:
    """The mix itself: docs with each document as often as it is taken."""
    plan, _ = plan_mix(docs, members, id_col, text_col, weights, share, most, seed)
    # the rows travel as one column, so that none of theirs is taken for one of ours
    rows = docs.select(F.struct("*").alias("__all"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.expr(members).alias("__given"))
    told = patterned(rows, "__given", "__id", "__text", seed).join(plan.drop("source_size", "target"), "__pattern")
    return told.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.expr(COPIES).cast("int")))).select("__all.*")


#: The mix of `documents` by source. Targets fill like water: sources are capped in the order of twice their size by weight.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(concat_ws(':', '0', CAST(doc_id AS VARCHAR), md5(text))) AS place,
    CAST(coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, size, [5, 2, 1][i % 3 + 1] AS w FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS size, CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS BIGINT) AS i FROM sized GROUP BY source)),
filling AS (
  SELECT *, 2.0e0 * size / w AS r, (1.5e0 * sum(size) OVER () - coalesce(sum(2 * size) OVER before, 0)) / sum(w) OVER onwards AS level FROM sources
  WINDOW before AS (ORDER BY 2.0e0 * size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), onwards AS (ORDER BY 2.0e0 * size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
water AS (SELECT min(r) AS r, arg_min(level, r) AS level FROM filling WHERE level <= r),
targets AS (SELECT source, f.size AS source_size, least(coalesce(water.level * w, 2 * f.size), 2.0e0 * f.size) AS target FROM filling f, water),
flows AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(round(target) AS BIGINT) // source_size END AS passes, CASE WHEN source_size = 0 THEN 0 ELSE CAST(round(target) AS BIGINT) % source_size END AS rest FROM targets),
places AS (SELECT source, place, sum(size) AS words FROM sized GROUP BY source, place),
runs AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM places)
SELECT d.doc_id, d.size, f.source_size, round(f.target, 6) AS target, CAST(d.size * (f.passes + CASE WHEN 2 * r.run + r.words <= 2 * f.rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN flows f ON d.source IS NOT DISTINCT FROM f.source JOIN runs r ON r.source IS NOT DISTINCT FROM d.source AND r.place = d.place
"""
