"""Quality classification by hierarchical empirical Bayes.

A document's evidence is a sum of log likelihood ratios, counted by grouped sums over all labelled rows: of its surface
features, in bins, and of the words and pairs of words that it holds, hashed to GRAM_CELLS cells, whose sum is divided by the
root of their number. It is then calibrated by the labels that each interval of it holds. A labelled row is scored by ratios
that its own fold of FOLDS took no part in, so calibration and figures over labelled rows are held out.

Each host and each path of a host has a posterior rate of good documents: its labels, and for other documents the
classifier's probability, shrunk towards the level above - a path towards its host, a host towards all - by prior weights
that the spread between hosts and between paths sets (method of moments). The quality of a document is its path's odds times
its evidence. A document's own label or probability is taken out of the sums of its path and host first, so its evidence
counts once.

All statistics are grouped sums over all rows; what comes to the driver is a row for each fold and bin or cell.

Cases: null and empty texts have features of their own (no words); a null host or path counts as the empty one; labels
that are null teach nothing, several labels of a document count by their mean; without any label all evidence is neutral;
repeated rows count each and are judged alike; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import slices, stage
from folioflow.llm.shingles import mixed, word_hashes

#: Bins of a feature at most.
BINS = 24
FEATURES = ("words", "distinct", "length", "symbols", "upper", "digits", "repeats", "top")
#: Intervals of calibration, in units of the log ratio.
REACH = 20
#: Pseudo-counts of each bin and interval.
SMOOTHING = 1.0
SALTS = 16
#: Cells that words and pairs of words are hashed to, and folds of labelled rows.
GRAM_CELLS = 1 << 14
FOLDS = 5
#: Labels, of some 16 bytes each, that are sent to every executor at most; more of them are joined by a shuffle.
BROADCAST_LABELS = 500_000
_kind = np.zeros(256, np.int64)
_kind[[ord(c) for c in "!\"#$%&()*+/:;<=>?@[\\]^_`{|}~"]] = 1
_kind[ord("A") : ord("Z") + 1] = 2
_kind[ord("0") : ord("9") + 1] = 3


def features(text: str | None) -> list[int]:
    """A bin for each of FEATURES."""
    words = (text or "").split()
    if not words:
        return [0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_kind[raw], minlength=4) / len(raw)
    n, seen = len(words), {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    share = lambda x, scale: min(BINS - 1, int(x * scale))
    return [
        min(BINS - 1, n.bit_length()),
        share(len(seen) / n, 10),
        min(BINS - 1, round(len(text) / n)),
        share(kinds[1], 100),
        share(kinds[2], 40),
        share(kinds[3], 60),
        share(sum(map(str.__eq__, words[1:], words)) / n, 30),
        share(max(seen.values()) / n, 30),
    ]


def gram_cells(texts: list[str | None]) -> list[np.ndarray]:
    """The cells of each text's words and pairs of neighbouring words, each once."""
    hashes, counts = word_hashes(texts)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    pairs = mixed(hashes[:-1] * np.uint64(3) + hashes[1:])
    whole = row[1:] == row[:-1]
    cell = np.concatenate([hashes, pairs[whole]]) >> np.uint64(64 - (GRAM_CELLS - 1).bit_length())
    keys = np.unique(np.concatenate([row, row[:-1][whole]]) * GRAM_CELLS + cell.astype(np.int64))
    return np.split(keys % GRAM_CELLS, np.searchsorted(keys, np.arange(1, len(texts)) * GRAM_CELLS))


def places(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Indexes into a row of ratios: of each text's surface bins, and of its cells."""
    surface = np.array([features(t) for t in texts], np.int64).reshape(-1, len(FEATURES)) + np.arange(len(FEATURES)) * BINS
    return surface, [c + len(FEATURES) * BINS for c in gram_cells(texts)]


def counted(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Good and bad labelled rows by fold and place; the last place counts the rows themselves. docs has doc_id, fold and text."""
    width = len(FEATURES) * BINS + GRAM_CELLS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, FOLDS, width))
        for whole in batches:
            for batch in slices(whole, "text"):
                surface, grams = places(batch.column("text").to_pylist())
                for fold, label, a, b in zip(batch.column("fold").to_pylist(), batch.column("label").to_pylist(), surface, grams, strict=True):
                    at = np.concatenate([a, b, [width - 1]])
                    sums[0, fold, at] += label
                    sums[1, fold, at] += 1 - label
        fold, place = np.nonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(fold.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(sums[0, fold, place]), pa.array(sums[1, fold, place])], names=["fold", "place", "good", "bad"])

    rows = docs.join(labels, "doc_id").select("fold", "label", "text").mapInArrow(run, "fold int, place int, good double, bad double")
    good, bad = np.zeros((FOLDS, width)), np.zeros((FOLDS, width))
    for r in rows.groupBy("fold", "place").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect():
        good[r["fold"], r["place"]], bad[r["fold"], r["place"]] = r["good"], r["bad"]
    return good, bad


def place_ratios(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log likelihood ratios by place: a row for each fold, of all other folds, and one of all."""
    rows = []
    for k in range(FOLDS + 1):
        others = [f for f in range(FOLDS) if f != k]
        g, b = good[others].sum(axis=0), bad[others].sum(axis=0)
        rows.append(np.log(g[:-1] + SMOOTHING) - np.log(b[:-1] + SMOOTHING))
        # a surface feature has one of BINS bins, a cell is there or not
        for part, kinds in ((slice(0, len(FEATURES) * BINS), BINS), (slice(len(FEATURES) * BINS, None), 2)):
            rows[-1][part] -= math.log(g[-1] + SMOOTHING * kinds) - math.log(b[-1] + SMOOTHING * kinds)
    return np.array(rows)


def featured(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, host, path, and the log ratio of every whole text: by the rows outside its fold, and by all."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                surface, grams = places(batch.column("text").to_pylist())
                told = []
                for fold, a, b in zip(batch.column("fold").to_pylist(), surface, grams, strict=True):
                    told.append([float(table[k][a].sum() + table[k][b].sum() / math.sqrt(max(1, len(b)))) for k in (fold, FOLDS)])
                x = np.array(told).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "host", "path")), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["doc_id", "host", "path", "held", "whole"])

    return docs.mapInArrow(run, "doc_id long, host string, path string, held double, whole double")


def log_ratios(counts: dict[tuple[int, int], tuple[float, float]], groups: int, width: int) -> list[list[float]]:
    """Smoothed log likelihood ratios of each group's bins."""
    out = []
    for g in range(groups):
        good, bad = (sum(c[k] for (h, _), c in counts.items() if h == g) + SMOOTHING * width for k in (0, 1))
        out.append([math.log((counts.get((g, b), (0, 0))[0] + SMOOTHING) / good) - math.log((counts.get((g, b), (0, 0))[1] + SMOOTHING) / bad) for b in range(width)])
    return out


def looked_up(ratios: list[list[float]], bins: Column) -> Column:
    """Sum of the ratios of a row's bins."""
    table = F.lit([x for row in ratios for x in row])
    at = F.transform(bins, lambda b, i: F.element_at(table, i * len(ratios[0]) + b + 1))
    return F.aggregate(at, F.lit(0.0), lambda a, x: a + x)


def spread_weight(mean: Column, n: Column, centre: Column, groups: DataFrame) -> float:
    """The prior weight that explains how much the groups' means differ from their centres, by the method of moments."""
    r = groups.select(mean.alias("m"), n.alias("n"), centre.alias("c")).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("c"), 2)).alias("ss"), F.sum(F.col("c") * (1 - F.col("c"))).alias("noise"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.avg(F.col("c") * (1 - F.col("c"))).alias("v")).first()
    if not r["all"] or not r["v"]:
        return 1.0
    free = r["all"] - r["nn"] / r["all"]
    between = (r["ss"] - r["noise"]) / free if free > 0 else 0.0
    return min(1e6, max(1.0, r["v"] / between - 1)) if between > 0 else 1e6


def logit(p: Column) -> Column:
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(held / (1 - held))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, evidence (log ratio), host_rate and path_rate without the row's own share, quality (posterior probability) and keep of every row of docs."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    told = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg(F.col("quality").cast("double")).alias("label"))
    if told.count() <= BROADCAST_LABELS:
        told = F.broadcast(told)
    fold = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(FOLDS)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col("text")).withColumn("fold", fold)
    ratios = place_ratios(*counted(texts.select("doc_id", "fold", "text"), told))
    rows = stage(featured(texts, ratios).join(told, "doc_id", "left").withColumn("raw", F.when(F.col("label").isNotNull(), F.col("held")).otherwise(F.col("whole"))), "quality-features")
    scored = rows.withColumn("interval", (F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH - 1), F.col("raw")))) + REACH).cast("int"))
    held = scored.where("label IS NOT NULL").groupBy("interval").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect()
    calibrated = log_ratios({(0, r["interval"]): (r["good"], r["bad"]) for r in held}, 1, 2 * REACH)
    good, bad = sum(r["good"] for r in held), sum(r["bad"] for r in held)
    base = (good + 1) / (good + bad + 2)
    judged = scored.withColumn("evidence", looked_up(calibrated, F.array("interval"))).withColumn("rate", F.coalesce("label", sigmoid(F.col("evidence") + math.log(base / (1 - base)))))
    paths = stage(judged.groupBy("host", "path").agg(F.sum("rate").alias("s"), F.count("*").cast("double").alias("n")), "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    whole = hosts.agg(F.sum("hs").alias("s"), F.sum("hn").alias("n")).first()
    centre = whole["s"] / whole["n"] if whole["n"] else base
    weight = spread_weight(F.col("hs") / F.col("hn"), F.col("hn"), F.lit(centre), hosts)
    shrunk = hosts.select("host", "hs", "hn", ((F.col("hs") + weight * centre) / (F.col("hn") + weight)).alias("host_rate"))
    sites = paths.join(shrunk, "host")
    deeper = spread_weight(F.col("s") / F.col("n"), F.col("n"), F.col("host_rate"), sites)
    sums = sites.select("host", "path", "hs", "hn", "s", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own_host = (F.col("hs") - F.col("rate") + weight * centre) / (F.col("hn") - 1 + weight)
    own_path = (F.col("s") - F.col("rate") + deeper * F.col("host_rate")) / (F.col("n") - 1 + deeper)
    return (
        judged.withColumn("salt", F.pmod(F.xxhash64("doc_id", "raw"), F.lit(SALTS)).cast("int"))
        .join(sums, ["host", "path", "salt"])
        .withColumn("host_rate", own_host)
        .withColumn("path_rate", own_path)
        .withColumn("quality", sigmoid(F.col("evidence") + logit(F.col("path_rate"))))
        .select("doc_id", "evidence", "host_rate", "path_rate", "quality", (F.col("quality") >= threshold).alias("keep"))
    )
