"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts with the same set of shingles form a class, and classes are joined. MinHash signatures are cut into bands; classes
that share a band are candidates. Their MinHash values are compared step by step, and a pair is dropped as soon as the
posterior probability, under a uniform prior, that its similarity reaches the threshold falls below TOLERANCE. Pairs that
survive connect classes into clusters; in a cluster every pair is compared in the same way and what survives is verified on
the whole sets of shingles.

No pair is written out. A bucket's survivors give a spanning forest, a cluster gives link counts and a forest. Buckets and
clusters are cut into blocks, each pair of blocks a group of its own, so the largest bucket is shared out among many tasks.

Cases: null texts and texts without words link with nothing and are their own class; texts with fewer words than a shingle
have one shingle of all of them; rows with equal sets of shingles are copies and link with each other; ties for a class's
document go to the smallest id, then a fixed hash of the row; a null id never names a class unless all are null; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import map_groups, slices, stage
from folioflow.llm.components import connected_components
from folioflow.llm.embedding_dedup import forest
from folioflow.llm.shingles import shingle_sets

WIDTH = 5
THRESHOLD = Fraction(4, 5)
HASHES = 128
#: 25 bands of 5 values find a pair at the threshold with probability 0.99995.
BANDS, ROWS = 25, 5
#: MinHash values that buckets compare; clusters compare all.
BUCKET_HASHES = 64
STEP = 16
TOLERANCE = 1e-7
#: Classes of a block of a bucket; classes and shingles of a block of a cluster.
BUCKET_BLOCK = 1024
CLUSTER_BLOCK = 512
CLUSTER_SHINGLES = 1_000_000

_random = np.random.default_rng(20240229)
FACTORS = (_random.integers(1, 1 << 31, HASHES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
ADDENDS = _random.integers(0, 1 << 32, HASHES).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES MinHash values, each kept as 16 mixed bits."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[at : at + 1024, None] * FACTORS[None, :] + ADDENDS[None, :]).min(axis=0), out=low)
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (low >> np.uint32(16)).astype("<u2")


def least_matches(threshold: Fraction, tolerance: float = TOLERANCE) -> dict[int, int]:
    """By number of values compared: the fewest matches at which the threshold is still likely enough.

    With a uniform prior, the similarity given m matches of n is Beta(m + 1, n - m + 1); the chance that it is t or more is
    the chance of at most m successes in n + 1 trials of probability t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        below, m, t = 0.0, -1, float(threshold)
        while below < tolerance:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def likely(left: np.ndarray, right: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs of signatures, row by row, survive the step-by-step comparison."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int32)
    for n in range(STEP, left.shape[1] + 1, STEP):
        matches[alive] += (left[alive, n - STEP : n] == right[alive, n - STEP : n]).sum(axis=1)
        alive = alive[matches[alive] >= least[n]]
        if not len(alive):
            break
    return alive


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_col)


def sign(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row a document: its set's fingerprint (h1, h2; null without words), size and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text").to_pylist(), width)
                prints = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist() if len(s) else [None, None] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("row"), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "row", "h1", "h2", "n", "sig"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, h1 long, h2 long, n long, sig binary")


def band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    factors = np.random.default_rng(17).integers(1, 1 << 62, ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)[:, : BANDS * ROWS]
        keys = (sig.reshape(-1, BANDS, ROWS).astype(np.uint64) * factors).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], names=["bucket", "node"])


def bucket_links(group: pa.Table, least: dict[int, int]) -> pa.Table | None:
    """A spanning forest of a bucket's surviving pairs: each class reached is compared with those not reached yet."""
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u2").reshape(len(group), -1)
    node, links, rest = group.column("node").to_numpy(), [], np.arange(len(group))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            near = likely(np.broadcast_to(sig[i], (len(rest), sig.shape[1])), sig[rest], least)
            links += [(node[i], node[j]) for j in rest[near].tolist()]
            todo += rest[near].tolist()
            rest = np.delete(rest, near)
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())}) if links else None


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets: by matrix products over the shingles where the pairs are many."""
    if len(i) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    everywhere = int((df == len(sets)).sum())
    useful = (df[column] > 1) & (df[column] < len(sets))
    owner, column = owner[useful], column[useful]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.unique(column[order], return_inverse=True)[1]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        block = np.zeros((len(sets), 4096), np.float32)
        block[owner[a:b], column[a:b] - at] = 1
        total += block @ block.T
    return total[i, j].astype(np.int64) + everywhere


def cluster_links(group: pa.Table, threshold: Fraction, least: dict[int, int]) -> pa.Table | None:
    """Link counts of the classes in a pair of a cluster's blocks, and a spanning forest of their verified links."""
    h = group.column("node").to_pylist()
    a, b = group.column("a")[0].as_py(), group.column("b")[0].as_py()
    first = {k: at for at, k in reversed(list(enumerate(h)))}  # a document that stands there twice counts once
    rows = np.array(sorted(first.values()))
    side, copies = group.column("block").to_numpy()[rows], group.column("copies").to_numpy()[rows]
    sig = np.frombuffer(b"".join(group.column("sig").take(pa.array(rows)).to_pylist()), "<u2").reshape(len(rows), -1)
    column = group.column("shingles").combine_chunks()
    flat, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    sets = [flat[ends[r] : ends[r + 1]] for r in rows.tolist()]
    sizes = np.array([len(s) for s in sets], np.int64)
    left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
    i_parts, j_parts = [], []
    for i in left.tolist():
        others = right[right > i] if a == b else right
        others = others[np.minimum(sizes[others], sizes[i]) * threshold.denominator >= np.maximum(sizes[others], sizes[i]) * threshold.numerator]
        others = others[likely(np.broadcast_to(sig[i], (len(others), HASHES)), sig[others], least)]
        i_parts.append(np.full(len(others), i))
        j_parts.append(others)
    i, j = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (i_parts, j_parts))
    if not len(i):
        return None
    common = intersections(sets, i, j)
    real = common * threshold.denominator >= (sizes[i] + sizes[j] - common) * threshold.numerator
    i, j = i[real], j[real]
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, i, copies[j])
    np.add.at(links, j, copies[i])
    root = forest(i, j, len(rows))
    hit, tree = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(rows)))
    node = np.array([h[r] for r in rows.tolist()], np.int64)
    none = lambda n: pa.nulls(n, pa.int64())
    return pa.concat_tables([
        pa.table({"node": node[hit], "links": links[hit], "p": none(len(hit)), "q": none(len(hit))}),
        pa.table({"node": none(len(tree)), "links": none(len(tree)), "p": node[tree], "q": node[root[tree]]}),
    ])


def paired(df: DataFrame, blocks: str, block: Column) -> DataFrame:
    """Deal rows into blocks, and each row to all pairs of blocks that hold its own: columns block, a, b."""
    each = F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b")))
    return df.withColumn("block", block.cast("int")).withColumn("pair", F.explode(each)).withColumn("a", F.col("pair.a")).withColumn("b", F.col("pair.b")).drop("pair")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: Fraction = THRESHOLD) -> DataFrame:
    """For every row: doc_id, n_links, class_id (the least id of its component), kept, and row (a hash of id and text)."""
    signed = stage(sign(docs, id_col, text_col, width), "signatures")
    # a class is a set of shingles, told by two hashes; its number, written with it, stands for it from here on
    classes = stage(
        signed.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")).select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "least_id", "best.row", "copies", "n", "sig"),
        "shingle-classes",
    )
    least = least_matches(threshold)
    buckets = classes.select("node", "sig").mapInArrow(band_keys, "bucket long, node long")
    # what many rows share a key with is staged first: a join of two plain shuffles is one that Spark can split where it is skewed
    shared = stage(buckets.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket", F.ceil(F.col("m") / BUCKET_BLOCK).cast("int").alias("blocks")), "shared-buckets")
    meeting = buckets.join(shared, "bucket").groupBy("node").agg(F.collect_list(F.struct("bucket", "blocks")).alias("buckets"))
    candidates = (
        meeting.join(classes.select("node", F.substring("sig", 1, 2 * BUCKET_HASHES).alias("sig")), "node")
        .select("node", "sig", F.explode("buckets").alias("in"))
        .select("node", "sig", "in.bucket", "in.blocks")
    )
    dealt = paired(candidates, "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")))
    survivors = map_groups(dealt.select("bucket", "a", "b", "node", "sig"), ["bucket", "a", "b"], lambda g: bucket_links(g, least), "a long, b long")
    clusters = stage(connected_components(survivors), "clusters")
    inside = stage(classes.join(clusters, "node"), "clustered")
    sizes = inside.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / CLUSTER_BLOCK), F.ceil(F.sum("n") / CLUSTER_SHINGLES)).cast("int").alias("blocks"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text").to_pylist(), width)
                prints = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8").tolist() for s in sets]
                mine = np.array([p == [x, y] for p, x, y in zip(prints, batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)], bool)
                flat = [s.view(np.int64) for s, m in zip(sets, mine.tolist(), strict=True) if m]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in flat])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(pa.array(mine)) for c in ("component", "node", "copies", "sig", "blocks")), lists], names=["component", "node", "copies", "sig", "blocks", "shingles"])

    texts = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    members = inside.join(sizes, "component").select("component", "node", "h1", "h2", "copies", "sig", "blocks", "row").join(texts, "row")
    sets = members.mapInArrow(spread, "component long, node long, copies long, sig binary, blocks int, shingles array<long>")
    grouped = paired(sets, "blocks", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))).drop("blocks")
    found = stage(map_groups(grouped, ["component", "a", "b"], lambda g: cluster_links(g, threshold, least), "node long, links long, p long, q long"), "jaccard-links")
    links = found.where("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("outer_links"))
    groups = connected_components(found.where("p IS NOT NULL").select(F.col("p").alias("a"), F.col("q").alias("b")))
    placed = inside.select("node", "least_id", "row", "copies").join(groups, "node").join(links, "node", "left")
    heads = placed.groupBy("component").agg(F.min("least_id").alias("class_id"), F.min(F.struct(F.col("least_id").isNull(), "least_id", "row")).alias("best"))
    linked = placed.join(heads, "component").select("node", "outer_links", "class_id", F.col("best.row").alias("head"))
    told = stage(
        classes.select("node", "h1", "h2", "least_id", "row", "copies")
        .join(linked, "node", "left")
        .select("h1", "h2", (F.col("copies") - 1 + F.coalesce("outer_links", F.lit(0))).alias("links"), F.when(F.col("head").isNull(), F.col("least_id")).otherwise(F.col("class_id")).alias("of"), F.coalesce("head", "row").alias("head")),
        "told-classes",
    )
    return (
        signed.select("doc_id", "row", "h1", "h2")
        .join(told, ["h1", "h2"], "left")
        .select("doc_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("of")).alias("class_id"), F.coalesce(F.col("row") == F.col("head"), F.lit(True)).alias("kept"), "row")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component.

    Rows of one id and one text, told by two hashes, are one document; of these the row of the least hash stays. Rows are never
    lost to a hash that they share with others: one too many may stay then.
    """
    kept = jaccard_groups(docs, id_col, text_col).where("kept").select(F.col("row").alias("__row")).distinct()
    rest = [f.name for f in docs.schema.fields if f.name not in (id_col, text_col) and "map<" not in f.dataType.simpleString()]
    keyed = docs.select(row_key(id_col, text_col).alias("__row"), F.xxhash64(F.lit(1), id_col, text_col).alias("__again"), F.struct("*").alias("__all"), F.xxhash64(F.lit(2), *(F.col(f"`{c}`") for c in rest)).alias("__rest"))
    one = keyed.join(kept, "__row").groupBy("__row", "__again").agg(F.min_by("__all", "__rest").alias("__all"))
    return one.select("__all.*")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * shared.n >= 4 * (x.n + y.n - shared.n)),
reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT node, min(other) AS other FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(d.doc_id, coalesce(other, d.doc_id)) AS class_id, d.doc_id = least(d.doc_id, coalesce(other, d.doc_id)) AS kept
FROM documents d LEFT JOIN counts ON d.doc_id = counts.a LEFT JOIN least ON d.doc_id = least.node
"""
