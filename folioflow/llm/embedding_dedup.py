"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative a group.

Equal vectors are first folded into one with a count. Centroids are fitted on a sample of at most SAMPLE vectors. Their
number is the one, of several that follow the square root of the number of vectors, that asks for the least work by what half of
the sample says of the other half: vectors in clusters are parted into many small cells that hardly meet, vectors that
lie evenly into few. Every vector is at home in the cell of its nearest centroid. So that no link between two cells is lost, a vector is also a guest of each cell of lower number that could hold a
partner. Two bounds say which: a vector x of cell A with centroid A is no nearer to another centroid B, so a partner y at home
in B has y.(B - A) / |B - A| <= sqrt(1 - t^2) at the threshold t; and x is within the cell's radius of A, so the angle of y
and A is at most that radius and acos(t). Results are thus exact whatever the centroids; good ones only mean fewer guests.
Cells that follow each other share a group, to which a guest travels once however many of its cells it could have partners in.
Groups are cut into blocks of bounded size, and every pair of blocks is a product, in double precision, of each cell's vectors and
those that could have partners there. A product
returns link counts a vector and a spanning forest of its links, never the pairs, and components follow from the forests.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors link only
with those of their own length; a null id gives a null component, is kept, and joins no components of others; rows that
repeat an id count as vectors of their own; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import map_groups, stage
from folioflow.llm.components import connected_components

THRESHOLD = 0.9
#: Vectors that the centroids are fitted on, and their values, at most about; and the least number of them a centroid.
SAMPLE, SAMPLE_VALUES, SAMPLED_BY_CELL = 16_384, 1_000_000, 8
#: Cells by the square root of the number of vectors at least, and the multiples of it that are weighed up; bounded, so that
#: centroids stay small.
CELLS_BY_ROOT = 1 / 8
MULTIPLES = (1, 2, 4, 8, 16)
MAX_CELLS = 4096
MAX_CENTROID_VALUES = 4_000_000
#: Nanoseconds that a vector's value takes to be shuffled, and to be multiplied, and that a vector's bounds for a cell take, about: only their ratios count.
SHUFFLED, MULTIPLIED, BOUNDED = 8.0, 0.15, 100.0
#: Rows of a block at home at most about, while cells are small; they grow with the square root of the number of vectors too.
#: Blocks of guests have twice as many.
BLOCK_ROWS = 4096
MAX_BLOCK_VALUES = 4_000_000
ROUNDS = 8
#: Groups of vectors at least that are not in clusters, while blocks are not at their bound: guests travel to half of them.
GROUPS = 16
#: Values of an array that is made on the way at most, about, and vectors of a product's one side that are multiplied at once.
SLICE_VALUES = 1_000_000
TILE = 512, 4096


def units(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def row_slices(n: int, wide: int) -> list[slice]:
    """n rows of so many values in slices of bounded size."""
    step = max(1, SLICE_VALUES // max(1, wide))
    return [slice(at, min(n, at + step)) for at in range(0, n, step)]


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """k unit centroids of unit vectors; empty cells start again from the vectors that fit worst."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        found = [(fit.argmax(axis=1), fit.max(axis=1)) for fit in (x[at] @ centres.T for at in row_slices(len(x), k))]
        near, best = (np.concatenate(z) for z in zip(*found, strict=True))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1)
        worst = iter(np.argsort(best))
        for c in np.flatnonzero(norms < 1e-12):
            sums[c], norms[c] = x[next(worst)], 1.0
        centres = sums / norms[:, None]
    return centres


def sizes_by_length(classes: DataFrame) -> dict[int, int]:
    return {r["wide"]: r["n"] for r in classes.groupBy("wide").agg(F.count("*").alias("n")).collect()}


def cell_number(n: int, wide: int, sampled: int, multiple: int = 1) -> int:
    return max(1, min(MAX_CELLS, MAX_CENTROID_VALUES // wide, multiple * math.ceil(CELLS_BY_ROOT * math.sqrt(n)), sampled // SAMPLED_BY_CELL))


def block_rows(n: int, wide: int) -> int:
    return max(1, min(max(BLOCK_ROWS, 2 * math.isqrt(n)), MAX_BLOCK_VALUES // wide))


def group_rows(n: int, wide: int) -> int:
    """Rows of a group of cells, and of a block at home, at most about."""
    return max(block_rows(n, wide), min(n // GROUPS, MAX_BLOCK_VALUES // wide))


def grouped(homes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each cell's group, and each group's blocks at home: neighbours of rows vectors in all at most, or a larger cell by itself in several blocks."""
    group, held = np.zeros(len(homes), np.int64), [0.0]
    for c, n in enumerate(homes.tolist()):
        if held[-1] and held[-1] + n > rows:
            held.append(0.0)
        held[-1] += n
        group[c] = len(held) - 1
    return group, np.maximum(1, np.ceil(np.array(held) / rows)).astype(np.int64)


def by_group(goes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether a vector goes to any cell of each group, from whether it goes to each cell."""
    return np.logical_or.reduceat(goes, np.flatnonzero(np.diff(group, prepend=-1)), axis=1)


def work(centres: np.ndarray, x: np.ndarray, n: int, threshold: float) -> tuple[float, float]:
    """Rows that n vectors would be shuffled as, and pairs compared, if cells held what they hold of x: each row goes to the blocks it meets."""
    parts = [(fit.argmax(axis=1), fit.max(axis=1)) for fit in (x[at] @ centres.T for at in row_slices(len(x), len(centres)))]
    home, own = (np.concatenate(z) for z in zip(*parts, strict=True))
    reach = np.full(len(centres), 2.0)
    np.minimum.at(reach, home, own)
    times = n / len(x)
    homes = np.bincount(home, minlength=len(centres)) * times
    group, home_blocks = grouped(homes, group_rows(n, x.shape[1]))
    goes, gone = np.zeros(len(centres)), np.zeros(len(home_blocks))
    for at in row_slices(len(x), len(centres)):
        to = could_link(centres, reach, x[at] @ centres.T, home[at], threshold)
        goes += to.sum(axis=0) * times
        gone += by_group(to, group).sum(axis=0) * times
    at_home = np.bincount(group, weights=homes)
    guests = gone - at_home
    guest_blocks = np.ceil(np.maximum(0, guests) / (2 * group_rows(n, x.shape[1])))
    return float((at_home * (home_blocks + guest_blocks) + guests * home_blocks).sum()), float((homes * (homes / 2 + goes - homes)).sum())


def choose_cells(x: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Centroids for n vectors from a sample x of them, in the number that asks for the least work."""
    half, best = len(x) // 2, (math.inf, 1)
    for k in sorted({cell_number(n, x.shape[1], len(x), m) for m in MULTIPLES}):
        if half >= k:
            rows, pairs = work(spherical_kmeans(x[:half], k), x[half:], n, threshold)
            best = min(best, (x.shape[1] * (rows * SHUFFLED + pairs * MULTIPLIED) + n * k * BOUNDED, k))
    return spherical_kmeans(x, best[1])


def fit_cells(classes: DataFrame, sizes: dict[int, int], threshold: float) -> dict[int, np.ndarray]:
    """Centroids by length of vectors."""
    rate = min(SAMPLE / max(1, sum(sizes.values())), SAMPLE_VALUES / max(1, sum(w * n for w, n in sizes.items())))
    cut = min(1 << 30, int((1 << 30) * rate))
    sample: dict[int, list[tuple[int, list[float]]]] = {w: [] for w in sizes}
    for r in classes.where(F.pmod(F.xxhash64("h1", F.lit(3)), F.lit(1 << 30)) <= cut).select("wide", "h1", "v").collect():
        sample[r["wide"]].append((r["h1"], r["v"]))
    # the order of a hash is none of the vectors' own; too few sampled vectors for any cell happen where lengths are rare
    return {wide: choose_cells(units(np.array([v for _, v in sorted(rows)], float)), sizes[wide], threshold) if rows else np.eye(1, wide) for wide, rows in sample.items()}


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least node reachable from each of n nodes by the links i, j."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        np.minimum.at(after, root[i], least)
        np.minimum.at(after, root[j], least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def near_cells(batch: pa.RecordBatch, cells: dict[int, np.ndarray]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Length, rows, cosines with the centroids and nearest cell of a batch's vectors, for each length and slice of them."""
    wides = batch.column("wide").to_numpy()
    for wide in np.unique(wides).tolist():
        some = batch.take(pa.array(np.flatnonzero(wides == wide)))
        for at in row_slices(len(some), max(wide, len(cells[wide]))):
            part = some.slice(at.start, at.stop - at.start)
            fit = units(np.array(part.column("v").to_pylist(), float)) @ cells[wide].T
            yield wide, part, fit, fit.argmax(axis=1)


def could_link(centres: np.ndarray, reach: np.ndarray, fit: np.ndarray, home: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each vector (row) is at home in a cell or could have a partner in one of lower number; reach is the least cosine with its centroid in a cell."""
    return could_link_in(np.arange(len(centres)), centres, reach, fit, fit[np.arange(len(home)), home], home, threshold)


def could_link_in(cells: np.ndarray, centres: np.ndarray, reach: np.ndarray, fit: np.ndarray, own: np.ndarray, home: np.ndarray, threshold: float) -> np.ndarray:
    """could_link for some of the cells: fit has the cosines with their centroids, own those with the vectors' own."""
    slack, side = 1e-9, math.sqrt(max(0.0, 1 - threshold * threshold))
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres[home] @ centres[cells].T))
    beyond = own[:, None] - fit <= side * apart + slack
    angle = np.arccos(np.clip(fit, -1, 1)) <= np.arccos(np.clip(reach[cells], -1, 1))[None, :] + math.acos(max(-1.0, min(1.0, threshold))) + 1e-7
    goes = beyond & angle & (reach[cells] <= 1.5)[None, :] & (cells[None, :] <= home[:, None])
    return goes | (cells[None, :] == home[:, None])


def dealing(cells: dict[int, np.ndarray], reach: dict[int, np.ndarray], groups: dict[int, np.ndarray], threshold: float):
    """Rows of classes, once for each group that they go to, with their own cell and whether they are guests; a slice's rows are one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wide, some, fit, home in near_cells(batch, cells):
                row, to = np.nonzero(by_group(could_link(cells[wide], reach[wide], fit, home, threshold), groups[wide]))
                for at in row_slices(len(row), wide):
                    out = pa.Table.from_batches([some]).take(pa.array(row[at]))
                    for name, values in (("cell", home[row[at]].astype(np.int32)), ("grp", to[at].astype(np.int32)), ("guest", to[at] != groups[wide][home[row[at]]])):
                        out = out.append_column(name, pa.array(values))
                    yield from out.to_batches()

    return run


def multiplied(group: pa.Table, cells: dict[int, np.ndarray], reach: dict[int, np.ndarray], threshold: float) -> pa.Table | None:
    """Links of the home block a with the block b: vectors of each cell with those that could have a partner there, and with each other."""
    a, b, wide = (group.column(c)[0].as_py() for c in ("a", "b", "wide"))
    side, cell, copies = (group.column(c).to_numpy() for c in ("side", "cell", "copies"))
    left, right = np.flatnonzero(side == a), np.flatnonzero(side == b)
    if not len(left) or not len(right):
        return None
    v = group.column("v").combine_chunks()
    raw = v.values.to_numpy()[v.offsets[0].as_py() : v.offsets[-1].as_py()].reshape(len(group), -1)
    x = np.empty(raw.shape)
    for at in row_slices(len(x), wide):
        x[at] = units(raw[at])
    own, first = np.unique(np.sort(cell[left]), return_index=True)
    goes = np.empty((len(right), len(own)), bool)
    for at in row_slices(len(right), max(wide, len(own))):
        y, home = x[right[at]], cell[right[at]]
        goes[at] = could_link_in(own, cells[wide], reach[wide], y @ cells[wide][own].T, np.einsum("ij,ij->i", y, cells[wide][home]), home, threshold)
    links, tree = np.zeros(len(group), np.int64), np.zeros((2, 0), np.int64)
    for c, mine, to in zip(own.tolist(), np.split(left[np.argsort(cell[left], kind="stable")], first[1:]), goes.T, strict=True):
        others = right[to]
        for k in range(0, len(others), TILE[1]):
            some = others[k : k + TILE[1]]
            y = x[some].T
            for m in range(0, len(mine), TILE[0]):
                i, j = np.divmod(np.flatnonzero(x[mine[m : m + TILE[0]]] @ y >= threshold), len(some))
                i, j = mine[m + i], some[j]
                if a == b:
                    once = (cell[j] != c) | (i < j)
                    i, j = i[once], j[once]
                if len(i):
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    tree = np.concatenate([tree, np.stack([i, j])], axis=1)
                    if tree.shape[1] > SLICE_VALUES:
                        tree = spanning(tree, len(group))
    tree, hit = spanning(tree, len(group)), np.flatnonzero(links)
    h1, h2, rep = (group.column(c).combine_chunks() for c in ("h1", "h2", "rep"))
    counted = {"h1": h1.take(pa.array(hit)), "h2": h2.take(pa.array(hit)), "links": pa.array(links[hit]), "p": pa.nulls(len(hit), pa.int64()), "q": pa.nulls(len(hit), pa.int64())}
    linked = {"h1": pa.nulls(tree.shape[1], pa.int64()), "h2": pa.nulls(tree.shape[1], pa.int64()), "links": pa.nulls(tree.shape[1], pa.int64()), "p": rep.take(pa.array(tree[0])), "q": rep.take(pa.array(tree[1]))}
    return pa.concat_tables([pa.table(counted), pa.table(linked)])


def spanning(links: np.ndarray, n: int) -> np.ndarray:
    """At most n - 1 links that reach what the links of n nodes reach."""
    root = forest(links[0], links[1], n)
    of = np.flatnonzero(root != np.arange(n))
    return np.stack([of, root[of]])


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    spark = vectors.sparkSession
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    keyed = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).withColumn("usable", F.coalesce(finite, F.lit(False)))
    same = keyed.withColumn("h1", F.when(F.col("usable"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("usable"), F.xxhash64(F.lit(7), F.col("v"))))
    classes = stage(
        same.where("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("wide", F.size("v")),
        "vector-classes",
    )
    sizes = sizes_by_length(classes)
    cells = spark.sparkContext.broadcast(fit_cells(classes, sizes, threshold))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wide, _, fit, home in near_cells(batch, cells.value):
                yield pa.RecordBatch.from_arrays([pa.array([wide] * len(home), pa.int32()), pa.array(home.astype(np.int32)), pa.array(fit[np.arange(len(home)), home])], names=["wide", "cell", "fit"])

    # a row a cell comes to the driver: how far its vectors stand from its centroid, and how many they are
    reach, held = {w: np.full(len(c), 2.0) for w, c in cells.value.items()}, {w: np.zeros(len(c), np.int64) for w, c in cells.value.items()}
    for r in classes.select("wide", "v").mapInArrow(homes, "wide int, cell int, fit double").groupBy("wide", "cell").agg(F.min("fit").alias("fit"), F.count("*").alias("n")).collect():
        reach[r["wide"]][r["cell"]], held[r["wide"]][r["cell"]] = r["fit"], r["n"]
    most = {w: group_rows(n, w) for w, n in sizes.items()}
    groups, home_blocks = ({w: grouped(held[w], most[w])[k] for w in held} for k in (0, 1))
    dealer = spark.sparkContext.broadcast((reach, groups))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from dealing(cells.value, *dealer.value, threshold)(batches)

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Guests of each group in a slice."""
        for batch in batches:
            for wide, _, fit, home in near_cells(batch, cells.value):
                reach, groups = (x[wide] for x in dealer.value)
                n = by_group(could_link(cells.value[wide], reach, fit, home, threshold), groups).sum(axis=0) - np.bincount(groups[home], minlength=groups[-1] + 1)
                yield pa.RecordBatch.from_arrays([pa.array([wide] * len(n), pa.int32()), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n.astype(np.int64))], names=["wide", "grp", "n"])

    kind = classes.schema["v"].dataType.simpleString()
    dealt = classes.mapInArrow(deal, f"h1 long, h2 long, rep long, copies long, v {kind}, wide int, cell int, grp int, guest boolean")
    counts = classes.select("wide", "v").mapInArrow(gone, "wide int, grp int, n long").groupBy("wide", "grp").agg(F.sum("n").alias("guests")).collect()  # a row a group
    blocks = spark.createDataFrame([(r["wide"], r["grp"], int(home_blocks[r["wide"]][r["grp"]]), -(-r["guests"] // (2 * most[r["wide"]]))) for r in counts], "wide int, grp int, hb int, gb int")
    place = F.pmod(F.xxhash64("h1", F.lit(11)), F.when(F.col("guest"), F.col("gb")).otherwise(F.col("hb"))).cast("int")
    # a product's key: a home block and another block, of homes (up to hb - 1) or of guests (from hb on)
    home_pairs = F.transform(F.sequence(F.lit(0), F.col("hb") + F.col("gb") - 1), lambda o: F.struct(F.least("place", F.when(o < F.col("hb"), o).otherwise(F.col("place"))).alias("a"), F.when(o < F.col("hb"), F.greatest("place", o)).otherwise(o).alias("b")))
    guest_pairs = F.transform(F.sequence(F.lit(0), F.col("hb") - 1), lambda o: F.struct(o.alias("a"), (F.col("hb") + F.col("place")).alias("b")))
    paired = (
        dealt.join(F.broadcast(blocks), ["wide", "grp"])
        .withColumn("place", place)
        .withColumn("side", F.when(F.col("guest"), F.col("hb") + F.col("place")).otherwise(F.col("place")))
        .withColumn("pair", F.explode(F.when(F.col("guest"), guest_pairs).otherwise(home_pairs)))
        .select("wide", "grp", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "side", "cell", "h1", "h2", "rep", "copies", "v")
    )

    def product(group: pa.Table) -> pa.Table | None:
        return multiplied(group, cells.value, dealer.value[0], threshold)

    found = stage(map_groups(paired, ["wide", "grp", "a", "b"], product, "h1 long, h2 long, links long, p long, q long"), "vector-links")
    links = found.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.sum("links").alias("outer_links"))
    groups = connected_components(found.where("p IS NOT NULL AND q IS NOT NULL").select(F.col("p").alias("a"), F.col("q").alias("b")))
    told = classes.select("h1", "h2", "rep", "copies").join(links, ["h1", "h2"], "left").join(groups, F.col("rep") == F.col("node"), "left")
    # staged, so that the last join is one of two plain shuffles, which Spark can split where many rows are one vector
    result = stage(told.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("outer_links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("of")), "told-vectors")
    joined = same.select("vec_id", "h1", "h2").join(result, ["h1", "h2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("of", "vec_id"))
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scaled AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM vectors),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM scaled a JOIN scaled b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reach AS (
  SELECT a AS node, b AS other FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT node, min(other) AS other FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(other, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(other, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts ON e.vec_id = counts.a LEFT JOIN least ON e.vec_id = least.node
"""
