"""Exact top-k inner products over a bit-sliced index.

Each component is floor(256 x). Rows are dealt into blocks; a block keeps, for each component, the bits of its high part
(the value without its SHIFT low bits, counted from the block's least) as bitmaps over the block's rows, one bitmap a
bit. For a query, the slices are added with bitmap arithmetic: from the query's most significant bit downward the sum is
doubled and the slices of all components with that bit are added by carry-save adders. Negative factors take the
complement slices, so nothing is subtracted. The low parts can change a score by a known width at most. The k-th largest
sum is found from the sum's most significant slice downward, every row within the width of it is a boundary row, and
boundary rows are scored exactly from the whole values.

Every query travels to every block; each block returns k rows a query, and a window keeps the best k. Nothing is sampled and nothing is left out.

Cases: vectors that are null, or hold null or non-finite components, or whose length differs from the query's, take no
part; an empty vector has score 0 with every other empty one; ties go to the smaller id; a null id takes no part; rows
that repeat an id are one candidate each and none of them is a candidate of that id's query; equal rows of queries are one
query, and different vectors of one id are asked each and share its k best; scores beyond 64 bits are
held at the ends of that range; fewer candidates than k give fewer rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import boundaries

SCALE = 256
#: Low bits that slices leave to the exact step.
SHIFT = 3
#: Rows of a block of the index, on average, while there are few; they grow with the root of the number of rows, so that
#: fewer blocks meet each query, up to what a task can hold.
BLOCK_ROWS = 8192
BLOCK_BY_ROOT = 8
MAX_BLOCK_VALUES = 8_000_000
#: Values and queries up to this size are summed in 64 bits; larger ones by Python's integers.
SAFE = 1 << 24
LIMITS = (-(1 << 63), (1 << 63) - 1)


def matrix(column: pa.Array, wide: int) -> np.ndarray:
    ends = column.offsets
    return column.values.to_numpy()[ends[0].as_py() : ends[-1].as_py()].reshape(len(column), wide)


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers where all are small, Python integers otherwise."""
    y = np.floor(x * SCALE)
    if y.size and np.abs(y).max() >= SAFE:
        return np.array([[int(v) for v in row] for row in y], dtype=object).reshape(y.shape)
    return y.astype(np.int64)


class Block:
    """Bit slices over the rows of a block."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.rows, self.wide = values.shape
        self.sliced = values.dtype != object and self.wide > 0
        self.words = -(-self.rows // 64)
        self.all = self.bitmap(np.ones(self.rows, bool))
        if self.sliced:
            high = self.values >> SHIFT
            self.least = high.min(axis=0)
            high = high - self.least
            self.bits = max(1, int(high.max()).bit_length())
            self.slices = np.stack([np.stack([self.bitmap((high[:, d] >> b) & 1 == 1) for b in range(self.bits)]) for d in range(self.wide)])
            self.complements = ~self.slices & self.all

    def bitmap(self, flags: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.words * 64, bool)
        padded[: len(flags)] = flags
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least first, of the sum over components of |q| times the slice value, or times its complement where q < 0."""
        sizes = np.abs(query)
        total: list[np.ndarray] = []
        for bit in reversed(range(int(sizes.max()).bit_length())):
            columns: list[list[np.ndarray]] = [[], *([x] for x in total)]
            for d in np.flatnonzero(sizes >> bit & 1).tolist():
                of = self.complements[d] if query[d] < 0 else self.slices[d]
                while len(columns) < self.bits:
                    columns.append([])
                for b in range(self.bits):
                    columns[b].append(of[b])
            total = carry_save(columns)
        return total

    def boundary(self, total: list[np.ndarray], k: int, width: int, own: np.ndarray) -> np.ndarray:
        """Rows whose sum is within width of the k-th largest among the rows that own doesn't mark."""
        among = self.all & ~own
        sure, maybe, kth, n = np.zeros_like(among), among, 0, 0
        for b in reversed(range(len(total))):
            upper = maybe & total[b]
            m = int(np.bitwise_count(upper).sum())
            if n + m >= k:
                maybe = upper
                kth |= 1 << b
            else:
                sure |= upper
                n += m
                maybe = maybe & ~total[b]
        floor = kth - width
        if floor <= 0 or int(np.bitwise_count(among).sum()) <= k:
            found = among
        else:
            more, same = np.zeros_like(among), among
            for b in reversed(range(len(total))):
                if floor >> b & 1:
                    same = same & total[b]
                else:
                    more |= same & total[b]
                    same = same & ~total[b]
            found = more | same
        return np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        own = self.ids == query_id
        if self.sliced and query.dtype != object and query.any():
            # each low part lies between 0 and 2^SHIFT - 1: in units of the slices the exact score moves by less than sum(|q|)
            width = int(np.abs(query).sum())
            rows = self.boundary(self.sums(query), k, width, self.bitmap(own))
        else:
            rows = np.flatnonzero(~own)
        if query.dtype == object or self.values.dtype == object:
            scores = [min(max(sum(int(a) * int(b) for a, b in zip(query, self.values[r], strict=True)), LIMITS[0]), LIMITS[1]) for r in rows.tolist()]
            best = sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i]))[:k]
            return self.ids[rows[best]], [scores[i] for i in best]
        scores = self.values[rows] @ query
        best = np.lexsort((rows, -scores))[:k]
        return self.ids[rows[best]], scores[best].tolist()


def carry_save(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Add bitmaps by the binary place of their column: three of a place make one there and one carried to the next."""
    out, at = [], 0
    while at < len(columns):
        here = columns[at]
        while len(here) > 1:
            if at + 1 == len(columns):
                columns.append([])
            a, b = here.pop(), here.pop()
            half = a ^ b
            if here:
                c = here.pop()
                columns[at + 1].append((a & b) | (half & c))
                here.insert(0, half ^ c)
            else:
                columns[at + 1].append(a & b)
                here.append(half)
        out.append(here[0] if here else np.zeros_like(next(x[0] for x in columns if x) if any(columns) else out[0]))
        at += 1
    return out


def block_rows(n: int, wide: int) -> int:
    return max(1, min(max(BLOCK_ROWS, BLOCK_BY_ROOT * math.isqrt(n)), MAX_BLOCK_VALUES // max(1, wide)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of vectors by integer inner product."""
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = lambda df: df.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.size(vector_col).alias("wide"))
    rows, asked = clean(vectors), clean(queries).dropDuplicates(["id", "v"])
    spark = vectors.sparkSession
    sizes = {r["wide"]: r["n"] for r in rows.groupBy("wide").agg(F.count("*").alias("n")).collect()}
    shape = [(w, -(-n // block_rows(n, w))) for w, n in sizes.items()]
    shapes = F.broadcast(spark.createDataFrame(shape, "wide int, blocks int"))  # a row for each length of vectors
    # a block's rows come first, then the queries, one by one: a task holds one block and no more queries than a batch
    index = rows.join(shapes, "wide").select("wide", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    asks = asked.join(shapes, "wide").select("wide", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for batch in batches:
            cuts = boundaries(pa.Table.from_batches([batch]), ["wide", "block", "kind"]) if batch.num_rows else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                piece = batch.slice(a, b - a)
                wide, number, kind = (piece.column(c)[0].as_py() for c in ("wide", "block", "kind"))
                if (wide, number) != key:
                    key, parts, block = (wide, number), [], None
                ids, values = piece.column("id").to_numpy(), matrix(piece.column("v"), wide)
                if kind == 0:
                    parts.append((ids, values))
                    continue
                if block is None and parts:
                    block = Block(np.concatenate([x for x, _ in parts]), whole_numbers(np.concatenate([x for _, x in parts])))
                if block is not None:
                    found = [block.top(q, x, k) for q, x in zip(ids.tolist(), whole_numbers(values), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids, [len(x) for x, _ in found])), pa.array(np.concatenate([x for x, _ in found]), pa.int64()), pa.array([s for _, x in found for s in x], pa.int64())],
                        names=["query_id", "vec_id", "score"],
                    )

    per_block = index.unionByName(asks).repartition("wide", "block").sortWithinPartitions("wide", "block", "kind").mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return per_block.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
