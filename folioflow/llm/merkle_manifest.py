"""Merkle manifest of a dataset: hashes of rows, a tree of them for each language, and a tree of the languages' roots.

A manifest is a folder of Parquet tables. `leaves` holds a row of the dataset each: its tree, its place there and the hash
of its fields. `trees/band-i` holds the preimages: the concatenated child hashes of every parent, 64 characters a child,
packed by blocks of `ARITY ** BAND` neighbouring nodes and the BAND levels of parents above them, so that a block has a
bounded size whatever the size of its tree, and each band is that many times smaller than the one below. `roots/band-i`
holds the same for the tree of the trees' roots.

A leaf's proof comes from its ancestors' preimages: it cuts its own 64 characters out of each, which leaves its siblings,
and folds a claimed leaf by putting the claim's hash in their place, level by level, up to the root. The paths above a
block are worked out a block at a time from the top down; only then do leaves join their blocks, so no path is shuffled
for a leaf and no task holds more of a tree than blocks.

Cases: null fields count as `-`, so they differ from empty texts; null ids come first in their tree and are never claimed
otherwise; rows of one id are ordered by their hash, and equal rows of one id by chance, which no result shows as text,
though each has a place, and so a proof, of its own; a tree of one row has that row's hash as root; an empty table gives
no rows; very long texts are hashed whole in the scan and go no further; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import fresh_path, stage

#: Children of a parent.
ARITY = 2
#: Levels of parents that a block holds: 2 ** 5 nodes and at most 31 preimages above them.
BAND = 5
DIGEST = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<preimage: string, slot: int>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of a row: each field as its length in UTF-8 bytes, a colon and its value, or `-` if it is null."""
    texts = [x.cast("string") for x in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]))


def quotient(x: Column, by: Column | int) -> Column:
    return F.floor((x - x % by) / by)


def ranked(rows: DataFrame, order: list[str], label: str, path: str | None = None) -> DataFrame:
    """Rows with their place (`pos`, from 0) within their tree, by order, and its number of rows (`n`).

    Rows are dealt by ranges, equal ones too, and counted a part and tree at a time; only those counts meet by tree.
    """
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    keys = ["tree", *order, "salt"]
    parts = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    # the upper bits are the part, the lower ones count within it
    laid = stage(parts.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), label)
    counts = laid.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    by_tree = Window.partitionBy("tree")
    before = by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "part", "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"), F.sum("held").over(by_tree).alias("n"))
    placed = laid.join(starts, ["tree", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("start"))
    return stage(placed.drop("part", "at", "first", "start"), label, path)


def blocks(nodes: DataFrame, arity: int, band: int) -> DataFrame:
    """One band of a forest: nodes (tree, n, pos, hash) as blocks (tree, n, block, preimages by level, hash of the topmost node).

    A tree of no more nodes than a block holds has only as many levels as bring it to one node.
    """
    width = arity**band
    rows = (
        nodes.withColumn("block", quotient(F.col("pos"), width).cast("long"))
        .groupBy("tree", "block")
        .agg(F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("level_0"))
    )
    for i in range(band):
        level = F.col(f"level_{i}")
        parents = F.transform(F.sequence(F.lit(0), quotient(F.size(level) - 1, arity).cast("int")), lambda j: F.array_join(F.slice(level, j * arity + 1, F.lit(arity)), ""))  # noqa: B023
        rows = rows.withColumn(f"parents_{i}", F.when(F.col("n") > arity**i, parents))
        rows = rows.withColumn(f"level_{i + 1}", F.coalesce(F.transform(f"parents_{i}", digest), level))
    kept = F.filter(F.array(*[f"parents_{i}" for i in range(band)]), lambda x: x.isNotNull())
    return rows.select("tree", "n", "block", kept.alias("preimages"), F.col(f"level_{band}")[0].alias("hash"))


def grown(nodes: DataFrame, arity: int, band: int, path: str) -> list[DataFrame]:
    """The bands of a forest from the leaves up, each written below path."""
    width, bands = arity**band, []
    while True:
        bands.append(stage(blocks(nodes, arity, band), "band", f"{path}/band-{len(bands)}"))
        higher = bands[-1].where(F.col("n") > width)
        if higher.isEmpty():
            return bands
        nodes = higher.select("tree", quotient(F.col("n") + (width - 1), width).cast("long").alias("n"), F.col("block").alias("pos"), "hash")


def tops(bands: list[DataFrame], width: int) -> DataFrame:
    """The root of every tree: the hash of the one block of its last band."""
    return reduce(DataFrame.unionByName, [b.where(F.col("n") <= width).select("tree", "hash") for b in bands])


def steps(preimages: Column, pos: Column, arity: int, band: int) -> Column:
    """A node's way through its block: the preimage of each ancestor, from the lowest, and the slot that the way comes from."""
    local = (pos % arity**band).cast("int")
    sizes = F.array(*[F.lit(arity**i) for i in range(band + 1)])
    return F.transform(
        preimages,
        lambda level, i: F.struct(
            F.get(level, quotient(local, F.get(sizes, i + 1)).cast("int")).alias("preimage"), (quotient(local, F.get(sizes, i)) % arity).cast("int").alias("slot")
        ),
    )


def descended(bands: list[DataFrame], ends: DataFrame, carried: list[str], arity: int, band: int) -> DataFrame:
    """The lowest blocks with the steps above them (`above`) and the carried columns of their tree.

    ends has, for each tree, the steps above its root (`above`) and the carried columns.
    """
    width, known = arity**band, None
    for rows in reversed(bands):
        found = rows.where(F.col("n") <= width).join(ends, "tree")
        if known is not None:
            over = known.select("tree", F.col("block").alias("parent"), F.col("preimages").alias("over"), F.col("above").alias("beyond"), *carried)
            joined = rows.where(F.col("n") > width).withColumn("parent", quotient(F.col("block"), width).cast("long")).join(over, ["tree", "parent"])
            joined = joined.withColumn("above", F.concat(steps(F.col("over"), F.col("block"), arity, band), F.col("beyond")))
            found = found.unionByName(joined.drop("parent", "over", "beyond"))
        known = found
    return known.drop("hash", "n")


def siblings(path: Column) -> Column:
    """All hashes that a proof needs, from the leaf up, left to right: preimages without the way's own slot."""
    own = lambda x: x["slot"] * DIGEST
    return F.array_join(F.transform(path, lambda x: F.concat(F.substr(x["preimage"], F.lit(1), own(x)), F.substr(x["preimage"], own(x) + DIGEST + 1))), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf gives with the siblings of a path: it replaces the way's own slot of each preimage."""
    own = lambda x: x["slot"] * DIGEST
    return F.aggregate(path, leaf, lambda h, x: digest(F.concat(F.substr(x["preimage"], F.lit(1), own(x)), h, F.substr(x["preimage"], own(x) + DIGEST + 1))))


class Manifest:
    """A manifest at a path; see build."""

    def __init__(self, spark: SparkSession, path: str, arity: int = ARITY, band: int = BAND):
        self.spark, self.path, self.arity, self.band = spark, path, arity, band

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def bands(self, name: str) -> list[DataFrame]:
        """The bands written below a folder of the manifest."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
        return [self.read(f"{name}/band-{i}") for i in range(sum(x.getPath().getName().startswith("band-") for x in files))]

    def proofs(self) -> DataFrame:
        """Per leaf: id, leaf, subroot, root, proof_sha256 (hash of all siblings), folded_root (from the claimed leaf) and verified."""
        arity, band = self.arity, self.band
        width = arity**band
        roots = self.bands("roots")
        last = tops(roots, width).select("tree", F.col("hash").alias("root"), F.array().cast(STEP).alias("above"))
        over = descended(roots, last, ["root"], arity, band)
        subroots = self.read("subroots").withColumn("block", quotient(F.col("pos"), width).cast("long"))
        ends = subroots.join(over.drop("tree"), "block").select(
            F.col("of").alias("tree"), F.col("hash").alias("subroot"), "root", F.concat(steps(F.col("preimages"), F.col("pos"), arity, band), F.col("above")).alias("above")
        )
        low = descended(self.bands("trees"), ends, ["subroot", "root"], arity, band)
        leaves = self.read("leaves").withColumn("block", quotient(F.col("pos"), width).cast("long"))
        ways = leaves.join(low, ["tree", "block"]).withColumn("path", F.concat(steps(F.col("preimages"), F.col("pos"), arity, band), F.col("above")))
        found = ways.select("id", F.col("hash").alias("leaf"), "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), folded(F.col("path"), F.coalesce("claim", "hash")).alias("folded_root"))
        return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def build(
    docs: DataFrame, path: str | None = None, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id", claims: dict[str, Column] | None = None, claimed: Column | None = None, arity: int = ARITY, band: int = BAND
) -> Manifest:
    """Write the manifest of a table below path.

    claims gives other values for some fields; where claimed holds, the leaf of those values is kept beside the true one,
    and proofs fold it in its place.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "manifest")
    other = leaf_hash([(claims or {}).get(x, F.col(x)) for x in fields])
    hashed = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit("")).alias("tree"),
        F.col(id_col).alias("id"),
        leaf_hash([F.col(x) for x in fields]).alias("hash"),
        F.when(F.coalesce(claimed if claimed is not None else F.lit(False), F.lit(False)), other).alias("claim"),
    )
    # dealing by ranges reads its input twice: texts are hashed once, before
    leaves = ranked(stage(hashed, "leaf-hashes"), ["id", "hash"], "leaves", f"{path}/leaves")
    trees = grown(leaves.select("tree", "n", "pos", "hash"), arity, band, f"{path}/trees")
    ends = tops(trees, arity**band).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash")
    subroots = ranked(ends, ["of"], "subroots", f"{path}/subroots")
    grown(subroots.select("tree", "n", "pos", "hash"), arity, band, f"{path}/roots")
    return Manifest(spark, path, arity, band)


def manifest_digest(docs: DataFrame) -> DataFrame:
    """The proofs of documents, where a seventh of them claim one character more than they have."""
    more = F.col("n_chars").cast("decimal(38,0)") + 1
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    return build(docs, claims={"n_chars": more}, claimed=hit).proofs().withColumnRenamed("id", "doc_id")


SQL = """
WITH RECURSIVE leaves AS (
  SELECT doc_id, tree, sha256(a || b || n || c) AS leaf,
         CASE WHEN n_chars IS NOT NULL AND coalesce(crc % 7 = 0, false) THEN sha256(a || b || m || c) ELSE sha256(a || b || n || c) END AS claim
  FROM (
    SELECT doc_id, n_chars, coalesce('=' || lang, '') AS tree,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS a,
           coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS b,
           coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS n,
           coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') AS m,
           coalesce(strlen(text) || ':' || text, '-') AS c,
           xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
             lambda v, x: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda w, i: CASE WHEN w & 1 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END, xor(v, x)),
             4294967295::BIGINT), 4294967295) AS crc
    FROM documents)),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (
  SELECT tree, 0 AS lvl, pos, leaf AS hash, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 2, n),
subroots AS (SELECT tree, hash AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees FROM nodes WHERE n = 1),
highs AS (
  SELECT 0 AS lvl, place AS pos, subroot AS hash, trees AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)), (n + 1) // 2 FROM highs WHERE n > 1 GROUP BY lvl, pos // 2, n),
low AS (
  SELECT tree, doc_id, pos AS place, leaf, 0 AS lvl, pos, '' AS others, claim AS h FROM placed
  UNION ALL
  SELECT w.tree, w.doc_id, w.place, w.leaf, w.lvl + 1, w.pos // 2, w.others || coalesce(s.hash, ''),
         sha256(CASE WHEN s.pos < w.pos THEN s.hash || w.h ELSE w.h || coalesce(s.hash, '') END)
  FROM low w JOIN nodes me ON me.tree = w.tree AND me.lvl = w.lvl AND me.pos = w.pos AND me.n > 1
  LEFT JOIN nodes s ON s.tree = w.tree AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1)),
high AS (
  SELECT w.tree, w.doc_id, w.place, w.leaf, s.subroot, 0 AS lvl, s.place AS pos, w.others, w.h
  FROM low w JOIN subroots s USING (tree) JOIN nodes me ON me.tree = w.tree AND me.lvl = w.lvl AND me.pos = w.pos AND me.n = 1
  UNION ALL
  SELECT w.tree, w.doc_id, w.place, w.leaf, w.subroot, w.lvl + 1, w.pos // 2, w.others || coalesce(s.hash, ''),
         sha256(CASE WHEN s.pos < w.pos THEN s.hash || w.h ELSE w.h || coalesce(s.hash, '') END)
  FROM high w JOIN highs me ON me.lvl = w.lvl AND me.pos = w.pos AND me.n > 1 LEFT JOIN highs s ON s.lvl = w.lvl AND s.pos = xor(w.pos, 1))
SELECT w.doc_id, w.leaf, w.subroot, r.hash AS root, sha256(w.others) AS proof_sha256, w.h AS folded_root, w.h = r.hash AS verified
FROM high w JOIN highs r ON r.n = 1 WHERE w.lvl = r.lvl
"""
