"""Removal of bytes covered by a string of LENGTH bytes that also starts anywhere else.

Documents are packed into units of about half a megabyte, those that share a long line mostly together. Every window of LENGTH bytes has an anchor: the place of its least
k-gram hash, which depends on the window's bytes only. Neighbouring windows with one anchor form a run. Equal windows have
equal anchors at the same offset, so only runs whose anchor k-gram stands elsewhere need a closer look.

Inside a unit, a suffix sort that compares prefix polynomial hashes (suffix_order) says which runs are equal: neighbours in
that order with a common extension of a run's length, verified byte by byte. Between units, three exchanges narrow down
common extensions: whole runs, then pieces of PIECE windows, then single windows. In each an item has a key (bytes that all
its windows share) and a value (all bytes it covers). A value that a unit holds twice by its suffix order, or that two units
hold, marks all its windows; a key with one value clears them; anything between goes on to the next, finer exchange. A unit
sends each key and value once, hashed and with a BLAKE2 digest of the bytes against collisions, and gets bits back, so a
passage that a third of the documents hold costs a few bytes a unit.

Windows of other lengths can be looked for on the way: they share units, hashes and exchanges, and are counted only.

Cases: null and empty texts have no bytes; documents of fewer than LENGTH bytes lose nothing; matches never cross
documents; repeated rows are copies of each other; a null id stays null; an empty table gives an empty one; other columns
are not read. A text longer than a unit is one by itself, and its task holds some 50 bytes of arrays for each of its bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import batch_bytes, fresh_path, lists, map_groups, remove, slices, stage
from folioflow.llm.shingles import mixed
from folioflow.llm.suffix_order import PrefixHash, equal_groups

LENGTH = 400
#: Passages of more than 50 words may be shorter than LENGTH; bytes in repeated strings of this length are counted beside.
PASSAGE = 280
KGRAM = 32
PIECE = 24
UNIT_BYTES = 500_000
#: Characters of a line that documents are brought together by, at least.
NEAR_LINE = 40
#: Bytes of the exchange that meet in one group, about.
BUCKET_BYTES = 16_000_000
KEY = np.dtype([("key", "<u8"), ("least", "<u8"), ("most", "<u8")])
VALUE = np.dtype([("value", "<u8"), ("check", "<u4"), ("local", "u1")])


def gram_keys(hashes: PrefixHash) -> np.ndarray:
    """For each k-gram half of its hash, and its place behind it."""
    at = np.arange(len(hashes.data) - KGRAM + 1)
    return (mixed(hashes.of(at, at + KGRAM)) >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)


def window_anchors(keys: np.ndarray, n: int, length: int) -> np.ndarray:
    """For each window of length bytes of n the place of its least k-gram; the leftmost of equal ones."""
    wide = length - KGRAM + 1
    padded = np.full(-(-len(keys) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    least = np.minimum(back[:windows], ahead[wide - 1 : wide - 1 + windows])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Windows:
    """The items of one window length in a unit, exchange by exchange: anchor, first and last window, and class of each run.

    It keeps the unit's bytes and hashes but not the unit, which has it: a unit is freed as soon as the next one comes.
    """

    def __init__(self, unit: Unit, length: int, items: np.ndarray | None = None):
        self.raw, self.hashes, self.length = unit.raw, unit.hashes, length
        self.removed = np.zeros(len(unit.raw) + 1, np.int32)
        self.classes: np.ndarray | None = None
        if items is not None:
            *self.items, self.classes = items
            return
        none = np.zeros(0, np.int64)
        self.items = [none, none, none]
        if len(unit.raw) >= length:
            anchors = window_anchors(unit.keys(), len(unit.raw), length)
            start = np.arange(len(anchors))
            doc = np.searchsorted(unit.ends, start, side="right")
            valid = start + length <= unit.ends[np.minimum(doc, len(unit.ends) - 1)]
            start, anchors, doc = start[valid], anchors[valid], doc[valid]
            new = np.ones(len(start), bool)
            new[1:] = (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(start)) - 1
            if len(first):
                self.items = [anchors[first], start[first], start[last]]

    def cores(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the bytes begin and end that all windows of an item share, wherever it stands."""
        anchor, low, _ = self.items
        if level == 0:
            return anchor, anchor + KGRAM
        # the bytes that all windows of the whole piece would share, though the run may hold a part of it only
        size = PIECE if level == 1 else 1
        from_ = (anchor - low) // size * size
        return anchor - from_, anchor - from_ - size + 1 + self.length

    def keys(self, level: int) -> np.ndarray:
        anchor, core = self.items[0], self.cores(level)
        return mixed(self.hashes.of(*core) + np.uint64(level) + (anchor - core[0]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def equal(self, level: int) -> np.ndarray:
        """For each item the one that stands for all of its bytes; only items that share a key with another are sorted."""
        if self.classes is None:
            _, low, high = self.items
            _, of, n = np.unique(self.keys(level), return_inverse=True, return_counts=True)
            some = np.flatnonzero(n[of] > 1)
            self.classes = np.arange(len(low))
            self.classes[some] = some[equal_groups(self.hashes, low[some], (high - low)[some] + self.length)]
        return self.classes

    def places(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Items that stand for a value, each item's value and how many have it; items with distinct keys, and each item's key."""
        heads, of_value, n = np.unique(self.equal(level), return_inverse=True, return_counts=True)
        _, first_key, of_key = np.unique(self.keys(level), return_index=True, return_inverse=True)
        return heads, of_value, n, first_key, of_key

    def records(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The unit's distinct keys and values."""
        anchor, low, high = self.items
        heads, of_value, n, first_key, of_key = self.places(level)
        spans = zip(low[heads].tolist(), (high[heads] + self.length).tolist(), strict=True)
        values = np.zeros(len(heads), VALUE)
        values["value"] = mixed(self.hashes.of(low[heads], high[heads] + self.length) + mixed(((anchor - low) << 20 | (high - low))[heads].astype(np.uint64)))
        values["check"] = np.frombuffer(b"".join(hashlib.blake2b(self.raw[a:b], digest_size=4).digest() for a, b in spans), "<u4")
        values["local"] = n > 1
        told = mixed(values["value"] + values["check"].astype(np.uint64))[of_value]
        keys = np.zeros(len(first_key), KEY)
        keys["key"] = self.keys(level)[first_key]
        keys["least"] = np.iinfo(np.uint64).max
        np.minimum.at(keys["least"], of_key, told)
        np.maximum.at(keys["most"], of_key, told)
        return keys, values

    def hashed(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashes by which records() are dealt into buckets."""
        anchor, low, high = self.items
        heads, _, _, first_key, _ = self.places(level)
        value = mixed(self.hashes.of(low[heads], high[heads] + self.length) + mixed(((anchor - low) << 20 | (high - low))[heads].astype(np.uint64)))
        return self.keys(level)[first_key], value

    def answer(self, level: int, codes: tuple[np.ndarray, np.ndarray]) -> None:
        """Mark what is found twice, and cut what needs a closer look into finer items."""
        heads, of_value, _, _, of_key = self.places(level)
        head = np.zeros(len(of_value), bool)
        head[heads] = True
        several, twice, first = codes[0][of_key] & 1 == 1, codes[1][of_value] & 1 == 1, codes[1][of_value] & 2 == 2
        anchor, low, high = self.items
        np.add.at(self.removed, low[twice], 1)
        np.add.at(self.removed, high[twice] + self.length, -1)
        more = several & (~twice | first & head)
        anchor, low, high = anchor[more], low[more], high[more]
        size = PIECE if level == 0 else 1
        # pieces are cut where the distance to the anchor is a multiple of their size, so that they match between copies
        top, bottom = (anchor - low) // size, (anchor - high) // size
        parts = top - bottom + 1
        at = np.repeat(np.arange(len(anchor)), parts)
        step = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
        near = (top[at] - step) * size
        self.items, self.classes = [anchor[at], np.maximum(low[at], anchor[at] - near - size + 1), np.minimum(high[at], anchor[at] - near)], None

    @property
    def gone(self) -> np.ndarray:
        return np.cumsum(self.removed[:-1]) > 0


class Unit:
    """The bytes of some documents and their windows of each length."""

    def __init__(self, data: bytes, ends: list[int], lengths: tuple[int, ...], items: list[np.ndarray] | None = None):
        self.raw, self.data = data, np.frombuffer(data, np.uint8)
        self.hashes = PrefixHash(self.data)
        self.ends = np.array(ends, np.int64)
        self.grams: np.ndarray | None = None
        self.windows = [Windows(self, n, x) for n, x in zip(lengths, items or [None] * len(lengths), strict=True)]

        self.grams = None

    def keys(self) -> np.ndarray:
        """gram_keys of all bytes, once for all lengths."""
        if self.grams is None:
            self.grams = gram_keys(self.hashes)
        return self.grams

    def results(self) -> list[tuple]:
        """n_bytes, n_removed, n_spans, kept_sha256 of each document by the first length, and the bytes covered by the others."""
        gone, *others = [x.gone for x in self.windows]
        out, start = [], 0
        for end in self.ends.tolist():
            lost = gone[start:end]
            n = int(lost.sum())
            spans = int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum()) if n else 0
            kept = self.data[start:end][~lost].tobytes() if n else self.raw[start:end]
            out.append((end - start, n, spans, hashlib.sha256(kept).hexdigest(), *(int(x[start:end].sum()) for x in others)))
            start = end
        return out


def pack(lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text", UNIT_BYTES):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
                data, ends = b"".join(raw), np.cumsum([len(x) for x in raw])
                items = [np.stack([*x.items, x.equal(0)]).astype("<i4").tobytes() for x in Unit(data, ends.tolist(), lengths).windows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + seq]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), lists([ends], pa.int64()), pa.array([data]), pa.array([items], pa.list_(pa.binary()))],
                    names=["unit", "doc_ids", "ends", "data", "items"],
                )
                seq += 1

    return run


def restored(row: dict, lengths: tuple[int, ...]) -> Unit:
    """A unit after the answers that it has so far. A record's kind is 2k for keys and 2k + 1 for values of length k."""
    unit = Unit(row["data"], row["ends"], lengths, [np.frombuffer(x, "<i4").reshape(4, -1).astype(np.int64) for x in row["items"]])
    answers: dict[int, dict[int, dict[int, bytes]]] = {}
    for x in row.get("answers") or []:
        answers.setdefault(x["level"], {}).setdefault(x["kind"], {})[x["bucket"]] = x["codes"]
    for level in sorted(answers):
        for k, windows in enumerate(unit.windows):
            codes = []
            for kind, hashes in enumerate(windows.hashed(level), 2 * k):
                order, cuts = dealt(hashes, row["buckets"])
                out, found = np.zeros(len(hashes), np.uint8), answers[level].get(kind, {})
                for b, at in cuts:
                    if b in found:
                        out[order[at]] = np.frombuffer(found[b], np.uint8)
                codes.append(out)
            windows.answer(level, (codes[0], codes[1]))
    return unit


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Records by bucket: an order, and each bucket's slice of it."""
    bucket = (mixed(hashes) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    if not len(order):
        return order, []
    return order, [(b, slice(s, e)) for b, s, e in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True)]


def asking(level: int, lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for k, windows in enumerate(restored(row, lengths).windows):
                    for kind, records, name in zip((2 * k, 2 * k + 1), windows.records(level), ("key", "value"), strict=True):
                        if name == "value" or level < 2:
                            order, cuts = dealt(records[name], row["buckets"])
                            n = len(cuts)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([row["unit"]] * n, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([b for b, _ in cuts], pa.int64()), pa.array([records[order[at]].tobytes() for _, at in cuts], pa.binary())],
                                names=["unit", "kind", "bucket", "data"],
                            )

    return run


def resolve(group: pa.Table) -> pa.Table:
    """Codes of a bucket's records. Keys: 1 if they have several values. Values: 1 if two units or one twice has them, 2 for the first unit's."""
    kind = VALUE if group.column("kind")[0].as_py() % 2 else KEY
    found = [np.frombuffer(x, kind) for x in group.column("data").to_pylist()]
    rows = np.concatenate(found)
    by = np.argsort(rows["key"], kind="stable") if kind is KEY else np.lexsort((np.arange(len(rows)), rows["check"], rows["value"]))
    s = rows[by]
    new = np.ones(len(s), bool)
    new[1:] = s["key"][1:] != s["key"][:-1] if kind is KEY else (s["value"][1:] != s["value"][:-1]) | (s["check"][1:] != s["check"][:-1])
    of, first = np.cumsum(new) - 1, np.flatnonzero(new)
    codes = np.zeros(len(rows), np.uint8)
    if kind is KEY:
        codes[by] = (np.minimum.reduceat(s["least"], first) != np.maximum.reduceat(s["most"], first))[of]
    else:
        unit = np.repeat(np.arange(len(found)), [len(x) for x in found])[by]
        apart = np.maximum.reduceat(unit, first) != np.minimum.reduceat(unit, first)
        codes[by] = (apart | (np.maximum.reduceat(s["local"], first) > 0))[of] + 2 * new.astype(np.uint8)
    parts = np.split(codes, np.cumsum([len(x) for x in found])[:-1])
    return pa.table({"unit": group.column("unit"), "kind": group.column("kind"), "bucket": group.column("bucket"), "codes": pa.array([x.tobytes() for x in parts])})


def answering(lengths: tuple[int, ...], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns = zip(*restored(row, lengths).results(), strict=True)
                kinds = [pa.string() if n == "kept_sha256" else pa.int64() for n in names[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=names)

    return run


def brought_together(rows: DataFrame, parts: int) -> DataFrame:
    """rows (doc_id, text) in an order in which documents that share a long line mostly follow each other, dealt by ranges.

    Units then hold what the suffix order can find. Which documents share a unit is no matter of results, and rows of a hot
    line are parted by their texts, and copies of one text by chance. The least hash of a text's lines is hashed again: it is
    the smaller the more lines there are, and long texts would stand together.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= NEAR_LINE)
    keyed = rows.withColumns({"near": F.xxhash64(F.array_min(F.transform(lines, lambda x: F.xxhash64(x)))), "whole": F.xxhash64("text"), "salt": F.monotonically_increasing_id()})
    keys = ["near", "whole", "salt"]
    return keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")


def remove_repeats(docs: DataFrame, length: int = LENGTH, others: tuple[int, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256; n_in_<k> bytes in repeated strings of k bytes for each other length k.

    The units' table is bucketed by unit, so that answers come to the texts and no text moves again.
    """
    spark, lengths = docs.sparkSession, (length, *others)
    name, n = f"folioflow_units_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    told_at: list[str] = []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = brought_together(rows, n).mapInArrow(pack(lengths), "unit long, doc_ids array<long>, ends array<long>, data binary, items array<binary>")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(f"n_in_{k}" for k in others)]
    path = fresh_path(spark, "suffix-units")
    try:
        with batch_bytes(spark, 4 * UNIT_BYTES):
            packed.repartition(n, "unit").write.option("compression", "zstd").option("path", path).bucketBy(n, "unit").format("parquet").saveAsTable(name)
            size = spark.table(name).agg(F.coalesce(F.sum(F.octet_length(F.col("items")[0])), F.lit(0))).first()[0]
            units = spark.table(name).withColumn("buckets", F.lit(max(8, 9 * size // (4 * BUCKET_BYTES))))
            answers = None
            for level in range(3):
                asked = with_answers(units, answers).mapInArrow(asking(level, lengths), "unit long, kind int, bucket long, data binary")
                told = map_groups(asked, ["kind", "bucket"], resolve, "unit long, kind int, bucket long, codes binary", order=["unit"]).withColumn("level", F.lit(level))
                told_at.append(fresh_path(spark, "suffix-answers"))
                told = stage(told, "suffix-answers", told_at[-1])
                answers = told if answers is None else answers.unionByName(told)
            schema = ", ".join(f"{x} {'string' if x == 'kept_sha256' else 'long'}" for x in names)
            return stage(with_answers(units, answers).mapInArrow(answering(lengths, names), schema), "suffix-dedup")
    finally:
        # the table's files are its own, in the shared folder, and stay when it is dropped
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for done in (path, *told_at):
            remove(spark, done)


def with_answers(units: DataFrame, answers: DataFrame | None) -> DataFrame:
    if answers is None:
        return units
    by_unit = answers.groupBy("unit").agg(F.collect_list(F.struct("level", "kind", "bucket", "codes")).alias("answers"))
    return units.join(by_unit, "unit", "left")
