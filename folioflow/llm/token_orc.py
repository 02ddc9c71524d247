"""Token ids in ORC: stripes of run-length encoded integers, row indexes and Bloom filters on document ids.

A token file set is a folder of ORC files in ascending order of document id. Each row is a document: its id, the task
and row that wrote it (`part`, `seq`, so files and rows in a file have a fixed order) and its ids as array<int>, which
ORC stores as run-length encoded integers in stripes. Readers split files by stripes, skip stripes and row groups by the
minima and maxima of the row index, and look up single documents by the Bloom filter.

Cases: a null or empty text gives only the end id; a null document id sorts first; rows with the same id keep all
their copies, ordered by a hash of their texts, and may fill many files; an empty table gives an empty file set; other columns are not read.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import lists, slices, stage

#: Words that a Python worker remembers with their ids; later ones are encoded anew for each slice of texts.
MEMO_WORDS = 600_000
#: ASCII punctuation but for the apostrophe.
AFTER_LETTERS = string.punctuation.replace("'", "")
ORC = {
    "compression": "zstd",
    "orc.stripe.size": str(64 << 20),
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def normal_letters(core: str) -> bool:
    """Whether a word is all letters, and stays so when the tokenizer composes and lowers it: some letters end in a mark then."""
    return core.isalpha() and (core.isascii() or unicodedata.normalize("NFC", core).lower().isalpha())


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space.

    Such a tokenizer's pieces never span a blank, so a text's ids are those of its blank-separated words in turn, and each
    worker has the tokenizers library encode a frequent word once. Other white space stays inside a word and is left to the library.
    ASCII punctuation after letters is a word of its own to the tokenizer, apostrophes apart, and is split off, which leaves
    fewer words, unless the letters become others and marks, which punctuation joins; words of letters go to the library many at a time, and the ends-of-word marks part their ids again.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<i4")

    def learn_letters(self, words: list[str]) -> dict[str, bytes]:
        out = {}
        for at in range(0, len(words), 400):
            some = words[at : at + 400]
            ids = self.ids(" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            found = np.split(ids, cuts[:-1]) if len(cuts) == len(some) and cuts[-1] == len(ids) else map(self.ids, some)
            out.update(zip(some, (x.tobytes() for x in found), strict=True))
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of new words; they are remembered while there is room."""
        out, split, letters, known = {}, [], set(), self.parts
        for word in words:
            core = word.rstrip(AFTER_LETTERS)
            if normal_letters(core):
                split.append((word, core, word[len(core) :]))
                if core not in known:
                    letters.add(core)
            else:
                out[word] = self.ids(word).tobytes()
        fresh = self.learn_letters(list(letters))
        fresh.update((x, self.ids(x).tobytes()) for x in {tail for _, _, tail in split} if x not in known)
        for word, core, tail in split:
            head, rest = fresh.get(core), fresh.get(tail)
            out[word] = (known[core] if head is None else head) + (known[tail] if rest is None else rest)
        if len(known) < MEMO_WORDS:
            known.update(fresh)
        if len(self.memo) < MEMO_WORDS:
            self.memo.update(out)
        return out

    def encode(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        split = [(t or "").replace("\n", " ").split(" ") for t in texts]
        of, end = self.memo.get, np.array([end_id], dtype="<i4").tobytes()
        found = [list(map(of, words)) for words in split]
        new = self.learn({w for words, ids in zip(split, found, strict=True) for w, x in zip(words, ids, strict=True) if x is None})
        return [np.frombuffer(b"".join([new[w] if x is None else x for w, x in zip(words, ids, strict=True)]) + end, dtype="<i4") for words, ids in zip(split, found, strict=True)]


@cache
def word_encoder(tokenizer_path: str) -> WordEncoder:
    """One encoder a Python worker, which serves many tasks."""
    return WordEncoder(tokenizer_path)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append end_id, and write a token file set in ascending order of document id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = word_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = encoder.encode(batch.column("text").to_pylist(), end_id)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), lists(ids, pa.int32())],
                    names=["doc_id", "part", "seq", "ids"],
                )
                seq += n

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a hash of the text parts the rows of an id that many of them have
    keyed = rows.withColumn("key", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "text")
    ordered.select("doc_id", "text").mapInArrow(encode, "doc_id long, part int, seq long, ids array<int>").write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, part int, seq long, ids array<int>").orc(path)


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; the filter reaches ORC, which skips stripes by row index and Bloom filter."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token file set: start (ids of all documents before it), n_tokens and ids_crc32.

    Running sums go part by part; only the parts' totals, one row a file, meet in one task.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends, flat = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("seq"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["doc_id", "part", "seq", "n_tokens", "ids_crc32"],
            )

    rows = stage(read_tokens(spark, path).mapInArrow(digest, "doc_id long, part int, seq long, n_tokens long, ids_crc32 long"), "token-digest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("doc_id", (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )
