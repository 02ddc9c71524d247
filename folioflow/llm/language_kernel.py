"""Language identification by string kernels: blended-spectrum presence kernels, Nystroem landmarks, kernel ridge regression.

A text's spectrum is the set of its character n-grams of one to three characters, lower-cased, every run of characters other
than letters (Unicode L) and their marks (M) a blank, hashed to 2^14 cells. The kernel of two texts is the cosine of their spectra. Landmarks
are training texts; the kernel with them gives each text its Nystroem coordinates, in which one ridge regression a
language against the rest is solved. A batch of texts is scored by two matrix products: with the landmarks' spectra, then
with the folded weights.

Training takes at most PER_LANGUAGE rows a language, by the order of a hash; that bound is the parameter per_language.
Every text is scored whole.

Cases: a text that is null or has no letter (digits, numerals such as a half or a Roman twelve, and marks alone are none) is `und` with score 0, and so is every text if nothing could be learned; rows
without a language, id or letters teach nothing; repeated rows are predicted alike; a null id is not held out; an empty
table gives an empty one; language and source are never inputs of a prediction.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import slices, stage

UNDETERMINED = "und"
CELLS = 1 << 14
PER_LANGUAGE = 400
LANDMARKS = 96
#: Parts in which the normal equations are summed up.
SUMS = 8
RIDGE = 1e-2
#: Below this score, where no language fits better than chance, a document counts as unidentified.
LEAST_SCORE = 0.3
#: Texts whose spectra are held at once.
BATCH = 64
#: Odd multipliers of the n-gram hash, by n and place: fixed values, so that models can be kept.
MULTIPLIERS = ((2654435761,), (2246822519, 3266489917), (668265263, 374761393, 2869860233))


@dataclass
class Model:
    languages: list[str]
    #: Spectra of the landmarks (cells by landmarks), scaled to unit length.
    landmarks: np.ndarray
    #: Landmarks by languages.
    weights: np.ndarray


@cache
def kinds() -> np.ndarray:
    """2 for letters, 1 for marks, 0 for other code points."""
    return np.frombuffer(bytes({"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), np.uint8)


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each run of others than letters and marks one blank and blanks at both ends; the text of each; whether a text has a letter."""
    ready = [f" {t.lower()} " if t else "  " for t in texts]
    points = np.frombuffer("".join(ready).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in ready])
    kind = kinds()[points]
    known = np.bincount(row[kind == 2], minlength=len(texts)) > 0
    blank = kind == 0
    kept = ~blank
    kept[1:] |= ~blank[:-1] | (row[1:] != row[:-1])
    kept[:1] = True
    return np.where(blank, np.uint32(32), points)[kept], row[kept], known


def spectra(points: np.ndarray, row: np.ndarray, n_texts: int) -> np.ndarray:
    """A row of presence flags for each text, of what letters() says."""
    out = np.zeros(n_texts * CELLS, np.uint8)
    row = row * CELLS
    for n, factors in enumerate(MULTIPLIERS, 1):
        if len(points) < n:
            break
        last = len(points) - n + 1
        mixed = np.zeros(last, np.uint32)
        for k, f in enumerate(factors):
            mixed += points[k : k + last] * np.uint32(f)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(2246822519)
        place = row[:last] + (mixed >> np.uint32(18))
        out[place[row[:last] == row[n - 1 :]] if n > 1 else place] = 1
    return out.reshape(n_texts, CELLS)


def unit(flags: np.ndarray) -> np.ndarray:
    x = flags.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def unpacked(flags: Sequence[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(flags), np.uint8).reshape(len(flags), -1), axis=1) if len(flags) else np.zeros((0, CELLS), np.uint8)


def nystroem(marks: np.ndarray) -> np.ndarray:
    """What turns the kernels with the landmarks into coordinates."""
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    return vectors[:, keep] / np.sqrt(values[keep])


def equations(marks: np.ndarray, root: np.ndarray, flags: np.ndarray, of: np.ndarray, names: list[str], share: dict[str, float]) -> np.ndarray:
    """Both sides of the regression's normal equations, over some texts: coordinates by coordinates, then by languages."""
    places = (unit(flags) @ marks.T).astype(np.float64) @ root
    wanted = np.where(of[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weighted = places * np.array([share[name] for name in of.tolist()])[:, None]
    return np.hstack([weighted.T @ places, weighted.T @ wanted])


def solved(names: list[str], marks: np.ndarray, root: np.ndarray, sums: np.ndarray, n: int) -> Model:
    wide = root.shape[1]
    gram = sums[:, :wide] + RIDGE * n / 100 * np.eye(wide)
    return Model(names, np.ascontiguousarray(marks.T), (root @ np.linalg.solve(gram, sums[:, wide:])).astype(np.float32))


def shares(counts: dict[str, int]) -> dict[str, float]:
    """The weight of a language's texts: all languages weigh the same."""
    return {name: sum(counts.values()) / (len(counts) * n) for name, n in counts.items()}


def fit(flags: np.ndarray, languages: list[str], landmarks: int = LANDMARKS) -> Model:
    """The model of some texts at hand; landmarks are spread evenly over the languages, rows come in a fixed order."""
    names, of = sorted(set(languages)), np.array(languages)
    if not names:
        return Model([], np.zeros((CELLS, 0), np.float32), np.zeros((0, 0), np.float32))
    each, share = max(1, landmarks // len(names)), shares({name: languages.count(name) for name in names})
    marks = unit(flags[np.concatenate([np.flatnonzero(of == name)[:each] for name in names])])
    root = nystroem(marks)
    sums = sum(equations(marks, root, flags[at : at + 512], of[at : at + 512], names, share) for at in range(0, len(of), 512))
    return solved(names, marks, root, sums, len(of))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    for at in range(0, len(texts) if model.languages else 0, BATCH):
        points, row, known = letters(texts[at : at + BATCH])
        some = (np.flatnonzero(known) + at).tolist()
        if not some:
            continue
        kernel = unit(spectra(points, row, len(known))[known]) @ model.landmarks
        answers = kernel @ model.weights
        best = answers.argmax(axis=1)
        for i, b, a in zip(some, best.tolist(), answers.max(axis=1).tolist(), strict=True):
            names[i], scores[i] = model.languages[b], min(1.0, max(0.0, (a + 1) / 2))
    return names, scores


def in_thirds(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model:
    """Learn from rows with a language whose crc32(doc_id as text) mod 3 is not 1.

    Spectra are packed, 2 KB a row. The landmarks come to the driver, one a language at least; the normal equations are summed
    up by tasks, a block of landmarks by landmarks and languages each, so no row of the rest does.
    """
    rows = docs.select(F.col("doc_id"), F.col("text"), F.col("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (in_thirds() != 1))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit(np.zeros((0, CELLS), np.uint8), [])
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30))
    rate = F.coalesce(*(F.when(F.col("lang") == name, F.lit(min(1 << 30, int((1 << 30) * 1.5 * per_language / n) + 1))) for name, n in sorted(counts.items())))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                points, row, known = letters(batch.column("text").to_pylist())
                flags = np.packbits(spectra(points, row, len(known)), axis=1)
                packed = pa.RecordBatch.from_arrays([batch.column("place"), batch.column("doc_id"), batch.column("lang"), pa.array([x.tobytes() for x in flags])], names=["place", "doc_id", "lang", "flags"])
                yield packed.filter(pa.array(known))

    taught = rows.withColumn("place", place).where(F.col("place") < rate).select("place", "doc_id", "lang", "text").mapInArrow(pack, "place long, doc_id long, lang string, flags binary")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "flags"))
    kept = stage(taught.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "nth", "flags"), "language-spectra")
    held = {r["lang"]: r["n"] for r in kept.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not held:
        return fit(np.zeros((0, CELLS), np.uint8), [])
    names, share = sorted(held), shares(held)
    chosen = sorted(map(tuple, kept.where(F.col("nth") <= max(1, landmarks // len(names))).collect()))
    marks = unit(unpacked([x[2] for x in chosen]))
    root = nystroem(marks)
    shared = docs.sparkSession.sparkContext.broadcast((marks, root))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((root.shape[1], root.shape[1] + len(names)))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                total += equations(*shared.value, unpacked(some.column("flags").to_pylist()), np.array(some.column("lang").to_pylist()), names, share)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()])], names=["part", "sums"])

    # a fixed number of parts, added up in order, so that a rerun gives the same model
    parts = sorted(map(tuple, kept.repartition(SUMS, "lang", "nth").sortWithinPartitions("lang", "nth").mapInArrow(summed, "part int, sums binary").collect()))
    sums = sum(np.frombuffer(x, np.float64).reshape(root.shape[1], -1) for _, x in parts)
    return solved(names, marks, root, sums, sum(held.values()))


def identify(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), text_col: str = "text", names: tuple[str, str] = ("__lang", "__score")) -> DataFrame:
    """The columns of keep, and the language and score of every whole text, under two names that keep doesn't hold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, *([] if text_col in keep else [text_col]))
    at, n = rows.columns.index(text_col), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                told, scores = predict(shared.value, batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(told, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    return rows.mapInArrow(run, f"{kinds}, `{names[0]}` string, `{names[1]}` double")


def language_digest(docs: DataFrame) -> DataFrame:
    """Per document: held_out, lang_pred, score."""
    held = F.coalesce(in_thirds() == 1, F.lit(False))
    return identify(docs, train(docs)).select("doc_id", held.alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs without those whose language can't be told: no letters, or no language's score reaches least_score."""
    name = "__lang"
    while any(c.lower() in (name, f"{name}_score") for c in docs.columns):
        name += "_"
    found = identify(docs, train(docs), docs.columns, names=(name, f"{name}_score"))
    return found.where((F.col(name) != UNDETERMINED) & (F.col(f"{name}_score") >= least_score)).drop(name, f"{name}_score")
