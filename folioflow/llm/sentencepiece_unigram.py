"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback.

Blanks become the marker U+2581 and one marker goes before the text; the best path by summed log scores gives the ids; a
character that no piece covers costs a fixed penalty and becomes one byte piece for each of its bytes. Decoding joins the
pieces, turns markers into blanks, puts byte pieces back together and drops the first blank.

Unigram models bring log scores. A model of merges has ranks in their place, whole numbers from 0 down; a rank r becomes the
log probability of Zipf's law, -log(r + 1) less the log of the sum over all pieces, so that scores along a path are those of
a unigram model over the same pieces. Nothing is trained: the ranks alone set the scores.

No piece has a marker after another character, so no piece spans the start of a run of markers, and the best path of a
text is the best paths of its marker-led chunks in turn. Each worker finds a frequent chunk's path once; Viterbi runs over many new
chunks at a time, column by column. In a long chunk the trie is walked from all its places at once instead, and one loop over
the matches finds the path. A vocabulary without that property is encoded whole.

Cases: null and empty texts have no ids and decode to the empty text; a text of U+2581 decodes with blanks in its place,
as SentencePiece has it; invalid byte sequences decode to U+FFFD; repeated rows are encoded alike; an empty table gives
an empty one; columns besides id and text are passed on only by encode().
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import lists, slices

MARK = "▁"
#: What an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Chunks that a Python worker remembers with their ids; later ones are encoded anew for each slice of texts.
MEMO_CHUNKS = 300_000
#: Cells of a Viterbi table.
CELLS = 2_000_000
#: Chunks of more characters than this are not remembered and have their matches found from all places at once.
LONG_CHUNK = 200


@dataclass
class Vocabulary:
    """Pieces as a double-array trie over UTF-8 bytes: a node's child by byte b is base[node] + b + 1 if check there is node."""

    pieces: list[bytes]
    scores: np.ndarray
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    byte_ids: np.ndarray
    unknown_id: int
    silent: frozenset[int]
    chunked: bool

    @property
    def unknown_score(self) -> float:
        return float(self.scores[[i for i in np.unique(self.piece) if i >= 0]].min()) - UNKNOWN_PENALTY


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and the piece id (or -1) of each node; node 0 is the root."""
    tree: list[dict[int, int]] = [{}]
    ends = {}
    for word, i in words.items():
        at = 0
        for b in word:
            if b not in tree[at]:
                tree[at][b] = len(tree)
                tree.append({})
            at = tree[at][b]
        ends[at] = i
    size = 4 * len(tree) + 4096
    base, check, piece, free = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.ones(size, bool)
    free[0], lowest, queue = False, 1, deque([(0, 0)])
    while queue:
        node, place = queue.popleft()
        piece[place] = ends.get(node, -1)
        if not tree[node]:
            continue
        steps = np.array(sorted(tree[node]), dtype=np.int64) + 1
        while lowest < len(free) - 1 and not free[lowest]:
            lowest += 1
        at = max(lowest, int(steps[0]))
        while True:
            if at + 2048 + 257 > len(free):
                more = len(free)
                base, check, piece, free = (np.concatenate([x, np.full(more, y, x.dtype)]) for x, y in ((base, 0), (check, -1), (piece, -1), (free, True)))
            starts = np.flatnonzero(free[at : at + 2048]) + at - steps[0]
            fits = free[starts[:, None] + steps].all(axis=1) if len(starts) else np.zeros(0, bool)
            if fits.any():
                b = int(starts[fits.argmax()])
                break
            at += 2048
        base[place] = b
        free[b + steps], check[b + steps] = False, place
        queue.extend((tree[node][s - 1], b + s) for s in steps.tolist())
    used = int(np.flatnonzero(~free).max()) + 258
    return base[:used], check[:used], piece[:used]


def rank_scores(scores: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Log probabilities by Zipf's law if the plain pieces' scores are whole numbers, as ranks of merges are, else the scores as they are."""
    given = scores[plain]
    if len(given) < 2 or (given != np.round(given)).any():
        return scores
    out, ranks = scores.copy(), np.empty(len(plain))
    ranks[np.argsort(-given, kind="stable")] = np.arange(len(plain))
    out[plain] = -np.log(ranks + 1) - np.log((1 / (ranks + 1)).sum())
    return out


def load_vocabulary(model_path: str, from_ranks: bool = True) -> Vocabulary:
    """The pieces and log scores of a SentencePiece model file; any model type gives a vocabulary. Ranks stay as they are without from_ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    scores = np.array([model.get_score(i) for i in range(len(names))], dtype=np.float64)
    special = {i for i in range(len(names)) if model.is_control(i) or model.is_unknown(i)}
    bytes_of = {int(x[3:5], 16): i for i, x in enumerate(names) if model.is_byte(i)}
    if from_ranks:
        scores = rank_scores(scores, np.array([i for i in range(len(names)) if i not in special and i not in bytes_of.values()]))
    return vocabulary(names, scores, special, bytes_of, model.unk_id())


def vocabulary(names: list[str], scores: np.ndarray, special: set[int], bytes_of: dict[int, int], unknown_id: int) -> Vocabulary:
    plain = {x.encode(): i for i, x in enumerate(names) if i not in special and i not in bytes_of.values()}
    pieces = [x.replace(MARK, " ").encode() for x in names]
    for b, i in bytes_of.items():
        pieces[i] = bytes([b])
    pieces[unknown_id] = " ⁇ ".encode()
    return Vocabulary(
        pieces, scores.astype(np.float64), *double_array(plain), np.array([bytes_of.get(b, unknown_id) for b in range(256)], np.int32), unknown_id,
        frozenset(special - {unknown_id}), not any(MARK in x.decode().lstrip(MARK) for x in plain),
    )


class Encoder:
    """Encodes and decodes texts within a task."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.memo, self.low = vocab, {}, vocab.unknown_score
        self.table = [b"" if i in vocab.silent else x for i, x in enumerate(vocab.pieces)]

    def chunks(self, text: str | None) -> list[str]:
        """The text's chunks, each without the first of its markers, as blanks."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if not self.vocab.chunked:
            return [text]
        words = text.split(" ")
        if "" not in words:
            return words
        return [x[1:] for x in re.findall(" +[^ ]*", f" {text}")]

    def viterbi(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk's best path; the earliest start wins ties."""
        v = self.vocab
        raw = [f" {x}".replace(" ", MARK).encode() for x in chunks]
        n, lengths = len(raw), np.array([len(x) for x in raw])
        wide = int(lengths.max())
        cells = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in raw), np.uint8).reshape(n, wide)
        starts = (cells & 0xC0) != 0x80
        best = np.full((n, wide + 1), -np.inf)
        came, by = np.zeros((n, wide + 1), np.int32), np.full((n, wide + 1), -1, np.int32)
        best[:, 0] = 0
        width = np.select([cells < 0x80, cells < 0xE0, cells < 0xF0], [1, 2, 3], 4)
        for i in range(wide):
            rows = np.flatnonzero((i < lengths) & starts[:, i] & (best[:, i] > -np.inf))
            covered = np.zeros(n, bool)
            live, node = rows, np.zeros(len(rows), np.int64)
            for j in range(i, wide):
                to = v.base[node].astype(np.int64) + cells[live, j] + 1
                ok = (v.check[to] == node) & (j < lengths[live])
                live, node = live[ok], to[ok]
                if not len(live):
                    break
                found = v.piece[node]
                hit = found >= 0
                if hit.any():
                    at, ids = live[hit], found[hit]
                    covered[at[j + 1 - i == width[at, i]]] = True
                    score = best[at, i] + v.scores[ids]
                    more = score > best[at, j + 1]
                    at = at[more]
                    best[at, j + 1], came[at, j + 1], by[at, j + 1] = score[more], i, ids[more]
            bare = rows[~covered[rows]]
            if len(bare):
                ends = i + width[bare, i]
                score = best[bare, i] + self.low
                more = score > best[bare, ends]
                bare, ends = bare[more], ends[more]
                best[bare, ends], came[bare, ends], by[bare, ends] = score[more], i, -1
        ids = np.full((n, wide), -1, np.int32)
        at, rows = lengths.copy(), np.arange(n)
        while len(rows):
            start, piece = came[rows, at[rows]], by[rows, at[rows]]
            known = piece >= 0
            ids[rows[known], start[known]] = piece[known]
            for r, a, b in zip(rows[~known].tolist(), start[~known].tolist(), at[rows[~known]].tolist(), strict=True):
                ids[r, a:b] = v.byte_ids[cells[r, a:b]]
            at[rows] = start
            rows = rows[start > 0]
        flat, ends = ids[ids >= 0], np.cumsum((ids >= 0).sum(axis=1))
        return np.split(flat, ends[:-1])

    def viterbi_long(self, chunk: str) -> np.ndarray:
        """The ids of a chunk's best path, as viterbi() finds it."""
        v = self.vocab
        raw = f" {chunk}".replace(" ", MARK).encode()
        cells = np.frombuffer(raw, np.uint8)
        n = len(cells)
        chars = np.flatnonzero((cells & 0xC0) != 0x80)
        width = np.diff(np.append(chars, n))
        live, node, found = chars, np.zeros(len(chars), np.int64), []
        covered = np.zeros(n, bool)
        depth = 0
        while len(live):
            to = v.base[node].astype(np.int64) + cells[live + depth] + 1
            ok = v.check[to] == node
            live, node, depth = live[ok], to[ok], depth + 1
            hit = v.piece[node] >= 0
            found.append((live[hit], live[hit] + depth, v.piece[node[hit]]))
            going = live + depth < n
            live, node = live[going], node[going]
        char_end = np.zeros(n + 1, np.int64)
        char_end[chars] = chars + width
        for start, end, _ in found:
            covered[start[char_end[start] == end]] = True
        bare = chars[~covered[chars]]
        start, end, piece = (np.concatenate(x) for x in zip(*found, (bare, char_end[bare], np.full(len(bare), -1)), strict=True))
        gain = np.where(piece >= 0, v.scores[piece], self.low)
        by = np.lexsort((start, end))
        best, came = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        for a, b, i, g in zip(start[by].tolist(), end[by].tolist(), piece[by].tolist(), gain[by].tolist(), strict=True):
            if (score := best[a] + g) > best[b]:
                best[b], came[b] = score, (a, i)
        parts, at = [], n
        while at:
            a, i = came[at]
            parts.append([i] if i >= 0 else v.byte_ids[cells[a:at]].tolist())
            at = a
        return np.array([i for x in reversed(parts) for i in x], np.int32)

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of new chunks; they are remembered while there is room."""
        out = {x: self.viterbi_long(x).astype("<i4").tobytes() for x in chunks if len(x) > LONG_CHUNK}
        new = sorted((x for x in chunks if len(x) <= LONG_CHUNK), key=len)
        while new:
            take = max(1, min(len(new), CELLS // (3 * len(new[min(len(new), 8192) - 1]) + 3), 8192))
            some, new = new[:take], new[take:]
            out.update(zip(some, (x.astype("<i4").tobytes() for x in self.viterbi(some)), strict=True))
        if len(self.memo) < MEMO_CHUNKS:
            self.memo.update((x, ids) for x, ids in out.items() if len(x) <= LONG_CHUNK)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split, of = [self.chunks(t) for t in texts], self.memo.get
        found = [list(map(of, chunks)) for chunks in split]
        new = self.learn({x for chunks, ids in zip(split, found, strict=True) for x, i in zip(chunks, ids, strict=True) if i is None})
        return [np.frombuffer(b"".join([new[x] if i is None else i for x, i in zip(chunks, ids, strict=True)]), "<i4") for chunks, ids in zip(split, found, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


_encoders: dict[str, Encoder] = {}


def worker_encoder(model_path: str, vocab: Broadcast) -> Encoder:
    """One encoder a Python worker, which serves many tasks."""
    if model_path not in _encoders:
        _encoders[model_path] = Encoder(vocab.value)
    return _encoders[model_path]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """The columns of keep, and the ids of every whole text."""
    vocab = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model_path, vocab)
        for whole in batches:
            for batch in slices(whole, "__text"):
                ids = encoder.encode(batch.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists(ids, pa.int32())], names=[*keep, ids_col])

    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, `{ids_col}` array<int>")


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns of keep, and the text of every list of ids (null: empty)."""
    vocab = rows.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model_path, vocab)
        for batch in batches:
            texts = [encoder.decode(np.array(x if x is not None else [], np.int32)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, text_col])

    kept = rows.select(*keep, F.col(ids_col).alias("__ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{kinds}, `{text_col}` string")


def encode_digest(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Per document: n_pieces, n_bytes (byte pieces), ids_crc32, and whether decoding its ids gives its text (null: empty) back; with_ids adds the ids."""
    vocab = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))
    names = ["doc_id", "n_pieces", "n_bytes", "ids_crc32", "round_trip", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(model_path, vocab)
        is_byte = np.zeros(len(encoder.table), np.int64)
        is_byte[encoder.vocab.byte_ids] = 1
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                ids = encoder.encode(texts)
                same = [encoder.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(is_byte[x].sum()) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(same), *[lists(ids, pa.int32())] * with_ids,
                    ],
                    names=names,
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids)
