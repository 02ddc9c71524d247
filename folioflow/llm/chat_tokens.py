"""Chat formatting by tokens: turns as token ids with reserved ids between, and a loss mask for each token.

A turn is `<|im_start|>role`, a line end, its text, `<|im_end|>` and a line end. Role and text are encoded apart, as
ordinary text, so that no text can give a reserved id and no merge crosses the mask's edges; the reserved ids are spliced
between the pieces. The mask has +1 where a text under the loss begins and -1 where it ends, and is the running sum of
these. Control strings within a text are escaped besides, by a backslash after their first character (one more where
there are some), so that a formatted text can be written and parsed as text; reading takes one away.

A file set holds a row a turn, in order of conversation and turn: conv_id, the task and row that wrote it (`part`,
`seq`), `ids` and `loss`. A conversation of any length is thus many rows, dealt to many tasks; `token_starts` says
where each row's ids begin in their conversation.

Cases: null texts and roles are empty; a null conversation is one of its own, a null turn comes first; rows of one turn
are ordered by role and a hash of their text, repeated rows stay; line ends and backslashes in roles are escaped too;
texts of any length are encoded whole; an empty table gives an empty file set; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm.common import fresh_path, lists, slices

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that are never left as they are in a text; their ids follow the vocabulary's.
CONTROL = ("<|endoftext|>", START, END)
#: Roles whose texts are trained on.
LOSS_ROLES = ("assistant",)
ROW = "conv_id long, part int, seq long, ids array<int>, loss array<tinyint>"


class Escapes:
    """Control strings in a text with a backslash more after their first character, and back."""

    def __init__(self, control: tuple[str, ...]):
        if any(x[0] in x[1:] or "\\" in x or len(x) < 2 for x in control):
            raise ValueError("a control string must hold its first character once, another one after it, and no backslash")
        self.found = re.compile("|".join(rf"(?<={re.escape(x[0])})\\*(?={re.escape(x[1:])})" for x in control))
        self.firsts = {x[0] for x in control}

    def escaped(self, text: str) -> str:
        return self.found.sub(lambda m: m[0] + "\\", text) if any(x in text for x in self.firsts) else text

    def plain(self, text: str) -> str:
        return self.found.sub(lambda m: m[0][1:], text) if "\\" in text else text

    def escaped_role(self, role: str) -> str:
        return self.escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def plain_role(self, role: str) -> str:
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.plain(role), flags=re.DOTALL)


class ChatCodec:
    """Turns to ids and loss masks, and ids to turns."""

    def __init__(self, ranks_path: str, control: tuple[str, ...] = CONTROL, loss_roles: tuple[str, ...] = LOSS_ROLES):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.words = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.reserved = {x: len(ranks) + i for i, x in enumerate(control)}
        self.escapes, self.loss_roles = Escapes(control), frozenset(loss_roles)
        self.tail = np.concatenate([[self.reserved[END]], self.ids("\n")]).astype(np.int32)
        self.heads: dict[str, np.ndarray] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.words.encode_ordinary(text), dtype=np.int32)

    def text(self, ids: np.ndarray) -> str:
        return self.words.decode_bytes(ids.tolist()).decode()

    def head(self, role: str) -> np.ndarray:
        if role not in self.heads:
            if len(self.heads) > 1000:
                self.heads.clear()
            self.heads[role] = np.concatenate([[self.reserved[START]], self.ids(self.escapes.escaped_role(role) + "\n")]).astype(np.int32)
        return self.heads[role]

    def encode(self, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and loss mask of some turns in a row, and where each turn ends."""
        pieces = [p for role, text in zip(roles, texts, strict=True) for p in (self.head(role), self.ids(self.escapes.escaped(text)), self.tail)]
        ends = np.cumsum([len(p) for p in pieces]).reshape(-1, 3)
        trained = np.fromiter((r in self.loss_roles for r in roles), bool, len(roles))
        edges = np.zeros(int(ends[-1, 2]) + 1, np.int32)
        np.add.at(edges, ends[trained, 0], 1)
        np.add.at(edges, ends[trained, 1], -1)
        return np.concatenate(pieces), np.cumsum(edges[:-1]).astype(np.int8), ends[:, 2]

    def decode(self, ids: np.ndarray, loss: np.ndarray) -> tuple[str, str, str, int]:
        """A turn's role and text, the text under its loss mask, and the length of the turn as formatted text."""
        marks = np.flatnonzero(ids >= self.words.n_vocab)
        if ids[marks].tolist() != [self.reserved[START], self.reserved[END]] or marks[0] != 0:
            raise ValueError("a turn begins with its start mark and holds one end mark")
        body, after = self.text(ids[1 : marks[1]]), self.text(ids[marks[1] + 1 :])
        role, text = body.split("\n", 1)
        trained = self.text(ids[loss.astype(bool)])
        size = len(START) + len(body) + len(END) + len(after)
        return self.escapes.plain_role(role), self.escapes.plain(text), self.escapes.plain(trained), size


@cache
def codec(ranks_path: str, control: tuple[str, ...], loss_roles: tuple[str, ...]) -> ChatCodec:
    """One codec a Python worker, which serves many tasks."""
    return ChatCodec(ranks_path, control, loss_roles)


def write_chats(turns: DataFrame, path: str, ranks_path: str, control: tuple[str, ...] = CONTROL, loss_roles: tuple[str, ...] = LOSS_ROLES) -> None:
    """Format all turns (conv_id, turn, role, text) and write them as a file set."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat, part, seq = codec(ranks_path, control, loss_roles), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in slices(whole, "text"):
                n = batch.num_rows
                ids, loss, ends = chat.encode(batch.column("role").to_pylist(), batch.column("text").to_pylist())
                cuts = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), pa.ListArray.from_arrays(cuts, pa.array(ids)), pa.ListArray.from_arrays(cuts, pa.array(loss))],
                    names=["conv_id", "part", "seq", "ids", "loss"],
                )
                seq += n

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    # a hash and a count part the rows of a turn that many of them have
    keys = ["conv_id", "turn", "role", "key", "salt"]
    keyed = rows.withColumn("key", F.md5("text")).withColumn("salt", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select("conv_id", "role", "text").mapInArrow(encode, ROW).write.option("compression", "zstd").parquet(path)


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(path)


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file set with `start`, the ids of their conversation before them.

    Running sums go part by part; only totals of a conversation's parts meet in one task.
    """
    rows = read_chats(spark, path)
    sizes = rows.select("conv_id", "part", "seq", F.size("ids").cast("long").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("conv_id", "part").agg(F.sum("n").alias("held")).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part", "conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum(F.size("ids").cast("long")).over(inside), F.lit(0)))
    joined = placed.join(parts, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")))
    return joined.withColumn("start", F.col("offset") + F.col("inside")).drop("c", "p", "offset", "inside")


def read_turns(spark: SparkSession, path: str, ranks_path: str, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """The turns of a file set, decoded: role, text, the text under the loss mask (null where it is the text) and the formatted length."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chat = codec(ranks_path, control, LOSS_ROLES)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids, loss = some.column("ids"), some.column("loss")
                ends = ids.offsets.to_numpy()
                flat, mask = ids.values.to_numpy(zero_copy_only=False), loss.values.to_numpy(zero_copy_only=False)
                found = [chat.decode(flat[a:b], mask[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                role, text, trained, size = (list(x) for x in zip(*found, strict=True))
                under = [None if t == x else t for x, t in zip(text, trained, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in ("conv_id", "part", "seq")), pa.array(role, pa.string()), pa.array(text, pa.string()), pa.array(under, pa.string()), pa.array(size, pa.int64())],
                    names=["conv_id", "part", "seq", "role", "text", "loss_text", "formatted_chars"],
                )

    schema = "conv_id long, part int, seq long, role string, text string, loss_text string, formatted_chars long"
    return read_chats(spark, path).mapInArrow(decode, schema)


def chat_digest(spark: SparkSession, path: str, ranks_path: str, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """Per conversation, read back from a file set: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars.

    A digest takes its turns one after the other, so a conversation's are streamed through one task, from sorted rows, and
    none but the current one is held.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], None

        def closed() -> None:
            conv, n, turns, chars, loss, size = held
            rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "formatted_chars"))
            for conv, role, text, under, size in zip(*columns, strict=True):
                if held is None or held[0] != conv:
                    if held is not None:
                        closed()
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                trained = text if under is None else under
                held[1] += 1
                held[2].update(f"{role}\n{text}\n".encode())
                held[3] += len(trained)
                held[4].update(trained.encode())
                held[5] += size
            if len(rows) > 1000:
                yield gathered(rows)
                rows.clear()
        if held is not None:
            closed()
        if rows:
            yield gathered(rows)

    def gathered(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    turns = read_turns(spark, path, ranks_path, control)
    streamed = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return streamed.mapInArrow(fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_digest(turns: DataFrame, ranks_path: str) -> DataFrame:
    """Format turns and read them back."""
    path = fresh_path(turns.sparkSession, "chats")
    write_chats(turns, path, ranks_path)
    return chat_digest(turns.sparkSession, path, ranks_path)


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS own(i, r)),
sized AS (
  SELECT *, length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10))
    + length(regexp_replace(text, '<\\*\|(im_start|im_end|endoftext)\|>', '_\0', 'g'))
    + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<\\*\|(im_start|im_end|endoftext)\|>', '_\0', 'g')) AS size
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
