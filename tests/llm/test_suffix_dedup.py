import gc
import hashlib
import random
import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import suffix_dedup as sd
from folioflow.llm.suffix_order import PrefixHash, equal_groups, suffix_order

SCHEMA = "doc_id long, text string, unit int, data string"


def brute(rows, length=400):
    raw = [(t or "").encode() for _, t, *_ in rows]
    seen = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (doc_id, *_), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone[:-1].tolist(), strict=True) if not g)
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def data():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(70, 200)) for _ in range(8)]
    rows = []
    for i in range(60):
        t = text(rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) - 300))
            t += p[a : a + rng.randint(380, 700)] + text(rng.randint(0, 30))
        rows.append((i, t, 1, "x"))
    rows += [(100 + i, text(5) + passages[0] + text(5), 1, "x") for i in range(40)]
    for i in range(12):
        t = list(rows[i][1])
        for _ in range(2):
            if t:
                t[rng.randrange(len(t))] = "#"
        rows.append((200 + i, "".join(t), 1, "x"))
    rows += [(300, "ab" * 600, 1, "x"), (301, "be " * 500, 1, "x"), (302, "z" * 400, 1, "x"), (303, "z" * 399, 1, "x"), (304, "q" * 401, 1, "x"), (305, None, 1, "x"), (306, "", 1, "x"), (None, "null id", 1, "x"), rows[3], (307, text(3000) * 2, None, None)]
    return rows


@pytest.mark.parametrize(("unit_bytes", "bucket_bytes"), [(3000, 400), (1_000_000, 4_000_000)])
def test_matches_brute_force(spark, monkeypatch, unit_bytes, bucket_bytes):
    monkeypatch.setattr(sd, "UNIT_BYTES", unit_bytes)
    monkeypatch.setattr(sd, "BUCKET_BYTES", bucket_bytes)
    rows = data()
    got = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA), others=(280,))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_in_280"]
    found = sorted(map(tuple, got.collect()), key=str)
    assert [x[:5] for x in found] == brute(rows)
    assert sorted(((x[0], x[5]) for x in found), key=str) == sorted(((x[0], x[2]) for x in brute(rows, 280)), key=str)


def test_suffix_order_decides(monkeypatch):
    """Within a unit, repeats are found by the suffix order and by nothing else."""
    rows = data()
    assert unit_results(rows) == [x[1:5] for x in brute_in_order(rows)]
    monkeypatch.setattr("folioflow.llm.suffix_order.suffix_order", lambda hashes, starts, limit: starts[np.argsort(starts * 7919 % 1000003)])
    assert unit_results(rows) != [x[1:5] for x in brute_in_order(rows)]


def brute_in_order(rows):
    found = {str(x[0]): [] for x in brute(rows)}
    for x in brute(rows):
        found[str(x[0])].append(x)
    return [found[str(r[0])].pop(0) for r in rows]


def unit_results(rows):
    """What one unit that is told nothing by others says, level by level."""
    raw = [(t or "").encode() for _, t, *_ in rows]
    unit = sd.Unit(b"".join(raw), np.cumsum([len(x) for x in raw]).tolist(), (400,))
    windows = unit.windows[0]
    for level in range(3):
        keys, values = windows.records(level)
        windows.answer(level, ((keys["least"] != keys["most"]).astype(np.uint8), values["local"] + np.uint8(2)))
    return [x[:4] for x in unit.results()]


def test_units_are_freed_without_the_garbage_collector():
    """A unit that its windows point back to stays until a full collection, which a task of large arrays hardly ever has."""
    raw = [(t or "").encode() for _, t, *_ in data()]
    gc.disable()
    try:
        unit = sd.Unit(b"".join(raw), np.cumsum([len(x) for x in raw]).tolist(), (400, 280))
        for level in range(3):
            for windows in unit.windows:
                keys, values = windows.records(level)
                windows.answer(level, ((keys["least"] != keys["most"]).astype(np.uint8), values["local"] + np.uint8(2)))
        unit.results()
        gone = [weakref.ref(unit), *(weakref.ref(x) for x in (*unit.windows, unit.hashes))]
        del unit, windows
        assert [x() for x in gone] == [None] * 4
    finally:
        gc.enable()


def test_colliding_hashes_are_settled_by_bytes(monkeypatch):
    hashes = PrefixHash(np.frombuffer(b"abcdabcxabcdabcy" * 4, np.uint8))
    monkeypatch.setattr(PrefixHash, "of", lambda self, start, end: np.zeros(np.broadcast(start, end).shape, np.uint64))
    starts, lengths = np.array([0, 4, 8, 12, 16, 20, 24, 28]), np.full(8, 4)
    assert equal_groups(hashes, starts, lengths).tolist() == [0, 1, 0, 3, 0, 1, 0, 3]


def test_empty(spark):
    assert sd.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_and_groups(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 97 + 1 + seed, 900).astype(np.uint8)
    data[500:800] = data[100:400]
    hashes, raw = PrefixHash(data), data.tobytes()
    starts = rng.permutation(900)[:300]
    want = sorted(starts.tolist(), key=lambda s: (raw[s : s + 120], s))
    assert suffix_order(hashes, starts, 120).tolist() == want
    lengths = rng.integers(1, 60, 300)
    lengths = np.minimum(lengths, 900 - starts)
    groups = equal_groups(hashes, starts, lengths)
    strings = [raw[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    assert all(strings[i] == strings[g] for i, g in enumerate(groups.tolist())) and len(set(groups.tolist())) == len(set(strings))


def test_documents_that_share_a_line_stand_together(spark):
    """Copies and passages dealt over many partitions meet in units, where the suffix order finds most of what is removed."""
    rng = random.Random(12)
    line = lambda: "".join(rng.choice("abcdefghij klm") for _ in range(120))
    shared = ["\n".join(line() for _ in range(6)) for _ in range(8)]
    rows = [(i, shared[i % 8] + "\n" + line() if i % 3 else line()) for i in range(240)] + [(i, None) for i in range(240, 250)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    placed = sd.brought_together(docs, 3).withColumn("part", F.spark_partition_id()).collect()
    assert sorted(r.doc_id for r in placed) == list(range(250)) and len({r.part for r in placed}) == 3
    found, all_ = 0, sum(r.n_removed for r in sd.remove_repeats(docs).collect())
    for part in range(3):
        raw = [(r.text or "").encode() for r in placed if r.part == part]
        windows = sd.Unit(b"".join(raw), np.cumsum([len(x) for x in raw]).tolist(), (400,)).windows[0]
        heads, of_value, n, *_ = windows.places(0)
        twice = n[of_value] > 1
        np.add.at(windows.removed, windows.items[1][twice], 1)
        np.add.at(windows.removed, windows.items[2][twice] + 400, -1)
        found += int(windows.gone.sum())
    assert found > 0.5 * all_ > 0


def test_suffix_order_is_that_of_the_suffixes():
    rng = np.random.default_rng(5)
    for alphabet, n, limit in ((2, 600, 50), (2, 600, 5), (1, 300, 40), (200, 900, 400), (3, 700, 8)):
        data = rng.integers(0, alphabet, n).astype(np.uint8)
        data[10:70] = data[200:260]
        starts = rng.permutation(n)[: n // 2]
        raw = data.tobytes()
        got = suffix_order(PrefixHash(data), starts, limit).tolist()
        assert got == sorted(starts.tolist(), key=lambda s: (raw[s : s + limit], s))
