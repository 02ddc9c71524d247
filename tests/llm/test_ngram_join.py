import random
from fractions import Fraction

import numpy as np
import pytest

from folioflow.llm import ngram_join as nj
from folioflow.llm.shingles import shingle_sets, word_hashes

SCHEMA = "doc_id long, text string, n_links string, row int, source string"


def sets_of(text, width=5):
    words = "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in (text or "").lower()).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set()


def brute(rows, threshold=Fraction(4, 5)):
    sets = [sets_of(t) for _, t, *_ in rows]
    n = len(rows)
    adjacent = [[j for j in range(n) if j != i and sets[i] and sets[j] and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in adjacent[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(adjacent[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def data(n=160):
    rng = random.Random(11)
    out = []
    for i in range(n):
        if i % 2 and i > 8:
            words = out[rng.randrange(i)][1].split(" ")
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
        else:
            words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 6, 30, 80, 200]))]
        out.append((i * 31 % 1009, " ".join(words), "x", 1, "s"))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(nj, "BUCKET_BLOCK", 3)
        monkeypatch.setattr(nj, "CLUSTER_BLOCK", 3)
    base = "one two three four five six seven eight nine ten " * 4
    rows = data()
    rows += [(2000 + i, f"{base} tail{i}", "x", 1, "s") for i in range(25)] + [(3000 + i, rows[0][1].upper() + " ", "x", 1, "s") for i in range(9)]
    rows += [(4000, None, "x", 1, "s"), (4001, "", "x", 1, "s"), (4002, " \n\t", "x", 1, "s"), (None, "null id here is one", "x", 1, "s"), (4003, "null id HERE is one", "x", 1, "s"), (5, "é " * 20_000, None, None, None), rows[7]]
    got = nj.jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_links, r.class_id) for r in got), key=str) == brute(rows)
    kept = nj.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in kept if r.text and r.text.strip()} == {c for d, _, c in brute(rows) if c not in (4000, 4001, 4002)}
    assert len(kept) == len({r.doc_id for r in kept}) and list(kept[0].asDict()) == ["doc_id", "text", "n_links", "row", "source"]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nj.jaccard_groups(empty).count() == 0 and nj.keep_one(empty).count() == 0


def test_posterior_bounds():
    least = nj.least_matches(Fraction(4, 5))
    assert list(least) == list(range(16, 129, 16)) and all(0 < least[n] < 0.8 * n for n in least)
    rng = np.random.default_rng(0)
    lost = sum((rng.random((20_000, 128)) < 0.8).cumsum(axis=1)[:, n - 1].__lt__(m).sum() for n, m in least.items())
    assert lost == 0


def test_shingles_follow_words():
    texts = ["a b c d e f", "A  b\nc d e", None, "", "b c d e f", "a", "a a", "e f", "x" * 5000, "b c d e f"]
    _, counts = word_hashes(texts)
    assert counts.tolist() == [6, 5, 0, 0, 5, 1, 2, 2, 1, 5]
    sets = [set(s.tolist()) for s in shingle_sets(texts, 5)]
    assert len(sets[0]) == 2 and sets[1] < sets[0] and sets[4] < sets[0] and sets[4] == sets[9] and len(set(map(frozenset, sets))) == 8


def test_intersections_both_ways():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    i, j = np.triu_indices(30, 1)
    want = [len(set(sets[a]) & set(sets[b])) for a, b in zip(i, j, strict=True)]
    assert nj.intersections(sets, i, j).tolist() == want and nj.intersections(sets, i[:20], j[:20]).tolist() == want[:20]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2400]), np.unique(pool[600:])
    errors = [(nj.signature(a ^ np.uint64(k << 40)) == nj.signature(b ^ np.uint64(k << 40))).mean() - 0.6 for k in range(40)]
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
