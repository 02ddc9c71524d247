import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from folioflow.llm import merkle_manifest as merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, hash string, salt long, pos long"


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels(hashes, arity):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def way(grown, pos, arity):
    """(left, right) siblings of a node, level by level."""
    out = []
    for level in grown[:-1]:
        first = pos - pos % arity
        run = level[first : first + arity]
        out.append((run[: pos - first], run[pos - first + 1 :]))
        pos //= arity
    return out


def plain(rows, arity=2):
    """Every proof by whole trees on one machine."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = levels([leaf(r) for r in by_lang[lang]], arity)
    top = levels([trees[x][-1][0] for x in langs], arity) if langs else []
    out = []
    for i, lang in enumerate(langs):
        for pos, r in enumerate(by_lang[lang]):
            path = way(trees[lang], pos, arity) + way(top, i, arity)
            claimed = r if r[0] is None or r[3] is None or zlib.crc32(str(r[0]).encode()) % 7 else (*r[:3], r[3] + 1, r[4])
            h = leaf(claimed)
            for left, right in path:
                h = sha(*left, h, *right)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[lang][-1][0], root, sha(*(x for a, b in path for x in a + b)), h, h == root))
    return sorted(out, key=str)


def proofs(spark, rows):
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, merkle.manifest_digest(docs).collect()), key=str)


AWKWARD = [
    *[(i, f"s{i % 3}", "en", i * 5, f"text {i}") for i in range(-2, 70)],
    *[(7, "s", "en", 1, "again")] * 3,
    *[(i, None, "de", None, "é" * i) for i in range(33)],
    (None, None, None, None, None), (None, "s", None, 3, ""), (5, "s", "", 9, ""), (5, "-", "ü", (1 << 63) - 1, "x" * 200_000), (3, "s", "zz", 0, None),
]


@pytest.mark.parametrize("rows", [AWKWARD, [], [(7, "a", "en", 3, "one")], [(i, "a", None, i, "t") for i in range(64)]])
def test_proofs_are_those_of_whole_trees(spark, rows):
    got = proofs(spark, rows)
    assert got == plain(rows)
    assert {r[-1] for r in got if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7} <= {True}


def test_other_runs_and_blocks_give_the_same_as_whole_trees(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"t{i}") for i in range(100)]
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)
    more = F.col("n_chars") + 1
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    for arity, band in ((3, 2), (2, 1), (4, 3)):
        found = merkle.build(docs, claims={"n_chars": more}, claimed=hit, arity=arity, band=band).proofs()
        assert sorted(map(tuple, found.collect()), key=str) == plain(rows, arity)


def test_a_manifest_holds_preimages_in_bounded_blocks(spark):
    rows = [(1, "s", "en", 1, "same")] * 500 + [(i, "s", "de", 1, "x") for i in range(9)]
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)
    made = merkle.build(docs)
    bands = [b.collect() for b in made.bands("trees")]
    assert [len(b) for b in bands] == [16 + 1, 1]
    for b in bands:
        for row in b:
            assert len(row.preimages) <= merkle.BAND
            assert all(len(p) in (64, 128) for level in row.preimages for p in level)
            # a parent's hash is in its own parent's preimage
            for low, high in zip(row.preimages[:-1], row.preimages[1:], strict=True):
                assert "".join(high) == "".join(sha(p) for p in low)
    # rows of one id and one text fill places of their own
    assert made.read("leaves").where("tree = '=en'").select("pos").distinct().count() == 500
    assert made.proofs().where("not verified").count() == 0
