import math

import numpy as np
import pytest

from folioflow.llm import bitslice_topk as bt

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def brute(rows, k=5):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in whole:
        if i % 50 == 0:
            hold = lambda s: min(max(s, bt.LIMITS[0]), bt.LIMITS[1])
            scores = sorted((-hold(sum(a * b for a, b in zip(q, v, strict=True))), j) for j, v in whole if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, bt.top_k(df, df.where("vec_id % 50 = 0")).collect()))


def data(n=700, wide=12, scale=0.4):
    rng = np.random.default_rng(2)
    return [(i, rng.normal(0, scale, wide).tolist(), 0, "x") for i in range(n)]


def test_matches_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bt, "BLOCK_ROWS", 100)
    rows = data()
    rows += [(1000 + i, rows[0][1], 0, "x") for i in range(60)] + [(2000 + i, [0.0] * 12, 0, "x") for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_blocks_grow_with_the_rows():
    assert [bt.block_rows(n, 64) for n in (1, 51_282, 10**8, 10**10)] == [8192, 8192, 80_000, 125_000] and bt.block_rows(1, 10**8) == 1


def test_queries_that_repeat_an_id(spark):
    rows = data(60)
    df = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([rows[0], rows[0], (50, rows[50][1], 0, "x")], SCHEMA)
    assert sorted(map(tuple, bt.top_k(df, asked).collect())) == brute(rows)
    both = spark.createDataFrame([rows[0], (0, rows[1][1], 0, "x")], SCHEMA)
    found = bt.top_k(df, both).collect()
    assert sorted(r["rank"] for r in found) == [1, 2, 3, 4, 5] and all(r.vec_id != 0 for r in found)


def test_cases(spark):
    rows = data(30) + [(100, None, 0, "x"), (150, [None] + [0.1] * 11, 0, "x"), (200, [float("nan")] * 12, 0, "x"), (201, [float("inf")] * 12, 0, "x"), (250, [], 0, "x"), (300, [], 0, "x"), (350, [1.0, 2.0], 0, "x"), (None, [0.1] * 12, 0, "x"), (400, [1e6] * 12, 0, "x"), (450, [1e30] * 12, 0, "x"), (451, [-1e-9] * 12, 0, "x")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", range(8))
def test_sums_and_boundary(seed):
    rng = np.random.default_rng(seed)
    values, query = rng.integers(-200, 200, (150, 7)), rng.integers(-90, 90, 7)
    block = bt.Block(np.arange(150), values)
    total = block.sums(query)
    high = (values >> bt.SHIFT) - block.least
    want = (np.where(query < 0, (1 << block.bits) - 1 - high, high) * np.abs(query)).sum(axis=1)
    got = sum(np.unpackbits(x.view(np.uint8), bitorder="little")[:150].astype(np.int64) << b for b, x in enumerate(total))
    assert (got == want).all()
    kept = block.boundary(total, 5, 40, block.bitmap(np.arange(150) == 3))
    others = np.delete(want, 3)
    assert set(kept) == {i for i in range(150) if i != 3 and want[i] >= np.sort(others)[-5] - 40}


def test_sql_agrees(spark):
    import duckdb

    rows = data(120)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [r[:2] for r in rows])
    assert sorted(con.execute(bt.SQL).fetchall()) == brute(rows)
