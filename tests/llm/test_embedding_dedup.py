import random

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import embedding_dedup as ed
from folioflow.llm.components import connected_components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, cell int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(np.float32(x) != 0 for x in v)


def brute(rows, threshold=0.9):
    vectors = [np.array(v, np.float32).astype(float) if usable(v) else None for _, v, *_ in rows]
    n = len(rows)
    adjacent = [[j for j in range(n) if j != i and vectors[i] is not None and vectors[j] is not None and len(vectors[i]) == len(vectors[j]) and vectors[i] @ vectors[j] / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j]) >= threshold] for i in range(n)]
    out = []
    for i in range(n):
        if rows[i][0] is None:
            out.append((None, len(adjacent[i]), None, True))
            continue
        seen, todo = {i}, [i]
        while todo:
            for j in adjacent[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(rows[j][0] for j in seen if rows[j][0] is not None)
        out.append((rows[i][0], len(adjacent[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def data(n=500, wide=8):
    rng = np.random.default_rng(4)
    out = []
    for i in range(n):
        v = rng.normal(size=wide) if i % 3 or i < 10 else np.array(out[rng.integers(i)][1]) + rng.normal(size=wide) * rng.uniform(0, 0.4)
        out.append((i * 7 % n, v.tolist(), 0, "x", 1))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_matches_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(ed, "BLOCK_ROWS", 20)
        monkeypatch.setattr(ed, "CELLS_BY_ROOT", 1)
    rows = data()
    rows += [(1000 + i, rows[3][1], 0, "x", 1) for i in range(80)]
    got = ed.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_cells_follow_the_size():
    assert [ed.cell_number(n, 64, ed.SAMPLE) for n in (0, 1, 200, 500, 2000, 10_256, 51_282, 10**6, 10**9)] == [1, 1, 2, 3, 6, 13, 29, 125, 2048]
    assert [ed.cell_number(10_256, 64, ed.SAMPLE, m) for m in ed.MULTIPLES] == [13, 26, 52, 104, 208]
    assert ed.cell_number(10**9, 10_000, ed.SAMPLE) == 400 and ed.cell_number(500, 64, 2) == 1
    assert [ed.block_rows(n, 64) for n in (1, 10**6, 10**9)] == [4096, 4096, 62_500] and ed.block_rows(5, 10**7) == 1


def clustered(n, wide, clusters, spread, seed=2):
    rng = np.random.default_rng(seed)
    return ed.units(rng.normal(size=(clusters, wide))[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, wide)))


def shares(centres, x):
    """Copies of the vectors by all there could be, and pairs that meet by all pairs."""
    fit = x @ centres.T
    home = fit.argmax(axis=1)
    reach = np.full(len(centres), 2.0)
    np.minimum.at(reach, home, fit[np.arange(len(x)), home])
    goes = ed.could_link(centres, reach, fit, home, 0.9)
    homes = np.bincount(home, minlength=len(centres))
    return goes.sum() / (home + 1).sum(), (homes * (homes / 2 + goes.sum(axis=0) - homes)).sum() / (len(x) ** 2 / 2)


@pytest.mark.parametrize(("n", "clusters", "spread"), [(2000, 40, 0.3), (8000, 150, 0.4), (8000, 20, 0.2)])
def test_cells_of_clustered_vectors_exclude_most_work(n, clusters, spread):
    x = clustered(n, 64, clusters, spread)
    centres = ed.choose_cells(x, n, 0.9)
    copies, pairs = shares(centres, x)
    assert len(centres) > ed.cell_number(n, 64, n) or clusters < 30
    assert copies < 0.5 and pairs < 0.2
    # without centroids all vectors are in one cell and meet
    assert shares(np.zeros_like(centres), x)[1] > 0.9


def test_cells_of_scattered_vectors_stay_few():
    x = ed.units(np.random.default_rng(1).normal(size=(4000, 64)))
    assert len(ed.choose_cells(x, 4000, 0.9)) == ed.cell_number(4000, 64, 4000)


def test_clustered_vectors_match_brute_force(spark):
    x = clustered(1500, 16, 30, 0.25)
    got = ed.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0, "x", 1) for i, v in enumerate(x)], SCHEMA))
    near = np.array(x, np.float32).astype(float)
    near = ed.units(near) @ ed.units(near).T >= 0.9
    assert {r.vec_id: r.n_links for r in got.collect()} == {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1))}


def test_scattered_vectors_travel_to_few_groups():
    """Before cells shared groups, 615,384 vectors of this kind were shuffled as more than a hundred times as many rows."""
    x = ed.units(np.random.default_rng(1).normal(size=(4000, 64)))
    rows, _ = ed.work(ed.spherical_kmeans(x[:2000], 250), x[2000:], 615_384, 0.9)
    assert rows < 20 * 615_384


def test_many_cells_make_no_large_arrays():
    """A batch's cosines and rows come in slices: at 307,692 vectors a task held 3.8 GB of them."""
    x = ed.units(np.random.default_rng(1).normal(size=(3000, 64)))
    cells = {64: ed.spherical_kmeans(x, 600, rounds=1)}
    n = pa.array(np.arange(3000))
    batch = pa.RecordBatch.from_arrays([n, n, n, n, pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32())), pa.array([64] * 3000, pa.int32())], names=["h1", "h2", "rep", "copies", "v", "wide"])
    assert max(fit.size for _, _, fit, _ in ed.near_cells(batch, cells)) <= 1_000_000
    group, blocks = ed.grouped(np.full(600, 5), 50)
    assert group.tolist() == [c // 10 for c in range(600)] and blocks.tolist() == [1] * 60
    reach = np.full(600, 0.1)
    out = list(ed.dealing(cells, {64: reach}, {64: group}, 0.9)([batch]))
    assert max(b.num_rows for b in out) * 64 <= 1_000_000
    goes = ed.could_link(cells[64], reach, x.astype(np.float32) @ cells[64].T, (x.astype(np.float32) @ cells[64].T).argmax(axis=1), 0.9)
    assert sum(b.num_rows for b in out) == sum(len(set((np.flatnonzero(g) // 10).tolist())) for g in goes)


def test_large_cells_stand_alone_in_blocks():
    group, blocks = ed.grouped(np.array([5, 0, 30, 0, 90, 8, 40, 0]), 40)
    assert group.tolist() == [0, 0, 0, 0, 1, 2, 3, 3] and blocks.tolist() == [1, 3, 1, 1]


@pytest.mark.parametrize(("wide", "spread", "threshold"), [(2, 1.0, 0.9), (3, 0.3, 0.9), (8, 0.2, 0.9), (8, 1.0, 0.5)])
def test_bounds_lose_no_link(wide, spread, threshold):
    """Partners meet in the lower of their cells; vectors around few centres are guests of few cells."""
    rng = np.random.default_rng(wide)
    x = ed.units(rng.normal(size=(12, wide))[rng.integers(12, size=600)] + spread * rng.normal(size=(600, wide)))
    centres = ed.spherical_kmeans(x, 12)
    fit = x @ centres.T
    home = fit.argmax(axis=1)
    reach = np.array([fit[home == c, c].min(initial=2.0) for c in range(12)])
    goes = ed.could_link(centres, reach, fit, home, threshold)
    i, j = np.nonzero(x @ x.T >= threshold)
    lower = np.minimum(home[i], home[j])
    assert goes[i, lower].all() and goes[j, lower].all()
    if wide == 8 and spread < 0.5:
        assert goes.sum() < 2.5 * len(x)


def test_cases(spark):
    rows = data(40) + [(100, None, 0, "x", 1), (101, [], 0, "x", 1), (102, [0.0] * 8, 0, "x", 1), (103, [None] * 8, 0, "x", 1), (104, [float("nan")] * 8, 0, "x", 1), (105, [float("inf")] * 8, 0, "x", 1), (106, [1.0, 1.0], 0, "x", 1), (107, [2.0, 2.1], 0, "x", 1), (None, [0.5, 0.5], 0, "x", 1)]
    rows.append(rows[0])
    got = sorted(map(tuple, ed.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_agrees(spark):
    import duckdb

    rows = data(150)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [r[:2] for r in rows])
    assert sorted(con.execute(ed.SQL).fetchall(), key=str) == brute(rows)


def test_components(spark):
    rng = random.Random(7)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)] + [(500, x) for x in range(501, 560)] + [(9, 9)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
