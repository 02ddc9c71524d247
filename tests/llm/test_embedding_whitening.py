import math
from fractions import Fraction

import numpy as np
import pytest

from folioflow.llm import embedding_whitening as white

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in rows], SCHEMA)


def plain(rows):
    """Whole-number vectors, their exact mean, and the covariance's eigenpairs by a dense solver."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    return kept, n, sums, values[::-1], vectors[:, ::-1], np.trace(cov)


def vectors(n, d, seed=3, clusters=9):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    return [(i, [float(c) for c in centres[i % clusters] + 0.3 * rng.normal(size=d) * (1 + np.arange(d))]) for i in range(n)]


@pytest.mark.parametrize("d", [24, 5])
def test_projections_are_those_of_a_dense_solver(spark, d):
    rows = vectors(300, d)
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(None, rows[1][1]), (5, rows[2][1])]
    rows += [(2000, None), (2001, []), (2002, [None] * d), (2003, [math.nan] * d), (2004, [math.inf] + [0.0] * (d - 1)), (2005, [1.0])]
    got = white.whiten(frame(spark, rows)).collect()
    kept, n, sums, values, vectors_, trace = plain([r for r in rows if r[1] and len(r[1]) == d])
    k = min(16, d)
    assert len(got) == len(kept) * k and {r.component for r in got} == set(range(1, k + 1))
    assert {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9
    found = {}
    for r in got:
        found.setdefault(r.component, []).append((r.vec_id is not None, r.vec_id or 0, float(r.deviation), r.whitened, r.explained))
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, sum((n * c - s) ** 2 for c, s in zip(r[1], sums, strict=True))))
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for _, x in kept])
    for j in range(k):
        mine = sorted(found[j + 1])
        assert [int(m[2]) for m in mine] == [sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for _, x in kept]
        want = centred @ vectors_[:, j] / math.sqrt(values[j])
        have = np.array([m[3] for m in mine])
        assert min(abs(have - want).max(), abs(have + want).max()) < 1e-8
        assert mine[0][4] == pytest.approx(values[j] / trace, rel=1e-9)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]])
def test_nothing_to_whiten_gives_no_rows(spark, rows):
    found = white.whiten(frame(spark, rows))
    assert found.collect() == [] and [f.name for f in found.schema] == [c.split()[0] for c in white.OUT.split(", ")]


def test_directions_without_spread_have_no_component(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-40, 40, size=(80, 3))
    rows = [(i, [float(c) / 64 for c in (*b, b[0] + b[1], 7)]) for i, b in enumerate(base)]
    got = white.whiten(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3}
    assert sum({r.component: r.explained for r in got}.values()) == pytest.approx(1, rel=1e-9)


def operator(values, seed=0):
    d = len(values)
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    matrix = (turn * values) @ turn.T
    return (matrix + matrix.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(50, 1, 300), np.concatenate([np.full(20, 9.0), np.full(280, 1.0)]), np.concatenate([np.full(3, 5.0), np.zeros(297)]), 0.8 ** np.arange(300), np.zeros(40),
])
def test_lanczos_finds_the_largest_eigenvalues(values):
    """Slow decay, more equal eigenvalues than a block holds, breakdown of a small range, fast decay, and the zero operator."""
    matrix, passes = operator(values), []

    def times(x):
        passes.append(x.shape[1])
        return matrix @ x

    got, found = white.block_lanczos(times, len(values), 16, limit=96)
    assert got == pytest.approx(np.sort(values)[::-1][:16], rel=1e-9, abs=1e-9)
    assert abs(found.T @ found - np.eye(16)).max() < 1e-9
    assert np.linalg.norm(matrix @ found - found * got, axis=0).max() <= 1e-9 * max(values.max(), 1e-9)


def test_large_numbers_stay_exact():
    centre = white.Centred(3_000_000_000, [3_000_000_000 * 1_000_000 + 7, -5])
    x = np.array([[1_000_000 + (1 << 44), -(1 << 45)], [1, 2]])
    want = [sum((3_000_000_000 * int(c) - s) ** 2 for c, s in zip(row, centre.sums, strict=True)) for row in x]
    assert [int(v) for v in white.squares(centre, x)] == want
