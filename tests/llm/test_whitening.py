import math

import numpy as np
import pytest

from tickloom.llm import whitening
from tickloom.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, x string, id string, component string, label int"


def table(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, v, "x", "x", "x", 1) for i, v in rows], SCHEMA)


def brute(rows, d, k=4):
    """By numpy's own eigensolver."""
    good = [(i, v) for i, v in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in good]
    fit = np.array(sorted({x for _, x in xs}), np.float64)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    mean = fit.sum(axis=0) / n
    cov = (fit - mean).T @ (fit - mean) / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    keep = e > 1e-9 * max(np.trace(cov), 1e-300)
    e, q = e[keep], q[:, keep]
    out = []
    for i, x in xs:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out.append((i, dev, ((np.array(x) - mean) @ q / np.sqrt(e)).tolist(), (e / np.trace(cov)).tolist()))
    return n, out


def by_id(got):
    found = {}
    for r in got:
        found.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    return found


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 12)) * np.linspace(3, 0.2, 12)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]  # copies weigh once
    n, want = brute(rows, 12)
    got = by_id(whitening.whiten(table(spark, rows)).collect())
    assert n == 300 and len(got) == 500
    signs = [None] * 4
    for i, dev, white, shares in want:
        for k in range(4):
            (r,) = got[i][k + 1]
            assert (r.n, r.deviation) == (n, dev)
            assert r.explained == pytest.approx(shares[k], rel=1e-9)
            if abs(white[k]) > 1e-3 and signs[k] is None:
                signs[k] = math.copysign(1, white[k] * r.whitened)
            assert r.whitened == pytest.approx((signs[k] or 1) * white[k], abs=1e-7)
            assert r.identity_error < 1e-9


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.0, -0.0, 1.0]), (2, [0.5, 0.25, 1.0]), (2, [0.5, 0.25, 1.0]), (None, [0.1, -0.9, 1.0])]
    bad = [(3, None), (4, []), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 2.0]), (7, [1.0, -inf, 2.0]), (8, [1.0, 2.0])]
    got = by_id(whitening.whiten(table(spark, good + bad)).collect())
    assert set(got) == {1, 2, None}
    # three points in a plane, one entry constant: two components
    assert set(got[1]) == {1, 2} and [len(got[2][k]) for k in (1, 2)] == [2, 2]
    assert got[1][1][0].n == 3


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whiten(table(spark, rows))
    assert got.count() == 0
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_extreme_entries(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    got = by_id(whitening.whiten(table(spark, rows)).collect())
    assert set(got) == {1, 2, 3} and all(r.deviation is None for r in got[1][1])


def test_deviation_beyond_a_batch_of_longs():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    assert whitening._deviations(x, 1000, [5, 6]) == [None, (3000 - 5) ** 2 + (4000 - 6) ** 2]


@pytest.mark.parametrize("seed", range(4))
def test_components_of_clustered_matrices(seed):
    rng = np.random.default_rng(seed)
    d = [20, 33, 2, 1][seed]
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = np.sort(rng.random(d))[::-1]
    values[: d // 2] = values[0] * (1 - 1e-12 * np.arange(d // 2))  # a cluster
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    e, v = whitening.leading(matrix, 4)
    assert e == pytest.approx(values[:4], rel=1e-12)
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-12
    assert np.abs(matrix @ v - v * e).max() < 1e-12


def test_sturm_count():
    rng = np.random.default_rng(5)
    a, b = rng.standard_normal(9), rng.standard_normal(8)
    b[3] = 0.0
    e = np.linalg.eigvalsh(np.diag(a) + np.diag(b, 1) + np.diag(b, -1))
    for at in np.linspace(-4, 4, 40):
        assert whitening.count_below(a, b, at) == (e < at).sum()
