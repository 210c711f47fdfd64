import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, id string, v string, list string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        scores = (x * x[at]).sum(axis=1)
        keep = ids != q
        order = np.lexsort((ids[keep], -scores[keep]))[:k]
        out[q] = list(zip(ids[keep][order].tolist(), scores[keep][order].tolist()))
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall_against_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)) + 1.5 * rng.normal(size=(8, 16))[rng.integers(0, 8, 3000)]
    if scale:  # lengths differ: the largest product is not the nearest direction
        x *= rng.uniform(0.2, 3, size=(3000, 1))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    got = found(ann.search(frame(spark, rows), F.col("id") % 50 == 0, per_list=100))
    want = brute(rows, range(0, 3000, 50), 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    x = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}
    for q, answers in got.items():
        assert answers == sorted(answers, key=lambda a: (-a[1], a[0]))
        assert all(abs(s - x[i] @ x[q]) <= 1e-9 for i, s in answers)


def test_copies_of_one_vector_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ann, "LONGEST", 64)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(600)] + [(600 + i, [float(i), 1.0, -1.0]) for i in range(30)]
    got = found(ann.search(frame(spark, rows), F.col("id") < 3, per_list=50))
    want = brute(rows, range(3), 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
        (7, [1.0, 2.0, 3.0]), (None, [3.0, 3.0]), (8, [-1.0, 0.0]), (1, [0.5, 0.0]), (20, None), (40, []),
    ]
    got = found(ann.search(frame(spark, rows), F.col("id") % 20 == 0))
    assert got == {0: [(1, 0.5), (8, -1.0)]}


def test_nothing_to_search(spark):
    assert found(ann.search(frame(spark, []), F.col("id") >= 0)) == {}
    assert found(ann.search(frame(spark, [(1, [1.0, 1.0])]), F.col("id") >= 0)) == {}


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.default_rng(1)
    points, vectors = rng.normal(size=(500, 8)), rng.normal(size=(50, 8))
    ids, dist = ann.link(points).search(vectors, 96)
    exact = np.sqrt(((vectors[:, None] - points[None]) ** 2).sum(axis=2))
    near = np.argsort(exact, axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, near)]) >= 0.95
    assert (np.diff(dist, axis=1) >= 0).all()
