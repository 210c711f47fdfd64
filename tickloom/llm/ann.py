"""Nearest neighbours by inner product, from balanced posting lists.

Every vector is put on a sphere: divided by the largest norm, and completed by one
component to length one, so that the largest inner product is the smallest distance.
Centroids are fitted on a bounded sample and linked to a neighbour graph held in memory;
a beam search on it finds the centroids near a vector. A vector is entered in the
list of its nearest centroid and, as a boundary vector, in those of up to ``REPLICAS``
centroids that are hardly farther. A query reads the lists whose centroid is within
``PROBE`` times the distance of the nearest one, or of its ``LEAST`` nearest.

Lists are balanced: the fit splits large clusters again, and a list longer than
``LONGEST`` rows (copies of one vector, say) is dealt to several tasks, each of which
answers for its part. A query reads its ``FIRST`` nearest lists first; from the others it
takes only rows that reach the score of the last of its ``k`` best so far, which
loses none of the ``k`` nearest in the lists read. Scores are inner products of the
original vectors in double precision.

Defined results: vectors that are null, zero, or hold null or non-finite components,
and vectors whose length is not the most common one (the smaller of equals), take no
part; rows with a null id neither. Of rows with the same id and vector one counts, and
a query never finds its own id. Fewer candidates than ``k`` are all returned. Ties go
to the smaller id. Other columns of the input are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import in_share
from tickloom.session import durable

#: Rows the centroids are fitted on, rows a list should hold, and most centroids.
SAMPLE, PER_LIST, CENTROIDS = 20_000, 256, 2048
#: Lists a vector may be in, and how much farther than the nearest their centroids may be.
REPLICAS, BOUNDARY = 2, 1.05
#: Lists a query reads: within this distance ratio, and at least so many.
PROBE, LEAST = 1.20, 16
#: Lists that set the score the others must reach.
FIRST = 4
#: Links of a centroid in the graph, and width of the beam.
DEGREE, BEAM = 32, 96
#: Rows of a list one task answers for.
LONGEST = 2048


@dataclass
class Graph:
    """Centroids, the neighbours of each, and where a search begins."""

    points: np.ndarray
    links: np.ndarray
    entry: int

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids found for each vector, nearest first, and their distances.

        Best-first search for all vectors side by side: each expands its nearest
        centroid not yet expanded, until none is left in its beam.
        """
        n, count = len(vectors), len(self.points)
        beam = min(beam, count)
        ids = np.full((n, beam), -1, np.int32)
        dist = np.full((n, beam), np.inf)
        done = np.ones((n, beam), bool)
        seen = np.zeros((n, count), bool)
        ids[:, 0], done[:, 0], seen[:, self.entry] = self.entry, False, True
        dist[:, 0] = self._distance(vectors, np.full((n, 1), self.entry))[:, 0]
        active = np.arange(n)
        while len(active):
            open_ = np.where(done[active], np.inf, dist[active])
            best = open_.argmin(axis=1)
            left = np.isfinite(open_[np.arange(len(active)), best])
            active, best = active[left], best[left]
            if not len(active):
                break
            done[active, best] = True
            near = self.links[ids[active, best]]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            seen[active[:, None], near] |= fresh
            far = np.where(fresh, self._distance(vectors[active], near), np.inf)
            all_dist = np.concatenate([dist[active], far], axis=1)
            keep = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
            row = np.arange(len(active))[:, None]
            ids[active] = np.concatenate([ids[active], near], axis=1)[row, keep]
            done[active] = np.concatenate([done[active], ~fresh], axis=1)[row, keep]
            dist[active] = all_dist[row, keep]
        order = np.argsort(dist, axis=1, kind="stable")
        row = np.arange(n)[:, None]
        return ids[row, order], dist[row, order]

    def _distance(self, vectors: np.ndarray, near: np.ndarray) -> np.ndarray:
        dots = np.einsum("nd,nkd->nk", vectors, self.points[near])
        lengths = (self.points ** 2).sum(axis=1)[near]
        return np.sqrt(np.maximum((vectors ** 2).sum(axis=1)[:, None] - 2 * dots + lengths, 0.0))


def link(points: np.ndarray) -> Graph:
    """Graph over centroids: nearest neighbours, a ring to keep it connected, entry at the middle."""
    count = len(points)
    degree = min(DEGREE, count - 1)
    lengths = (points ** 2).sum(axis=1)
    links = np.full((count, max(degree, 1) + 1), -1, np.int32)
    for k in range(0, count, 512):
        dist = lengths[k:k + 512, None] - 2 * points[k:k + 512] @ points.T + lengths
        dist[np.arange(len(dist)), np.arange(k, k + len(dist))] = np.inf
        if degree:
            links[k:k + 512, :degree] = np.argsort(dist, axis=1, kind="stable")[:, :degree]
    if count > 1:
        links[:, -1] = (np.arange(count) + 1) % count
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    return Graph(points, links, entry)


def fit(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids by repeated splitting: the largest cluster is split until there are enough,
    then all are settled together. Splitting by size keeps the lists alike."""
    rng = np.random.default_rng(7)
    sample = np.unique(sample, axis=0)
    lists = min(lists, len(sample))
    groups = [np.arange(len(sample))]
    while len(groups) < lists:
        groups.sort(key=len)
        group = groups.pop()
        part = sample[group]
        ends = part[rng.choice(len(part), 2, replace=False)]
        side = part @ (ends[1] - ends[0])
        for _ in range(4):
            right = side > np.median(side)
            if right.all() or not right.any():
                break
            axis = part[right].mean(axis=0) - part[~right].mean(axis=0)
            side = part @ axis
        order = np.argsort(side, kind="stable")
        half = len(order) // 2
        groups += [group[order[:half]], group[order[half:]]]
    points = np.stack([sample[g].mean(axis=0) for g in groups])
    for _ in range(rounds):
        near = np.concatenate([
            ((points ** 2).sum(axis=1) - 2 * sample[k:k + 4096] @ points.T).argmin(axis=1)
            for k in range(0, len(sample), 4096)
        ])
        sums = np.zeros_like(points)
        np.add.at(sums, near, sample)
        sizes = np.bincount(near, minlength=len(points))
        points = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], points)
    return points


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v, norm`` of the vectors that take part, one row for each id and vector."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    clean = (
        rows.filter(F.col(id_col).isNotNull() & v.isNotNull())
        .filter(F.coalesce(fine, F.lit(False)))
        .select(F.col(id_col).cast("bigint").alias("id"), v.cast("array<double>").alias("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
        .filter("norm > 0").dropDuplicates(["id", "v"])
    )
    return durable(clean)


def _lifted(matrix: np.ndarray, largest: float) -> np.ndarray:
    unit = matrix / largest
    rest = np.sqrt(np.maximum(1.0 - (unit ** 2).sum(axis=1), 0.0))
    return np.concatenate([unit, rest[:, None]], axis=1)


def _turned(matrix: np.ndarray) -> np.ndarray:
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.concatenate([unit, np.zeros((len(unit), 1))], axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _place(rows: DataFrame, shared: Any, width: int, largest: float | None) -> DataFrame:
    """Each row of ``id, v`` once per list it belongs to (``largest`` given) or reads;
    ``place`` numbers the lists from the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph: Graph = shared.value
        for whole in batches:
            for start in range(0, len(whole), 1024):
                batch = whole.slice(start, 1024)
                matrix = _matrix(batch.column("v"), width)
                if largest is None:
                    ids, dist = graph.search(_turned(matrix), max(BEAM, len(graph.points) // 2))
                    take = dist <= dist[:, :1] * PROBE
                    take[:, :LEAST] = True
                else:
                    ids, dist = graph.search(_lifted(matrix, largest), 16)
                    take = dist <= dist[:, :1] * BOUNDARY
                    take[:, REPLICAS:] = False
                take &= ids >= 0
                row, col = np.nonzero(take)
                picked = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [picked.column("id"), picked.column("v"), pa.array(ids[row, col], pa.int32()),
                     pa.array(col, pa.int32())], ["id", "v", "list", "place"]
                )

    return rows.select("id", "v").mapInArrow(run, "id bigint, v array<double>, list int, place int")


def _answers(k: int, width: int) -> Any:
    def answer(key: Any, queries: pa.Table, members: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {"query_id": [], "vec_id": [], "score": []}
        if queries.num_rows and members.num_rows:
            ids = members.column("id").to_numpy()
            own = queries.column("id").to_numpy()
            bound = queries.column("bound").to_numpy()
            vectors, asked = _matrix(members.column("v"), width), _matrix(queries.column("v"), width)
            for s in range(0, len(asked), 256):
                rough = asked[s:s + 256] @ vectors.T
                rough[own[s:s + 256, None] == ids] = -np.inf
                for q, line in enumerate(rough):
                    cut = max(np.partition(line, -k)[-k] if len(line) > k else -np.inf, bound[s + q])
                    # the product of matrices may differ in the last digits: take those, too
                    near = np.flatnonzero((line >= cut - 1e-9 * max(1.0, abs(cut))) & np.isfinite(line)) \
                        if np.isfinite(cut) else np.flatnonzero(np.isfinite(line))
                    exact = (vectors[near] * asked[s + q]).sum(axis=1)
                    order = np.lexsort((ids[near], -exact))[:k]
                    out["query_id"].append(np.full(len(order), own[s + q]))
                    out["vec_id"].append(ids[near][order])
                    out["score"].append(exact[order])
        return pa.table({
            name: np.concatenate(parts) if parts else np.zeros(0, np.float64 if name == "score" else np.int64)
            for name, parts in out.items()
        })

    return answer


RESULT = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType()),
])


def search(
    rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
    per_list: int = PER_LIST,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of each query.

    ``is_query`` is a condition on the column ``id`` (the id of a row as a long).
    """
    spark = rows.sparkSession
    clean = usable(rows, id_col, vector_col)
    widths = clean.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width = widths[0]["w"] if widths else 1
    clean = clean.filter(F.size("v") == width)
    facts = clean.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("largest")).first()
    count, largest = facts["n"], facts["largest"] or 1.0
    # A sample of fixed size, chosen by a hash of the id.
    some = clean.select("v", F.xxhash64("id").alias("h"), "id")
    some = some.filter(in_share(F.col("h"), min(1.0, 1.2 * SAMPLE / max(count, 1))))
    taken = some.orderBy("h", "id").limit(SAMPLE).select("v")
    sample = _matrix(taken.toArrow().column("v"), width)
    lists = int(min(CENTROIDS, max(1, count // per_list)))
    points = fit(_lifted(sample, largest), lists) if len(sample) else np.zeros((1, width + 1))
    shared = spark.sparkContext.broadcast(link(points))  # CENTROIDS rows at most
    members = durable(_place(clean, shared, width, largest))
    sizes = members.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / LONGEST).cast("int").alias("parts"))
    sizes = F.broadcast(sizes)  # a row per centroid
    dealt = members.join(sizes, "list").select(
        "id", "v", "list", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int").alias("part")
    )
    asked = durable(_place(clean.filter(is_query), shared, width, None)).join(sizes, "list").select(
        "id", "v", "list", "place", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def answers(queries: DataFrame) -> DataFrame:
        return queries.groupBy("list", "part").cogroup(dealt.groupBy("list", "part")).applyInArrow(
            _answers(k, width), RESULT
        )

    def nearest(found: DataFrame) -> DataFrame:
        each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    none = F.lit(float("-inf"))
    first = durable(nearest(answers(
        asked.filter(F.col("place") < FIRST).select("id", "v", "list", "part", none.alias("bound"))
    )))
    reached = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("reached"))
    rest = answers(asked.filter(F.col("place") >= FIRST).join(reached, "id", "left").select(
        "id", "v", "list", "part", F.coalesce("reached", none).alias("bound")
    ))
    return nearest(first.select("query_id", "vec_id", "score").unionByName(rest)).select(
        "query_id", "rank", "vec_id", "score"
    )
