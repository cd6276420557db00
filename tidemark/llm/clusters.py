"""Clusters around centroids of whole numbers, with an n-simplex projection that spares most exact distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Components of a vector that is kept, and what they are multiplied by before they are rounded down.
SIZE, SCALE = 64, 1024
#: Whole components are held to this, so that squared distances fit into 64 bits; it is reached by components of 131,072 or more.
MOST = 1 << 27
CLUSTERS, ROUNDS = 8, 10
#: Pivots at most, vectors that they are chosen among, and how high a pivot must stand over those before it, of its distance.
PIVOTS, CANDIDATES, LEAST_HEIGHT = 16, 64, 0.05
#: How far bounds on squared distances may be off by rounding, of the largest distance that enters them.
SLACK = 1e-6


def squares(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of whole numbers, exact."""
    apart = rows.astype(np.int64) - point
    return np.einsum("ij,ij->i", apart, apart)


@dataclass
class Simplex:
    """Pivots, of which the first is the origin, and the lower triangular matrix of the others' coordinates."""

    pivots: np.ndarray
    corners: np.ndarray

    @classmethod
    def among(cls, rows: np.ndarray, most: int = PIVOTS) -> Simplex:
        """Pivots far from one another: the first row, then whichever stands highest over the simplex so far."""
        simplex = cls(rows[:1].astype(np.int64), np.zeros((0, 0)))
        far = squares(rows, simplex.pivots[0])
        while len(simplex.pivots) < most:
            apexes = simplex.apexes(rows)
            heights = np.where(apexes[:, -1] >= LEAST_HEIGHT * np.sqrt(far), apexes[:, -1], 0.0)
            best = int(np.argmax(heights))
            if not heights[best] > 0:
                break
            corners = np.zeros((len(simplex.corners) + 1,) * 2)
            corners[:-1, :-1] = simplex.corners
            corners[-1] = apexes[best]
            simplex = cls(np.vstack([simplex.pivots, rows[best]]).astype(np.int64), corners)
        return simplex

    def apexes(self, rows: np.ndarray) -> np.ndarray:
        """Of each row the point that lies as far from the simplex's corners as the row from the pivots: coordinates within the
        simplex's space, from the distances alone, and its height over it."""
        distances = np.stack([squares(rows, x) for x in self.pivots], axis=1).astype(float)
        right = (distances[:, :1] - distances[:, 1:] + (self.corners**2).sum(axis=1)) / 2
        inside = np.linalg.solve(self.corners, right.T).T if len(self.corners) else np.empty((len(rows), 0))
        height = np.sqrt(np.maximum(distances[:, 0] - (inside**2).sum(axis=1), 0.0))
        return np.column_stack([inside, height])


def bounds(apexes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of rows from centres, by their apexes: heights on the same side, and on
    opposite sides of the simplex. Slack for rounding is taken off and put on."""
    inside = ((apexes[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(axis=2)
    low = inside + (apexes[:, None, -1] - centres[None, :, -1]) ** 2
    high = inside + (apexes[:, None, -1] + centres[None, :, -1]) ** 2
    slack = 1 + SLACK * np.maximum((apexes**2).sum(axis=1)[:, None], (centres**2).sum(axis=1)[None, :])
    return low - slack, high + slack


def nearest(rows: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row the nearest centroid (of equally near ones the first) and the squared distance, both exact; and how many
    exact distances that took. Only centroids whose lower bound doesn't lie above another one's upper bound are compared."""
    low, high = bounds(apexes, simplex.apexes(centroids))
    open_ = low <= high.min(axis=1, keepdims=True)
    best = np.full(len(rows), -1, np.int64)
    cluster = np.zeros(len(rows), np.int64)
    for c in range(len(centroids)):
        at = np.flatnonzero(open_[:, c])
        d = squares(rows[at], centroids[c])
        nearer = (best[at] < 0) | (d < best[at])
        best[at[nearer]], cluster[at[nearer]] = d[nearer], c
    return cluster, best, int(open_.sum())


def whole(vectors: DataFrame, column: str = "embedding", size: int = SIZE) -> DataFrame:
    """vec_id, parts (whole numbers) of the vectors that have size components, none null or non-finite."""
    x = F.col(column).cast("array<double>")
    finite = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    held = F.transform(x, lambda y: F.floor(F.greatest(F.least(y * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return vectors.where((F.size(column) == size) & finite).select("vec_id", held.alias("parts"))


def _rows(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _with_apexes(rows: DataFrame, simplex: Simplex, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.apexes(_rows(batch, "parts", size))
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(apexes) + 1) * apexes.shape[1], pa.int32()), pa.array(apexes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "apex"])

    return rows.mapInArrow(run, "vec_id long, parts array<int>, apex array<double>")


def _sums(rows: DataFrame, centroids: np.ndarray, simplex: Simplex, size: int) -> dict[int, list[int]]:
    """By cluster that has vectors the sums of their components and, last, how many there are; one row for each of these and
    task is summed up by Spark, k * (size + 1) reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), size + 1), np.int64)
        for batch in batches:
            own = _rows(batch, "parts", size)
            cluster, _, _ = nearest(own, _rows(batch, "apex", len(simplex.pivots)), centroids, simplex)
            for c in range(len(centroids)):
                mine = cluster == c
                total[c, :-1] += own[mine].sum(axis=0, dtype=np.int64)
                total[c, -1] += mine.sum()
        c, place = np.divmod(np.arange(total.size), size + 1)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(place), pa.array(total.ravel())], ["cluster", "place", "sum"])

    parts = rows.mapInArrow(run, "cluster long, place long, sum long")
    found = parts.groupBy("cluster", "place").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
    sums: dict[int, list[int]] = {}
    for x in found:
        sums.setdefault(x.cluster, [0] * (size + 1))[x.place] = int(x.sum)
    return {c: x for c, x in sums.items() if x[-1]}


def _assigned(rows: DataFrame, centroids: np.ndarray, simplex: Simplex, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, exact = nearest(_rows(batch, "parts", size), _rows(batch, "apex", len(simplex.pivots)), centroids, simplex)
            compared = np.zeros(batch.num_rows, np.int64)
            compared[:1] = exact
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(compared)], ["vec_id", "cluster", "distance", "compared"])

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long, compared long")


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 3, column: str = "embedding", size: int = SIZE) -> DataFrame:
    """Every vector of size components, none of which is null or non-finite: vec_id, cluster, distance (squared, from the final
    centroid), cluster_inertia, inertia, centroid_sha256. Components are made whole by floor(1024 * x). Centroids begin as
    the k vectors of the smallest sha256 of seed:vec_id; in each round every vector goes to the nearest (ties: the smaller
    number), and each centroid that has vectors becomes the floor of their mean. All in whole numbers, so that the result
    doesn't depend on how rows are dealt out.

    The vectors' distances from up to PIVOTS pivots are kept as apexes beside them; a round compares exactly only what their
    bounds leave open. Rows that repeat a vec_id count each; those of the same hash start in order of their components. Rows
    without vec_id take part but start last of all. Fewer than k vectors: as many centroids; none: no rows. Components of 131,072 or more in size are
    held to that; an inertia beyond 64 bits is null. Other columns aren't read."""
    spark = vectors.sparkSession
    kept = whole(vectors, column, size)
    own = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(F.asc_nulls_last(own), "parts").limit(max(k, CANDIDATES)).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    some = np.array([x.parts for x in first], np.int64)
    centroids, simplex = some[:k].copy(), Simplex.among(some)
    rows = saved(_with_apexes(kept, simplex, size))
    for _ in range(rounds):
        before = centroids.copy()
        for c, sums in _sums(rows, centroids, simplex, size).items():
            centroids[c] = [x // sums[-1] for x in sums[:-1]]
        if (before == centroids).all():
            break  # every further round would give the same
    done = saved(_assigned(rows, centroids, simplex, size))
    inertia = done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # k rows at most
    total = sum(int(x.own) for x in inertia)
    held = lambda x: x if x < 1 << 63 else None
    facts = [(x.cluster, held(int(x.own)), held(total), hashlib.sha256(",".join(map(str, centroids[x.cluster].tolist())).encode()).hexdigest()) for x in inertia]
    named = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(named), "cluster").select(*[x.split()[0] for x in RESULT.split(", ")], "compared")
