"""Nearest neighbours by cosine: one-bit codes of randomly rotated vectors choose what is compared exactly."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How many standard errors an estimate may be off before a neighbour could be missed.
SURE = 4.0
#: Vectors and queries of a block; a task compares one block with another. Queries are few, so that vectors have few copies.
VECTORS, QUERIES = 8192, 16384
#: Best estimates that are compared first, to know what the others must reach.
FIRST = 32

ROWS = "vec_id long, size int, vector binary, code binary, length double, grip double"


@functools.lru_cache(4)
def rotation(size: int) -> np.ndarray:
    """A fixed random rotation of that many dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, size, vector (doubles), code (the signs of the rotated vector, packed), length, grip (inner product of the
    rotated unit vector with the unit vector of its signs: what an estimate is divided by). Rows without vec_id and vectors
    that are null, empty or zero or hold null or non-finite components are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, tuple[list[int], list[np.ndarray]]] = {}
            for vec_id, x in zip(batch.column("vec_id").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                if vec_id is not None and x and None not in x:
                    vector = np.array(x, np.float64)
                    if np.isfinite(vector).all() and vector.any():
                        ids, rows = by_size.setdefault(len(x), ([], []))
                        ids.append(vec_id)
                        rows.append(vector)
            for size, (ids, rows) in by_size.items():
                matrix = np.stack(rows)
                largest = np.abs(matrix).max(axis=1)  # first, so that squares of tiny or huge components don't vanish or overflow
                length = largest * np.sqrt(np.einsum("ij,ij->i", matrix / largest[:, None], matrix / largest[:, None]))
                turned = (matrix / length[:, None]) @ rotation(size)
                grip = np.abs(turned).sum(axis=1) / np.sqrt(size)
                codes = np.packbits(turned > 0, axis=1)
                columns = [pa.array(ids, pa.int64()), pa.array(np.full(len(ids), size, np.int32)), pa.array([x.tobytes() for x in matrix], pa.binary()), pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(length), pa.array(grip)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "size", "vector", "code", "length", "grip"])

    return vectors.select("vec_id", F.col(column).alias("vector")).mapInArrow(run, ROWS)


def _columns(table: pa.Table, size: int) -> tuple[np.ndarray, ...]:
    vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(-1, size)
    return table.column("vec_id").to_numpy(), vectors, table.column("length").to_numpy(), table.column("grip").to_numpy()


def cosines(query: np.ndarray, length: float, vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """In double precision; the same for equal vectors, wherever they stand."""
    return np.einsum("ij,j->i", vectors, query) / (lengths * length)


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            size = left.column("size")[0].as_py()
            right = right.sort_by("vec_id")
            ids, vectors, lengths, grips = _columns(right, size)
            # Of equal vectors, the k + 1 smallest ids can be among the nearest; they are compared as one.
            _, first, same = np.unique(vectors.view(f"V{8 * size}").ravel(), return_index=True, return_inverse=True)
            order = np.argsort(same, kind="stable")
            begin = np.searchsorted(same[order], np.arange(len(first) + 1))
            signs = np.unpackbits(np.frombuffer(b"".join(right.column("code").take(pa.array(first)).to_pylist()), np.uint8).reshape(len(first), -1), axis=1)[:, :size].astype(np.float32) * 2 - 1
            vectors, lengths, grips = vectors[first], lengths[first], grips[first]
            query_ids, queries, query_lengths, _ = _columns(left, size)
            turned = ((queries / query_lengths[:, None]) @ rotation(size)).astype(np.float32)
            slack = SURE * np.sqrt(np.maximum(0, 1 - grips**2)) / (grips * np.sqrt(max(size - 1, 1))) + 1e-5
            for q in range(len(query_ids)):
                guess = signs @ turned[q] / (np.sqrt(size) * grips)
                near = np.argpartition(-guess, FIRST)[:FIRST] if len(guess) > FIRST else np.arange(len(guess))
                score = cosines(queries[q], query_lengths[q], vectors[near], lengths[near])
                if len(guess) > FIRST:
                    enough = np.partition(score, -k - 1)[-k - 1]  # k + 1 different vectors: the query's own may be one
                    more = np.setdiff1d(np.flatnonzero(guess + slack >= enough), near)
                    near = np.concatenate([near, more])
                    score = np.concatenate([score, cosines(queries[q], query_lengths[q], vectors[more], lengths[more])])
                best = []
                floor = np.sort(score)[-k - 1] if len(score) > k else -np.inf
                for j in np.flatnonzero(score >= floor):
                    group = near[j]
                    best += [(-score[j], int(i)) for i in ids[order[begin[group] : begin[group + 1]][: k + 1]] if i != query_ids[q]]
                for negative, i in sorted(best)[:k]:
                    out[0].append(int(query_ids[q]))
                    out[1].append(i)
                    out[2].append(float(-negative))
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def search(queries: DataFrame, vectors: DataFrame, n_queries: int, n_vectors: int, k: int = 5, column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query the k nearest vectors by cosine, nearest first, ties to the
    smaller vec_id, without those of its own vec_id; all if there are fewer. Vectors that encode() leaves out take no part,
    and vectors of different lengths don't meet. Rows that repeat a vec_id count once, by their best vector.
    n_queries, n_vectors: about how many there are, to choose the numbers of blocks.

    Every block of queries meets every block of vectors: codes give estimates with error bounds, only vectors that could be
    among the nearest by their bound are compared exactly, and each meeting returns its k best."""
    blocks, query_blocks = max(1, -(-n_vectors // VECTORS)), max(1, -(-n_queries // QUERIES))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")))

    left = dealt(encode(queries, column), "query_block", query_blocks, "block", blocks)
    right = dealt(encode(vectors, column), "block", blocks, "query_block", query_blocks)
    keys = ["size", "query_block", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score double")
    ranked = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
