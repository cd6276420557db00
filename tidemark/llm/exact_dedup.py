"""Exact duplicates of new documents against historical ones and one another."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, texts

#: Digests of a bucket of the index on average; a bucket is what one call builds or searches.
BUCKET = 2048
GROUPS = "digest binary, keep_id long, group_size long"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest: SHA-256 of each row's text with A-Z lower-cased, in UTF-8; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [hashlib.sha256(lower_ascii(x).encode()).digest() for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "digest"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary")


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest doc_id (null if none has one) and the number of rows. Counted before the shuffle, so a hot digest is one row of each task."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


def _place(words: np.ndarray, groups: int, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, first slot and step of each digest."""
    return (words[:, 1] % np.uint64(groups)).astype(np.int64), words[:, 2] % np.uint64(slots), words[:, 3] | np.uint64(1)


def build(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of n distinct digests by hash and displace: seeds (one for about four digests) and the slot
    of each digest, 0 to n - 1 once each. Large groups look for the first displacement that hits free slots only; groups
    of one take any free slot, which their seed names as a negative number."""
    n = len(words)
    parts = -(-n // 4)
    group, first, step = _place(words, parts, n)
    seeds, slot, free = np.zeros(parts, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=parts)
    starts = np.cumsum(sizes) - sizes
    ranked = np.argsort(-sizes, kind="stable")
    alone = [g for g in ranked if sizes[g] == 1]
    for g in ranked:
        if sizes[g] < 2:
            break
        own = order[starts[g] : starts[g] + sizes[g]]
        found, tried = None, 0
        while found is None:
            if tried > 4096 * n + 65_536:
                raise ValueError("two digests of one bucket agree in three of four words")
            tries = np.arange(tried, tried + 256, dtype=np.uint64)
            at = ((mixed_step(step[own], tries) + first[own][None, :]) % np.uint64(n)).astype(np.int64)
            good = free[at].all(axis=1)
            for k in np.flatnonzero(good):
                if len(set(at[k].tolist())) == len(own):
                    found = k
                    break
            tried += 256
        seeds[g] = tried - 256 + found
        slot[own] = at[found]
        free[at[found]] = False
    for g, place in zip(alone, np.flatnonzero(free), strict=True):
        seeds[g] = -1 - place
        slot[order[starts[g]]] = place
    return seeds, slot


def mixed_step(step: np.ndarray, tries: np.ndarray) -> np.ndarray:
    """Where each try moves each digest; high bits of a product, so that tries of one step differ whatever the number of slots."""
    moved = (tries[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ step[None, :]
    return (moved * np.uint64(0xBF58476D1CE4E5B9) ^ moved >> np.uint64(29)) >> np.uint64(16)


def find(words: np.ndarray, seeds: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The slot of each digest in an index, -1 for those that aren't members: the slot's full digest is compared."""
    if not len(slots) or not len(words):
        return np.full(len(words), -1)
    group, first, step = _place(words, len(seeds), len(slots))
    seed = seeds[group]
    tries = np.maximum(seed, 0).astype(np.uint64)
    moved = (tries * np.uint64(0x9E3779B97F4A7C15)) ^ step
    moved = (moved * np.uint64(0xBF58476D1CE4E5B9) ^ moved >> np.uint64(29)) >> np.uint64(16)
    at = np.where(seed < 0, -1 - seed, ((moved + first) % np.uint64(len(slots))).astype(np.int64))
    return np.where((slots[at] == words).all(axis=1), at, -1)


def bucket(buckets: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(buckets))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """A minimal perfect hash over the distinct digests of groups(), bucketed by their first bytes: per bucket the seeds
    and, slot by slot, full digest, winner (its doc_id may be null) and number of rows."""

    def run(table: pa.Table) -> pa.Table:
        found = table.column("digest").to_pylist()
        seeds, slot = build(_words(found))
        by_slot = np.argsort(slot)
        ids, sizes = table.column("keep_id").to_pylist(), table.column("group_size").to_pylist()
        return pa.table({
            "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int64()),
            "seeds": pa.array([seeds.tolist()], pa.list_(pa.int64())),
            "slots": pa.array([b"".join(found[i] for i in by_slot)], pa.binary()),
            "winners": pa.array([[ids[i] for i in by_slot]], pa.list_(pa.int64())),
            "sizes": pa.array([[sizes[i] for i in by_slot]], pa.list_(pa.int64())),
        })

    return history.withColumn("bucket", bucket(buckets)).groupBy("bucket").applyInArrow(run, "bucket long, seeds array<long>, slots binary, winners array<long>, sizes array<long>")


def merge(index: DataFrame, arrivals: DataFrame, buckets: int) -> DataFrame:
    """groups() of history and arrivals together. Arrivals (themselves groups()) are looked up in the index: members join
    their slot, the others stay groups of their own."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = right.column("digest").to_pylist()
        new_ids, new_sizes = right.column("keep_id").to_pylist(), right.column("group_size").to_pylist()
        digests, ids, sizes = [], [], []
        if left.num_rows:
            slots = _words([left.column("slots")[0].as_py()])
            at = find(_words(found), np.array(left.column("seeds")[0].as_py(), np.int64), slots)
            digests = [x.tobytes() for x in slots]
            ids, sizes = left.column("winners")[0].as_py(), left.column("sizes")[0].as_py()
        else:
            at = np.full(len(found), -1)
        for digest, slot, new_id, new_size in zip(found, at.tolist(), new_ids, new_sizes, strict=True):
            if slot < 0:
                digests.append(digest)
                ids.append(new_id)
                sizes.append(new_size)
            else:
                ids[slot] = max((x for x in (ids[slot], new_id) if x is not None), default=None)
                sizes[slot] += new_size
        return pa.table({"digest": pa.array(digests, pa.binary()), "keep_id": pa.array(ids, pa.int64()), "group_size": pa.array(sizes, pa.int64())})

    coming = arrivals.withColumn("bucket", bucket(buckets))
    return index.groupBy("bucket").cogroup(coming.groupBy("bucket")).applyInArrow(run, GROUPS)


def exact_dedup(history: DataFrame, arrivals: DataFrame, rows: int) -> DataFrame:
    """Every row of both: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts (A-Z lower-cased, null as empty)
    the row with the largest doc_id stays. A row without doc_id stays only if no equal text has one; rows that repeat a
    doc_id stay or go together. Empty tables give no rows. rows: about how many there are, to size the buckets."""
    buckets = max(1, -(-rows // BUCKET))
    old, new = digests(history), digests(arrivals)
    merged = merge(build_index(groups(old), buckets), groups(new), buckets)
    return old.unionByName(new).join(merged, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
