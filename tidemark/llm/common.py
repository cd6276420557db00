"""What the operators on documents share: reading, cutting lineage, words and hashes."""

from __future__ import annotations

import ctypes
import hashlib
import re
import sys
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster shares; a temporary one only in a single process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-tidemark-"))
    return context.getCheckpointDir()


def saved(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df computed once into a Parquet folder in the checkpoint folder, so that lost executors cost no recomputation. Unlike
    checkpoint(), what is read again brings no constraints along, which in loops would double with every turn. The folder
    stays until the cluster clears it."""
    path = f"{shared_folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out anew, without regard to keys. Put between an aggregation and a join on its keys, it makes Spark shuffle
    both sides for the join alone, and then adaptive execution can split the partition of a hot key."""
    return df.repartition(partitions(df.sparkSession))


#: Rows that Python code works on at once: Spark's batches may hold ten times as many, and texts take room once more as strings.
PORTION = 1024


def portions(batches: Iterator[pa.RecordBatch], rows: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batches' rows, some at a time. In the end the worker, which lives on, gives memory back to the system."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def row_key(*columns: str):
    """With doc_id, tells rows apart for joins: equal for rows that repeat one another in these columns, so the other side has one row a key."""
    return F.xxhash64(*columns)


class Cache(dict):
    """A dict that works out missing values with make and forgets everything when it holds too many bytes, about."""

    every: weakref.WeakSet = weakref.WeakSet()

    def __init__(self, make, most: int = 64 << 20):
        super().__init__()
        self.make, self.most, self.room = make, most, most
        Cache.every.add(self)

    __hash__ = object.__hash__

    def clear(self) -> None:
        super().clear()
        self.room = self.most

    def __missing__(self, key):
        value = self.make(key)
        size = sys.getsizeof(key) + sys.getsizeof(value) + 100
        if size <= self.most >> 7:
            self.room -= size
            if self.room < 0:
                self.clear()
            self[key] = value
        return value


def alone(*caches: Cache) -> None:
    """Empties all other caches: Python workers live on from stage to stage, and what one stage remembers is of no use to the next."""
    for x in list(Cache.every):
        if not any(x is y for y in caches):
            x.clear()


def hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


#: Hashes of words or lines seen lately, in each Python worker.
UNIT_HASHES = Cache(hash64)


def unit_hashes(units: list[bytes]) -> np.ndarray:
    return np.fromiter(map(UNIT_HASHES.__getitem__, units), np.uint64, len(units))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Rabin-Karp hashes modulo 2**64 of every run of n units, from prefix sums; the base is odd, so that it has an inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.full(size, x, np.uint64) for x in (self.base, self.inverse))
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up, dtype=np.uint64), np.cumprod(self.down, dtype=np.uint64)

    def of(self, hashes: np.ndarray, n: int) -> np.ndarray:
        count = len(hashes) - n + 1
        if count <= 0:
            return np.empty(0, np.uint64)
        self._powers(len(hashes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.up[: len(hashes)], dtype=np.uint64)])
        return mix((sums[n:] - sums[:-n]) * self.down[:count])


#: Fixed odd bases of the two independent rolling hashes.
ROLLING = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Winnowing: positions that hold the smallest value (the rightmost of equals) of some window of so many values; all together make one window if there are fewer."""
    if not len(values):
        return np.empty(0, np.int64)
    if len(values) <= width:
        return np.array([len(values) - 1 - int(np.argmin(values[::-1]))])
    windows = np.lib.stride_tricks.sliding_window_view(values[::-1], width)
    return np.unique(len(values) - 1 - (np.argmin(windows, axis=1) + np.arange(len(windows))))


def lower_ascii(text: str) -> str:
    """A-Z only; str.lower() would change other letters too."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


SPACE_BEFORE_SPACE = re.compile(r" (?:\s|$)")


def rewrite(docs: DataFrame, joined: DataFrame, change) -> DataFrame:
    """docs with texts changed. joined: docs' columns as one struct named row, so that no name clashes, and others;
    change(texts, batch) gives the new texts of a batch of it. n_chars, where docs has it, follows; texts that stay as they
    are, null ones too, keep both."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            columns = batch.column("row").flatten()
            old = columns[names.index("text")].to_pylist()
            changed = change(["" if x is None else x for x in old], batch)
            new = [x if y == (x or "") else y for x, y in zip(old, changed, strict=True)]
            columns[names.index("text")] = pa.array(new, columns[names.index("text")].type)
            if "n_chars" in names:
                at = names.index("n_chars")
                sizes = [n if x is y else len(y) for n, x, y in zip(columns[at].to_pylist(), old, new, strict=True)]
                columns[at] = pa.array(sizes, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, docs.schema)
