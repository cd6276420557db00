"""A keyed table in Parquet that takes change batches exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.fold import fold
from .shared import delete

LEDGER = T.StructType([T.StructField("version", T.LongType()), T.StructField("batch_id", T.LongType()), T.StructField("last_vsn", T.LongType()), T.StructField("of_bucket", T.ArrayType(T.LongType())), T.StructField("since", T.LongType())])
BUCKET = [T.StructField("v", T.LongType()), T.StructField("bucket", T.IntegerType())]


class VersionedTable:
    """Rows lie in buckets of the key's hash. A batch adds its changes as they are, under a new version, so it costs what it
    brings; readers fold the changes since the last merge into the rows. After merge_after versions the buckets that have
    changes are rewritten with them (merge). A row of the ledger, one file, makes a version count: it names for every bucket
    the version that holds its rows, and the version since which changes are to be folded in. Readers go by the last ledger
    row, so a version that broke off before it leaves nothing and is written over, and a batch that comes again is known by
    its number. vacuum() drops what no reader of the last ledger row needs. Choose buckets so that one of them is some
    hundred MB."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], columns: list[str], buckets: int = 16, merge_after: int = 8):
        self.spark, self.path, self.key, self.columns, self.buckets, self.merge_after = spark, path, key, columns, buckets, merge_after

    def _write(self, df: DataFrame, folder: str, version: int) -> None:
        bucketed = df.withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}/v={version}")

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).json(f"{self.path}/ledger")

    def _commit(self, version: int, batch_id: int | None, last_vsn: int, of_bucket: list[int], since: int) -> None:
        self.spark.createDataFrame([(version, batch_id, last_vsn, of_bucket, since)], LEDGER).coalesce(1).write.mode("append").json(f"{self.path}/ledger")

    def create(self, df: DataFrame) -> None:
        rows = df.select(*self.key, *self.columns)
        # The types outlive vacuum() and tables without rows.
        rows.limit(0).write.parquet(f"{self.path}/types")
        self._write(rows, "rows", 0)
        self._commit(0, -1, -1, [0] * self.buckets, 0)

    def state(self):
        return self.ledger().orderBy(F.desc("version")).first()

    def _types(self) -> T.StructType:
        return self.spark.read.parquet(f"{self.path}/types").schema

    def _rows(self, of_bucket: list[int]) -> DataFrame:
        """The rows of each bucket's version, chosen by partition alone."""
        rows = self.spark.read.schema(T.StructType([*self._types(), *BUCKET])).parquet(f"{self.path}/rows")
        return rows.where(F.array(*[F.lit(x).cast("long") for x in of_bucket])[F.col("bucket")] == F.col("v")).drop("v")

    def _changes(self, after: int, upto: int) -> DataFrame:
        types = self._types()
        schema = [*[types[x] for x in self.key], T.StructField("vsn", T.LongType()), T.StructField("op", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]
        return self.spark.read.schema(T.StructType([*schema, *BUCKET])).parquet(f"{self.path}/changes").where(F.col("v").between(after + 1, upto)).drop("v")

    def read(self) -> DataFrame:
        now = self.state()
        rows = self._rows(now.of_bucket).drop("bucket")
        return rows if now.version == now.since else fold(rows, self._changes(now.since, now.version), self.key, self.columns)

    def apply(self, changes: DataFrame, batch_id: int) -> bool:
        """Whether the batch was applied; one that the ledger has isn't. Events up to the last applied vsn are left out."""
        if not self.ledger().where(F.col("batch_id") == batch_id).isEmpty():
            return False
        now = self.state()
        version = now.version + 1
        new = changes.where(F.col("vsn") > now.last_vsn)
        self._write(new.select(*self.key, F.col("vsn").cast("long").alias("vsn"), "op", "fields"), "changes", version)
        last = self._changes(now.version, version).agg(F.max("vsn")).first()[0]
        if last is not None:
            self._commit(version, batch_id, last, now.of_bucket, now.since)
            if version - now.since >= self.merge_after:
                self.merge()
        return True

    def merge(self) -> None:
        """Rewrites the buckets that have changes with them folded in."""
        now = self.state()
        if now.version == now.since:
            return
        changes = self._changes(now.since, now.version)
        touched = {r.bucket for r in changes.select("bucket").distinct().collect()}  # at most as many as there are buckets
        rows = self._rows(now.of_bucket).where(F.col("bucket").isin(*touched))
        version = now.version + 1
        self._write(fold(rows.drop("bucket"), changes.drop("bucket"), self.key, self.columns), "rows", version)
        self._commit(version, None, now.last_vsn, [version if b in touched else v for b, v in enumerate(now.of_bucket)], version)

    def vacuum(self) -> None:
        """Drops the rows and changes of versions that the last ledger row doesn't need; readers of earlier ones lose them."""
        now = self.state()
        needed = set(now.of_bucket)
        for version in range(now.version + 1):
            if version not in needed:
                delete(self.spark, f"{self.path}/rows/v={version}")
            if version <= now.since:
                delete(self.spark, f"{self.path}/changes/v={version}")
