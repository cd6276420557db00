"""Running a stream over what there is, and applying its batches exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.shared import cut, delete, new_path, now_ms, put_in_order
from ..sources.versioned import VersionedTable


def to_table(spark: SparkSession, stream: DataFrame, keys: list[str] | None = None, mode: str = "append", path: str | None = None) -> DataFrame:
    """The stream's result over all input there is now, by way of Parquet files a batch. With mode update, keys tell which
    row's last version counts. With a path, the folder of an earlier run of the same stream, it goes on from there."""
    path = path or new_path(spark)

    def write(df: DataFrame, batch_id: int) -> None:
        df.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/rows/b={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("__batch", T.IntegerType()), T.StructField("b", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows").drop("b")
    if keys is None:
        return rows.drop("__batch")
    names = [x for x in stream.columns if x not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "__batch").alias("x")).select(*keys, "x.*")


def apply_stream(stream: DataFrame, table: VersionedTable, progress: str, prepare: Callable[[DataFrame], DataFrame] = lambda x: x, interval: str | None = None) -> StreamingQuery:
    """Applies each batch of a change stream to a table once, though it may come again: the batch's rows and its ledger row
    are written before the stream's own progress, and a batch in the ledger is skipped. With an interval (2 seconds) a batch
    begins at most that often and the query goes on until it is stopped; else it ends with the input there is now."""

    def write(df: DataFrame, batch_id: int) -> None:
        table.apply(prepare(df), batch_id)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", progress)
    if interval is not None:
        return writer.trigger(processingTime=interval).start()
    started = writer.trigger(availableNow=True).start()
    started.awaitTermination()
    return started


def after_snapshot(events: DataFrame, boundary: int) -> DataFrame:
    """The events beyond those that the snapshot holds already."""
    return events.where((F.col("op") != "r") & (F.col("vsn") > boundary))


def follow(stream: DataFrame, path: str, load: Callable[[DataFrame, int], None], apply: Callable[[DataFrame, int], None]) -> DataFrame:
    """Loads the snapshot that a stream of events (source, vsn, snapshot and others) begins with, and applies the changes that
    come after it, over all input there is now; again with the same path it goes on from there. Where a source's snapshot ends
    is found in the stream: at the event that is marked last, or before the first that isn't of the snapshot (snapshot null or
    false), as there is no mark when the last table is empty. Returns source, boundary of the sources that are past it.

    load and apply get a batch's rows of each kind with its number; one that is tried again comes with the same number, and
    boundaries are kept beside it, so that a batch that broke off is parted as before."""
    spark, kept = stream.sparkSession, "source string, boundary long, b int"

    def write(df: DataFrame, batch_id: int) -> None:
        known = spark.read.schema(kept).parquet(f"{path}/boundaries").where(F.col("b") < batch_id).select("source", "boundary")
        over = F.coalesce("snapshot", F.lit("false")) == "false"
        found = df.groupBy("source").agg(F.least(F.min(F.when(F.col("snapshot") == "last", F.col("vsn"))), F.min(F.when(over, F.col("vsn"))) - 1).alias("boundary"))
        found.where("boundary IS NOT NULL").join(known, "source", "left_anti").write.mode("overwrite").parquet(f"{path}/boundaries/b={batch_id}")
        now = spark.read.schema(kept).parquet(f"{path}/boundaries").where(F.col("b") <= batch_id).select("source", "boundary")
        placed = df.join(now, "source", "left").withColumn("__held", F.col("boundary").isNull() | (F.col("vsn") <= F.col("boundary")))
        load(placed.where("__held").select(*df.columns), batch_id)
        apply(placed.where("NOT __held").select(*df.columns), batch_id)

    spark.createDataFrame([], "source string, boundary long").write.mode("overwrite").parquet(f"{path}/boundaries/b=-1")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept).parquet(f"{path}/boundaries").select("source", "boundary")


def read_files(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream over a folder's Parquet files of that name."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_in_order(df: DataFrame, path: str, order: str, rows: int) -> int:
    """Segments of so many places of a whole-numbered order, a file each, as if written one after the other as a log grows, so
    that a stream over them keeps the order. One job writes them all, a segment in one task; ranges without rows have no file.
    Returns how many there are."""
    began = now_ms()
    low = df.agg(F.min(order)).first()[0]
    if low is None:
        df.limit(0).write.parquet(f"{path}/s0")
        return 1
    numbered = df.withColumn("s__", F.call_function("div", F.col(order) - F.lit(low), F.lit(rows)))
    numbered.repartition("s__").write.partitionBy("s__").parquet(path)
    return put_in_order(df.sparkSession, path, began, lambda name: int(name.split("/")[0].split("=")[1]))


def read_in_order(spark: SparkSession, path: str, schema, segments_per_batch: int = 1) -> DataFrame:
    """A stream over what write_in_order() has written, so many segments a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", segments_per_batch).parquet(f"{path}/*")


def archive(spark: SparkSession, path: str, target: str, eligible: DataFrame) -> DataFrame:
    """Compacts finished segments (eligible: segment_no) of a partitioned change log to Parquet in target, over what an
    earlier try left, and returns segment_no, n_rows. A segment without rows raises when the result is used."""
    rows = spark.read.parquet(path).join(eligible.select("segment_no"), "segment_no", "left_semi")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment_no").parquet(target)
    counts = spark.read.schema(rows.schema).parquet(target).groupBy("segment_no").agg(F.count("*").alias("n_rows"))
    joined = eligible.select("segment_no").join(counts, "segment_no", "left")
    return joined.withColumn("n_rows", F.coalesce("n_rows", F.raise_error(F.lit("a segment's file is missing")).cast("long")))


def clean(spark: SparkSession, path: str, eligible: DataFrame, policy: str, target: str | None = None) -> DataFrame | None:
    """What becomes of finished segments (eligible: segment_no) of a partitioned change log: with retain they stay, with delete
    they go, with archive they go once target has all of them. Segments that an earlier try has archived and dropped already
    are no error; one that neither place has is. Returns archive()'s counts, else None."""
    if policy not in ("retain", "delete", "archive"):
        raise ValueError(f"no policy: {policy}")
    if policy == "retain":
        return None
    counts = None
    if policy == "archive":
        counts = cut(archive(spark, path, target, eligible))
    for row in eligible.select("segment_no").toLocalIterator():  # one row a segment, not held together
        delete(spark, f"{path}/segment_no={row.segment_no}")
    return counts


def batch_sizes(spark: SparkSession, *streams: DataFrame) -> DataFrame:
    """lane (the stream's place), batch_id, n_events of the streams' batches over all input there is now; the streams run side by side. What a batch takes is bounded by its reader
    (files_per_batch) and the events of a segment (write_change_log()'s rows)."""
    path, kept = new_path(spark), "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, "10000000")  # a stream's reports of its batches, some KB each: no job is needed to count a batch
    started: list[StreamingQuery] = []
    try:
        for lane, x in enumerate(streams):
            counted = x.observe("sizes", F.count("*").alias("n")).writeStream.format("noop")
            started.append(counted.option("checkpointLocation", f"{path}/progress/{lane}").trigger(availableNow=True).start())
        for x in started:
            x.awaitTermination()
        reports = [(lane, p) for lane, x in enumerate(started) for p in x.recentProgress]
    finally:
        spark.conf.set(kept, before)
        for x in started:
            x.stop()
    sizes = {(lane, p["batchId"]): p["observedMetrics"]["sizes"]["n"] for lane, p in reports if "sizes" in p["observedMetrics"]}
    return spark.createDataFrame([(lane, b, n) for (lane, b), n in sizes.items()], "lane int, batch_id long, n_events long")
