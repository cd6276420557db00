"""Change logs as lines of JSON, the last line of each segment being an end mark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import ENVELOPE
from .shared import make_folder, now_ms, put_in_order

END = "\\."


def parse_change_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events, and lines that aren't any (value, reason). Works on streams too."""
    read = lines.where((F.col("value") != END) & (F.trim("value") != "")).withColumn("event", F.from_json("value", ENVELOPE))
    good = F.col("event.op").isNotNull() & (F.col("event.vsn").isNotNull() | F.col("event.op").startswith("cutover"))
    return read.where(good).select("event.*"), read.where(~F.coalesce(good, F.lit(False))).select("value", F.lit("not a change event").alias("reason"))


def read_change_log(spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int = 16) -> tuple[DataFrame, DataFrame]:
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if streaming else spark.read
    return parse_change_log(reader.schema("value string").text(path))


#: Events that one task sorts, about: what a task takes doesn't grow with the log.
SORTED = 250_000


def write_change_log(events: DataFrame, path: str, rows: int = 1_000_000, partitions: int | None = None, lane: str | None = None, lanes: int = 0) -> None:
    """In segments of at most so many events, in order of vsn within and across files, which streams take in that order too. A
    task sorts about SORTED events: of a long log there are more partitions than asked for. lane: a column of whole numbers,
    which isn't written; each lane is a log by itself, in the folder lane=number. The first so many lanes have a folder even if no
    event is theirs, so that streams over them can begin."""
    spark, began = events.sparkSession, now_ms()
    n = max(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-events.count() // SORTED))
    order = [x for x in (lane, "vsn") if x]
    ordered = events.repartitionByRange(n, "vsn").sortWithinPartitions(*order)
    names = [x for x in events.columns if x != lane]
    lines = ordered.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"), *([F.col(lane).alias("lane")] if lane else []))
    writer = lines.write.option("maxRecordsPerFile", rows)
    (writer.partitionBy("lane") if lane else writer).text(path)
    for k in range(lanes):
        make_folder(spark, f"{path}/lane={k}")
    put_in_order(spark, path, began, lambda name: [int(x) for x in re.search(r"part-(\d+)-.*[.-]c(\d+)[^/]*$", name).groups()])
