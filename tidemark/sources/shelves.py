"""A change log whose finished segments lie many to a folder (a shelf), so that archiving or dropping them doesn't cost a folder
each. What is left of a shelf in part is written as its next generation beside it, and readers take a shelf's newest one: a
run that breaks off loses and repeats nothing, and may be tried again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, delete


def _system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """Of the folders name=number in path."""
    system, target = _system(spark, path)
    names = [x.getPath().getName() for x in system.listStatus(target)] if system.exists(target) else []
    return [int(x.split("=")[1]) for x in names if x.startswith(f"{name}=")]


def with_shelf(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("shelf", F.call_function("div", F.col("segment_no"), F.lit(size)))


def _put(spark: SparkSession, rows: DataFrame, path: str, shelves: list[int]) -> None:
    """Makes rows (with shelf) all that these shelves hold."""
    staged = f"{path}/_{uuid.uuid4().hex}"
    rows.repartition("shelf").write.partitionBy("shelf").parquet(staged)
    system, _ = _system(spark, path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = set(_numbers(spark, staged, "shelf"))
    for k in shelves:  # no more than folders, a move and a removal each
        if k not in there:
            delete(spark, f"{path}/shelf={k}")
            continue
        old = _numbers(spark, f"{path}/shelf={k}", "g")
        system.mkdirs(place(f"{path}/shelf={k}"))
        if not system.rename(place(f"{staged}/shelf={k}"), place(f"{path}/shelf={k}/g={max(old, default=-1) + 1}")):
            raise OSError(f"shelf {k} can't be put in its place: {path}")
        for g in old:
            delete(spark, f"{path}/shelf={k}/g={g}")
    delete(spark, staged)


def write(rows: DataFrame, path: str, size: int) -> None:
    """A new log of rows (with segment_no), so many segments to a shelf."""
    with_shelf(rows, size).withColumn("g", F.lit(0)).repartition("shelf").write.partitionBy("shelf", "g").parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType, shelves: list[int] | None = None) -> DataFrame:
    """The rows of all shelves, or of these; none where there is no folder. schema: without shelf."""
    whole = T.StructType([*schema, T.StructField("shelf", T.LongType()), T.StructField("g", T.IntegerType())])
    known = _numbers(spark, path, "shelf")
    wanted = known if shelves is None else sorted(set(known) & set(shelves))
    newest = [(k, max(_numbers(spark, f"{path}/shelf={k}", "g"), default=None)) for k in wanted]
    folders = [f"{path}/shelf={k}/g={g}" for k, g in newest if g is not None]
    if not folders:
        return spark.createDataFrame([], whole).drop("g")
    return spark.read.schema(whole).option("basePath", path).parquet(*folders).drop("g")


def clean(spark: SparkSession, path: str, schema: T.StructType, size: int, eligible: DataFrame, policy: str, target: str | None = None) -> DataFrame | None:
    """run.clean() for such a log: what becomes of finished segments (eligible: segment_no). With retain they stay, with delete
    they go, with archive they go once target, shelved alike, has all of them. Segments that an earlier try has archived and
    dropped already are no error; one that neither place has is. Returns segment_no, n_rows of the archived ones, else None."""
    if policy not in ("retain", "delete", "archive"):
        raise ValueError(f"no policy: {policy}")
    if policy == "retain":
        return None
    chosen = cut(with_shelf(eligible.select("segment_no").distinct(), size))
    shelves = [r.shelf for r in chosen.select("shelf").distinct().collect()]  # a number for each shelf
    log, own = read(spark, path, schema, shelves), chosen.select("segment_no")
    counts = None
    if policy == "archive":
        going = log.join(own, "segment_no", "left_semi")
        earlier = read(spark, target, schema, shelves).join(going.select("segment_no").distinct(), "segment_no", "left_anti")
        _put(spark, going.unionByName(earlier), target, shelves)
        counted = read(spark, target, schema, shelves).groupBy("segment_no").agg(F.count("*").alias("n_rows"))
        missing = F.raise_error(F.lit("a segment's file is missing")).cast("long")
        counts = cut(own.join(counted, "segment_no", "left").withColumn("n_rows", F.coalesce("n_rows", missing)))
    _put(spark, log.join(own, "segment_no", "left_anti"), path, shelves)
    return counts
