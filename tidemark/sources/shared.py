"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; a temporary one only where one process runs all."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-tidemark-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was a file or folder of that path, in any file system that Spark knows; it is gone afterwards."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    """A folder of that path, in any file system that Spark knows, if there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def cut(df: DataFrame) -> DataFrame:
    """df computed once into a Parquet folder in the shared folder, its lineage cut. Unlike checkpoint(), what is read again
    brings no constraints along, which in loops would double with every turn."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def put_in_order(spark: SparkSession, path: str, began: int, key: Callable[[str], object]) -> int:
    """Gives the files below path, which a job has written side by side since began (now_ms()), times of change a millisecond
    apart in the order of key (of a file's path below path), as if they had been written one after the other: streams take
    files by that time. None is before began or after now. Returns how many files there are."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top, found, files = str(system.getFileStatus(root).getPath()), [], system.listFiles(root, True)
    while files.hasNext():
        name = str(files.next().getPath())[len(top) + 1 :]
        if not any(x[0] in "._" for x in name.split("/")):
            found.append(name)
    time.sleep(max(0, began + len(found) + 1 - now_ms()) / 1000)
    last = now_ms()
    for k, name in enumerate(sorted(found, key=key)):
        system.setTimes(hadoop.Path(f"{path}/{name}"), last - len(found) + 1 + k, -1)
    return len(found)
