"""Bookkeeping of loads: bad rows, batches, resuming, status."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stash(df: DataFrame, reason: Column, policy: str = "stash") -> tuple[DataFrame, DataFrame]:
    """Good rows and bad ones (with reason). reason is null for good rows. With policy abort, using the good rows raises at the first bad one."""
    marked = df.withColumn("reason", reason)
    if policy == "abort":
        check = F.when(F.col("reason").isNotNull(), F.raise_error(F.concat(F.lit("bad row: "), "reason")).cast("boolean")).otherwise(True)
        return marked.where(check).drop("reason"), marked.where(F.lit(False))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def cast_reason(types: dict[str, str]) -> Column:
    """Which column's text can't be cast to its type, if any."""
    wrong = [F.when(F.col(x).isNotNull() & F.expr(f"try_cast(`{x}` AS {kind})").isNull(), F.lit(f"{x} is no {kind}")) for x, kind in types.items()]
    return F.coalesce(*wrong, F.lit(None).cast("string"))


def oversize_reason(columns: list[str], limit: int) -> Column:
    size = sum((F.coalesce(F.octet_length(F.col(x).cast("string")), F.lit(0)) for x in columns), F.lit(0))
    return F.when(size > limit, F.format_string(f"%d bytes are more than {limit}", size))


def error_counts(bad: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    size = sum((F.coalesce(F.octet_length(F.col(x).cast("string")), F.lit(0)) for x in columns), F.lit(0))
    return bad.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"))


#: Fixed value: rows of a batch at most.
BATCH_ROWS = 20_000


def _text_size(columns: list[str]) -> Column:
    return sum((F.coalesce(F.octet_length(F.col(x).cast("string")), F.lit(0)) for x in columns), F.lit(0)).cast("long")


def number_batches(df: DataFrame, rows: int, size: int) -> DataFrame:
    """df with __size (bytes of the row as text), __part and __batch: each of Spark's partitions deals its rows in order into
    batches, of which each takes rows as long as it stays within so many rows and bytes. A row that is larger than a batch
    may be is one by itself (oversize_reason() finds such rows beforehand). Nothing is shuffled or held whole."""

    def fill(batches):
        part, number, n, used = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            ends = np.cumsum(batch.column(batch.schema.get_field_index("__size")).to_numpy())
            numbers = np.empty(len(ends), np.int64)
            at = 0
            while at < len(ends):
                before = int(ends[at - 1]) if at else 0
                stop = min(int(np.searchsorted(ends, before + size - used, "right")), at + rows - n)
                if stop <= at and n:
                    number, n, used = number + 1, 0, 0
                    continue
                stop = max(stop, at + 1)
                numbers[at:stop] = number
                n, used, at = n + stop - at, used + int(ends[stop - 1]) - before, stop
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ends), part, np.int32)), pa.array(numbers)], names=[*batch.schema.names, "__part", "__batch"])

    sized = df.withColumn("__size", _text_size(df.columns))
    return sized.mapInArrow(fill, T.StructType([*sized.schema, T.StructField("__part", T.IntegerType()), T.StructField("__batch", T.LongType())]))


def write_batches(df: DataFrame, path: str, rows: int = BATCH_ROWS, size: int | None = None) -> DataFrame:
    """Writes df in batches of at most so many rows, and bytes of text if size is given, and returns their ledger: batch,
    n_rows, n_bytes (of the file, or of the text), state. With a size, each of Spark's partitions leaves one file, in which its
    batches follow one another (columns __part and __batch, which batch joins by -), not a folder for each."""
    spark = df.sparkSession
    if size is None:
        df.write.option("maxRecordsPerFile", rows).parquet(path)
        read = spark.read.schema(df.schema).parquet(path)
        grouped = read.groupBy(F.col("_metadata.file_name").alias("batch")).agg(F.count("*").alias("n_rows"), F.max("_metadata.file_size").alias("n_bytes"))
    else:
        numbered = number_batches(df, rows, size)
        numbered.write.parquet(path)
        read = spark.read.schema(numbered.schema).parquet(path)
        grouped = read.groupBy(F.concat_ws("-", "__part", "__batch").alias("batch")).agg(F.count("*").alias("n_rows"), F.sum("__size").alias("n_bytes"))
    return grouped.withColumn("state", F.lit("pending"))


def unfinished(batches: DataFrame, ledger: DataFrame) -> DataFrame:
    """batches (file_path, batch_no) that the ledger doesn't have as done."""
    return batches.join(ledger.where("state = 'done'"), ["file_path", "batch_no"], "left_anti")


def status(imported: Column, total: Column, errored: Column) -> Column:
    """DONE, DONE_WITH_ERRORS, NOT_STARTED or MIGRATING; nothing to do is done."""
    processed = imported + errored
    return F.when(processed >= total, F.when(errored > 0, "DONE_WITH_ERRORS").otherwise("DONE")).when(processed == 0, "NOT_STARTED").otherwise("MIGRATING")


def load_status(ledger: DataFrame, keys: list[str]) -> DataFrame:
    """total, imported, errored, percent and status by keys: by rows, or by bytes where rows aren't known (-1)."""
    known = F.min("n_rows") >= 0
    done = F.col("state") == "done"

    def sums(x: str) -> tuple[Column, Column]:
        return F.sum(x), F.sum(F.when(done, F.col(x)).otherwise(0))

    (rows, rows_done), (size, size_done) = sums("n_rows"), sums("n_bytes")
    errors = F.sum(F.when(done, F.col("errored")).otherwise(0))
    got = ledger.groupBy(*keys).agg(F.when(known, rows).otherwise(size).alias("total"), F.when(known, rows_done - errors).otherwise(size_done).alias("imported"), errors.alias("errored"))
    percent = F.when(F.col("total") == 0, 100.0).otherwise(F.round((F.col("imported") + F.col("errored")) * 100 / F.col("total"), 2))
    return got.withColumn("percent", percent.cast("double")).withColumn("status", status(F.col("imported"), F.col("total"), F.col("errored")))


def recover(rows: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """What a repeated load does: total, ignored (keys that target has already), inserted."""
    marked = rows.join(target.select(*key).distinct().withColumn("__there", F.lit(True)), key, "left")
    return marked.agg(F.count("*").alias("total"), F.count_if(F.col("__there").isNotNull()).alias("ignored"), F.count_if(F.col("__there").isNull()).alias("inserted"))


def sequences_to_restore(sequences: DataFrame, tables: DataFrame) -> DataFrame:
    """sequences (table_name, sequence_name, last_value) of the listed tables that have been used."""
    return sequences.join(tables.select("table_name").distinct(), "table_name", "left_semi").where("last_value <> 0")


def filter_tables(df: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, column: str = "table_name") -> DataFrame:
    """Rows of tables whose names match an include pattern (all if None) and no exclude pattern; * stands for any text, ? for
    one character. A pattern that matches no table is an error."""

    def like(pattern: str) -> Column:
        regex = "".join(".*" if x == "*" else "." if x == "?" else x if x.isalnum() or x == "_" else "\\" + x for x in pattern)
        return F.col(column).rlike(f"^{regex}$")

    patterns = [*(include or []), *(exclude or [])]
    if patterns:
        hit = df.select(column).distinct().agg(*[F.max(like(x)).alias(f"p{k}") for k, x in enumerate(patterns)]).first()
        if unknown := [x for k, x in enumerate(patterns) if not hit[k]]:
            raise ValueError(f"no table matches: {', '.join(unknown)}")
    out = df
    if include is not None:
        good = F.lit(False)
        for x in include:
            good = good | like(x)
        out = out.where(good)
    for x in exclude or []:
        out = out.where(~like(x))
    return out


def flag_column_types(columns: DataFrame, rules: DataFrame) -> DataFrame:
    """columns (data_type like ns.type[] or type(10)) with base_type, is_array and the severity that rules (base_type, severity) give; ok without one."""
    base = F.lower(F.regexp_replace(F.regexp_replace(F.substring_index("data_type", ".", -1), r"\(.*\)", ""), r"\[\]$", ""))
    named = columns.withColumns({"base_type": base, "is_array": F.col("data_type").endswith("[]")})
    return named.join(rules, "base_type", "left").withColumn("severity", F.coalesce("severity", F.lit("ok")))


def select_columns(df: DataFrame, exported: list[str]) -> DataFrame:
    return df.select(*[x for x in df.columns if x in set(exported)])


def rows_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small reference table."""
    return spark.createDataFrame(rows, schema)
