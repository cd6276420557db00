"""Joins with reference tables by nearness, and joins of two catalogs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import cut

#: Rows that a reference table may have at most to be sent to every executor as one array.
MOST = 100_000


def as_array(lookup: DataFrame, key: str, value: str, name: str, order: str | None = None, most: int = MOST) -> DataFrame:
    """One row with the array of (key, order, value). The size is checked: a larger table raises."""
    size = lookup.limit(most + 1).count()
    if size > most:
        raise ValueError(f"a lookup table may have {most} rows at most")
    entry = F.struct(F.col(key).alias("key"), F.col(order or key).alias("ord"), F.col(value).alias("value"))
    return lookup.agg(F.array_sort(F.collect_list(entry)).alias(name))


def with_lookup(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """df with the lookup's one row beside each row; it is checked to be small by as_array()."""
    return df.join(F.broadcast(lookup))


def nearest(table: str, at: Column) -> Column:
    """The value of the key nearest to at; of equally near ones the first by order."""
    return F.array_min(F.transform(table, lambda x: F.struct(F.abs(x["key"] - at), x["ord"], x["value"].alias("value"))))["value"]


def as_of(table: str, at: Column, default: Column | None = None) -> Column:
    """The value of the greatest key that isn't above at, else the default."""
    found = F.array_max(F.filter(table, lambda x: x["key"] <= at))["value"]
    return found if default is None else F.coalesce(found, default)


def ceiling(table: str, at: Column) -> Column:
    """The value of the smallest key that isn't below at, else that of the greatest key."""
    return F.coalesce(F.array_min(F.filter(table, lambda x: x["key"] >= at))["value"], F.array_max(table)["value"])


def carried(df: DataFrame, order: list[Column], entry: str, name: str, own: bool = True) -> DataFrame:
    """df with the last entry (a struct) that isn't null of the rows before each one, and with own of the row itself too, in a
    total order of the whole table. The table is dealt out by ranges of the order and sorted; within a part the last entry goes
    on from batch to batch, and what a part lacks at its beginning comes from the parts before it, of which there is a row each."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # an array of the one entry that is carried
        for batch in batches:
            entries = batch.column(entry)
            here = np.where(entries.is_valid().to_numpy(zero_copy_only=False), np.arange(1, len(entries) + 1), 0)
            at = np.maximum.accumulate(np.concatenate([[0], here]))
            known = pa.concat_arrays([pa.nulls(1, entries.type) if last is None else last, entries])
            last = known.slice(int(at[-1]), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, known.take(pa.array(at[1:] if own else at[:-1]))], [*batch.schema.names, name])

    wide = T.StructType([*df.schema.fields, T.StructField(name, df.schema[entry].dataType)])
    placed = cut(ordered.mapInArrow(run, wide).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    ends = placed.where(F.col(entry).isNotNull()).groupBy("__part").agg(F.max_by(entry, "__row").alias("__end"))
    parts = spark.range(n).select(F.col("id").cast("int").alias("__part")).join(ends, "__part", "left")
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    seams = parts.select("__part", F.last("__end", True).over(earlier).alias("__before"))  # one row for each part
    return placed.join(F.broadcast(seams), "__part").withColumn(name, F.coalesce(name, "__before")).drop("__part", "__row", "__before")


def _beside(df: DataFrame, lookup: DataFrame, at: Column, key: str, value: str, order: str | None) -> DataFrame:
    """df with __at, __low (the entry of the greatest key that isn't above at) and __high (that of the smallest key above it). An
    entry has a key, and the first and last value of the lookup's rows of that key by order. Neither side is collected and
    neither is multiplied; a value that many rows share is split by their place."""
    by = F.struct(F.col(order or key).alias("ord"), F.col(value).alias("value"))
    one = lookup.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(by).alias("first"), F.max(by).alias("last"))
    entries = one.select(F.struct("key", "first", "last").alias("entry"))
    least = entries.agg(F.min("entry").alias("__least"))  # one row
    linked = carried(entries, [F.desc("entry.key")], "entry", "next", own=False).select(F.struct("entry", "next").alias("__entry"))
    kind = linked.schema["__entry"].dataType
    rows = df.select(at.alias("__at"), F.lit(1).alias("__turn"), F.xxhash64(F.monotonically_increasing_id()).alias("__place"), F.struct(*df.columns).alias("__row_of"), F.lit(None).cast(kind).alias("__entry"))
    keys = linked.select(F.col("__entry.entry.key").alias("__at"), F.lit(0).alias("__turn"), F.lit(0).cast("long").alias("__place"), F.lit(None).cast(rows.schema["__row_of"].dataType).alias("__row_of"), "__entry")
    found = carried(keys.unionByName(rows), [F.col("__at"), F.col("__turn"), F.col("__place")], "__entry", "__found").where("__turn = 1")
    with_least = found.join(F.broadcast(least))
    high = F.when(F.col("__found").isNotNull(), F.col("__found.next")).otherwise(F.col("__least"))
    return with_least.select("__row_of.*", "__at", F.col("__found.entry").alias("__low"), high.alias("__high"))


def nearest_join(df: DataFrame, lookup: DataFrame, at: Column, key: str, value: str, name: str, order: str | None = None) -> DataFrame:
    """df with the value of the lookup's key nearest to at; of equally near ones the first by order. Null where at is or the
    lookup has no keys; rows of the lookup without a key take no part. For lookups of any size: nearest() is for small ones."""
    near = F.array_compact(F.array(*[F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col(f"{x}.key") - F.col("__at")).alias("far"), F.col(f"{x}.first").alias("first"))) for x in ("__low", "__high")]))
    found = _beside(df, lookup, at, key, value, order)
    return found.withColumn(name, F.when(F.col("__at").isNotNull(), F.array_min(near)["first"]["value"])).drop("__at", "__low", "__high")


def as_of_join(df: DataFrame, lookup: DataFrame, at: Column, key: str, value: str, name: str, order: str | None = None, default: Column | None = None) -> DataFrame:
    """df with the value of the lookup's greatest key that isn't above at (of several rows of that key the last by order), else
    the default; as nearest_join()."""
    found = F.when(F.col("__low").isNotNull(), F.col("__low.last.value")).otherwise(F.lit(None) if default is None else default)
    return _beside(df, lookup, at, key, value, order).withColumn(name, found).drop("__at", "__low", "__high")


def ceiling_join(df: DataFrame, lookup: DataFrame, at: Column, key: str, value: str, name: str, order: str | None = None) -> DataFrame:
    """df with the value of the lookup's smallest key that isn't below at (of several rows of that key the first by order), else
    the last value of the greatest key; as nearest_join()."""
    low, high = F.col("__low"), F.col("__high")
    found = F.when(low["key"] == F.col("__at"), low["first"]["value"]).when(high.isNotNull(), high["first"]["value"]).otherwise(low["last"]["value"])
    return _beside(df, lookup, at, key, value, order).withColumn(name, F.when(F.col("__at").isNotNull(), found)).drop("__at", "__low", "__high")


def match_exact(source: DataFrame, target: DataFrame, on: str) -> DataFrame:
    """Both sides (other columns prefixed src_ and tgt_) by equal text: status MATCHED, SOURCE_ONLY or TARGET_ONLY."""
    one = source.select(on, F.lit(True).alias("__one"), *[F.col(x).alias(f"src_{x}") for x in source.columns if x != on])
    two = target.select(on, F.lit(True).alias("__two"), *[F.col(x).alias(f"tgt_{x}") for x in target.columns if x != on])
    status = F.when(F.col("__two").isNull(), "SOURCE_ONLY").when(F.col("__one").isNull(), "TARGET_ONLY").otherwise("MATCHED")
    return one.join(two, on, "full").withColumn("status", status).drop("__one", "__two")


def enrich(objects: DataFrame, *attributes: DataFrame, on: tuple[str, ...] = ("db_id", "schema_name", "object_name")) -> DataFrame:
    """objects left-joined with one-row-per-object attribute tables."""
    for x in attributes:
        objects = objects.join(x, list(on), "left")
    return objects


def initial_and_final(measured: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of measurement_type initial and final side by side, as initial_x and final_x; objects measured once are left out."""
    sides = [measured.where(F.col("measurement_type") == kind).select(*keys, *[F.col(x).alias(f"{kind}_{x}") for x in values]) for kind in ("initial", "final")]
    return sides[0].join(sides[1], keys)


def prefix_covers(short: Column, long: Column) -> Column:
    """Whether a list is how a longer one begins."""
    return (F.size(short) < F.size(long)) & short.eqNullSafe(F.slice(long, 1, F.size(short)))


def prefixes(columns: Column, least: int = 1) -> Column:
    """The beginnings of a list, from that length up to its own; an empty list has none."""
    return F.when(F.size(columns) >= least, F.transform(F.sequence(F.lit(least), F.size(columns)), lambda n: F.slice(columns, F.lit(1), n))).otherwise(F.array().cast("array<array<string>>"))


def longer_lists(df: DataFrame, keys: list[str], columns: str, name: str) -> DataFrame:
    """df's rows whose list (of text, not null) is how longer lists of the same keys begin, with the number of those. Each different list says
    its beginnings, and lists meet them by equality: no pairs of a key's lists are formed."""
    counted = df.groupBy(*keys, columns).agg(F.count("*").alias("__n"))
    shorter = F.filter(prefixes(F.col(columns)), lambda x: F.size(x) < F.size(columns))
    begun = counted.select(*keys, F.explode(shorter).alias(columns), "__n").groupBy(*keys, columns).agg(F.sum("__n").alias(name))
    return df.join(begun, [*keys, columns])


def prefix_holds_set(columns: Column, index: Column) -> Column:
    """Whether an index begins with all these columns, in any order."""
    return (F.size(columns) <= F.size(index)) & F.array_sort(columns).eqNullSafe(F.array_sort(F.slice(index, 1, F.size(columns))))
