"""Change events: normalising, choosing, renaming, routing and dealing them out.

An event is a row of vsn (its place in the log), op (c, u, d; r is a snapshot read), schema_name, table_name, key, fields and
before_fields (maps from column to value as text; a column that is missing wasn't sent, one that is null was set to null)
and exporter_role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import cut

OPS = ("c", "u", "d", "r")
TEXT_MAP = "map<string,string>"

ENVELOPE = T.StructType([
    T.StructField("vsn", T.LongType()), T.StructField("op", T.StringType()), T.StructField("schema_name", T.StringType()), T.StructField("table_name", T.StringType()),
    T.StructField("partition_schema_name", T.StringType()), T.StructField("partition_table_name", T.StringType()),
    T.StructField("key", T.MapType(T.StringType(), T.StringType())), T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("before_fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("exporter_role", T.StringType()), T.StructField("event_id", T.StringType()),
])


def changed_fields(before: Column, after: Column) -> Column:
    """The entries of after whose value isn't before's; null equals null, and a column that before lacks counts as null."""
    return F.map_filter(after, lambda name, value: ~value.eqNullSafe(F.try_element_at(before, name)))


def normalize_envelope(df: DataFrame) -> DataFrame:
    """Raw connector rows (before, after, op, key, schema_name, table_name, ... as maps) as events: inserts and reads carry
    all columns, updates only the changed ones, deletes none; before_fields is kept for updates and deletes."""
    fields = F.when(F.col("op").isin("c", "r"), F.col("after")).when(F.col("op") == "u", changed_fields(F.col("before"), F.col("after")))
    before = F.when(F.col("op").isin("u", "d"), F.col("before"))
    return df.withColumns({"fields": F.coalesce(fields, F.create_map().cast(TEXT_MAP)), "before_fields": before}).drop("before", "after")


def normalize_set_envelope(df: DataFrame) -> DataFrame:
    """The variant in which each column of before and after is a struct of value and set: only columns with set are kept."""

    def kept(side: str) -> Column:
        return F.transform_values(F.map_filter(side, lambda _, x: x["set"]), lambda _, x: x["value"])

    fields = F.when(F.col("op") != "d", kept("after"))
    return df.withColumns({"fields": F.coalesce(fields, F.create_map().cast(TEXT_MAP)), "before_fields": F.when(F.col("op").isin("u", "d"), kept("before"))}).drop("before", "after")


def valid_events(df: DataFrame) -> DataFrame:
    """Without tombstones (no op), transaction markers, unsupported and control events."""
    return df.where(F.col("op").isin(*OPS))


def drop_noop_updates(df: DataFrame) -> DataFrame:
    return df.where(~((F.col("op") == "u") & (F.coalesce(F.size("fields"), F.lit(0)) <= 0)))


def filter_role(df: DataFrame, role: str) -> DataFrame:
    return df.where(F.col("exporter_role") == role)


def rename_tables(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping: schema_name, table_name, new_schema, new_table, one row per table. Renamed events keep their old names as
    partition_schema_name and partition_table_name; others are left as they are."""
    joined = df.drop("partition_schema_name", "partition_table_name").join(mapping, ["schema_name", "table_name"], "left")
    renamed = F.col("new_table").isNotNull()
    return joined.withColumns({
        "partition_schema_name": F.when(renamed, F.col("schema_name")), "partition_table_name": F.when(renamed, F.col("table_name")),
        "schema_name": F.coalesce("new_schema", "schema_name"), "table_name": F.coalesce("new_table", "table_name"),
    }).drop("new_schema", "new_table")


def route_partitions(df: DataFrame, mapping: DataFrame, use_root: bool = True) -> DataFrame:
    """mapping: leaf, root. target_table is the root of a leaf partition, or the leaf itself if use_root is false."""
    joined = df.join(mapping.select(F.col("leaf").alias("table_name"), "root"), "table_name", "left")
    return joined.withColumn("target_table", F.coalesce("root", "table_name") if use_root else F.col("table_name")).drop("root")


def dedup_events(df: DataFrame, arrival: str = "arrival") -> DataFrame:
    """The first to arrive of each event_id; events without one all stay. min_by is combined before the shuffle, so an id
    that comes back often costs one row a task."""
    names = [x for x in df.columns if x != "event_id"]
    first = df.where("event_id IS NOT NULL").groupBy("event_id").agg(F.min_by(F.struct(*names), arrival).alias("x"))
    return first.select("event_id", "x.*").unionByName(df.where("event_id IS NULL"))


NULL_KEY = "<NULL>"


def partition_key(strategy: str, custom: list[str] | None = None) -> Column:
    """What must stay in order together: a row (pk: its key's values, by column name), a table (table), or the values of chosen
    columns (custom: from fields for inserts, else from before_fields). With custom keys an event that lacks such a column and
    an update that carries one are errors."""
    table = F.concat_ws(".", "schema_name", "table_name")
    if strategy == "table":
        return table
    if strategy == "pk":
        values = F.transform(F.array_sort(F.map_entries("key")), lambda x: F.coalesce(x["value"], F.lit(NULL_KEY)))
        return F.concat_ws("|", table, F.array_join(values, "|"))
    names = sorted(custom or [])
    if strategy != "custom" or not names:
        raise ValueError("a partition key needs a strategy (pk, table or custom), and custom ones columns")
    side = F.when(F.col("op") == "c", F.col("fields")).otherwise(F.col("before_fields"))
    has = lambda x, name: F.coalesce(F.map_contains_key(x, name), F.lit(False))
    values = [F.coalesce(F.try_element_at(side, F.lit(x)), F.lit(NULL_KEY)) for x in names]
    changed = F.lit(False)
    lacking = F.lit(False)
    for x in names:
        changed = changed | ((F.col("op") == "u") & has(F.col("fields"), x))
        lacking = lacking | ~has(side, x)

    def wrong(text: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{text}, event "), F.col("vsn").cast("string"))).cast("string")

    return F.when(changed, wrong("an update carries a column that events are dealt out by")).when(lacking, wrong("a column that events are dealt out by is missing")).otherwise(F.concat_ws("|", table, *values))


def channel(key: Column, channels: int = 100) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(channels)).cast("int")


def resolve_strategies(tables: DataFrame, overrides: DataFrame, default: str = "auto") -> DataFrame:
    """tables: table_name, has_expression_index. overrides: table_name, strategy. The override, else the default; auto is
    table for tables with a unique index on an expression, else pk; pk for such a table is an error."""
    named = tables.join(overrides, "table_name", "left").withColumn("strategy", F.coalesce("strategy", F.lit(default)))
    chosen = F.when(F.col("strategy") == "auto", F.when(F.col("has_expression_index"), "table").otherwise("pk")).otherwise(F.col("strategy"))
    wrong = (F.col("strategy") == "pk") & F.col("has_expression_index")
    return named.withColumn("strategy", F.when(wrong, F.raise_error(F.concat(F.lit("pk can't order the expression index of "), "table_name")).cast("string")).otherwise(chosen))


def strategy_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What differs between two runs' strategies (table_name, strategy, columns): missing, extra or changed; the order of columns counts."""
    one = before.select("table_name", F.struct("strategy", "columns").alias("old"))
    two = after.select("table_name", F.struct("strategy", "columns").alias("new"))
    status = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "extra").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return one.join(two, "table_name", "full").withColumn("status", status).where("status IS NOT NULL").select("table_name", "status")


def number_events(df: DataFrame, order: list[str] | list[Column], partitions: int, name: str = "vsn") -> DataFrame:
    """Numbers 0, 1, ... in the given total order: dealt out by range and sorted, then each part numbers on from the rows of
    the parts before it. Only one count for each part passes through a single task."""
    ordered = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    placed = cut(ordered.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("__part").count().select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
