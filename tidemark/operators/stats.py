"""Counting and ranking: event counters, rates, profiles, query statistics."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_counters(events: DataFrame, keys: list[str]) -> DataFrame:
    """inserts, updates, deletes and total by keys."""
    ops = {"inserts": "c", "updates": "u", "deletes": "d"}
    return events.groupBy(*keys).agg(*[F.count_if(F.col("op") == op).alias(name) for name, op in ops.items()], F.count_if(F.col("op").isin("c", "u", "d")).alias("total"))


def merge_counters(partial: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Partial counters added up; names of keys that differ in case are one."""
    return partial.groupBy(*[F.lower(x).alias(x) for x in keys]).agg(*[F.sum(x).alias(x) for x in values])


def merge_query_stats(stats: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each query text: calls, rows and total added up, least and most kept, mean = total / calls (0 without
    calls), queryid the smallest."""
    sums = stats.groupBy(*keys).agg(F.min("queryid").alias("queryid"), F.sum("calls").alias("calls"), F.sum("row_count").alias("row_count"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))
    return sums.withColumn("mean", F.when(F.col("calls") == 0, F.lit(0.0)).otherwise(F.col("total").cast("double") / F.col("calls")))


def rates(paired: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """reads_per_second over all nodes, writes_per_second of the primary, in whole numbers; an interval of 0 counts as 1."""
    interval = F.lit(max(1, seconds))
    per_second = lambda x: F.call_function("div", F.col(x).cast("long"), interval)
    reads = F.sum(F.col("final_seq_reads") - F.col("initial_seq_reads"))
    writes = F.sum(F.when(F.col("source_node") == "primary", F.col("final_row_writes") - F.col("initial_row_writes")).otherwise(0))
    sums = paired.groupBy(*keys).agg(reads.alias("r"), writes.alias("w"))
    return sums.select(*keys, per_second("r").alias("reads_per_second"), per_second("w").alias("writes_per_second"))


def usage_totals(usage: DataFrame, keys: list[str]) -> DataFrame:
    """reads over all nodes; inserts, updates, deletes and their sum writes of the primary."""
    primary = F.col("source_node") == "primary"
    kinds = ("inserts", "updates", "deletes")
    sums = usage.groupBy(*keys).agg(F.sum("scans").alias("reads"), *[F.sum(F.when(primary, F.col(x)).otherwise(0)).alias(x) for x in kinds])
    return sums.withColumn("writes", sum((F.col(x) for x in kinds), F.lit(0)))


def expected_rows(snapshot: Column, inserts: Column, deletes: Column) -> Column:
    return F.coalesce(snapshot, F.lit(0)) + F.coalesce(inserts, F.lit(0)) - F.coalesce(deletes, F.lit(0))


#: From how many issues of an impact on a database is of medium and of high complexity.
THRESHOLDS = {"LEVEL_1": (20, None), "LEVEL_2": (10, 100), "LEVEL_3": (0, 4)}


def complexity(issues: DataFrame, keys: list[str]) -> DataFrame:
    """LOW, MEDIUM or HIGH by the numbers of issues of each impact: high if any is above its high threshold, medium if any is above its medium one."""
    counts = issues.groupBy(*keys).agg(*[F.count_if(F.col("impact") == x).alias(x.lower()) for x in THRESHOLDS])
    high, medium = F.lit(False), F.lit(False)
    for x, (low, top) in THRESHOLDS.items():
        medium = medium | (F.col(x.lower()) > low)
        if top is not None:
            high = high | (F.col(x.lower()) > top)
    return counts.withColumn("complexity", F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW"))


def impact_summary(issues: DataFrame) -> DataFrame:
    """Issues by category (its words capitalised) and impact."""
    title = F.initcap(F.replace("category", F.lit("_"), F.lit(" "))).alias("category")
    return issues.groupBy(title).agg(*[F.count_if(F.col("impact") == x).alias(x.lower()) for x in THRESHOLDS], F.count("*").alias("total"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_rows, null_frac, n_distinct, top_value (of equally frequent ones the smallest), top_freq: exact, by
    counts of each value that are combined before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(x).alias("column_name"), F.col(x).cast("string").alias("value")) for x in columns])
    counts = df.select(F.explode(pairs).alias("x")).select("x.*").groupBy("column_name", "value").agg(F.count("*").alias("n"))
    there = F.col("value").isNotNull()
    sums = counts.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~there, F.col("n"))), F.lit(0)).alias("nulls"), F.count_if(there).alias("n_distinct"),
        F.min(F.when(there, F.struct((-F.col("n")).alias("minus"), "value"))).alias("top"),
    )
    return sums.select("column_name", "n_rows", (F.col("nulls") / F.col("n_rows")).alias("null_frac"), "n_distinct", F.col("top.value").alias("top_value"), (-F.col("top.minus") / F.col("n_rows")).alias("top_freq"))


def approximate_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n_rows, null_frac and n_distinct within about 5 % in one pass, for tables whose values are too many to count."""
    sums = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(x).isNull()).alias(f"nulls_{x}") for x in columns], *[F.approx_count_distinct(x).alias(f"distinct_{x}") for x in columns])
    rows = F.array(*[F.struct(F.lit(x).alias("column_name"), F.col("n").alias("n_rows"), (F.col(f"nulls_{x}") / F.col("n")).alias("null_frac"), F.col(f"distinct_{x}").alias("n_distinct")) for x in columns])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


#: The share of one value, and of nulls, from which a column's index is worth a warning.
TOP_SHARE, NULL_SHARE = 0.6, 0.4


def skew_flags(profiled: DataFrame, predicates: DataFrame) -> DataFrame:
    """column_name, flag (mostly_one_value, mostly_null). predicates: column_name, excluded (a value that a partial index
    leaves out, null for nulls): such a flag is suppressed."""
    one = profiled.where(F.col("top_freq") >= TOP_SHARE).select("column_name", F.lit("mostly_one_value").alias("flag"), F.col("top_value").alias("excluded"))
    null = profiled.where(F.col("null_frac") >= NULL_SHARE).select("column_name", F.lit("mostly_null").alias("flag"), F.lit(None).cast("string").alias("excluded"))
    found = one.unionByName(null)
    p = predicates.select(F.col("column_name").alias("__column"), F.col("excluded").alias("__excluded"))
    same = (F.col("column_name") == F.col("__column")) & F.col("excluded").eqNullSafe(F.col("__excluded"))
    return found.join(p, same, "left_anti").select("column_name", "flag")


def size_totals(objects: DataFrame, indexes: DataFrame, keys: list[str]) -> DataFrame:
    """Of each object set (keys, one of db_id, ...): objects and indexes, their size, and the reads and writes of indexes.
    indexes are summed up for each object first."""
    own = indexes.groupBy("db_id", "schema_name", F.col("table_name").alias("object_name")).agg(F.count("*").alias("n_indexes"), F.sum("size_gb").alias("index_gb"), F.sum("reads").alias("reads"), F.sum("writes").alias("writes"))
    joined = objects.join(own, ["db_id", "schema_name", "object_name"], "left")
    zero = lambda x: F.sum(F.coalesce(F.col(x), F.lit(0))).alias(x)
    return joined.groupBy(*keys).agg(F.count("*").alias("n_objects"), zero("n_indexes"), F.sum(F.col("size_gb") + F.coalesce(F.col("index_gb"), F.lit(0))).alias("size_gb"), zero("reads"), zero("writes"))


def sequence_maxima(events: DataFrame, sequences: DataFrame, initial: DataFrame) -> DataFrame:
    """sequence_name, last_value: the largest whole number that inserts and updates put in a sequence's column, or its initial
    value if that is larger. sequences: schema_name, table_name, column_name, sequence_name; initial: sequence_name, last_value."""
    set_values = events.where(F.col("op") != "d").select("schema_name", "table_name", F.explode("fields").alias("column_name", "value"))
    found = set_values.join(sequences, ["schema_name", "table_name", "column_name"]).select("sequence_name", F.expr("try_cast(value AS bigint)").alias("last_value"))
    return found.unionByName(initial.select("sequence_name", "last_value")).groupBy("sequence_name").agg(F.max("last_value").alias("last_value"))


def value_checks(df: DataFrame, number: str, text: str) -> DataFrame:
    """Rows, sum, distinct values and text length, as a check of a copied table."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(number).alias("total"), F.countDistinct(text).alias("n_distinct"), F.sum(F.length(text)).alias("text_length"))


def ordered_hash(df: DataFrame, segment: Column, row: Column, order: str) -> DataFrame:
    """segment, n_rows, hash: md5 of the rows' md5 in order. A segment goes through one task, sorted on disk if need be and
    hashed as it passes, so that none is held whole; validate.segments() splits further."""
    hashed = df.select(segment.alias("segment"), F.md5(row).alias("h"), F.col(order).alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = kind = digest = None
        n = 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([n], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["segment", "n_rows", "hash"])

        for batch in batches:
            kind = batch.schema.field("segment").type
            for key, rows in itertools.groupby(zip(batch.column("segment").to_pylist(), batch.column("h").to_pylist(), strict=True), key=lambda x: x[0]):
                if digest is None or key != now:
                    if digest is not None:
                        yield done()
                    now, n, digest = key, 0, hashlib.md5()
                for _, h in rows:
                    n += 1
                    digest.update((h or "").encode())
        if digest is not None:
            yield done()

    kind = hashed.schema["segment"].dataType.simpleString()
    ordered = hashed.repartition("segment").sortWithinPartitions("segment", "o", "h")
    return ordered.select("segment", "h").mapInArrow(run, f"segment {kind}, n_rows long, hash string")


def ordered_lists(df: DataFrame, keys: list[str], value: str, position: str, name: str) -> DataFrame:
    """The values of each key as one array, by position."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(position, value))), lambda x: x[value]).alias(name))


def compare_performance(matched: DataFrame) -> DataFrame:
    """match_exact() of two merged query statistics with impact (total time on the target beyond the source's mean, for the
    target's calls) and slowdown (ratio of means, each 2 ms more); -1 for the unmatched."""
    both = F.col("status") == "MATCHED"
    impact = F.col("tgt_total").cast("double") - F.col("src_mean") * F.col("tgt_calls")
    slowdown = (F.col("tgt_mean") + 2) / (F.col("src_mean") + 2)
    return matched.withColumns({"impact": F.when(both, impact).otherwise(-1.0), "slowdown": F.when(both, slowdown).otherwise(-1.0)})


def top(df: DataFrame, by: str, n: int = 20, ties: str = "query") -> DataFrame:
    """The n largest of the matched."""
    return df.where("status = 'MATCHED'").orderBy(F.desc(by), ties).limit(n)


def report_order(calls: str = "tgt_calls") -> list[Column]:
    """Matched first, then target only, then source only; within each by calls."""
    rank = F.when(F.col("status") == "MATCHED", 0).when(F.col("status") == "TARGET_ONLY", 1).otherwise(2)
    return [rank, F.desc_nulls_last(calls), F.col("query")]


def ordered_report(df: DataFrame, calls: str = "tgt_calls") -> DataFrame:
    """df in report_order()."""
    return df.orderBy(*report_order(calls))


def fits_within(df: DataFrame, keys: list[str], order: list[str], limits: dict[str, Column]) -> DataFrame:
    """Rows with fits: whether the sums of all limited columns, over the row and those before it in order, stay within their
    limits. Negative and null values count as 0, so the rows that fit are a prefix."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fits = F.lit(True)
    for name, limit in limits.items():
        fits = fits & (F.sum(F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(0))).over(frame) <= limit)
    return df.withColumn("fits", fits)


def fits_cores(df: DataFrame, keys: list[str], order: list[str], reads: float, writes: float, cores: Column) -> DataFrame:
    """As fits_within(), by the cores that all reads and writes so far need, rounded up."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    need = F.ceil(F.sum("reads").over(frame) / reads + F.sum("writes").over(frame) / writes)
    return df.withColumn("fits", need <= cores)


def cumulative(df: DataFrame, keys: list[str], order: str, delta: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(delta).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def best(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in that order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


#: Share of the most used object's use from which use is frequent or moderate; reads up to which it is none.
FREQUENT, MODERATE, FEW_READS = 0.7, 0.1, 20


def usage_category(df: DataFrame, keys: list[str]) -> DataFrame:
    """reads_category, writes_category and their stronger one, usage: FREQUENT, MODERATE, RARE or UNUSED by the share of the
    most read and most written object of the same keys."""

    def category(x: str, least: int) -> Column:
        share = F.col(x) / F.max(x).over(Window.partitionBy(*keys))
        return F.when(F.coalesce(F.col(x), F.lit(0)) <= least, 3).when(share >= FREQUENT, 0).when(share >= MODERATE, 1).otherwise(2)

    names = F.array(*[F.lit(x) for x in ("FREQUENT", "MODERATE", "RARE", "UNUSED")])
    ranked = df.withColumns({"__r": category("reads", FEW_READS), "__w": category("writes", 0)})
    return ranked.withColumns({"reads_category": F.element_at(names, F.col("__r") + 1), "writes_category": F.element_at(names, F.col("__w") + 1), "usage": F.element_at(names, F.least("__r", "__w") + 1)}).drop("__r", "__w")


def retained(segments: DataFrame, keep: int = 3) -> DataFrame:
    """Processed segments that may go: all but the last ones. Only the keep newest numbers are looked for, by a top-k."""
    done = segments.where("done")
    newest = done.select("segment_no").orderBy(F.desc("segment_no")).limit(keep)
    return done.join(newest, "segment_no", "left_anti")
