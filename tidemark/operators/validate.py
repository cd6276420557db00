"""Whether two copies of a table agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 65_536


def as_text(df: DataFrame, columns: list[str]) -> Column:
    """The columns' texts joined by |, null as \\N. Give doubles as decimals, for their texts differ between engines."""
    return F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("\\N")) for x in columns])


def bucket(key: Column) -> Column:
    """The first 4 bytes of the key text's md5, modulo 65536."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")


def segments(df: DataFrame, key: list[str], columns: list[str], n: int = 16) -> DataFrame:
    """segment, n_rows, xor_hash, sum_hash of the rows in each of n equal ranges of buckets (n divides 65536). The hashes
    don't depend on order, so they are combined before the shuffle; repeated rows cancel in the one, not in the other."""
    if n <= 0 or BUCKETS % n:
        raise ValueError("the number of segments must divide 65536")
    part = F.conv(F.substring(F.md5(as_text(df, columns)), 1, 15), 16, 10).cast("long")
    placed = df.select(F.floor(bucket(as_text(df, key)) / (BUCKETS // n)).cast("int").alias("segment"), part.alias("h"))
    return placed.groupBy("segment").agg(F.count("*").alias("n_rows"), F.bit_xor("h").alias("xor_hash"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum_hash"))


def compare_segments(source: DataFrame, target: DataFrame) -> DataFrame:
    """segment, source_rows, target_rows, status: match, mismatch, missing_source or missing_target."""
    one = source.select("segment", F.struct("n_rows", "xor_hash", "sum_hash").alias("one"))
    two = target.select("segment", F.struct("n_rows", "xor_hash", "sum_hash").alias("two"))
    status = F.when(F.col("one").isNull(), "missing_source").when(F.col("two").isNull(), "missing_target").when(F.col("one") == F.col("two"), "match").otherwise("mismatch")
    return one.join(two, "segment", "full").select("segment", F.col("one.n_rows").alias("source_rows"), F.col("two.n_rows").alias("target_rows"), status.alias("status"))


def drill_down(source: DataFrame, target: DataFrame, key: list[str], columns: list[str], n: int = 16) -> DataFrame:
    """The rows that differ, looked for in mismatching segments alone: key, source_n, target_n (how often each row's text
    occurs on each side), row_text."""
    bad = compare_segments(segments(source, key, columns, n), segments(target, key, columns, n)).where("status <> 'match'").select("segment")

    def rows(df: DataFrame, name: str) -> DataFrame:
        segment = F.floor(bucket(as_text(df, key)) / (BUCKETS // n)).cast("int")
        own = df.select(*key, as_text(df, columns).alias("row_text"), segment.alias("segment")).join(bad, "segment", "left_semi")
        return own.groupBy(*key, "row_text").agg(F.count("*").alias(name))

    both = rows(source, "source_n").join(rows(target, "target_n"), [*key, "row_text"], "full").fillna(0, ["source_n", "target_n"])
    return both.where("source_n <> target_n")


def compare_counts(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """table_name, source_rows, target_rows, same of all tables, in one job a side."""

    def counts(tables: dict[str, DataFrame], name: str) -> DataFrame:
        each = [df.agg(F.count("*").alias(name)).withColumn("table_name", F.lit(x)) for x, df in tables.items()]
        return reduce(DataFrame.unionByName, each)

    both = counts(source, "source_rows").join(counts(target, "target_rows"), "table_name", "full")
    return both.withColumn("same", F.col("source_rows").eqNullSafe(F.col("target_rows")))


def lag(exported: DataFrame, imported: DataFrame, keys: list[str]) -> DataFrame:
    """Events exported and not yet imported, by keys."""
    one, two = exported.select(*keys, F.col("total").alias("exported")), imported.select(*keys, F.col("total").alias("imported"))
    joined = one.join(two, keys, "full").fillna(0, ["exported", "imported"])
    return joined.withColumn("remaining", F.col("exported") - F.col("imported"))


def column_differences(source: DataFrame, target: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """column_name, check, source_value, target_value, same: sums of numbers, distinct values and lengths of texts."""

    def checks(df: DataFrame, name: str) -> DataFrame:
        found = [(x, "sum", F.sum(x)) for x in numbers] + [(x, "distinct", F.countDistinct(x)) for x in texts] + [(x, "length", F.sum(F.length(x))) for x in texts]
        one = df.agg(*[value.cast("string").alias(f"v{k}") for k, (_, _, value) in enumerate(found)])
        rows = F.array(*[F.struct(F.lit(x).alias("column_name"), F.lit(kind).alias("check"), F.col(f"v{k}").alias(name)) for k, (x, kind, _) in enumerate(found)])
        return one.select(F.explode(rows).alias("x")).select("x.*")

    both = checks(source, "source_value").join(checks(target, "target_value"), ["column_name", "check"])
    return both.withColumn("same", F.col("source_value").eqNullSafe(F.col("target_value")))


def audit(df: DataFrame, key: list[str], not_null: list[str], parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """check, column_name, n: nulls, surplus rows of a key, and values whose parent row is missing."""
    parts = [df.agg(F.count_if(F.col(x).isNull()).alias("n")).select(F.lit("null").alias("check"), F.lit(x).alias("column_name"), "n") for x in not_null]
    surplus = df.groupBy(*key).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    parts.append(surplus.select(F.lit("duplicate_key").alias("check"), F.lit(",".join(key)).alias("column_name"), "n"))
    for x, (parent, name) in parents.items():
        lost = df.where(F.col(x).isNotNull()).join(parent.select(F.col(name).alias("__parent")), F.col(x) == F.col("__parent"), "left_anti")
        parts.append(lost.agg(F.count("*").alias("n")).select(F.lit("orphan").alias("check"), F.lit(x).alias("column_name"), "n"))
    return reduce(DataFrame.unionByName, parts)


def multiset_difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows that one side has more often, with side (source, target)."""
    return one.exceptAll(two).withColumn("side", F.lit("source")).unionByName(two.exceptAll(one).withColumn("side", F.lit("target")))


def key_difference(one: DataFrame, two: DataFrame, key: list[str]) -> DataFrame:
    """key, side of keys that one side alone has. Repeated keys are made one of what is left, not of whole sides, whose keys a
    task would hold."""
    a, b = (df.select(*key) for df in (one, two))
    return a.join(b, key, "left_anti").distinct().withColumn("side", F.lit("source")).unionByName(b.join(a, key, "left_anti").distinct().withColumn("side", F.lit("target")))


def archive_completeness(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """segment_no, status: ok, missing (in the ledger, no file) or unknown (a file that the ledger lacks)."""
    both = ledger.select("segment_no", F.lit(True).alias("a")).join(files.select("segment_no", F.lit(True).alias("b")).distinct(), "segment_no", "full")
    return both.select("segment_no", F.when(F.col("a").isNull(), "unknown").when(F.col("b").isNull(), "missing").otherwise("ok").alias("status"))
