"""Changes of different rows that meet in one unique key, and so must not be applied at the same time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .fold import CHUNK, carry_last, count_before

NULL = "<null>"


def bucket_key(values: Column, columns: list[str], nulls_not_distinct: bool, prefix: str) -> Column:
    """A text that is equal for equal values of an index's columns, each with its length before it. Null where values (a map)
    lacks a column, or holds a null and nulls are distinct."""
    parts = []
    usable = F.lit(True)
    for x in columns:
        value = F.try_element_at(values, F.lit(x))
        usable = usable & F.coalesce(F.map_contains_key(values, x), F.lit(False))
        if not nulls_not_distinct:
            usable = usable & value.isNotNull()
        text = F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit(NULL))
        parts.append(text)
    return F.when(usable, F.concat_ws("|", F.lit(prefix), *parts))


def pair_conflicts(log: DataFrame, later_ops: tuple[str, ...] = ("c", "u")) -> DataFrame:
    """earlier, later: events of different pkey, where the earlier (u, d) gives up the value that the later one takes.
    log: vsn, op, pkey, before_bucket, after_bucket. All pairs; nearest_conflicts() gives one for each event."""
    early = log.where(F.col("op").isin("u", "d") & F.col("before_bucket").isNotNull()).select(F.col("vsn").alias("earlier"), F.col("pkey").alias("__pkey"), F.col("before_bucket").alias("bucket"))
    late = log.where(F.col("op").isin(*later_ops) & F.col("after_bucket").isNotNull()).select(F.col("vsn").alias("later"), "pkey", F.col("after_bucket").alias("bucket"))
    return late.join(early, "bucket").where((F.col("earlier") < F.col("later")) & (F.col("__pkey") != F.col("pkey"))).select("bucket", "earlier", "later")


def before_conflicts(log: DataFrame) -> DataFrame:
    """earlier, later: as pair_conflicts(), but the later one, which isn't an insert, held the same value before."""
    return pair_conflicts(_held(log), ("u", "d"))


def _held(log: DataFrame) -> DataFrame:
    """log with what an event that isn't an insert held before in place of what it takes."""
    return log.withColumn("after_bucket", F.when(F.col("op") != "c", F.col("before_bucket")))


def conflict_counts(log: DataFrame, later_ops: tuple[str, ...] = ("c", "u")) -> DataFrame:
    """later, n, nearest: of each event that has any, how many pairs pair_conflicts() gives it, and the last of their earlier
    ones. No pairs are formed: the events before it that free the value, less those of its own pkey."""
    frees = _frees(log).where("pkey IS NOT NULL")
    takes = log.where(F.col("op").isin(*later_ops) & F.col("after_bucket").isNotNull() & F.col("pkey").isNotNull()).select("vsn", "pkey", F.col("after_bucket").alias("bucket"), F.lit(False).alias("frees"))
    placed = cut(_with_last_free(frees.unionByName(takes)).select("vsn", "pkey", "bucket", "frees", "at", "blocker"))
    by_bucket = count_before(placed, ["bucket"], "at", F.col("frees"), "__all")
    counted = count_before(by_bucket, ["bucket", "pkey"], "at", F.col("frees"), "__own").where(~F.col("frees"))
    return counted.select(F.col("vsn").alias("later"), (F.col("__all") - F.col("__own")).alias("n"), F.col("blocker").alias("nearest")).where("n > 0")


def before_conflict_counts(log: DataFrame) -> DataFrame:
    """later, n, nearest: as conflict_counts(), of the pairs that before_conflicts() gives."""
    return conflict_counts(_held(log), ("u", "d"))


def _frees(log: DataFrame) -> DataFrame:
    return log.where(F.col("op").isin("u", "d") & F.col("before_bucket").isNotNull()).select("vsn", "pkey", F.col("before_bucket").alias("bucket"), F.lit(True).alias("frees"))


def _running(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with last, the freeing event (vsn, pkey) before each one, and other, the last one before that of another pkey. Where
    one pkey's run of freeing events begins, the event before it is of another; so the last such turn is the answer. Both
    windows share one order."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("frees"), F.struct("vsn", "pkey"))
    ran = rows.withColumn("last", F.last(own, True).over(before))
    turned = ran.withColumn("turn", F.when(F.col("frees") & (F.col("last.pkey") != F.col("pkey")), F.col("last")))
    return turned.withColumn("other", F.last("turn", True).over(before))


def _with_last_free(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """rows (vsn, pkey, bucket, frees) in order (at) with blocker, the last event before each that frees the bucket and is of
    another pkey. A bucket's rows are split into chunks of the log, each gone through by itself. What a chunk
    leaves behind is its last freeing event and the last of another pkey; those are gone through in the same way."""
    placed = rows.withColumns({"at": F.col("vsn") * 2 + F.col("frees").cast("int"), "chunk": F.floor(F.col("vsn") / chunk)})
    # what an event asks for sorts before its own freeing, which has its own pkey, so that it doesn't matter
    inner = _running(placed, ["bucket", "chunk"], "at")
    state = F.struct(F.struct("vsn", "pkey").alias("last"), F.coalesce("turn", "other").alias("other"))
    left = cut(inner.groupBy("bucket", "chunk").agg(F.max_by(state, F.when(F.col("frees"), F.col("vsn"))).alias("x")))
    ends = left.select("bucket", "chunk", F.explode(F.array_compact(F.array("x.last", "x.other"))).alias("e")).select("bucket", "chunk", "e.*", F.lit(True).alias("frees"))
    outer = _running(ends, ["bucket"], "vsn").groupBy("bucket", "chunk").agg(F.max_by(state, "vsn").alias("x"))
    earlier = Window.partitionBy("bucket").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = left.select("bucket", "chunk").join(outer, ["bucket", "chunk"], "left")
    carried = chunks.select("bucket", "chunk", F.last("x", True).over(earlier).alias("x")).where("x IS NOT NULL")
    joined = inner.join(carried, ["bucket", "chunk"], "left")
    differs = lambda x: F.coalesce(F.col(f"{x}.pkey") != F.col("pkey"), F.lit(False))
    found = [F.when(differs(x), F.col(f"{x}.vsn")) for x in ("last", "other", "x.last", "x.other")]  # from the latest to the earliest
    return joined.select("vsn", "pkey", "bucket", "frees", "at", F.coalesce(*found).alias("blocker"))


def nearest_conflicts(log: DataFrame, window: int | None = None) -> DataFrame:
    """vsn, bucket, blocker: for each event and value that it takes (or, updating, holds), the latest earlier event of another
    pkey that gives the value up, at most window places back if that is given. Linear: no pairs are formed."""
    before, after, op = F.col("before_bucket"), F.col("after_bucket"), F.col("op")
    holds = F.when((op == "u") & F.coalesce(before != after, F.lit(True)), before)
    each = [(F.when(op.isin("u", "d"), before), True), (F.when(op.isin("c", "u"), after), False), (holds, False)]
    parts = F.array(*[F.struct(bucket.alias("bucket"), F.lit(frees).alias("frees")) for bucket, frees in each])
    rows = log.select("vsn", "pkey", F.explode(F.filter(parts, lambda x: x["bucket"].isNotNull())).alias("x")).select("vsn", "pkey", "x.*")
    placed = _with_last_free(rows)
    found = placed.where(~F.col("frees")).select("vsn", "bucket", "blocker").where("blocker IS NOT NULL")
    return found if window is None else found.where(F.col("vsn") - F.col("blocker") <= window)


def coarse_conflicts(log: DataFrame) -> DataFrame:
    """vsn, blocker, for logs without before-values: the nearest earlier event of another pkey that is a delete of the table or,
    for events that set unique columns, an update that sets some of the same. log: vsn, op, pkey, table_name, columns (unique
    ones it sets)."""
    named = log.select("vsn", "pkey", "op", F.concat(F.lit("d|"), "table_name").alias("table_bucket"), F.transform("columns", lambda x: F.concat(F.lit("u|"), "table_name", F.lit("|"), x)).alias("set_buckets"))
    set_each = named.where(F.col("op") != "d").select("vsn", "pkey", "op", F.explode("set_buckets").alias("bucket"))
    table_each = named.select("vsn", "pkey", "op", F.col("table_bucket").alias("bucket"))
    frees = table_each.where("op = 'd'").unionByName(set_each.where("op = 'u'")).select("vsn", "pkey", "bucket", F.lit(True).alias("frees"))
    asks = table_each.unionByName(set_each).select("vsn", "pkey", "bucket", F.lit(False).alias("frees"))
    found = _with_last_free(frees.unionByName(asks)).where(~F.col("frees") & F.col("blocker").isNotNull())
    return found.groupBy("vsn").agg(F.max("blocker").alias("blocker"))


def role_stretches(log: DataFrame) -> DataFrame:
    """log (vsn, exporter_role) with stretch: how often the role has changed up to the event. Only the ends of chunks of the
    log pass through one task."""
    marked = carry_last(log, [], "vsn", F.col("exporter_role"), "__role_before")
    turned = marked.withColumn("__turned", F.coalesce(F.col("__role_before") != F.col("exporter_role"), F.lit(False)))
    counted = count_before(turned, [], "vsn", F.col("__turned"), "stretch")
    return counted.withColumn("stretch", F.col("stretch") + F.col("__turned").cast("long")).drop("__role_before", "__turned")


def conflicts_by_role(log: DataFrame, coarse_roles: list[str]) -> DataFrame:
    """stretch, vsn, blocker: the last earlier event that each one must wait for, where the exporter's role changes within the
    log. Whoever takes over, detection begins anew, since all before has been applied by then; and it goes by the rules of
    the role: by values, or coarsely for those of coarse_roles, whose events have no before-values. log: vsn, op, pkey,
    exporter_role, before_bucket, after_bucket, table_name, columns (unique ones it sets)."""
    placed = cut(role_stretches(log))
    coarse = F.col("exporter_role").isin(*coarse_roles)

    def within(x: str) -> Column:
        return F.concat(F.col("stretch").cast("string"), F.lit("|"), F.col(x))

    by_value = nearest_conflicts(placed.where(~coarse).withColumns({x: within(x) for x in ("before_bucket", "after_bucket")})).select("vsn", "blocker")
    by_table = coarse_conflicts(placed.where(coarse).withColumn("table_name", within("table_name")))
    found = by_value.unionByName(by_table).groupBy("vsn").agg(F.max("blocker").alias("blocker"))
    return found.join(placed.select("vsn", "stretch"), "vsn").select("stretch", "vsn", "blocker")


def unchecked_tables(tables: DataFrame, indexes: DataFrame, strategies: DataFrame) -> DataFrame:
    """Tables whose events can't conflict: without a unique index, or kept in order as a whole."""
    whole = strategies.where("strategy = 'table'").select("table_name")
    safe = tables.join(indexes.select("table_name").distinct(), "table_name", "left_anti").select("table_name")
    return safe.union(tables.join(whole, "table_name", "left_semi").select("table_name")).distinct()


def merge_indexes(indexes: DataFrame, roots: DataFrame) -> DataFrame:
    """Unique indexes of leaf partitions as their root's, each once. indexes: table_name, columns. roots: leaf, root."""
    named = indexes.join(roots.select(F.col("leaf").alias("table_name"), "root"), "table_name", "left")
    return named.select(F.coalesce("root", "table_name").alias("table_name"), "columns").distinct()


def duplicate_keys(df: DataFrame, columns: list[str], nulls_distinct: bool = True) -> DataFrame:
    """columns, n of keys that more than one row has; rows with a null equal none if nulls are distinct."""
    rows = df.dropna(subset=columns) if nulls_distinct else df
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
