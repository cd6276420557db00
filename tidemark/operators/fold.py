"""Folding a change log into a table, with what each change does: an insert of a live key is ignored, an update or delete of
a dead one touches nothing, an update sets only the columns it carries (to null too), a delete ends the row.

Everything that grows with a key's events is combined before the shuffle or split by ranges of the log, so that a key which
holds a large part of all events doesn't end in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of the log that are carried over as one.
CHUNK = 1 << 16


def carry_last(df: DataFrame, keys: list[str], order: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with the last value that isn't null of the rows before each one, by keys in that order. A key's rows are split into
    chunks of the order: within a chunk by a window over it, before it by a window over the chunks' last values."""
    split = df.withColumns({"__chunk": F.floor(F.col(order) / chunk), "__value": value})
    chunks = split.groupBy(*keys, "__chunk").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(order))).alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.withColumn("__before", F.last("__end", True).over(earlier)).select(*keys, "__chunk", "__before")
    within = Window.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = split.withColumn("__inner", F.last("__value", True).over(within))
    return inner.join(before, [*keys, "__chunk"]).withColumn(name, F.coalesce("__inner", "__before")).drop("__chunk", "__value", "__inner", "__before")


def count_before(df: DataFrame, keys: list[str], order: str, counts: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """df with the number of rows before each one, by keys in that order, for which counts holds. Goes by chunks as carry_last()."""
    split = df.withColumns({"__chunk": F.floor(F.col(order) / chunk), "__one": F.coalesce(counts, F.lit(False)).cast("long")})
    chunks = split.groupBy(*keys, "__chunk").agg(F.sum("__one").alias("__all"))
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.withColumn("__before", F.sum("__all").over(earlier)).select(*keys, "__chunk", "__before")
    within = Window.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = split.withColumn("__inner", F.sum("__one").over(within))
    zero = F.lit(0).cast("long")
    return inner.join(before, [*keys, "__chunk"]).withColumn(name, F.coalesce("__inner", zero) + F.coalesce("__before", zero)).drop("__chunk", "__one", "__inner", "__before")


def effects(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """changes with live (whether the row exists just before) and effective (whether the change does anything)."""
    carried = carry_last(changes, key, "vsn", F.when(F.col("op").isin("c", "d"), F.col("op")), "__prior")
    joined = carried.join(base.select(*key).distinct().withColumn("__base", F.lit(True)), key, "left")
    live = F.when(F.col("__prior").isNull(), F.coalesce("__base", F.lit(False))).otherwise(F.col("__prior") == "c")
    return joined.withColumn("live", live).withColumn("effective", F.when(F.col("op") == "c", ~F.col("live")).otherwise(F.col("live"))).drop("__prior", "__base")


def ineffective(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """How many changes, by op, touch no row."""
    return effects(base, changes, key).groupBy("op").agg(F.count("*").alias("n"), F.count_if(~F.col("effective")).alias("n_ineffective"))


def fold(base: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The table after the changes: key and columns (as text) of base, patched.

    One aggregate over the log gives, per key, the last delete and of each column the latest update; one over the inserts
    after the last delete gives the first of them, which begins the row's last life (none: it began in base, if no delete
    came). Of each column the update counts if it is of that life, else the insert's value. The aggregates combine before
    the shuffle, and the join of inserts isn't grouped by its own partitioning, so that a hot key's part of it can be split."""

    def latest(name: str) -> Column:
        there = (F.col("op") == "u") & F.map_contains_key("fields", name)
        return F.max_by(F.when(there, F.struct("vsn", F.col("fields")[name].alias("v"))), F.when(there, F.col("vsn"))).alias(f"__{name}")

    facts = changes.groupBy(*key).agg(F.max(F.when(F.col("op") == "d", F.col("vsn"))).alias("__death"), *[latest(x) for x in columns])
    inserts = changes.where("op = 'c'").select(*key, "vsn", *[F.try_element_at("fields", F.lit(x)).alias(f"__new_{x}") for x in columns])
    ends = facts.where("__death IS NOT NULL").select(*key, "__death")
    later = inserts.join(ends, key, "left").where(F.col("vsn") > F.coalesce("__death", F.lit(-1)))
    first = later.groupBy(F.struct(*key).alias("__key")).agg(F.min_by(F.struct("vsn", *[f"__new_{x}" for x in columns]), "vsn").alias("__birth"))
    births = first.select("__key.*", "__birth")
    old = base.select(*key, F.lit(True).alias("__base"), *[F.col(x).alias(f"__old_{x}") for x in columns])
    rows = old.join(facts, key, "full").join(births, key, "left")
    kept = F.col("__base").isNotNull() & F.col("__death").isNull()

    def value(x: str) -> Column:
        update, birth = F.col(f"__{x}"), F.col("__birth")
        since = F.when(kept, F.lit(-1)).otherwise(birth["vsn"])
        return F.when(F.coalesce(update["vsn"] > since, F.lit(False)), update["v"]).when(kept, F.col(f"__old_{x}")).otherwise(birth[f"__new_{x}"]).alias(x)

    return rows.where(kept | F.col("__birth").isNotNull()).select(*key, *[value(x) for x in columns])


def latest_state(changes: DataFrame, key: list[str]) -> DataFrame:
    """The last event of each key, for logs in which every event carries the whole row; deleted keys are left out."""
    last = changes.groupBy(*key).agg(F.max_by(F.struct("op", "fields"), "vsn").alias("x"), F.max("vsn").alias("vsn"))
    return last.where("x.op <> 'd'").select(*key, "vsn", "x.fields")


def history(base: DataFrame, changes: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """key, vsn, op, columns: the row after each effective insert and update, and as it was before each effective delete."""
    done = effects(base, changes, key).where("effective")
    start = base.select(*key, F.lit(-1).cast("long").alias("vsn"), F.lit("c").alias("op"), F.map_from_arrays(F.array(*[F.lit(x) for x in columns]), F.array(*columns)).alias("fields"))
    events = done.select(*key, "vsn", "op", "fields").unionByName(start)
    out = events
    for x in columns:
        there = (F.col("op") == "c") | F.map_contains_key("fields", x)
        out = carry_last(out, key, "vsn", F.when(there, F.struct(F.try_element_at("fields", F.lit(x)).alias("v"))), f"__before_{x}")
    values = []
    for x in columns:
        there = (F.col("op") == "c") | F.map_contains_key("fields", x)
        values.append(F.when(there, F.try_element_at("fields", F.lit(x))).otherwise(F.col(f"__before_{x}")["v"]).alias(x))
    return out.where("vsn >= 0").select(*key, "vsn", "op", *values)


def net_change(base: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """key, net of each changed key: c, u, d or none, from whether it exists before and after."""
    facts = changes.groupBy(*key).agg(
        F.max(F.when(F.col("op") == "d", F.col("vsn"))).alias("__death"), F.max(F.when(F.col("op") == "c", F.col("vsn"))).alias("__insert"), F.max(F.when(F.col("op") == "u", F.col("vsn"))).alias("__update")
    ).join(base.select(*key).withColumn("__base", F.lit(True)), key, "left")
    was = F.coalesce("__base", F.lit(False))
    now = F.when(F.col("__death").isNull(), was | F.col("__insert").isNotNull()).otherwise(F.coalesce(F.col("__insert") > F.col("__death"), F.lit(False)))
    touched = F.col("__death").isNotNull() | F.col("__update").isNotNull()
    net = F.when(~was & now, "c").when(was & ~now, "d").when(was & now & touched, "u").otherwise("none")
    return facts.select(*key, net.alias("net"))


def resume(changes: DataFrame, ledger: DataFrame) -> DataFrame:
    """changes (with channel) beyond what their channel has applied. ledger: channel, last_applied; one row a channel."""
    joined = changes.join(ledger, "channel", "left")
    return joined.where(F.col("vsn") > F.coalesce("last_applied", F.lit(-1))).drop("last_applied")


def until_marker(changes: DataFrame, markers: tuple[str, ...] = ("cutover.target", "cutover.source", "cutover.source_replica")) -> DataFrame:
    """The changes before the first marker; all if there is none."""
    end = changes.where(F.col("op").isin(*markers)).agg(F.min("vsn").alias("__end"))
    return changes.join(F.broadcast(end), F.coalesce(F.col("vsn") < F.col("__end"), F.lit(True))).drop("__end")


def next_segments(ledger: DataFrame) -> DataFrame:
    """Segments (segment_no, done) in order that are still to be processed."""
    return ledger.where(~F.col("done")).orderBy("segment_no")


def snapshot_conflicts(rows: DataFrame, target: DataFrame, key: list[str], policy: str = "error") -> DataFrame:
    """rows that a snapshot load may insert: one of each key, none that target has. With policy error, a repeated or existing
    key raises when the result is used; with ignore, it is left out."""
    names = [x for x in rows.columns if x not in key]
    one = rows.groupBy(*key).agg(F.min(F.struct(*names)).alias("__row"), F.count("*").alias("__n"))
    if policy == "ignore":
        return one.join(target.select(*key), key, "left_anti").select(*key, "__row.*")
    clash = one.join(target.select(*key).withColumn("__there", F.lit(True)), key, "left")
    wrong = F.col("__there").isNotNull() | (F.col("__n") > 1)
    check = F.when(wrong, F.raise_error(F.concat_ws(" ", F.lit("key exists:"), *[F.col(x).cast("string") for x in key])).cast("boolean")).otherwise(True)
    return clash.where(check).select(*key, "__row.*")
