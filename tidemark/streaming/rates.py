"""Event rates, live. Each but sliding_rates(), which takes the slots counted so far, takes a batch or streaming DataFrame; give
streams a watermark by late (events that come later are left out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """A stream with its watermark, which needs an instant: times without a zone are taken in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def tumbling_counts(events: DataFrame, keys: list[str], ts: str = "ts", width: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """slot, keys, n: events in each slot of time."""
    counted = watermarked(events, ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("slot"), *keys, "n")


#: Seconds of a slot of tumbling_counts() by default; sliding_rates() gives a row for each.
SLOT = 10


def sliding_rates(slots: DataFrame, keys: list[str], minutes: tuple[int, ...] = (3, 10), began: str | None = None, until: Column | None = None) -> DataFrame:
    """ends, keys and for each m of minutes n_m, per_minute_m and per_second_m (whole numbers): events of the last m minutes at
    each full ten seconds, without the slot that only begins there. slots: slot (a time), keys, n, as tumbling_counts() gives
    them by default, one row for a slot and key. There is a row while the longest of the times holds a slot, until a time if one
    is given (of a live stream: now). While a run is younger than m minutes, its events are divided by the minutes that it has
    begun; it begins with the key's first slot, or at the time in the column began. Slots that are null are left out, counts
    that are null are 0, keys that are null are one key.

    Works on slots, however many events they hold, and repeats none for each window that it lies in: every step from a slot to
    the next appears once, and windows are sums over ranges of steps."""
    length = 60 * max(minutes)
    over = Window.partitionBy(*keys).orderBy("__at")
    seconds = lambda x: F.unix_seconds(F.col(x).cast("timestamp"))
    known = slots.where(F.col("slot").isNotNull()).select(*keys, seconds("slot").alias("__at"), F.coalesce("n", F.lit(0)).cast("long").alias("__n"), (seconds(began) if began else F.lit(None).cast("long")).alias("__began"))
    first = F.coalesce("__began", F.min("__at").over(Window.partitionBy(*keys)))
    last = F.least(F.lead("__at").over(over) - SLOT, F.col("__at") + length)  # least() passes over nulls
    marked = known.withColumns({"__first": first, "__last": last})
    here = F.col("__step") == F.col("__at")
    found = (
        marked.withColumn("__step", F.explode(F.sequence("__at", "__last", F.lit(SLOT))))
        .select(*keys, F.col("__step").alias("__at"), F.round((F.col("__step") - F.col("__first")) / 60, 2).alias("__age"), F.when(here, F.col("__n")).otherwise(0).alias("__n"), here.cast("int").alias("__slots"))
    )
    sums = {f"n_{m}": F.sum("__n").over(over.rangeBetween(-60 * m, -1)) for m in minutes}
    summed = found.withColumns({**sums, "__slots": F.sum("__slots").over(over.rangeBetween(-length, -1))}).where("__slots > 0")
    if until is not None:
        summed = summed.where(F.timestamp_seconds("__at") <= until.cast("timestamp"))
    summed = summed.withColumns({f"n_{m}": F.coalesce(f"n_{m}", F.lit(0)) for m in minutes})
    summed = summed.withColumns({f"per_minute_{m}": F.expr(f"n_{m} div if(__age < {m}, cast(floor(__age) as bigint) + 1, {m})") for m in minutes})
    rates = [c for m in minutes for c in (F.col(f"n_{m}"), F.col(f"per_minute_{m}"), F.expr(f"per_minute_{m} div 60").alias(f"per_second_{m}"))]
    return summed.select(F.timestamp_seconds("__at").cast("timestamp_ntz").alias("ends"), *keys, *rates)


def catch_up_minutes(remaining: Column, per_minute: Column) -> Column:
    """Whole minutes until what remains is worked off at that rate; null if nothing moves."""
    return F.floor(remaining / F.nullif(per_minute, F.lit(0)))


def running_sequences(events: DataFrame, column: str, sequence: str) -> DataFrame:
    """The largest whole number so far that inserts and updates put in a column; a state of one number."""
    value = F.expr(f"try_cast(try_element_at(fields, '{column}') AS bigint)")
    return events.where("op <> 'd'").groupBy(F.lit(sequence).alias("sequence_name")).agg(F.max(value).alias("last_value"))


def dedup(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """One of each event_id: on a stream those that repeat within the watermark, in a batch all."""
    if events.isStreaming:
        return watermarked(events, ts, late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
