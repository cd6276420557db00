"""State by key that outlives a stream's batches and restarts: rows of a table, maxima of sequences, changes in flight.

The state is kept by Spark's state store in the stream's own progress folder. It must be RocksDB's, which state_store() sets;
what each key holds is bounded: a row, a number, or the changes that no channel has reported applied."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Batches without data are left out: with a time-to-live there would always be another, and a run over what there is would never end.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB, in as many partitions as there are cores at most: each has
    files to commit with every batch, however little it holds. A stream that goes on keeps its number."""
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    settings = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)}
    before = {x: spark.conf.get(x, None) for x in settings}
    for x, value in settings.items():
        spark.conf.set(x, value)
    try:
        yield
    finally:
        for x, value in before.items():
            spark.conf.unset(x) if value is None else spark.conf.set(x, value)


class _Rows(StatefulProcessor):
    """A row: its columns as text and the last change that touched it. Of a row that is gone only the change that ended it is
    kept, for as long as changes may come twice."""

    def __init__(self, key: list[str], keep_ms: int):
        self.out, self.keep_ms = Row(*key, "vsn", "live", "fields"), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", "vsn long, fields map<string,string>")
        self.gone = handle.getValueState("gone", "vsn long", self.keep_ms)

    def handleInitialState(self, key, initial, timers) -> None:
        self.row.update((-1, dict(initial["fields"])))

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        vsn, fields = self.row.get() if self.row.exists() else (self.gone.get()[0] if self.gone.exists() else -1, None)
        fields, touched = None if fields is None else dict(fields), False
        for x in sorted(rows, key=lambda x: x["vsn"]):  # of one key and batch
            if x["vsn"] <= vsn:
                continue  # has been applied
            if (x["op"] == "c") == (fields is not None):
                continue  # an insert of a live row, or anything else of a dead one
            vsn, touched = x["vsn"], True
            fields = None if x["op"] == "d" else (fields or {}) | dict(x["fields"])
        if touched:
            if fields is None:
                self.row.clear()
                self.gone.update((vsn,))
            else:
                self.gone.clear()
                self.row.update((vsn, fields))
            yield self.out(*key, vsn, fields is not None, fields)

    def close(self) -> None:
        pass


def row_states(changes: DataFrame, base: DataFrame | None, key: list[str], columns: list[str], keep_ms: int = 3_600_000) -> DataFrame:
    """A stream of key, vsn, live, fields: the state of each row that a batch has touched, after the batch. changes: a stream of
    vsn, op (c, u, d), fields and the key; applied in order of vsn, which must not fall from batch to batch for a key. base (key
    and columns, as text) is what the rows are to begin with. A change that comes again does nothing; for keys whose row is gone
    that holds for keep_ms after it went."""
    out = T.StructType([*[changes.schema[x] for x in key], T.StructField("vsn", T.LongType()), T.StructField("live", T.BooleanType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))])
    events = changes.where(F.col("op").isin("c", "u", "d")).select(*key, "vsn", "op", "fields")
    start = None
    if base is not None:
        start = base.select(*key, F.map_from_arrays(F.array(*[F.lit(x) for x in columns]), F.array(*columns)).alias("fields")).groupBy(*key)
    return events.groupBy(*key).transformWithState(_Rows(key, keep_ms), out, "Update", "ProcessingTime", start)


def latest_rows(base: DataFrame, states: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The table: base's rows that no state replaces, and the rows of the last states that are live."""
    untouched = base.join(states.select(*key), key, "left_anti").select(*key, *columns)
    return untouched.unionByName(states.where("live").select(*key, *[F.try_element_at("fields", F.lit(x)).alias(x) for x in columns]))


class _Maxima(StatefulProcessor):
    """The largest number so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.most = handle.getValueState("most", "value long")

    def handleInitialState(self, key, initial, timers) -> None:
        self.most.update((initial["last_value"],))

    def handleInputRows(self, key, rows, timers) -> Iterator[Row]:
        before = self.most.get()[0] if self.most.exists() else None
        found = max((x["value"] for x in rows), default=None)
        if found is not None and (before is None or found > before):
            self.most.update((found,))
            yield Row(sequence_name=key[0], last_value=found)

    def close(self) -> None:
        pass


def sequence_states(changes: DataFrame, sequences: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """A stream of sequence_name, last_value whenever a batch has raised it. sequences: schema_name, table_name, column_name,
    sequence_name; inserts and updates of those columns count where they are whole numbers. start (sequence_name, last_value):
    the values to begin with."""
    fields = changes.where(F.col("op").isin("c", "u", "r")).select("schema_name", "table_name", F.explode("fields").alias("column_name", "text"))
    named = fields.join(sequences, ["schema_name", "table_name", "column_name"])
    values = named.select("sequence_name", F.col("text").try_cast("long").alias("value")).where("value IS NOT NULL")
    highest = values.groupBy("sequence_name")
    begin = None if start is None else start.where("last_value IS NOT NULL").groupBy("sequence_name")
    return highest.transformWithState(_Maxima(), "sequence_name string, last_value long", "Update", "None", begin)


#: Groups that buckets are dealt to; a channel's reports go to each of them.
GROUPS = 64

#: Bytes of a log, about, that go to the groups in one pack each.
PACK = 4 << 20

#: Pairs of a change and one in flight that are looked at together.
PAIRS = 1 << 20

#: Before and after all places of a batch.
BEGIN, END = np.iinfo(np.int64).min, np.iinfo(np.int64).max

#: What packs hold.
CHANGES = pa.schema({"seq": pa.int64(), "vsn": pa.int64(), "pkey": pa.string(), "channel": pa.int32(), "asks": pa.bool_(), "bucket": pa.string()})
REPORTS = pa.schema({"seq": pa.int64(), "channel": pa.int32(), "applied": pa.int64()})


def _spark_hash(number: int) -> int:
    """Spark's hash() of an int."""
    k = number * 0xCC9E2D51 & 0xFFFFFFFF
    h = 42 ^ ((k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF)
    h = ((h << 13 | h >> 19) * 5 + 0xE6546B64 & 0xFFFFFFFF) ^ 4
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    h ^= h >> 16
    return h - (h >> 31 << 32)


def group_keys(groups: int, cycle: int = 5040) -> list[int]:
    """Keys of the groups that Spark deals to the partitions in turn, for any number of partitions that divides the cycle. The
    keys 0, 1, 2 and so on would go to partitions by chance, three to one and none to another."""
    found: dict[int, int] = {}
    number = 0
    while len(found) < groups:
        place = _spark_hash(number) % cycle
        while place in found:
            place += cycle
        if place < groups:
            found[place] = number
        number += 1
    return [found[g] for g in range(groups)]


def _packed(rows: pa.Table, schema: pa.Schema) -> bytes | None:
    if not rows.num_rows:
        return None
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(rows.select(schema.names).cast(schema))
    return sink.getvalue().to_pybytes()


def _unpacked(packs: list[bytes | None], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *[pa.ipc.open_stream(x).read_all() for x in packs if x is not None]])


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, a null's too, and the values."""
    found = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _first_reports(channel: np.ndarray, seq: np.ndarray, vsn: np.ndarray, r_channel: np.ndarray, r_seq: np.ndarray, applied: np.ndarray) -> np.ndarray:
    """The place of the first report that each change's channel makes after it and that covers its vsn; END where there is none.
    Steps over blocks of reports that don't cover it, which get shorter by half each time."""
    channels = np.arange(max(channel.max(initial=-1), r_channel.max(initial=-1)) + 1)
    r_channel, r_seq, applied = (np.concatenate([x, y]) for x, y in ((r_channel, channels), (r_seq, np.full(len(channels), END)), (applied, np.full(len(channels), END))))
    order = np.lexsort((r_seq, r_channel))
    r_channel, r_seq, applied = r_channel[order], r_seq[order], applied[order]  # each channel's last one covers all
    places = np.unique(r_seq)
    at = np.searchsorted(r_channel * len(places) + np.searchsorted(places, r_seq), channel * len(places) + np.searchsorted(places, seq))
    highest = [applied]  # of as many reports from each one on as the level says
    while 1 << len(highest) < len(applied):
        x = highest[-1]
        highest.append(np.maximum(x, x[np.minimum(np.arange(len(x)) + (1 << len(highest) - 1), len(x) - 1)]))
    for level in range(len(highest) - 1, -1, -1):
        at += (highest[level][at] < vsn) << level
    return r_seq[at]


def _blockers(asks: tuple[np.ndarray, ...], frees: tuple[np.ndarray, ...], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each ask the highest vsn of the frees in flight that block it, and how many there are. asks, frees: bucket, seq, vsn, pkey, as
    numbers. A free is in flight after its place and up to its end, so that what it meets are the asks of one stretch."""
    (bucket, seq, vsn, pkey), (f_bucket, f_seq, f_vsn, f_pkey) = asks, frees
    most, n = np.full(len(seq), BEGIN), np.zeros(len(seq), np.int64)
    order = np.lexsort((seq, bucket))
    places = np.unique(seq)
    width = len(places) + 1
    stretch = bucket[order] * width + np.searchsorted(places, seq[order])
    low, high = (np.searchsorted(stretch, f_bucket * width + np.searchsorted(places, x, "right")) for x in (f_seq, ends))
    pairs = np.maximum(high - low, 0)
    upto = np.cumsum(pairs)
    shift, first = low - (upto - pairs), 0
    while first < len(pairs):
        done = upto[first] - pairs[first]
        last = max(first + 1, int(np.searchsorted(upto, done + PAIRS, "right")))
        free = np.repeat(np.arange(first, last), pairs[first:last])
        ask = order[done + np.arange(len(free)) + shift[free]]
        blocks = (f_pkey[free] != pkey[ask]) & (f_vsn[free] < vsn[ask])
        free, ask = free[blocks], ask[blocks]
        np.add.at(n, ask, 1)
        np.maximum.at(most, ask, f_vsn[free])
        first = last
    return most, n


class _InFlight(StatefulProcessor):
    """A group of buckets: by bucket the unapplied changes that free it, by channel the buckets in which it has such changes. A
    batch's changes are gone through all at once, as columns."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frees = handle.getMapState("frees", "bucket string", "vsns array<long>, pkeys array<string>, channels array<int>")
        self.queues = handle.getMapState("queues", "channel int", "buckets array<string>")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        packs = [x for df in rows for x in zip(df["changes"], df["reports"])]
        changes, reports = _unpacked([x for x, _ in packs], CHANGES), _unpacked([x for _, x in packs], REPORTS)
        waiting, known = {x[0] for x in self.queues.keys()}, {x[0] for x in self.frees.keys()}
        reporting = set(reports["channel"].unique().to_pylist())
        queues = {x: set(self.queues.getValue((x,))[0]) for x in reporting & waiting}
        held = {x: self.frees.getValue((x,)) for x in known & {*changes["bucket"].unique().to_pylist(), *(b for x in queues.values() for b in x)}}

        before = [(BEGIN, vsn, pkey, channel, False, bucket) for bucket, x in held.items() for vsn, pkey, channel in zip(*x)]
        table = pa.concat_tables([pa.table([pa.array(x, of.type) for x, of in zip(list(zip(*before)) or [[]] * len(CHANGES), CHANGES)], CHANGES), changes])
        seq, vsn, asks = (table[x].to_numpy() for x in ("seq", "vsn", "asks"))
        (bucket, buckets), (pkey, pkeys) = _codes(table["bucket"]), _codes(table["pkey"])
        channel, channels = _codes(pa.chunked_array([*table["channel"].chunks, *reports["channel"].chunks], pa.int32()))

        free, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
        ends = _first_reports(channel[free], seq[free], vsn[free], channel[len(seq) :], reports["seq"].to_numpy(), reports["applied"].to_numpy())
        order = np.lexsort((seq[free], vsn[free], bucket[free]))
        again = (np.diff(bucket[free][order]) == 0) & (np.diff(vsn[free][order]) == 0)  # a change that comes again takes its own place
        ends[order[:-1][again]] = np.minimum(ends[order[:-1][again]], seq[free][order[1:][again]])
        most, n = _blockers(*(tuple(x[those] for x in (bucket, seq, vsn, pkey)) for those in (ask, free)), ends)
        found = np.flatnonzero(n)
        if len(found):
            yield pd.DataFrame({"vsn": vsn[ask[found]], "bucket": buckets.to_numpy(zero_copy_only=False)[bucket[ask[found]]], "blocker": most[found], "n_blockers": n[found].astype(np.int32)})

        changed = set(buckets.take(pa.array(np.unique(bucket[free[(seq[free] != BEGIN) | (ends != END)]]))).to_pylist())
        left: dict[str, list[tuple]] = {x: [] for x in changed}
        flying: dict[int, set[str]] = {x: set() for x in queues}
        stay = free[ends == END]
        for name, where, *x in zip(buckets.take(pa.array(bucket[stay])).to_pylist(), channels.take(pa.array(channel[stay])).to_pylist(), vsn[stay].tolist(), pkeys.take(pa.array(pkey[stay])).to_pylist()):
            flying.setdefault(where, set()).add(name)
            if name in changed:
                left[name].append((*x, where))
        for name, x in left.items():
            if x:
                self.frees.updateValue((name,), tuple(map(list, zip(*x))))
            elif name in held:
                self.frees.removeKey((name,))
        for where, names in flying.items():
            if where not in queues and where in waiting:  # it has reported nothing
                queues[where] = set(self.queues.getValue((where,))[0])
                names |= queues[where]
            if not names:
                self.queues.removeKey((where,))
            elif names != queues.get(where):
                self.queues.updateValue((where,), (sorted(names),))

    def close(self) -> None:
        pass


def _packs(log: DataFrame, groups: int) -> DataFrame:
    """part, changes, reports: what a group gets of a task's rows, some megabytes in a row, as each row on its own that goes to
    a stateful processor, and each of its values, costs a step of Python's."""
    keys = group_keys(groups)

    def deal(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        part = table["part"].fill_null(groups).to_numpy()
        table = table.take(pa.array(np.argsort(part, kind="stable"))).combine_chunks()
        bounds = [0, *np.cumsum(np.bincount(part, minlength=groups + 1)).tolist()]
        reports = _packed(table.slice(bounds[groups]), REPORTS)
        for key, low, high in zip(keys, bounds, bounds[1:]):
            changes = _packed(table.slice(low, high - low), CHANGES)
            if changes is not None or reports is not None:
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([changes], pa.binary()), pa.array([reports], pa.binary())], ["part", "changes", "reports"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= PACK:
                yield from deal(waiting)
                waiting, size = [], 0
        if waiting:
            yield from deal(waiting)

    return log.mapInArrow(run, "part int, changes binary, reports binary")


def conflicts_in_flight(log: DataFrame, groups: int = GROUPS) -> DataFrame:
    """A stream of vsn, bucket, blocker, n_blockers: for each change and value that it takes (or, updating, holds) the last of the
    earlier changes of other pkeys that give the value up and that haven't been applied when it comes, and how many there are. log, a stream in order of
    seq: changes (vsn, op, pkey, before_bucket, after_bucket, channel) and reports (channel, applied: all changes of the channel up
    to that vsn have been applied), which leave the other columns null. Applied changes leave the state; only those in flight are kept."""
    frees = F.when(F.col("op").isin("u", "d"), F.col("before_bucket"))
    takes = F.when(F.col("op").isin("c", "u"), F.col("after_bucket"))
    holds = F.when((F.col("op") == "u") & ~F.col("before_bucket").eqNullSafe(F.col("after_bucket")), F.col("before_bucket"))

    def part(asks: bool, bucket: Column, place: int) -> Column:
        return F.struct(F.lit(asks).alias("asks"), bucket.alias("bucket"), F.lit(place).alias("place"))

    report = F.col("applied").isNotNull()
    each = F.explode(F.array(part(True, takes, 0), part(True, holds, 1), part(False, frees, 2))).alias("x")
    parts = log.select("seq", "vsn", "pkey", F.col("channel").cast("int").alias("channel"), "applied", each).where((F.col("x.bucket").isNotNull() & ~report) | (report & (F.col("x.place") == 0)))
    dealt = F.when(~report, F.pmod(F.xxhash64("x.bucket"), F.lit(groups)).cast("int"))
    rows = parts.select(dealt.alias("part"), "seq", "vsn", "pkey", "channel", "x.asks", "x.bucket", "applied")
    return _packs(rows, groups).groupBy("part").transformWithStateInPandas(_InFlight(), "vsn long, bucket string, blocker long, n_blockers int", "Append", "None")
