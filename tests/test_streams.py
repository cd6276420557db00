"""State that outlives batches and restarts, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import rates, run, state

from .test_fold import COLUMNS, frames, model, random_log


@pytest.mark.parametrize("rows", [17, 1000])
def test_row_states_over_a_restart(spark, tmp_path, rows):
    base, log = random_log(rows, 400)
    text, changes = frames(spark, base, log)
    wanted = model(base, log)[0]
    events = changes.select("id", "vsn", "op", "fields")
    middle = 200
    with state.state_store(spark):
        run.write_in_order(events.where(F.col("vsn") < middle), str(tmp_path / "log/a"), "vsn", rows)
        for more in (False, True):  # the query ends, and begins again where it stopped
            if more:
                again = events.where(F.col("vsn").between(middle - 40, middle - 1))  # changes that come once more do nothing
                run.write_in_order(again, str(tmp_path / "log/b"), "vsn", rows)
                run.write_in_order(events.where(F.col("vsn") >= middle), str(tmp_path / "log/c"), "vsn", rows)
            stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log/*/*"))
            states = run.to_table(spark, state.row_states(stream, text, ["id"], COLUMNS), ["id"], "update", str(tmp_path / "out"))
    got = state.latest_rows(text, states, ["id"], COLUMNS).collect()
    assert {r.id: {x: r[x] for x in COLUMNS} for r in got} == wanted and len(got) == len(wanted)


def test_sequence_states_over_a_restart(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b"]), rnd.choice(["t", "u"]), k, rnd.choice("cuudr"), {"n": rnd.choice(["x", None, str(rnd.randint(-5, 900)), "7.5"]), "m": str(rnd.randint(0, 50))}) for k in range(300)]
    log = spark.createDataFrame(rows, "schema_name string, table_name string, vsn long, op string, fields map<string,string>")
    names = [("a", "t", "n", "s1"), ("b", "t", "n", "s2"), ("a", "u", "m", "s3"), ("b", "u", "m", "s3")]
    sequences = spark.createDataFrame(names, "schema_name string, table_name string, column_name string, sequence_name string")
    start = spark.createDataFrame([("s1", 5), ("s2", 5000), ("s4", None)], "sequence_name string, last_value long")
    want: dict = {}
    for schema, table, _, op, fields in rows:
        for s, t, column, name in names:
            value = fields.get(column)
            if (s, t) == (schema, table) and op != "d" and value is not None and value.lstrip("-").isdigit():
                want[name] = max(want.get(name, -99), int(value))
    with state.state_store(spark):
        for part in (0, 1):
            run.write_in_order(log.where(F.floor(F.col("vsn") / 150) == part), str(tmp_path / f"log/{part}"), "vsn", 40)
            stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log/*/*"))
            raised = run.to_table(spark, state.sequence_states(stream, sequences, start), ["sequence_name"], "update", str(tmp_path / "out"))
    got = {r.sequence_name: r.last_value for r in raised.collect()}
    assert got == {k: v for k, v in want.items() if v > {"s1": 5, "s2": 5000}.get(k, -100)}


def _simulated(log):
    """One event after the other: what is in flight, as a list."""
    flying, out = [], []
    for x in log:
        seq, vsn, op, pkey, before, after, channel, applied = x
        if applied is not None:
            flying = [e for e in flying if not (e[3] == channel and e[0] <= applied)]
            continue
        asked = {after} if op == "c" else {after, before} if op == "u" else set()
        for bucket in asked - {None}:
            found = [e[0] for e in flying if e[2] == bucket and e[1] != pkey]
            if found:
                out.append((vsn, bucket, max(found), len(found)))
        if op in "ud" and before is not None:
            flying.append((vsn, pkey, before, channel))
    return sorted(out), flying


@pytest.mark.parametrize("rows,groups", [(9, 3), (1000, 64)])
def test_conflicts_in_flight_are_those_of_a_simulation(spark, tmp_path, rows, groups):
    rnd = random.Random(groups)
    log, sent = [], {}
    for vsn in range(260):
        key = rnd.randrange(14)
        op = rnd.choice("cuud")
        value = lambda: rnd.choice([None, *[f"v{k}" for k in range(6)]])
        log.append((len(log), vsn, op, f"p{key}", value() if op != "c" else None, value() if op != "d" else None, key % 4, None))
        sent[key % 4] = vsn
        if rnd.random() < 0.15:
            channel = rnd.choice(sorted(sent))
            log.append((len(log), None, None, None, None, None, channel, sent[channel] - rnd.choice([0, 3, 30])))
    log += [(len(log) + k, None, None, None, None, None, channel, vsn) for k, (channel, vsn) in enumerate(sent.items())]
    want, left = _simulated(log)
    assert want and not left
    df = spark.createDataFrame(log, "seq long, vsn long, op string, pkey string, before_bucket string, after_bucket string, channel int, applied long")
    found = None
    with state.state_store(spark):
        for part in ("seq < 120", "seq >= 120"):  # with a restart between
            run.write_in_order(df.where(part), str(tmp_path / f"log/{part[4]}"), "seq", rows)
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log/*/*"))
            found = run.to_table(spark, state.conflicts_in_flight(stream, groups), path=str(tmp_path / "out"))
    assert sorted(tuple(r) for r in found.collect()) == want
    for name in ("frees", "queues"):  # nothing is left once all has been applied
        assert spark.read.format("statestore").option("path", str(tmp_path / "out/progress")).option("stateVarName", name).load().isEmpty()


def test_a_report_covers_changes_by_vsn_whatever_order_they_came_in(spark, tmp_path):
    rows = [(0, 5, "d", "p0", "a", None, 1, None), (1, 3, "d", "p1", "a", None, 1, None), (2, None, None, None, None, None, 1, 3), (3, 6, "c", "p2", None, "a", 1, None), (4, 4, "c", "p3", None, "a", 1, None)]
    df = spark.createDataFrame(rows, "seq long, vsn long, op string, pkey string, before_bucket string, after_bucket string, channel int, applied long")
    for segment in (9, 2):
        path = str(tmp_path / str(segment))
        run.write_in_order(df, f"{path}/log", "seq", segment)
        with state.state_store(spark):
            found = run.to_table(spark, state.conflicts_in_flight(run.read_in_order(spark, f"{path}/log", df.schema), 2), path=f"{path}/out")
        assert [tuple(r) for r in found.collect()] == [(6, "a", 5, 1)]


def test_groups_are_dealt_evenly_and_get_changes_in_packs(spark):
    keys = spark.createDataFrame([(k,) for k in state.group_keys(24)], "k int")
    for n in (3, 4, 8, 12, 24):
        assert {r["count"] for r in keys.groupBy(F.pmod(F.hash("k"), F.lit(n))).count().collect()} == {24 // n}
    rows = spark.range(0, 20_000, 1, 2).select(F.when(F.col("id") % 10 > 0, F.col("id") % 5).cast("int").alias("part"), F.col("id").alias("seq"), F.col("id").alias("vsn"), F.lit("p").alias("pkey"), F.lit(1).alias("channel"), F.lit(True).alias("asks"), F.lit("b").alias("bucket"), F.lit(7).cast("long").alias("applied"))
    packs = state._packs(rows, 5).collect()
    assert len(packs) == 2 * 5  # of two tasks
    for g, key in enumerate(state.group_keys(5)):
        mine = [x for x in packs if x["part"] == key]
        assert sorted(state._unpacked([x["changes"] for x in mine], state.CHANGES)["seq"].to_pylist()) == [k for k in range(20_000) if k % 10 and k % 5 == g]
        assert sorted(state._unpacked([x["reports"] for x in mine], state.REPORTS)["seq"].to_pylist()) == list(range(0, 20_000, 10))


@pytest.mark.parametrize("pairs", [1, 7, 1 << 20])
def test_blockers_are_those_of_plain_loops(monkeypatch, pairs):
    monkeypatch.setattr(state, "PAIRS", pairs)
    rnd = random.Random(pairs)
    for size in (0, 1, 40, 300):
        some = lambda n, most: np.array([rnd.randrange(most) for _ in range(n)], np.int64)
        channel, seq, vsn, r_channel, r_seq, applied = some(size, 4), some(size, 90), some(size, 90), some(size // 2, 5), some(size // 2, 90), some(size // 2, 99)
        ends = state._first_reports(channel, seq, vsn, r_channel, r_seq, applied)
        assert ends.tolist() == [min((int(s) for c, s, a in zip(r_channel, r_seq, applied) if c == channel[k] and s >= seq[k] and a >= vsn[k]), default=state.END) for k in range(size)]
        bucket, pkey, asks = some(size, 3), some(size, 4), tuple(some(size, x) for x in (4, 90, 90, 4))
        most, n = state._blockers(asks, (bucket, seq, vsn, pkey), ends)
        for k, (b, s, v, p) in enumerate(zip(*asks)):
            want = [int(vsn[j]) for j in range(size) if bucket[j] == b and seq[j] < s <= ends[j] and vsn[j] < v and pkey[j] != p]
            assert n[k] == len(want) and most[k] == max(want, default=state.BEGIN)


def test_segments_in_order(spark, tmp_path):
    assert run.write_in_order(spark.range(0), str(tmp_path / "a"), "id", 10) == 1
    assert run.write_in_order(spark.range(5, 36), str(tmp_path / "b"), "id", 10) == 4
    stream = run.read_in_order(spark, str(tmp_path / "b"), spark.range(1).schema)
    assert sorted(r.n_events for r in run.batch_sizes(spark, stream).collect()) == [1, 10, 10, 10]


def test_handover_is_found_in_the_stream_and_kept_over_a_restart(spark, tmp_path):
    marks = {"a": ["true", "true", "last", "false", "false"], "b": ["true", "true", "true", None, None], "c": ["true"] * 5, "d": ["false"] * 5}
    rows = sorted((k * 4 + i, source, x) for i, (source, own) in enumerate(marks.items()) for k, x in enumerate(own))
    df = spark.createDataFrame(rows, "vsn long, source string, snapshot string")
    want = {"a": 8, "b": 12, "d": 2}
    into = lambda part: lambda batch, n: batch.write.mode("overwrite").parquet(str(tmp_path / f"{part}/b={n}"))
    for part in ("vsn < 11", "vsn >= 11"):
        run.write_in_order(df.where(part), str(tmp_path / f"log/{part[4]}"), "vsn", 3)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log/*/*"))
        found = run.follow(stream, str(tmp_path / "state"), into("loaded"), into("applied"))
    assert {r.source: r.boundary for r in found.collect()} == want
    got = {part: sorted(r.vsn for r in spark.read.schema(df.schema).parquet(str(tmp_path / part)).collect()) for part in ("loaded", "applied")}
    assert got["loaded"] == [v for v, s, _ in rows if v <= want.get(s, 99)] and got["applied"] == [v for v, s, _ in rows if v > want.get(s, 99)]


def _reported(events, began, tick, minutes):
    """The rate as a reporter with a row of slots of ten seconds says it at a tick, event by event."""
    inside = sum(n for at, n in events if tick - 60 * minutes <= at // 10 * 10 < tick)
    age = (tick - began) / 60
    return inside, inside // (int(age) + 1 if age < minutes else minutes)


@pytest.mark.parametrize("given", [False, True])
def test_sliding_rates_of_a_young_run_and_over_gaps(spark, given):
    rnd = random.Random(11)
    start = 1_700_000_000
    at = {"a": [start + rnd.randint(0, 400) for _ in range(300)] + [start + 3000 + rnd.randint(0, 50) for _ in range(40)], None: [start + 7], "b": [start + 1200 * k for k in range(3)]}
    at["a"] += [start + 1010, start + 1020]  # the row of slots runs out in between, and on the edge of ten minutes
    rows = [(key, x) for key, many in at.items() for x in many]
    events = spark.createDataFrame(rows, "k string, x long").select("k", F.timestamp_seconds("x").alias("ts"))
    slots = rates.tumbling_counts(events, ["k"]).withColumn("run", F.timestamp_seconds(F.lit(start - 95)))
    more = slots.limit(1).withColumns({"slot": F.lit(None).cast("timestamp_ntz"), "n": F.lit(5).cast("long")})
    found = rates.sliding_rates(slots.unionByName(more), ["k"], (1, 3, 10), "run" if given else None)
    got = {(r.k, r.at): r for r in found.withColumn("at", F.unix_seconds(F.col("ends").cast("timestamp"))).collect()}
    ticks = {(key, t) for key, many in at.items() for x in many for t in range(x // 10 * 10 + 10, x // 10 * 10 + 601, 10)}
    assert set(got) == ticks and found.count() == len(ticks)
    for (key, tick), r in got.items():
        began = start - 95 if given else min(at[key]) // 10 * 10
        for m in (1, 3, 10):
            n, rate = _reported([(x, 1) for x in at[key]], began, tick, m)
            assert (r[f"n_{m}"], r[f"per_minute_{m}"], r[f"per_second_{m}"]) == (n, rate, rate // 60)
    now = start + 300
    live = rates.sliding_rates(slots, ["k"], (3,), until=F.timestamp_seconds(F.lit(now)))
    assert live.agg(F.max(F.unix_seconds(F.col("ends").cast("timestamp")))).first()[0] == now
    assert rates.sliding_rates(slots.where("false"), ["k"]).count() == 0
