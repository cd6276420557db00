"""Folding and conflicts against models that take one event at a time."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import conflicts, events, fold
from tidemark.plans import change_queries, registry

COLUMNS = ["a", "b"]
CHANGES = "id long, vsn long, op string, fields map<string,string>"


def random_log(seed, n=120, keys=12):
    rnd = random.Random(seed)
    base = {k: {"a": f"a{k}", "b": None} for k in range(keys) if rnd.random() < 0.5}
    log = []
    for vsn in range(n):
        op = rnd.choice("ccuuuud")
        value = lambda: rnd.choice([None, f"v{vsn}"])
        fields = {x: value() for x in COLUMNS} if op == "c" else {x: value() for x in COLUMNS if rnd.random() < 0.6} if op == "u" else {}
        log.append((rnd.randrange(keys) if rnd.random() < 0.6 else 0, vsn, op, fields))
    return base, log


def model(base, log):
    rows, idle, seen = {k: dict(v) for k, v in base.items()}, 0, []
    for key, vsn, op, fields in log:
        live = key in rows
        if (op == "c") == live:
            idle += 1
            continue
        if op == "c":
            rows[key] = {x: fields.get(x) for x in COLUMNS}
        elif op == "u":
            rows[key] |= fields
        seen.append((key, vsn, rows[key]["a"], rows[key]["b"]))
        if op == "d":
            del rows[key]
    return rows, idle, seen


def frames(spark, base, log):
    return spark.createDataFrame([(k, v["a"], v["b"]) for k, v in base.items()], "id long, a string, b string"), spark.createDataFrame(log, CHANGES).repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_fold_history_and_idle_events(spark, seed):
    base, log = random_log(seed)
    rows, idle, seen = model(base, log)
    old, changes = frames(spark, base, log)
    got = {r.id: {"a": r.a, "b": r.b} for r in fold.fold(old, changes, ["id"], COLUMNS).collect()}
    assert got == rows
    assert sum(r.n_ineffective for r in fold.ineffective(old, changes, ["id"]).collect()) == idle
    assert sorted((r.id, r.vsn, r.a, r.b) for r in fold.history(old, changes, ["id"], COLUMNS).collect()) == sorted(seen)
    net = {r.id: r.net for r in fold.net_change(old, changes, ["id"]).collect()}
    for key, kind in net.items():
        assert (kind == "c") == (key not in base and key in rows)
        assert (kind == "d") == (key in base and key not in rows)


def test_fold_in_two_steps_is_fold_in_one(spark):
    base, log = random_log(9)
    old, changes = frames(spark, base, log)
    middle = fold.fold(old, changes.where("vsn < 57"), ["id"], COLUMNS)
    one, two = fold.fold(old, changes, ["id"], COLUMNS), fold.fold(middle, changes.where("vsn >= 57"), ["id"], COLUMNS)
    assert sorted(one.collect()) == sorted(two.collect())


def test_empty_log_and_empty_base(spark):
    base, log = random_log(3)
    old, changes = frames(spark, base, log)
    assert sorted(fold.fold(old, changes.limit(0), ["id"], COLUMNS).collect()) == sorted(old.collect())
    rows, _, _ = model({}, log)
    assert {r.id for r in fold.fold(old.limit(0), changes, ["id"], COLUMNS).collect()} == set(rows)


def test_carry_last_over_chunks(spark):
    rows = [(k % 3, k, k if k % 7 == 0 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, at long, v long")
    got = {r.at: r.last for r in fold.carry_last(df, ["id"], "at", F.col("v"), "last", chunk=16).collect()}
    last = {}
    for key, at, v in rows:
        assert got[at] == last.get(key)
        last[key] = v if v is not None else last.get(key)


@pytest.mark.parametrize("seed", range(3))
def test_nearest_conflict_is_the_last_of_all_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = [(vsn, rnd.choice("cuud"), f"p{rnd.randrange(4)}", f"x{rnd.randrange(3)}", f"x{rnd.randrange(3)}") for vsn in range(150)]
    log = spark.createDataFrame([(v, o, p, b if o != "c" else None, a if o != "d" else None) for v, o, p, b, a in rows], "vsn long, op string, pkey string, before_bucket string, after_bucket string")
    frees = [(v, p, b) for v, o, p, b, _ in rows if o != "c"]
    want = {}
    for v, o, p, b, a in rows:
        for bucket in {a} if o == "c" else {a, b} if o == "u" else set():
            earlier = [w for w, q, x in frees if x == bucket and w < v and q != p]
            if earlier:
                want[v, bucket] = max(earlier)
    got = {(r.vsn, r.bucket): r.blocker for r in conflicts.nearest_conflicts(log).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_conflict_counts_equal_all_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = [(k * 7001, rnd.choice("cuud"), rnd.choice(["p0", "p1", "p2", None]), rnd.choice(["x0", "x1", None]), rnd.choice(["x0", "x1", None])) for k in range(200)]
    log = spark.createDataFrame(rows, "vsn long, op string, pkey string, before_bucket string, after_bucket string")
    for counts, pairs in ((conflicts.conflict_counts, conflicts.pair_conflicts), (conflicts.before_conflict_counts, conflicts.before_conflicts)):
        want = pairs(log).groupBy("later").agg(F.count("*").alias("n"), F.max("earlier").alias("nearest")).collect()
        assert want and sorted(map(tuple, counts(log).collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("name", ["i2_before_after_conflicts", "i3_before_before_conflicts"])
def test_conflict_queries_form_no_pairs(spark, monkeypatch, name):
    rows, many = [(k, "u", f"p{k}", "x", "x") for k in range(20000)], "vsn long, op string, pkey string, before_bucket string, after_bucket string"
    monkeypatch.setattr(change_queries, "uk_events", lambda *_: spark.createDataFrame(rows, many))
    monkeypatch.setattr(conflicts, "pair_conflicts", None)
    got = registry.QUERIES[name](spark, "").agg(F.count("*"), F.sum("n"), F.sum(F.col("later") - F.col("nearest"))).first()
    assert tuple(got) == (19999, 19999 * 10000, 19999)


def test_unique_values_that_are_null_or_missing(spark):
    values = F.from_json(F.col("j"), "map<string,string>")
    df = spark.createDataFrame([(0, '{"a":"x","b":"y"}'), (1, '{"a":"x","b":null}'), (2, '{"a":"x"}'), (3, '{"a":"xy","b":""}')], "k int, j string")
    distinct = {r.k: r.key for r in df.select("k", conflicts.bucket_key(values, ["a", "b"], False, "i").alias("key")).collect()}
    same = {r.k: r.key for r in df.select("k", conflicts.bucket_key(values, ["a", "b"], True, "i").alias("key")).collect()}
    assert distinct[1] is None and distinct[2] is None and same[1] is not None and same[2] is None
    assert len(set(filter(None, same.values()))) == 3


def test_errors_are_raised(spark):
    log = spark.createDataFrame([("s", "t", "u", {"id": "1"}, {"c": "2"}, {"c": "1"})], "schema_name string, table_name string, op string, key map<string,string>, fields map<string,string>, before_fields map<string,string>")
    with pytest.raises(Exception, match="dealt out"):
        log.select(events.partition_key("custom", ["c"])).collect()
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    with pytest.raises(Exception, match="key exists"):
        fold.snapshot_conflicts(rows, rows.limit(0), ["id"]).collect()
    tables = spark.createDataFrame([("t", True)], "table_name string, has_expression_index boolean")
    with pytest.raises(Exception, match="expression index"):
        events.resolve_strategies(tables, spark.createDataFrame([("t", "pk")], "table_name string, strategy string")).collect()


def test_coarse_conflicts_are_between_different_rows(spark):
    rnd = random.Random(6)
    log = [(vsn, rnd.choice("cuuud"), f"p{rnd.randrange(5)}", f"t{rnd.randrange(2)}", rnd.sample(["a", "b", "c"], rnd.randint(0, 2))) for vsn in range(150)]
    log = [(v, op, p, t, [] if op == "d" else x) for v, op, p, t, x in log]
    want = {}
    for v, op, p, t, columns in log:
        for e, e_op, e_p, e_t, e_columns in log[:v]:
            if e_t == t and e_p != p and (e_op == "d" or e_op == "u" and set(columns) & set(e_columns)):
                want[v] = e
    df = spark.createDataFrame(log, "vsn long, op string, pkey string, table_name string, columns array<string>").repartition(3)
    assert {r.vsn: r.blocker for r in conflicts.coarse_conflicts(df).collect()} == want
    same = df.where("vsn < 0").unionByName(spark.createDataFrame([(1, "u", "p", "t", ["a"]), (2, "u", "p", "t", ["a"]), (3, "d", "p", "t", [])], df.schema))
    assert conflicts.coarse_conflicts(same).collect() == []  # events of one row don't meet


def test_custom_partition_keys(spark):
    schema = "vsn long, op string, schema_name string, table_name string, key map<string,string>, fields map<string,string>, before_fields map<string,string>"
    good = [(1, "c", "s", "t", {}, {"b": "2", "a": None}, None), (2, "u", "s", "t", {}, {"x": "1"}, {"a": "1", "b": "2"}), (3, "d", "s", "t", {}, {}, {"a": "1", "b": "2", "c": "3"})]
    got = spark.createDataFrame(good, schema).select(events.partition_key("custom", ["b", "a"])).collect()
    assert [r[0] for r in got] == ["s.t|<NULL>|2", "s.t|1|2", "s.t|1|2"]
    wrong = [(4, "c", "s", "t", {}, {"a": "1"}, None), (5, "u", "s", "t", {}, {"a": "1"}, {"a": "1", "b": "2"}), (6, "u", "s", "t", {"b": "2"}, {"x": "1"}, {"a": "1"}), (7, "d", "s", "t", {"a": "1", "b": "2"}, {}, None)]
    for row in wrong:
        with pytest.raises(Exception, match="dealt out by"):
            spark.createDataFrame([row], schema).select(events.partition_key("custom", ["b", "a"])).collect()
    for strategy, columns in (("custom", []), ("rows", ["a"])):
        with pytest.raises(ValueError):
            events.partition_key(strategy, columns)


@pytest.mark.parametrize("chunk", [1, 3, 16, 1 << 16])
def test_last_free_over_chunks(spark, chunk):
    rnd = random.Random(chunk)
    rows = [(vsn, rnd.choice(["p", "p", "p", "q", "r"]), rnd.choice("ab"), rnd.random() < 0.6) for vsn in range(130)]
    rows += [(v, p, b, False) for v, p, b, f in rows if f and rnd.random() < 0.5]
    want = {}
    for vsn, pkey, bucket, frees in rows:
        want[vsn, frees] = max((v for v, p, b, f in rows if f and b == bucket and p != pkey and v < vsn), default=None)
    df = spark.createDataFrame(rows, "vsn long, pkey string, bucket string, frees boolean").repartition(3)
    got = conflicts._with_last_free(df, chunk).collect()
    assert {(r.vsn, r.frees): r.blocker for r in got} == want and len(got) == len(rows)
