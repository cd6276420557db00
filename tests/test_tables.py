"""Tables that take batches, streams, validation, readers."""

import hashlib
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import convert
from tidemark.operators import conflicts, fleet, load, lookups, sketches, stats, validate
from tidemark.plans import registry
from tidemark.sources import changelog, dumps, quoted
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming import run

from .test_fold import COLUMNS, frames, model, random_log


def test_ordered_hash_holds_no_segment(spark):
    rows = [(k % 3 or None, None if k % 50 == 0 else f"r{k}", k * 7919 % 3001) for k in range(3000)]
    got = stats.ordered_hash(spark.createDataFrame(rows, "s int, r string, o long").repartition(5), F.col("s"), F.col("r"), "o")
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for key in (None, 1, 2):
        own = sorted((o, r) for s, r, o in rows if s == key)
        want.append((key, len(own), hashlib.md5("".join(hashlib.md5(r.encode()).hexdigest() for _, r in own if r).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_report_is_numbered_in_parts(spark):
    df = registry.QUERIES["w3_ordered_report"](spark, "/root/testdata/sf0.001")
    assert "row_number()" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_batches_that_come_again_or_break_off(spark, tmp_path):
    base, log = random_log(5)
    old, changes = frames(spark, base, log)
    table = VersionedTable(spark, str(tmp_path / "t"), ["id"], COLUMNS, 4)
    table.create(old)
    assert table.apply(changes.where("vsn < 50"), 0)
    assert not table.apply(changes.where("vsn < 50"), 0)
    # A batch that broke off after its rows and before its ledger row.
    kept, table._commit = table._commit, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        table.apply(changes.where("vsn >= 50 AND vsn < 90"), 1)
    table._commit = kept
    before, _, _ = model(base, [x for x in log if x[1] < 50])
    assert {r.id: {"a": r.a, "b": r.b} for r in table.read().collect()} == before
    assert table.apply(changes.where("vsn >= 50 AND vsn < 90"), 1)
    assert table.apply(changes.where("vsn >= 40"), 2)  # overlaps what is applied
    rows, _, _ = model(base, log)
    assert {r.id: {"a": r.a, "b": r.b} for r in table.read().collect()} == rows


def test_stream_of_segments_equals_one_batch(spark, tmp_path):
    base, log = random_log(7)
    old, changes = frames(spark, base, log)
    changelog.write_change_log(changes.withColumn("key", F.create_map(F.lit("id"), F.col("id").cast("string"))), str(tmp_path / "log"), rows=20, partitions=3)
    table = VersionedTable(spark, str(tmp_path / "t"), ["id"], COLUMNS, 4)
    table.create(old)
    stream, _ = changelog.read_change_log(spark, str(tmp_path / "log"), streaming=True, files_per_batch=100)
    keyed = stream.withColumn("id", F.element_at("key", "id").cast("long"))
    for _ in range(2):
        run.apply_stream(keyed, table, str(tmp_path / "progress"))
    rows, _, _ = model(base, log)
    assert {r.id: {"a": r.a, "b": r.b} for r in table.read().collect()} == rows


def test_segments_do_not_depend_on_order_and_see_repeats(spark):
    df = spark.range(500).select("id", (F.col("id") * 7).alias("v"))
    one = validate.segments(df, ["id"], ["id", "v"], 8)
    two = validate.segments(df.repartition(7).orderBy(F.desc("id")), ["id"], ["id", "v"], 8)
    assert {r.status for r in validate.compare_segments(one, two).collect()} == {"match"}
    thrice = df.unionByName(df.where("id = 3")).unionByName(df.where("id = 3"))
    assert "mismatch" in {r.status for r in validate.compare_segments(one, validate.segments(thrice, ["id"], ["id", "v"], 8)).collect()}
    with pytest.raises(ValueError):
        validate.segments(df, ["id"], ["v"], 7)


def test_log_lines_that_are_no_events(spark, tmp_path):
    lines = ['{"vsn":1,"op":"c","table_name":"t","fields":{"a":null}}', "{oops", '{"op":"cutover.target"}', "\\.", ""]
    (tmp_path / "segment").write_text("\n".join(lines))
    good, bad = changelog.read_change_log(spark, str(tmp_path / "segment"))
    rows = good.collect()
    assert [r.op for r in rows] == ["c", "cutover.target"] and rows[0].fields == {"a": None}
    assert [r.value for r in bad.collect()] == ["{oops"]


def test_csv_with_quoted_line_breaks_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"two\nlines"\n\nx,y\n\\.\n')
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.StringType())])
    rows = dumps.read_csv_dump(spark, str(tmp_path / "a.csv"), schema, multiline=True).collect()
    assert [(r.k, r.t) for r in rows if r[dumps.CORRUPT] is None] == [(1, "two\nlines")]
    assert [r[dumps.CORRUPT] for r in rows if r[dumps.CORRUPT]] == ["x,y"]
    with pytest.raises(ValueError):
        dumps.read_csv_dump(spark, "x", schema, sep='"')


def test_sql_dump_carries_over_splits(spark, tmp_path):
    (tmp_path / "d.sql").write_text("a;\nCOPY s.t (x) FROM STDIN;\n" + "".join(f"{k}\n" for k in range(200)) + "\\.\nb;\nCOPY u FROM STDIN;\n1\n\\.\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128")
    try:
        rows = dumps.read_sql_dump(spark, str(tmp_path / "d.sql")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.table_name, int(r.line)) for r in rows) == sorted([("s.t", k) for k in range(200)] + [("u", 1)])


def test_table_patterns(spark):
    df = spark.createDataFrame([("orders",), ("order_x",), ("nation",)], "table_name string")
    assert {r.table_name for r in load.filter_tables(df, ["order*"], ["order?x"]).collect()} == {"orders"}
    with pytest.raises(ValueError, match="zzz"):
        load.filter_tables(df, ["zzz"])


def test_bad_rows_abort(spark):
    df = spark.createDataFrame([("1",), ("x",)], "id string")
    good, _ = load.stash(df, load.cast_reason({"id": "bigint"}), "abort")
    with pytest.raises(Exception, match="bad row"):
        good.collect()


def test_conversion_of_nulls_and_nonsense(spark):
    df = spark.createDataFrame([(None,), ("x",), ("-1",)], "x string")
    got = [r.x for r in convert.convert_values(df, {"x": ("timestamp", None)}).collect()]
    assert got == [None, None, "1969-12-31 23:59:59"]


def test_jdbc_reader_asks_for_the_named_columns():
    class Reader:
        def __init__(self):
            self.given = {}

        def format(self, kind):
            return self

        def options(self, **given):
            self.given = given
            return self

        def load(self):
            return self.given

    class Session:
        read = Reader()

    given = dumps.read_jdbc_table(Session(), "jdbc:x", "t", ["a", "b"], "a", 0, 9, 3)
    assert given["dbtable"] == "(SELECT a, b FROM t) t" and given["numPartitions"] == 3


def test_values_do_not_depend_on_the_sessions_zone(spark):
    rows = [("1700000000999999999", "1700000000999999", "1700000000999", "2024-01-01T00:00:00+02:00", "-1")]
    df = spark.createDataFrame(rows, "n string, u string, m string, z string, d string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        out = convert.convert_values(df, {"n": ("nano_timestamp", None), "u": ("micro_timestamp", None), "m": ("timestamp", None), "z": ("zoned_timestamp", None), "d": ("date", None)})
        got = out.withColumn("o", convert.oracle_timestamp(F.lit("1700000000999"))).collect()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(got) == ("2023-11-14T22:13:20.999999999", "2023-11-14T22:13:20.999999", "2023-11-14 22:13:20", "2023-12-31T22:00:00Z", "1969-12-31", "14-11-2023 22:13:20.999")


def test_decimals_and_bits_of_any_size(spark):
    import base64

    numbers = [0, 1, -1, 127, -128, 255, -256, 10**9, -(10**9), 2**63, -(2**63), 2**64 + 7, -(2**95) - 3, 10**40, -(10**40)]
    rows = [(scale, str(n), base64.b64encode(n.to_bytes((n.bit_length() + 8) // 8, "big", signed=True)).decode()) for n in numbers for scale in (0, 2, 12)]
    df = spark.createDataFrame(rows, "scale int, n string, x string")
    for r in df.withColumn("y", convert.variable_decimal(F.col("scale"), F.col("x"))).collect():
        digits = r.n.lstrip("-").zfill(r.scale + 1)
        text = f"{digits[:-r.scale]}.{digits[-r.scale:]}" if r.scale else digits
        assert r.y == "-" * r.n.startswith("-") + text, r
    bits = spark.createDataFrame([(base64.b64encode(bytes(range(1, 13))).decode(),), ("",)], "x string")
    want = "".join(f"{k:08b}" for k in range(12, 0, -1))
    assert [r[0] for r in bits.select(convert.bits(F.col("x"), 100)).collect()] == [("0" * 4 + want)[-100:], "0" * 100]


def test_copy_escapes(spark):
    rows = [("a\x01b", "a\x01b"), (r"\101\x42c", "ABc"), (r"\\t\t\\", "\\t\t\\"), (r"\q\.", "q."), (r"\N", None), (r"\\N", "\\N"), (r"x\1019", "xA9"), (r"\x", "x"), ("", "")]
    df = spark.createDataFrame(rows, "x string, want string")
    assert [r.got for r in df.withColumn("got", dumps.unescape(F.col("x"))).collect()] == [x[1] for x in rows]


def test_a_circle_of_pairs_raises(spark):
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a")], "k int, redundant string, existing string")
    with pytest.raises(ValueError):
        fleet.resolve(pairs, ["k"])


def test_changes_are_merged_and_old_versions_dropped(spark, tmp_path):
    base, log = random_log(11)
    old, changes = frames(spark, base, log)
    table = VersionedTable(spark, str(tmp_path / "t"), ["id"], COLUMNS, 4, merge_after=2)
    table.create(old)
    last = max(x[1] for x in log)
    step = last // 5 + 1
    for batch in range(5):
        assert table.apply(changes.where(f"vsn div {step} = {batch}"), batch)
        rows, _, _ = model(base, [x for x in log if x[1] < (batch + 1) * step])
        assert {r.id: {"a": r.a, "b": r.b} for r in table.read().collect()} == rows
    assert table.state().since > 0
    table.vacuum()
    assert {r.id: {"a": r.a, "b": r.b} for r in table.read().collect()} == rows
    assert not (tmp_path / "t" / "changes" / "v=1").exists()
    assert not table.apply(changes, 4)  # known after the merge too


def test_batches_keep_both_limits(spark, tmp_path):
    sizes = [3, 900, 1, 1, 1, 1, 1, 50, 50, 50, 1, 2000, 4, 5, 0, 0]
    df = spark.createDataFrame([("x" * n,) for n in sizes], "t string").coalesce(1)
    got = [r.n_bytes for r in load.write_batches(df, str(tmp_path / "b"), 4, 101).orderBy(F.split("batch", "-")[1].cast("int")).collect()]
    assert got == [3, 900, 4, 101, 51, 2000, 9]
    empty = load.write_batches(df.where("false"), str(tmp_path / "e"), 4, 101)
    assert empty.count() == 0


def test_clean_up_policies(spark, tmp_path):
    def written(name):
        path = str(tmp_path / name)
        spark.range(60).selectExpr("id", "id div 10 AS segment_no").write.partitionBy("segment_no").parquet(path)
        return path

    def left(path):
        return {r.segment_no for r in spark.read.parquet(path).select("segment_no").distinct().collect()}

    some = spark.range(2).select(F.col("id").alias("segment_no"))
    kept = written("kept")
    assert run.clean(spark, kept, some, "retain") is None and left(kept) == set(range(6))
    gone = written("gone")
    assert run.clean(spark, gone, some, "delete") is None and left(gone) == set(range(2, 6))
    moved, target = written("moved"), str(tmp_path / "archive")
    more = spark.range(4).select(F.col("id").alias("segment_no"))
    for eligible in (some, more, more):  # comes again, in part and as a whole
        counts = run.clean(spark, moved, eligible, "archive", target)
        assert {r.n_rows for r in counts.collect()} == {10}
    assert left(moved) == {4, 5} and left(target) == {0, 1, 2, 3}
    with pytest.raises(Exception, match="missing"):
        run.clean(spark, moved, spark.range(9, 10).select(F.col("id").alias("segment_no")), "archive", target)
    with pytest.raises(ValueError):
        run.clean(spark, moved, some, "burn")


def test_redundant_indexes_by_all_their_traits(spark):
    schema = "index_name string, columns array<string>, options array<string>, included array<string>, method string, predicate string, is_unique boolean, nulls_not_distinct boolean, is_constraint boolean"

    def found(*rows):
        df = spark.createDataFrame([(name, keys, ["asc"] * len(keys) if options is None else options, beside, method, predicate, unique, strict, constraint) for name, keys, options, beside, method, predicate, unique, strict, constraint in rows], schema)
        placed = df.select(F.lit("d").alias("db_id"), F.lit("s").alias("schema_name"), F.lit("t").alias("table_name"), "*")
        return {(r.redundant, r.existing) for r in fleet.redundant_indexes(placed).collect()}

    def index(name, keys, options=None, beside=(), method="btree", predicate=None, unique=False, strict=False, constraint=False):
        return name, list(keys), options, list(beside), method, predicate, unique, strict, constraint

    assert found(index("a", "x"), index("b", "xy")) == {("a", "b")}
    assert found(index("a", "x"), index("b", "xy", method="hash")) == set()
    assert found(index("a", "x"), index("b", "xy", predicate="x > 0")) == set()
    assert found(index("a", "x"), index("b", "xy", ["desc", "asc"])) == set()
    assert found(index("a", "x", beside="z"), index("b", "xy")) == set()
    assert found(index("a", "x", beside="y"), index("b", "xy")) == {("a", "b")}
    assert found(index("a", "x", unique=True), index("b", "xy", unique=True)) == set()
    assert found(index("a", "x", unique=True, strict=True), index("b", "x", unique=True)) == {("b", "a")}
    assert found(index("a", "x", constraint=True), index("b", "x")) == {("b", "a")}
    assert found(index("a", "xy", beside="zw"), index("b", "xy", beside="wz")) == {("b", "a")}


def test_conflicts_begin_anew_with_the_role(spark):
    rows = [(0, "u", "p", "s", "1", None), (1, "c", "q", "s", None, "1"), (2, "c", "r", "f", None, "1"), (3, "d", "z", "f", None, None), (4, "c", "w", "f", None, None), (5, "c", "v", "s", None, "1")]
    log = spark.createDataFrame(rows, "vsn long, op string, pkey string, exporter_role string, before_bucket string, after_bucket string")
    log = log.withColumns({"table_name": F.lit("t"), "columns": F.array(F.lit("k"))})
    got = {(r.stretch, r.vsn, r.blocker) for r in conflicts.conflicts_by_role(log, ["f"]).collect()}
    assert got == {(0, 1, 0), (1, 4, 3)}


def _csv_text(rnd, quote, escape, rows):
    """Well-formed records with line breaks, quotes and delimiters within quotes, and what they mean."""
    lines, values = ["id,text,k"], []
    for k in range(rows):
        text = "".join(rnd.choice(["a", "b", ",", "\n", quote, "\r\n", " é", "\n\n"] if rnd.random() < 0.6 else ["x", "y"]) for _ in range(rnd.choice([1, 3, 12, 60])))
        text = text if text.strip() and text == text.strip() else f"<{text}>"
        lines.append(f"{k},{quote}{text.replace(escape, escape * 2).replace(quote, escape + quote) if escape != quote else text.replace(quote, quote * 2)}{quote},{k % 7}")
        values.append((k, text, k % 7))
    return "\n".join(lines) + "\n", values


@pytest.mark.parametrize("escape,joined", [('"', False), ("\\", False), ('"', True)])
@pytest.mark.parametrize("width", [50, 700])
def test_quoted_line_breaks_in_many_splits(spark, tmp_path, monkeypatch, escape, joined, width):
    if joined:
        monkeypatch.setattr(quoted, "MOST_SPLITS", 3)
    rnd = random.Random(width)
    wanted = []
    for name in ("a", "b", "c"):
        text, values = _csv_text(rnd, '"', escape, 120)
        if name == "c":
            text = text.rstrip("\n")
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
        wanted += values
    before = {x: spark.conf.get(x) for x in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("k", T.IntegerType())])
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = dumps.read_csv_dump(spark, str(tmp_path), schema, escape=escape, header=True, multiline=True)
        if width == 700 and not joined:
            lines = quoted.quoted_records(spark, str(tmp_path), escape=escape)
            assert lines.rdd.getNumPartitions() >= sum(x.stat().st_size for x in tmp_path.iterdir()) / 700
        got = sorted((r.id, r.text, r.k) for r in df.where("_corrupt_record IS NULL").collect())
        assert got == sorted(wanted)
        if escape == '"':  # as Spark's own reader of whole files has them
            whole = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape=escape).csv(str(tmp_path))
            assert sorted(tuple(r) for r in whole.collect()) == got
    finally:
        for x, y in before.items():
            spark.conf.set(x, y)


def test_states_of_lines_are_those_of_one_pass():
    rnd = random.Random(3)
    for quote, escape in (('"', '"'), ('"', "\\"), ("'", "~")):
        ends = quoted.line_ends(quote, escape)
        for _ in range(200):
            lines = ["".join(rnd.choice([quote, escape, "x", ","]) for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(1, 9))]
            for start in (False, True):
                want, within = [start], start
                for line in lines:
                    k = 0
                    while k < len(line):
                        if within and line[k] == escape and escape != quote:
                            k += 2
                            continue
                        within ^= line[k] == quote
                        k += 1
                    want.append(within)
                assert quoted.states(*ends(pa.array(lines)), start).tolist() == want


def test_quoted_records_of_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1,h2\n1,"open to the end\nof the file')
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text('"h\n1",h2\n\n\r\n2,x\r\n')
    assert sorted(r.record for r in quoted.quoted_records(spark, str(tmp_path), header=True).collect()) == ['1,"open to the end\nof the file', "2,x"]


@pytest.mark.parametrize("hot", [False, True])
def test_lookups_of_any_size(spark, hot):
    rnd = random.Random(9)
    table = [(rnd.randint(-50, 50) * 3, k, f"v{k}") for k in range(150)] + [(None, 7, "never")]
    rows = [(k, 12 if hot and k % 3 else rnd.randint(-180, 180), None) for k in range(900)] + [(900, None, None), (901, None, "x"), (5, 5, None), (5, 5, None)]
    lookup = spark.createDataFrame(table, "key int, ord int, value string").repartition(3)
    df = spark.createDataFrame(rows, "id int, at int, entry string").repartition(4)
    keyed = [x for x in table if x[0] is not None]
    answers = {
        lookups.nearest_join: lambda at: min(keyed, key=lambda x: (abs(x[0] - at), x[1]))[2],
        lookups.as_of_join: lambda at: max((x for x in keyed if x[0] <= at), default=(0, 0, None))[2],
        lookups.ceiling_join: lambda at: min((x for x in keyed if x[0] >= at), default=max(keyed))[2],
    }
    for join, answer in answers.items():
        got = sorted(join(df, lookup, F.col("at"), "key", "value", "found", "ord").collect(), key=str)
        assert [tuple(x) for x in got] == sorted([(*x, None if x[1] is None else answer(x[1])) for x in rows], key=lambda x: str(Row(id=x[0], at=x[1], entry=x[2], found=x[3])))
        assert [x.found for x in join(df.limit(3), lookup.limit(0), F.col("at"), "key", "value", "found").collect()] == [None] * 3
        assert join(df.limit(0), lookup, F.col("at"), "key", "value", "found").collect() == []


def test_a_hot_value_of_a_lookup_is_split(spark):
    df = spark.range(8000).select(F.lit(5).alias("at"))
    entry = df.select("at", F.lit(None).cast("struct<a:int>").alias("entry"), F.xxhash64(F.monotonically_increasing_id()).alias("place"))
    files = {x.removeprefix("file://") for x in lookups.carried(entry, [F.col("at"), F.col("place")], "entry", "found").inputFiles()}
    sizes = [pq.read_metadata(x).num_rows for x in files]
    assert sum(sizes) == 8000 and len(sizes) >= 4 and max(sizes) < 4000


def test_intervals_and_varying_bits_as_connectors_send_them(spark):
    rows = [("P-1Y-5M0DT0H0M0S", "P0Y0M24DT23H34M5.878667S", "BQ=="), ("P1Y5M0DT0H0M0S", "P0Y0M-24DT-23H-34M-5.878667S", "AAE="), ("P0Y-5M0DT0H0M0S", "P0Y0M1DT2H3M4.5S", "AA=="), ("P-0Y0M0DT0H0M0S", "P0Y0M0DT0H0M-0.000001S", ""), (None, None, None)]
    df = spark.createDataFrame(rows, "x string, y string, z string")
    got = convert.convert_values(df, {"x": ("year_month", None), "y": ("day_second", None), "z": ("bits", None)}).collect()
    assert [r.x for r in got] == ["-1-5", "1-5", "-0-5", "0-0", None]
    assert [r.y for r in got] == ["24 23:34:5.878667000", "-24 23:34:5.878667000", "1 2:3:4.500000000", "-0 0:0:0.000001000", None]
    assert [r.z for r in got] == ["101", "100000000", "0", "0", None]
    assert [r[0] for r in df.select(convert.bits(F.col("z"), convert.VARYING)).collect()] == ["101", "100000000", "0", "0", None]


def test_placement_counts_indexes(spark):
    limits = spark.createDataFrame([(4, 10.0, 5, 10.0, 10.0)], "cores long, most_gb double, most_objects long, reads_per_core double, writes_per_core double")

    def placed(*rows):
        names = "object_name string, size_gb double, n_indexes long, index_gb double, reads long, writes long, index_reads long, index_writes long"
        df = spark.createDataFrame(list(rows), names).withColumns({"db_id": F.lit("d"), "schema_name": F.lit("s")})
        return "".join(r.placement[0] for r in fleet.place(df, limits).orderBy("object_name").collect())

    assert placed(("a", 1.0, 1, 2.0, 0, 0, 0, 0), ("b", 2.0, 0, None, 0, 0, 0, 0), ("c", 3.0, 0, None, 0, 0, 0, 0)) == "ccc"
    assert placed(("a", 1.0, 1, 9.5, 0, 0, 0, 0), ("b", 2.0, 0, None, 0, 0, 0, 0)) == "ss"  # the size of an index counts, and all that follow go
    assert placed(("a", 1.0, 2, 0.0, 0, 0, 0, 0), ("b", 1.5, 1, 0.0, 0, 0, 0, 0), ("c", 2.0, 0, None, 0, 0, 0, 0)) == "ccs"  # 3 + 2 objects are as many as may be
    assert placed(("a", 1.0, 3, 99.0, 9, 9, 9, 9), ("b", 2.0, 0, None, None, None, None, None)) == "sc"  # too many indexes: counts nowhere
    assert placed(("a", 1.0, 0, None, 20, 0, 0, 0), ("b", 2.0, 1, 0.0, 10, 0, 0, 11), ("c", 3.0, 0, None, 0, 0, 0, 0)) == "css"  # reads and writes of table and index


def test_tablets_by_phases(spark):
    sizes = [0.0, 0.3, 1.5, 2.0, 30.0, 31.0, 720.0, 800.0, 2400.0, 2500.0, 7300.0, 76800.0, 76801.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in sizes], "gb double").coalesce(1).select(fleet.tablets(F.col("gb"), F.lit(3))).collect()]
    assert got == [0, 1, 3, 3, 3, 4, 72, 72, 72, 25, 73, 768, 257]
    none = spark.createDataFrame([], "db_id string, cores long, size_gb double")
    nodes = spark.createDataFrame([("d", 4, 5)], "db_id string, cores long, nodes long")
    limits = spark.createDataFrame([(4, 60)], "cores long, most_tablets long")
    assert [tuple(r) for r in fleet.nodes_with_tablets(none, nodes, limits).collect()] == [("d", 4, 0, 5)]
    many = spark.createDataFrame([("d", 4, 2.0)] * 12, "db_id string, cores long, size_gb double")
    assert [tuple(r) for r in fleet.nodes_with_tablets(many, nodes, limits).collect()] == [("d", 4, 48, 5)]
    assert [tuple(r) for r in fleet.nodes_with_tablets(many.union(many), nodes, limits).collect()] == [("d", 4, 96, 10)]


def test_hotspots_by_whole_type_names(spark):
    kinds = ["date", "DATE", "timestamp", "timestamptz", "timestamp(3) with time zone", "timestamp without time zone", "daterange", "datemultirange", "text", "timestamps"]
    df = spark.createDataFrame([("d", "t", f"i{k}", 1, x) for k, x in enumerate(kinds)] + [("d", "t", "second", 2, "date")], "db_id string, table_name string, index_name string, position int, data_type string")
    assert sorted(r.index_name for r in fleet.hotspots(df).collect()) == [f"i{k}" for k in range(6)]


PLAN = "db_id string, strategy string, cores long, nodes long, cores_needed long, failure string"


def test_best_type_of_each_strategy(spark):
    def best(*rows):
        found = fleet.best_by_strategy(spark.createDataFrame([("d", "mixed", *x) for x in rows], PLAN)).collect()
        return [(r.cores, r.nodes, r.failure) for r in found]

    assert best((2, 9, 17, None), (4, 4, 16, None), (8, 3, 24, None)) == [(4, 4, None)]
    assert best((2, 8, 16, None), (4, 4, 16, None)) == [(4, 4, None)]  # of equal need the larger
    assert best((2, 2, 4, "too many"), (4, 4, 16, None)) == [(4, 4, None)]
    assert best((2, 2, 4, "too many"), (8, 1, 8, "too many"), (4, 1, 4, "x")) == [(8, 1, fleet.NO_PLAN)]
    assert best() == []


def test_choice_between_mixed_and_sharded(spark):
    def chosen(mixed, sharded):
        rows = [("d", name, cores, nodes, cores * nodes, failure) for name, (cores, nodes, failure) in (("mixed", mixed), ("sharded", sharded))]
        (row,) = fleet.choose_strategy(spark.createDataFrame(rows, PLAN)).collect()
        return row.strategy, row.why

    assert chosen((4, 3, None), (4, 3, None)) == ("sharded", "as many nodes")
    assert chosen((4, 3, None), (4, 4, None)) == ("mixed", "12 cores, not 16")
    assert chosen((4, 5, None), (4, 4, None)) == ("sharded", "16 cores, not 20")
    assert chosen((8, 3, None), (4, 6, None)) == ("mixed", "as many cores on larger nodes")
    assert chosen((4, 6, None), (8, 3, None)) == ("sharded", "as many cores on larger nodes")
    assert chosen((16, 3, None), (4, 4, None)) == ("sharded", "16 cores, not 48")
    assert chosen((4, 9, None), (4, 3, "no")) == ("mixed", "the other does not fit")
    assert chosen((4, 3, "no"), (16, 30, None)) == ("sharded", "the other does not fit")
    assert chosen((4, 9, "no"), (16, 3, "no")) == ("mixed", "neither fits")
    assert chosen((4, 3, "no"), (16, 30, "no")) == ("mixed", "neither fits")


def test_plans_of_a_database(spark):
    objects = spark.createDataFrame([("d", "s", "a", 1.0, 1, 0.5, 10, 0, 5, 0), ("d", "s", "b", 40.0, 2, 3.0, 100, 50, None, 10), ("d", "s", "c", None, None, None, None, None, None, None)], "db_id string, schema_name string, object_name string, size_gb double, n_indexes long, index_gb double, reads long, writes long, index_reads long, index_writes long")
    indexes = spark.createDataFrame([("d", "s", "a", 0.5), ("d", "s", "b", 1.0), ("d", "s", "b", 2.0)], "db_id string, schema_name string, object_name string, size_gb double")
    limits = spark.createDataFrame([(4, 10.0, 9, 10.0, 10.0, 30, 4), (8, 10.0, 9, 10.0, 10.0, 1000, 9)], "cores long, most_gb double, most_objects long, reads_per_core double, writes_per_core double, most_tablets long, most_sharded long")
    rows = fleet.plans(fleet.place(objects, limits), objects, indexes, limits).withColumn("reason", fleet.plan_reason()).collect()
    got = {(r.strategy, r.cores): (r.nodes, r.cores_needed, r.tablets, r.failure) for r in rows}
    # 4 cores, mixed: 16 cores of work are 4 nodes and one for the colocated; 5 + 2 + 4 tablets are held by 3.
    assert got[("mixed", 4)] == (5, 20, 11, None)
    assert got[("sharded", 4)] == (5, 18, 0, "6 sharded tables and indexes are more than 4")  # 17.5 cores of work
    assert got[("mixed", 8)] == (3, 24, 4 + 2 + 3, None)
    assert got[("sharded", 8)] == (3, 24, 4 + 2 + 3 + 2 + 1, None)
    (reason,) = [r.reason for r in rows if (r.strategy, r.cores) == ("mixed", 4)]
    assert reason == "5 nodes of 4 cores; 3 colocated objects (2 tables, 1 indexes) of 1.5000 GB, 15 reads and 0 writes a second; 3 sharded objects (1 tables, 2 indexes) of 43.0000 GB, 100 reads and 60 writes a second"


def _redundant(rows):
    """Pair by pair."""
    found = {}
    for name, method, columns, options, included, predicate, unique, lax, fixed in rows:
        if fixed or predicate:
            continue
        for other, o_method, o_columns, o_options, o_included, o_predicate, o_unique, o_lax, _ in rows:
            n = len(columns)
            begins = other != name and not o_predicate and method == o_method and o_columns[:n] == columns and o_options[:n] == options
            held = set(included) <= set(o_columns[n:]) | set(o_included)
            strong = not unique or (o_unique and columns == o_columns and (not lax or o_lax))
            twins = (columns, set(included), unique, unique and lax) == (o_columns, set(o_included), o_unique, o_unique and o_lax)
            if begins and held and strong and not (twins and name < other):
                found[name] = min(found.get(name, other), other)
    return found


INDEXES = "index_name string, method string, columns array<string>, options array<string>, included array<string>, predicate string, is_unique boolean, nulls_not_distinct boolean, is_constraint boolean"


def test_redundant_indexes_of_any_traits(spark):
    rnd = random.Random(7)
    some = lambda most: [rnd.choice("abc") for _ in range(rnd.randint(0, most))]
    rows = []
    for k in range(400):
        columns = some(3)
        rows.append((f"i{k}", rnd.choice(["btree", "btree", "hash"]), columns, [rnd.choice(["asc", "asc", "desc"]) for _ in columns], some(1), rnd.choice([None, None, None, "p"]), rnd.random() < 0.3, rnd.random() < 0.5, rnd.random() < 0.2))
    rows = [x for x in rows if x[2]]
    df = spark.createDataFrame(rows, INDEXES).withColumns({"db_id": F.lit("d"), "schema_name": F.lit("s"), "table_name": F.lit("t")})
    got = fleet.redundant_indexes(df.withColumn("extra", F.lit(1))).collect()
    assert {r.redundant: r.existing for r in got} == _redundant(rows) and len(got) == len(_redundant(rows))
    assert fleet.redundant_indexes(df.where("false")).count() == 0


def test_many_indexes_of_one_table_form_no_pairs(spark):
    n = 30000
    alike = spark.range(n).select(F.format_string("i%05d", "id").alias("index_name"), F.array(F.lit("a"), F.lit("b")).alias("columns"))
    longer = spark.range(n).select(F.format_string("j%05d", "id").alias("index_name"), F.array(F.lit("a"), F.lit("b"), F.format_string("c%d", "id")).alias("columns"))
    rows = alike.union(longer).selectExpr("'d' db_id", "'s' schema_name", "'t' table_name", "index_name", "'btree' method", "columns", "transform(columns, x -> 'asc') options", "array() :: array<string> included", "null :: string predicate", "false is_unique", "false nulls_not_distinct", "false is_constraint")
    found = fleet.redundant_indexes(rows)
    assert found.agg(F.count("*"), F.countDistinct("existing"), F.min("existing"), F.min("redundant")).first() == (n, 2, "i00000", "i00000")
    counted = lookups.longer_lists(rows, ["db_id", "table_name"], "columns", "n")
    assert counted.agg(F.count("*"), F.min("n"), F.max("n")).first() == (n, n, n)


def test_prefixes(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b"],), (["b", "a"],), (["a", "b", "c"],)], "c array<string>").withColumn("k", F.lit(1))
    got = sorted((r.c, r.n) for r in lookups.longer_lists(df, ["k"], "c", "n").collect())
    assert got == [(["a"], 3), (["a", "b"], 1), (["a", "b"], 1)]


def test_stored_profile_of_parts(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id % 4 AS p", "IF(id % 7 = 0, NULL, id % 11) AS `a b`", "id AS many", "NULL :: string AS none", "IF(id % 10 < 3, 'often', id :: string) AS skewed")
    rows = rows.unionByName(rows.where("p = 0").withColumn("p", F.lit(None).cast("long")))
    columns = ["a b", "many", "none", "skewed"]
    kept = sketches.StoredProfile(spark, str(tmp_path / "sketches"), columns, "p", 256)
    kept.add(rows.where("false"))
    assert kept.known() == [] and kept.profile().count() == 0
    kept.add(rows.where("p < 2"))
    assert sorted(kept.known()) == ["0", "1"]
    kept.add(rows.withColumn("none", F.when(F.col("p") == 0, "changed")))  # parts that are there aren't read again
    assert kept.read().count() == 5 * len(columns) and None in kept.known()
    got = {r.column_name: r for r in kept.profile().collect()}
    want = {r.column_name: r for r in stats.profile(rows, columns).collect()}
    for name in columns:
        assert (got[name].n_rows, got[name].null_frac) == (want[name].n_rows, want[name].null_frac)
        assert abs(got[name].n_distinct - want[name].n_distinct) <= 0.05 * want[name].n_distinct
    assert got["a b"][3:] == want["a b"][3:] and got["none"].top_value is None
    assert got["skewed"].top_value == "often" and 0 <= got["skewed"].top_freq - want["skewed"].top_freq <= 3.5 / 256
    kept.replace(rows.where("p = 0").withColumn("none", F.lit("changed")))
    assert {r.column_name: r for r in kept.profile().collect()}["none"].top_value == "changed"
    assert kept.read().count() == 5 * len(columns)
    kept.add(rows)
    assert kept.read().count() == 5 * len(columns)
    kept.add(rows.where("false"))
    assert sketches.merged_profile(sketches.sketch(rows.where("false"), columns, "p")).count() == 0


def test_keys_over_a_hierarchy_of_partitions(spark):
    tables = spark.createDataFrame([
        ("plain", False, False, None, None), ("keyed", True, False, None, None), ("heir", False, True, None, None),
        ("top", False, False, None, ["a"]), ("mid", False, False, "top", ["b"]), ("leaf", False, False, "mid", None), ("other", None, None, "top", []),
        ("top2", False, False, None, ["a"]), ("mid2", False, False, "top2", ["b"]), ("leaf2", True, False, "mid2", None),
        ("vague", False, False, None, None), ("part", False, False, "vague", None),
    ], "table_name string, has_pk boolean, is_inherited boolean, parent string, partition_columns array<string>").withColumn("db_id", F.lit("d"))
    names = [r.table_name for r in tables.collect()]
    uniques = spark.createDataFrame([(x, f"{x}_{''.join(c)}", c) for x in names for c in (["a"], ["b", "a"], ["a", "n"], ["a", "b", "c"])], "table_name string, index_name string, columns array<string>").withColumn("db_id", F.lit("d"))
    columns = spark.createDataFrame([(x, c, c != "n") for x in names for c in "abcn"], "table_name string, column_name string, not_null boolean").withColumn("db_id", F.lit("d"))
    got = sorted(r.index_name for r in fleet.pk_recommendations(tables, uniques, columns).collect())
    assert got == ["plain_a", "plain_abc", "plain_ba", "top_abc", "top_ba"]
    assert fleet.pk_recommendations(tables.where("false"), uniques, columns).count() == 0
    circle = spark.createDataFrame([("d", "x", False, False, "y", None), ("d", "y", False, False, "x", None)], "db_id string, table_name string, has_pk boolean, is_inherited boolean, parent string, partition_columns array<string>")
    with pytest.raises(ValueError):
        fleet.pk_recommendations(circle, uniques, columns)
