"""What only larger tables bring about."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import convert
from tidemark.llm import toxicity
from tidemark.operators import drift, fleet, load, validate
from tidemark.plans import catalog_queries, inputs, registry
from tidemark.sources import changelog, shelves
from tidemark.streaming import run


def test_timestamps_beyond_64_bits_of_nanoseconds_and_four_digits_of_years(spark):
    seconds = [0, -1, 106_752 * 86_399, 9_000_000 * 86_399]
    rows = spark.createDataFrame([(s, f"{s * 1000 + 5}", f"{s * 1_000_000 + 5000}", f"{s * 1_000_000_000 + 5}") for s in seconds], "s long, x string, y string, z string")
    got = {r.s: (r.x, r.y, r.z) for r in convert.convert_values(rows, {"x": ("timestamp", None), "y": ("micro_timestamp", None), "z": ("nano_timestamp", None)}).collect()}
    days = {0: "1970-01-01 00:00:00", -1: "1969-12-31 23:59:59", 106_752 * 86_399: "2262-04-10 18:20:48", 9_000_000 * 86_399: "26610-11-17 20:00:00"}
    assert got == {s: (x, x.replace(" ", "T") + ".005", x.replace(" ", "T") + ".000000005") for s, x in days.items()}
    odd = spark.createDataFrame([("1.5",), ("x",), (None,), (" 1 ",)], "z string").withColumn("k", F.col("z"))
    assert {r.k: r.z for r in convert.convert_values(odd, {"z": ("nano_timestamp", None)}).collect()} == {"1.5": None, "x": None, None: None, " 1 ": "1970-01-01T00:00:00.000000001"}


def test_shelves_are_archived_and_dropped_in_part_and_again(spark, tmp_path):
    rows = spark.range(600).selectExpr("id", "id div 10 AS segment_no")
    log, target = str(tmp_path / "log"), str(tmp_path / "archive")
    shelves.write(rows, log, 25)
    assert len(list((tmp_path / "log").glob("shelf=*"))) == 3  # not a folder for each of 60 segments

    def held(path):
        return sorted(r.id for r in shelves.read(spark, path, rows.schema).collect())

    def some(*numbers):
        return spark.createDataFrame([(k,) for k in numbers], "segment_no long")

    assert shelves.clean(spark, log, rows.schema, 25, some(1), "retain") is None and len(held(log)) == 600
    for eligible in (some(*range(10)), some(*range(30), 59), some(*range(30), 59)):  # more than before, then again
        counts = shelves.clean(spark, log, rows.schema, 25, eligible, "archive", target)
        assert {(r.segment_no, r.n_rows) for r in counts.collect()} == {(r.segment_no, 10) for r in eligible.collect()}
    gone = {*range(300), *range(590, 600)}
    assert held(target) == sorted(gone) and held(log) == sorted(set(range(600)) - gone)
    shelves._put(spark, shelves.with_shelf(rows.where("segment_no = 30"), 25), str(tmp_path / "log"), [1])
    (tmp_path / "log/shelf=1/g=0").mkdir()  # what a run that broke off may leave
    assert [x for x in held(log) if 250 <= x < 500] == list(range(300, 310))
    shelves.clean(spark, log, rows.schema, 25, some(30, 31), "delete")
    assert not [x for x in held(log) if 250 <= x < 500] and not (tmp_path / "log/shelf=1").exists()
    with pytest.raises(Exception, match="missing"):
        shelves.clean(spark, log, rows.schema, 25, some(99), "archive", target)
    with pytest.raises(ValueError):
        shelves.clean(spark, log, rows.schema, 25, some(1), "burn")


def test_segments_are_written_by_one_job_and_come_in_order(spark, tmp_path):
    spark.sparkContext.setJobGroup("segments", "")
    assert run.write_in_order(spark.range(0, 400).where("id NOT BETWEEN 100 AND 199").repartition(3), str(tmp_path / "log"), "id", 10) == 30
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("segments")) < 8  # before: one for each segment
    spark.sparkContext.setJobGroup("others", "")
    found = []
    stream = run.read_in_order(spark, str(tmp_path / "log"), spark.range(1).schema, 7)
    stream.writeStream.foreachBatch(lambda df, n: found.append(sorted(r.id for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [len(x) for x in found] == [70, 70, 70, 70, 20] and sum(found, []) == [x for x in range(400) if not 100 <= x < 200]


def test_long_change_logs_are_sorted_in_small_parts_and_read_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changelog, "SORTED", 100)
    log = spark.range(0, 1000).select(F.col("id").alias("vsn"), F.lit("u").alias("op"), (F.col("id") % 2).alias("side")).repartition(3)
    changelog.write_change_log(log.drop("side"), str(tmp_path / "one"), rows=60, partitions=2)
    stream, _ = changelog.read_change_log(spark, str(tmp_path / "one"), streaming=True, files_per_batch=3)
    found = []
    stream.writeStream.foreachBatch(lambda df, n: found.append(sorted(r.vsn for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sum(found, []) == list(range(1000)) and max(len(x) for x in found) <= 180
    assert len({x.name.split("-")[1] for x in (tmp_path / "one").glob("part-*")}) == 10  # before: 2, whatever the log's length
    changelog.write_change_log(log, str(tmp_path / "two"), rows=60, partitions=2, lane="side")
    streams = [changelog.read_change_log(spark, str(tmp_path / f"two/lane={k}"), streaming=True, files_per_batch=1)[0] for k in range(2)]
    sizes = run.batch_sizes(spark, *streams).collect()
    assert {lane: sum(r.n_events for r in sizes if r.lane == lane) for lane in range(2)} == {0: 500, 1: 500} and max(r.n_events for r in sizes) <= 60


@pytest.mark.parametrize("n", [0, 40])
def test_a_lane_without_events_is_an_empty_log(spark, tmp_path, n):
    log = spark.range(n).select(F.col("id").alias("vsn"), F.lit("c").alias("op"), F.lit(2).alias("lane"))
    changelog.write_change_log(log, str(tmp_path / "log"), rows=15, partitions=1, lane="lane", lanes=4)
    streams = [changelog.read_change_log(spark, str(tmp_path / f"log/lane={k}"), streaming=True, files_per_batch=1)[0] for k in range(4)]
    assert sorted((r.lane, r.n_events) for r in run.batch_sizes(spark, *streams).collect()) == ([(2, 10), (2, 15), (2, 15)] if n else [])


def test_keys_that_repeat_count_once_and_sides_are_not_made_distinct_whole(spark):
    one, two = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 1, 2, None, None], [2, 3, 3]))
    got = validate.key_difference(one, two, ["k"])
    assert sorted(map(str, got.collect())) == sorted(map(str, [Row(k=1, side="source"), Row(k=None, side="source"), Row(k=3, side="target")]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Join") and plan.count("Aggregate") == 2


def test_batches_leave_a_file_for_each_part(spark, tmp_path):
    ledger = load.write_batches(spark.range(1000).repartition(3), str(tmp_path / "b"), 10, 10_000)
    assert ledger.count() >= 100 and sum(r.n_rows for r in ledger.collect()) == 1000
    assert len(list((tmp_path / "b").rglob("*.parquet"))) == 3  # before: one for each batch


def test_word_counts_are_passed_on_in_parts_and_come_out_the_same(monkeypatch):
    rnd = random.Random(5)
    rows = [(" ".join(rnd.choice(["Word", "wordlessly", "ΟΔΟΣ,", "a-b", "x"]) + rnd.choice(["", "7"]) for _ in range(rnd.randrange(9))), int(rnd.random() < 0.3)) for _ in range(3000)]
    want = {k: Counter() for k in ("toxic", "toxic_docs", "clean")}
    for text, toxic in rows:
        found = re.findall(r"\w+", text.lower())
        own = Counter(x for word in found for x in toxicity.features(word)) + Counter({"": len(found)})
        want["toxic" if toxic else "clean"].update(own)
        want["toxic_docs"].update({"", *own} if toxic else ())
    monkeypatch.setattr(toxicity, "HELD", 3)
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([x for _, x in rows])], ["text", "toxic"])
    parts = list(toxicity._count(iter([batch])))
    assert len(parts) == 4  # before: one for a batch of Spark's, however many words it holds
    for k, counts in want.items():
        got = Counter()
        for part in parts:
            got.update(dict(zip(part.column("feature").to_pylist(), part.column(k).to_pylist())))
        assert +got == +counts


@pytest.mark.parametrize("name", ["w7_best_plan", "p13_chosen_plan", "p9_nodes_needed", "p10_tablets"])
def test_plans_read_the_lines_once(spark, monkeypatch, name):
    found, read = [], catalog_queries.read
    monkeypatch.setattr(catalog_queries, "read", lambda spark, sf_dir, x: found.append(x) or read(spark, sf_dir, x))
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert found.count("indexes") == 1  # before: 2 to 4 times, and more where the plan used them twice
    assert not [x for x in plan.inputFiles() if "lineitem" in x]


def test_lines_are_added_up_before_they_meet_objects_with_the_same_result(spark, tmp_path):
    parts = [(1, "B1", 3, 900.0), (1, "B1", 6, 901.0), (1, "B2", 3, 900.0), (2, None, 4, 1.0), (3, "B1", None, 1.0), (4, "B1", 1, None), (None, "B1", 1, 1.0)]
    lines = [(k, k, n, q) for k in (1, 1, 2, 3, 4, 5, None) for n, q in ((1, 5.0), (1, None), (2, 7.0), (2, 1.0), (3, None))]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = spark.sql(inputs.INPUTS["indexes"], objects=inputs.load(spark, str(tmp_path), "objects"), lineitem=inputs.load(spark, str(tmp_path), "lineitem"))
    got = inputs.load(spark, str(tmp_path), "indexes")
    assert got.select(want.columns).dtypes == want.dtypes
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 9
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate [l_partkey")  # before: after the join, each line with its object's names


def test_plans_of_a_fleet_need_one_shuffle_by_database_and_cores(spark):
    rnd = random.Random(3)
    sizes = [(f"d{k % 7}", "s", f"o{k}", rnd.choice([None, 0.1, 3.0, 600.0]), [rnd.choice([None, 0.2, 70.0]) for _ in range(k % 4)], rnd.randrange(9), rnd.randrange(90)) for k in range(60)]
    rows = [(*x[:4], len(x[4]) or None, sum((y or 0.0 for y in x[4]), 0.0), *x[5:], 1, 2, [x[3], *x[4]]) for x in sizes]
    objects = spark.createDataFrame(rows, "db_id string, schema_name string, object_name string, size_gb double, n_indexes long, index_gb double, reads long, writes long, index_reads long, index_writes long, sizes array<double>")
    indexes = spark.createDataFrame([(*x[:3], y) for x in sizes for y in x[4]], "db_id string, schema_name string, object_name string, size_gb double")
    limits = spark.createDataFrame([(2, 5.0, 9, 10.0, 300.0, 120, 17), (8, 90.0, 16, 40.0, 900.0, 120, 40)], "cores long, most_gb double, most_objects long, reads_per_core double, writes_per_core double, most_tablets long, most_sharded long")
    want = fleet.plans(fleet.place(objects, limits), objects, indexes, limits)
    got = fleet.plans_of(fleet.with_placement(objects, limits, "sizes"))
    text = lambda df: sorted(str([round(x, 6) if isinstance(x, float) else x for x in row]) for row in df.collect())
    assert text(got) == text(want) and want.count() == 7 * 2 * 2 and 0 < want.where("failure IS NULL").count() < 28
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert re.findall(r"hashpartitioning\((.*?)#", plan) == ["db_id"]  # before: joins by object as well


@pytest.mark.parametrize("name", ["p15_schema_drift_by_name", "p15_schema_drift_by_id", "p15_table_drift"])
def test_drift_is_worked_out_once_before_it_is_sorted(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert not [x for x in plan.inputFiles() if "lineitem" in x or "orders" in x]  # before: the sample for the sort worked all out once more


def test_lists_are_the_same_in_any_order_and_with_nulls(spark):
    rows = [(None, []), (None, None), (["b", "a"], ["a", "b"]), (["a", None], [None, "a"]), (["a"], ["a", "a"]), (["a"], None), (["a"], ["a"])]
    got = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, x array<string>, y array<string>").select("k", drift.same_list(F.col("x"), F.col("y")).alias("same")).collect()
    assert [x.same for x in sorted(got)] == [True, True, True, True, False, False, True]
