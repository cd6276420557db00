"""Queries on change logs: events, folding, conflicts, validation, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conflicts, events, fold, load, stats, validate
from ..sources import changelog, shelves
from ..sources.shared import new_path
from ..sources.versioned import VersionedTable
from ..streaming import rates, run, state
from .catalog_queries import SEQUENCES, sequence_columns
from .inputs import change_log
from .inputs import load as read
from .registry import query

COLUMNS = ["value", "k", "kind"]
KEY = ["id"]

# The state of affairs before each event, and each key's last life.
LIVES = """
    WITH e AS (SELECT f.*, b.id IS NOT NULL AS based, last_value(CASE WHEN op IN ('c', 'd') THEN op END IGNORE NULLS) OVER (PARTITION BY f.id ORDER BY vsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
               FROM {cdc_flat} f LEFT JOIN {base} b ON b.id = f.id),
    l AS (SELECT *, CASE WHEN prior IS NULL THEN based ELSE prior = 'c' END AS live FROM e),
    x AS (SELECT *, CASE WHEN op = 'c' THEN NOT live ELSE live END AS effective FROM l),
    n AS (SELECT *, sum(CASE WHEN op = 'c' AND effective THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY vsn) AS life FROM x),
    z AS (SELECT id, max(life) AS life, any_value(based) AS based, arg_max(CASE WHEN op = 'c' THEN true WHEN op = 'd' THEN false ELSE live END, vsn) AS alive FROM n GROUP BY id)"""
FOLDED = LIVES + """,
    p AS (SELECT n.*, z.life AS last_life FROM n JOIN z ON z.id = n.id AND z.life = n.life WHERE z.alive AND n.effective AND n.op <> 'd'),
    v AS (SELECT id, max(last_life) AS life, max(CASE WHEN op <> 'd' THEN vsn END) AS value_at, max(CASE WHEN has_k THEN vsn END) AS k_at, max(CASE WHEN op = 'c' THEN vsn END) AS kind_at FROM p GROUP BY id)"""
FOLD = FOLDED + """
    SELECT b.id, b.value, b.k, b.kind FROM {base} b WHERE b.id NOT IN (SELECT id FROM {cdc_flat})
    UNION ALL
    SELECT z.id, CASE WHEN v.value_at IS NOT NULL THEN pv.value WHEN z.life = 0 THEN b.value END AS value,
           CASE WHEN v.k_at IS NOT NULL THEN pk.k WHEN z.life = 0 THEN b.k END AS k, CASE WHEN v.kind_at IS NOT NULL THEN pn.kind WHEN z.life = 0 THEN b.kind END AS kind
    FROM z LEFT JOIN {base} b ON b.id = z.id LEFT JOIN v ON v.id = z.id LEFT JOIN p pv ON pv.id = z.id AND pv.vsn = v.value_at
         LEFT JOIN p pk ON pk.id = z.id AND pk.vsn = v.k_at LEFT JOIN p pn ON pn.id = z.id AND pn.vsn = v.kind_at
    WHERE z.alive"""


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold(read(spark, sf_dir, "base"), change_log(spark, sf_dir), KEY, COLUMNS)


def segment_sql(table: str, key: str, columns: list[str], n: int = 16) -> str:
    text = "concat_ws('|', " + ", ".join(f"coalesce(CAST({x} AS STRING), '\\N')" for x in columns) + ")"
    return f"""SELECT CAST(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % 65536 // {65536 // n} AS INTEGER) AS segment, count(*) AS n_rows,
        bit_xor(CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)) AS xor_hash, sum(CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)) AS sum_hash
        FROM {table} GROUP BY 1"""


SIDE = ["id", "cust", "status", "price"]
SEGMENTS = f"WITH s AS ({segment_sql('{source_side}', 'CAST(id AS STRING)', SIDE)}), t AS ({segment_sql('{target_side}', 'CAST(id AS STRING)', SIDE)})"
COMPARED = """SELECT coalesce(s.segment, t.segment) AS segment, s.n_rows AS source_rows, t.n_rows AS target_rows,
    CASE WHEN s.segment IS NULL THEN 'missing_source' WHEN t.segment IS NULL THEN 'missing_target' WHEN s.n_rows = t.n_rows AND s.xor_hash = t.xor_hash AND s.sum_hash = t.sum_hash THEN 'match' ELSE 'mismatch' END AS status
    FROM s FULL JOIN t ON s.segment = t.segment"""


@query("flagship_fold_and_compare", FOLD.replace("\n    SELECT b.id, b.value", ",\n    fin AS (SELECT b.id, b.value", 1) + f"""),
    s AS ({segment_sql('fin', 'CAST(id AS STRING)', ['id', 'value', 'k', 'kind'])}), t AS ({segment_sql('{base}', 'CAST(id AS STRING)', ['id', 'value', 'k', 'kind'])}) {COMPARED}""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the table looks like after its changes, and where it no longer agrees with the copy before them."""
    columns = [*KEY, *COLUMNS]
    return validate.compare_segments(validate.segments(folded(spark, sf_dir), KEY, columns), validate.segments(read(spark, sf_dir, "base"), KEY, columns))


# B: choosing and changing events

@query("b4_valid_events", "SELECT op, count(*) AS n FROM {cdc_flat} WHERE vsn % 7 <> 0 GROUP BY op")
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = change_log(spark, sf_dir).withColumn("op", F.when(F.col("vsn") % 7 != 0, F.col("op")).when(F.col("vsn") % 2 == 0, "cutover.target"))
    return events.valid_events(marked).groupBy("op").agg(F.count("*").alias("n"))


@query("b2_rename_tables", "SELECT CASE WHEN id % 9 = 1 THEN 'sales' ELSE 'public' END AS schema_name, CASE WHEN id % 9 = 1 THEN 'clients' ELSE 't' || CAST(id % 9 AS STRING) END AS table_name, CASE WHEN id % 9 = 1 THEN 't1' END AS partition_table_name, count(*) AS n FROM {cdc_flat} GROUP BY 1, 2, 3")
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = load.rows_frame(spark, [("public", "t1", "sales", "clients")], "schema_name string, table_name string, new_schema string, new_table string")
    return events.rename_tables(change_log(spark, sf_dir), mapping).groupBy("schema_name", "table_name", "partition_table_name").agg(F.count("*").alias("n"))


@query("b3_route_partitions", "SELECT CASE WHEN year(o_orderdate) % 2 = 0 THEN 'orders' ELSE 'orders_' || CAST(year(o_orderdate) AS STRING) END AS target_table, count(*) AS n FROM {orders} GROUP BY 1")
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumn("table_name", F.concat(F.lit("orders_"), F.year("o_orderdate")))
    mapping = rows.where(F.year("o_orderdate") % 2 == 0).select(F.col("table_name").alias("leaf"), F.lit("orders").alias("root")).distinct()
    return events.route_partitions(rows, mapping).groupBy("target_table").agg(F.count("*").alias("n"))


def raw_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("price", "priority", "status")
    sides = {side: F.map_from_arrays(F.array(*[F.lit(x) for x in names]), F.array(*[F.col(f"{x}{k}") for x in names])) for k, side in enumerate(("before", "after"))}
    return read(spark, sf_dir, "pairs").select("id", F.lit("u").alias("op"), sides["before"].alias("before"), sides["after"].alias("after"))


CHANGED = "SELECT id, CASE WHEN price0 IS DISTINCT FROM price1 THEN price1 END AS price, price0 IS DISTINCT FROM price1 AS sets_price, priority0 IS DISTINCT FROM priority1 AS sets_priority FROM {pairs}"


def shown(df: DataFrame) -> DataFrame:
    there = lambda x: F.map_contains_key("fields", x)
    return df.select("id", F.try_element_at("fields", F.lit("price")).alias("price"), there("price").alias("sets_price"), there("priority").alias("sets_priority"))


@query("a7_connector_envelope", CHANGED)
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(events.normalize_envelope(raw_envelope(spark, sf_dir)))


@query("a8_set_envelope", "SELECT id, price1 AS price, true AS sets_price, id % 2 = 0 AS sets_priority FROM {pairs}")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_envelope(spark, sf_dir)
    wrapped = {x: F.transform_values(x, lambda name, value: F.struct(value.alias("value"), ((name != "priority") | (F.col("id") % 2 == 0)).alias("set"))) for x in ("before", "after")}
    return shown(events.normalize_set_envelope(raw.withColumns(wrapped)))


@query("b5_drop_noop_updates", f"SELECT * FROM ({CHANGED}) x WHERE sets_price OR sets_priority")
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(events.drop_noop_updates(events.normalize_envelope(raw_envelope(spark, sf_dir))))


@query("b6_changed_fields", "SELECT sum(CASE WHEN price0 IS DISTINCT FROM price1 THEN 1 ELSE 0 END + CASE WHEN priority0 IS DISTINCT FROM priority1 THEN 1 ELSE 0 END) AS n_fields FROM {pairs}")
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_envelope(spark, sf_dir).agg(F.sum(F.size(events.changed_fields(F.col("before"), F.col("after")))).alias("n_fields"))


@query("b7_filter_role", "SELECT exporter_role, count(*) AS n FROM {cdc_flat} WHERE exporter_role = 'source_db_exporter' GROUP BY 1")
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.filter_role(change_log(spark, sf_dir), "source_db_exporter").groupBy("exporter_role").agg(F.count("*").alias("n"))


# G: order, identity, folding

@query("g1_dedup_events", "SELECT vsn, op, min(arrival) AS arrival FROM {cdc_dup} WHERE event_id IS NOT NULL GROUP BY vsn, op UNION ALL SELECT vsn, op, arrival FROM {cdc_dup} WHERE event_id IS NULL")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.dedup_events(read(spark, sf_dir, "cdc_dup")).select("vsn", "op", "arrival")


@query("g2_number_events", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS n FROM {events}")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.number_events(read(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"], 8, "n").select("event_id", "n")


@query("g3_fold", FOLD)
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(spark, sf_dir)


@query("g4_latest_state", "SELECT id, vsn, value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY vsn DESC) AS n FROM {cdc_flat}) x WHERE n = 1 AND op <> 'd'")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.latest_state(change_log(spark, sf_dir), KEY).select("id", "vsn", F.try_element_at("fields", F.lit("value")).alias("value"))


@query("g5_row_history", LIVES + """,
    m AS (SELECT id, vsn, op, life, value, has_k, k, kind FROM n WHERE effective UNION ALL SELECT id, -1, 'c', 0, value, true, k, kind FROM {base}),
    s AS (SELECT *, max(CASE WHEN op <> 'd' THEN vsn END) OVER w AS value_at, max(CASE WHEN has_k THEN vsn END) OVER w AS k_at, max(CASE WHEN op = 'c' THEN vsn END) OVER w AS kind_at FROM m WINDOW w AS (PARTITION BY id, life ORDER BY vsn))
    SELECT s.id, s.vsn, s.op, a.value, b.k, c.kind FROM s LEFT JOIN m a ON a.id = s.id AND a.vsn = s.value_at LEFT JOIN m b ON b.id = s.id AND b.vsn = s.k_at LEFT JOIN m c ON c.id = s.id AND c.vsn = s.kind_at WHERE s.vsn >= 0""")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.history(read(spark, sf_dir, "base"), change_log(spark, sf_dir), KEY, COLUMNS)


@query("g6_net_change", LIVES + " SELECT z.id, CASE WHEN NOT z.based AND z.alive THEN 'c' WHEN z.based AND NOT z.alive THEN 'd' WHEN z.based AND z.alive AND EXISTS (SELECT 1 FROM {cdc_flat} f WHERE f.id = z.id AND f.op IN ('u', 'd')) THEN 'u' ELSE 'none' END AS net FROM z")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.net_change(read(spark, sf_dir, "base"), change_log(spark, sf_dir), KEY)


@query("g7_ineffective_events", LIVES + " SELECT op, count(*) AS n, sum(CASE WHEN effective THEN 0 ELSE 1 END) AS n_ineffective FROM x GROUP BY op")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.ineffective(read(spark, sf_dir, "base"), change_log(spark, sf_dir), KEY)


@query("g8_resume", "SELECT vsn, id % 4 AS channel FROM {cdc_flat} WHERE vsn > CASE id % 4 WHEN 0 THEN 100 WHEN 1 THEN 500 ELSE -1 END")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = load.rows_frame(spark, [(0, 100), (1, 500)], "channel long, last_applied long")
    return fold.resume(change_log(spark, sf_dir).withColumn("channel", F.col("id") % 4), ledger).select("vsn", "channel")


@query("g9_partition_keys", "SELECT vsn, 'public.t' || CAST(id % 9 AS STRING) || '|' || CAST(id AS STRING) AS by_pk, 'public.t' || CAST(id % 9 AS STRING) AS by_table FROM {cdc_flat}")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_log(spark, sf_dir).select("vsn", events.partition_key("pk").alias("by_pk"), events.partition_key("table").alias("by_table"))


@query("g9_custom_keys", "SELECT vsn, 'public.t' || CAST(id % 9 AS STRING) || '|' || CASE WHEN op = 'c' THEN kind WHEN id % 4 = 0 THEN '<NULL>' ELSE 'kind' || CAST(id % 3 AS STRING) END || '|' || CAST(id AS STRING) AS by_columns FROM {cdc_flat}")
def g9_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By two columns that no update carries; a null counts as a value."""
    own = F.create_map(F.lit("no"), F.col("id").cast("string"))
    before = F.map_concat(own, F.create_map(F.lit("kind"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("kind"), (F.col("id") % 3).cast("string")))))
    inserted = F.col("op") == "c"
    log = change_log(spark, sf_dir).withColumns({"before_fields": F.when(~inserted, before), "fields": F.when(inserted, F.map_concat("fields", own)).otherwise(F.col("fields"))})
    return log.select("vsn", events.partition_key("custom", ["no", "kind"]).alias("by_columns"))


@query("g10_channels", "SELECT count(DISTINCT id) AS keys, true AS one_channel_each, true AS in_range FROM {cdc_flat}")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = change_log(spark, sf_dir).withColumn("channel", events.channel(events.partition_key("pk"))).groupBy("id").agg(F.min("channel").alias("low"), F.max("channel").alias("high"))
    return dealt.agg(F.count("*").alias("keys"), F.bool_and(F.col("low") == F.col("high")).alias("one_channel_each"), F.bool_and(F.col("low").between(0, 99)).alias("in_range"))


TABLE_FACTS = "SELECT 't' || CAST(id % 9 AS STRING) AS table_name, max(id) % 2 = 0 AS has_expression_index FROM {cdc_flat} GROUP BY id % 9"


@query("g11_resolve_strategies", f"SELECT table_name, has_expression_index, CASE WHEN table_name = 't3' THEN 'table' WHEN has_expression_index THEN 'table' ELSE 'pk' END AS strategy FROM ({TABLE_FACTS}) x")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = change_log(spark, sf_dir).groupBy("table_name").agg((F.max("id") % 2 == 0).alias("has_expression_index"))
    return events.resolve_strategies(tables, load.rows_frame(spark, [("t3", "table")], "table_name string, strategy string"))


@query("g12_strategy_changes", "SELECT DISTINCT 't' || CAST(id % 9 AS STRING) AS table_name, CASE WHEN id % 9 = 0 THEN 'missing' WHEN id % 9 = 8 THEN 'extra' ELSE 'changed' END AS status FROM {cdc_flat} WHERE id % 9 IN (0, 8, 4)")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = change_log(spark, sf_dir).select("table_name").distinct().withColumns({"strategy": F.lit("pk"), "columns": F.array(F.lit("id"))})
    after = tables.where("table_name <> 't0'").withColumn("columns", F.when(F.col("table_name") == "t4", F.array(F.lit("k"), F.lit("id"))).otherwise(F.col("columns")))
    return events.strategy_changes(tables.where("table_name <> 't8'"), after)


@query("g13_snapshot_insert_policy", "SELECT id, min(vsn) AS vsn FROM {cdc_flat} f WHERE id NOT IN (SELECT id FROM {base} WHERE id % 2 = 0) GROUP BY id")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "cdc_flat").select("id", "vsn")
    return fold.snapshot_conflicts(rows, read(spark, sf_dir, "base").where("id % 2 = 0"), KEY, "ignore")


def mark(log: DataFrame, parts: int, of: int) -> F.Column:
    """The place of the log that is so many parts of the way to its end."""
    return F.lit((log.agg(F.max("vsn")).first()[0] or 0) * parts // of)


@query("g14_until_marker", "SELECT count(*) AS n, max(vsn) AS last FROM {cdc_flat} WHERE vsn < (SELECT max(vsn) * 7 // 9 FROM {cdc_flat})")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    marked = log.withColumn("op", F.when(F.col("vsn") == mark(log, 7, 9), "cutover.target").otherwise(F.col("op")))
    return fold.until_marker(marked).agg(F.count("*").alias("n"), F.max("vsn").alias("last"))


@query("g15_next_segments", "SELECT file_no AS segment_no FROM {ledger} GROUP BY file_no HAVING max(CASE WHEN state <> 'done' THEN 1 ELSE 0 END) = 1")
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = read(spark, sf_dir, "ledger").groupBy(F.col("file_no").alias("segment_no")).agg(F.bool_and(F.col("state") == "done").alias("done"))
    return fold.next_segments(ledger).select("segment_no")


# I: conflicts on unique keys

def uk_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "uk_log")

    def bucket(column: str, there) -> F.Column:
        values = F.when(there, F.create_map(F.lit("uk"), F.col(column))).otherwise(F.create_map().cast("map<string,string>"))
        return conflicts.bucket_key(values, ["uk"], False, "t.uk")

    return log.select("vsn", "op", "pkey", bucket("before_uk", F.col("op") != "c").alias("before_bucket"), bucket("after_uk", F.col("has_after")).alias("after_bucket"))


def bucketed(column: str) -> str:
    return f"'t.uk|' || CAST(length({column}) AS STRING) || ':' || {column}"


@query("i1_bucket_keys", f"SELECT vsn, {bucketed('before_uk')} AS before_bucket, {bucketed('after_uk')} AS after_bucket FROM {{uk_log}}")
def i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uk_events(spark, sf_dir).select("vsn", "before_bucket", "after_bucket")


@query("i2_before_after_conflicts", "SELECT l.vsn AS later, count(*) AS n, max(e.vsn) AS nearest FROM {uk_log} l JOIN {uk_log} e ON e.before_uk = l.after_uk AND e.op IN ('u', 'd') AND l.op IN ('c', 'u') AND e.vsn < l.vsn AND e.pkey <> l.pkey GROUP BY l.vsn")
def i2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.conflict_counts(uk_events(spark, sf_dir))


@query("i3_before_before_conflicts", "SELECT l.vsn AS later, count(*) AS n, max(e.vsn) AS nearest FROM {uk_log} l JOIN {uk_log} e ON e.before_uk = l.before_uk AND e.op IN ('u', 'd') AND l.op <> 'c' AND e.vsn < l.vsn AND e.pkey <> l.pkey GROUP BY l.vsn")
def i3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.before_conflict_counts(uk_events(spark, sf_dir))


NEAREST = f"""
    WITH t AS (SELECT vsn, pkey, after_uk AS uk FROM {{uk_log}} WHERE op IN ('c', 'u') AND after_uk IS NOT NULL UNION SELECT vsn, pkey, before_uk FROM {{uk_log}} WHERE op = 'u')
    SELECT t.vsn, {bucketed('t.uk')} AS bucket, max(e.vsn) AS blocker FROM t JOIN {{uk_log}} e ON e.before_uk = t.uk AND e.op IN ('u', 'd') AND e.vsn < t.vsn AND e.pkey <> t.pkey GROUP BY t.vsn, t.uk"""


@query("i4_nearest_conflict", NEAREST)
def i4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.nearest_conflicts(uk_events(spark, sf_dir))


@query("i5_conflicts_in_flight", NEAREST + " HAVING t.vsn - max(e.vsn) <= 500")
def i5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.nearest_conflicts(uk_events(spark, sf_dir), 500)


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uk_events() in eight channels, and every 50 places a report of each on what it has applied, some way behind."""
    log = uk_events(spark, sf_dir).select((F.col("vsn") * 2).alias("seq"), "vsn", "op", "pkey", "before_bucket", "after_bucket", (F.col("pkey").cast("long") % 8).cast("int").alias("channel"), F.lit(None).cast("long").alias("applied"))
    none = F.lit(None).cast("string")
    marks = read(spark, sf_dir, "cdc_flat").where("vsn % 50 = 0").select("vsn", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("channel"))
    reports = marks.select((F.col("vsn") * 2 + 1).alias("seq"), F.lit(None).cast("long").alias("vsn"), none.alias("op"), none.alias("pkey"), none.alias("before_bucket"), none.alias("after_bucket"), "channel", (F.col("vsn") - 10 * (F.col("channel") + 1)).alias("applied"))
    return log.unionByName(reports)


IN_FLIGHT = f"""
    WITH t AS (SELECT vsn, pkey, after_uk AS uk FROM {{uk_log}} WHERE op IN ('c', 'u') AND after_uk IS NOT NULL UNION SELECT vsn, pkey, before_uk FROM {{uk_log}} WHERE op = 'u'),
    m AS (SELECT vsn AS mark FROM {{cdc_flat}} WHERE vsn % 50 = 0),
    r AS (SELECT t.*, coalesce((SELECT max(mark) FROM m WHERE mark < t.vsn), -1000000) AS mark FROM t)
    SELECT r.vsn, {bucketed('r.uk')} AS bucket, max(e.vsn) AS blocker, CAST(count(*) AS INTEGER) AS n_blockers FROM r JOIN {{uk_log}} e ON e.before_uk = r.uk AND e.op IN ('u', 'd') AND e.vsn < r.vsn AND e.pkey <> r.pkey
    WHERE e.vsn > r.mark - 10 * (CAST(e.pkey AS BIGINT) % 8 + 1) GROUP BY r.vsn, r.uk"""


@query("i5_in_flight_stream", IN_FLIGHT)
def i5_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the log and the reports come in, against what hasn't been applied."""
    path, log = new_path(spark), reported(spark, sf_dir)
    run.write_in_order(log, path, "seq", 50_000)
    with state.state_store(spark):
        return run.to_table(spark, state.conflicts_in_flight(run.read_in_order(spark, path, log.schema, 16), 8))


@query("i6_coarse_conflicts", "SELECT l.vsn, max(e.vsn) AS blocker FROM {cdc_flat} l JOIN {cdc_flat} e ON e.id % 9 = l.id % 9 AND e.id <> l.id AND e.vsn < l.vsn AND (e.op = 'd' OR (e.op = 'u' AND e.has_k AND l.has_k AND l.op <> 'd')) GROUP BY l.vsn")
def i6(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir).select("vsn", "op", F.element_at("key", "id").alias("pkey"), "table_name", F.array_intersect(F.map_keys("fields"), F.array(F.lit("k"))).alias("columns"))
    return conflicts.coarse_conflicts(log)


@query("i7_unchecked_tables", "SELECT DISTINCT 't' || CAST(id % 9 AS STRING) AS table_name FROM {cdc_flat} WHERE id % 9 NOT IN (1, 2, 3) OR id % 9 = 2")
def i7(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = change_log(spark, sf_dir).select("table_name").distinct()
    indexes = tables.where(F.col("table_name").isin("t1", "t2", "t3"))
    return conflicts.unchecked_tables(tables, indexes, load.rows_frame(spark, [("t2", "table")], "table_name string, strategy string"))


@query("i8_merged_indexes", "SELECT DISTINCT CASE WHEN o_orderstatus = 'P' THEN 'orders_P_' || CAST(year(o_orderdate) AS STRING) ELSE 'orders_' || o_orderstatus END AS table_name, CASE WHEN o_custkey % 2 = 0 THEN 'o_orderkey' ELSE 'k' || CAST(o_custkey % 10 AS STRING) END AS first_column FROM {orders}")
def i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves by status and year; those of status P have no root."""
    first = F.when(F.col("o_custkey") % 2 == 0, "o_orderkey").otherwise(F.concat(F.lit("k"), F.col("o_custkey") % 10))
    indexes = read(spark, sf_dir, "orders").select(F.concat_ws("_", F.lit("orders"), "o_orderstatus", F.year("o_orderdate")).alias("table_name"), F.array(first).alias("columns")).distinct()
    roots = indexes.select(F.col("table_name").alias("leaf"), F.substring_index("table_name", "_", 2).alias("root")).where("root <> 'orders_P'").distinct()
    return conflicts.merge_indexes(indexes, roots).select("table_name", F.element_at("columns", 1).alias("first_column"))


@query("i9_duplicate_keys", "SELECT id, count(*) AS n FROM {target_side} GROUP BY id HAVING count(*) > 1")
def i9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.duplicate_keys(read(spark, sf_dir, "target_side"), ["id"])


# H and T: two sides

@query("h1_row_counts", "SELECT 'orders' AS table_name, (SELECT count(*) FROM {source_side}) AS source_rows, (SELECT count(*) FROM {target_side}) AS target_rows, (SELECT count(*) FROM {source_side}) = (SELECT count(*) FROM {target_side}) AS same UNION ALL SELECT 'nation', count(*), count(*), true FROM {nation}")
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    return validate.compare_counts({"orders": read(spark, sf_dir, "source_side"), "nation": nation}, {"orders": read(spark, sf_dir, "target_side"), "nation": nation})


@query("h2_segment_hashes", SEGMENTS + " " + COMPARED)
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = (validate.segments(read(spark, sf_dir, x), ["id"], SIDE) for x in ("source_side", "target_side"))
    return validate.compare_segments(one, two)


@query("h3_drill_down", """
    WITH s AS (SELECT id, concat_ws('|', id, cust, status, CAST(price AS STRING)) AS row_text, count(*) AS n FROM {source_side} GROUP BY 1, 2), t AS (SELECT id, concat_ws('|', id, cust, status, CAST(price AS STRING)) AS row_text, count(*) AS n FROM {target_side} GROUP BY 1, 2)
    SELECT coalesce(s.id, t.id) AS id, coalesce(s.row_text, t.row_text) AS row_text, coalesce(s.n, 0) AS source_n, coalesce(t.n, 0) AS target_n FROM s FULL JOIN t ON s.id = t.id AND s.row_text = t.row_text WHERE coalesce(s.n, 0) <> coalesce(t.n, 0)""")
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.drill_down(read(spark, sf_dir, "source_side"), read(spark, sf_dir, "target_side"), ["id"], SIDE, 4096)


EXPECTED = "WITH c AS (SELECT 't' || CAST(id % 9 AS STRING) AS table_name, sum(CASE WHEN op = 'c' THEN 1 ELSE 0 END) AS inserts, sum(CASE WHEN op = 'd' THEN 1 ELSE 0 END) AS deletes FROM {cdc_flat} GROUP BY 1), b AS (SELECT 't' || CAST(id % 9 AS STRING) AS table_name, count(*) AS snapshot_rows FROM {base} GROUP BY 1)"


@query("f6_expected_rows", EXPECTED + " SELECT b.table_name, snapshot_rows + coalesce(inserts, 0) - coalesce(deletes, 0) AS expected FROM b LEFT JOIN c ON b.table_name = c.table_name")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = stats.event_counters(change_log(spark, sf_dir), ["table_name"])
    snapshot = read(spark, sf_dir, "base").groupBy(F.concat(F.lit("t"), F.col("id") % 9).alias("table_name")).agg(F.count("*").alias("snapshot_rows"))
    return snapshot.join(counted, "table_name", "left").select("table_name", stats.expected_rows(F.col("snapshot_rows"), F.col("inserts"), F.col("deletes")).alias("expected"))


@query("h4_expected_and_actual_rows", FOLD.replace("\n    SELECT b.id, b.value", ",\n    fin AS (SELECT b.id, b.value", 1) + """),
    c AS (SELECT 't' || CAST(id % 9 AS STRING) AS table_name, sum(CASE WHEN op = 'c' THEN 1 ELSE 0 END) AS inserts, sum(CASE WHEN op = 'd' THEN 1 ELSE 0 END) AS deletes FROM {cdc_flat} GROUP BY 1),
    b AS (SELECT 't' || CAST(id % 9 AS STRING) AS table_name, count(*) AS snapshot_rows FROM {base} GROUP BY 1), f AS (SELECT 't' || CAST(id % 9 AS STRING) AS table_name, count(*) AS actual FROM fin GROUP BY 1)
    SELECT b.table_name, snapshot_rows + coalesce(inserts, 0) - coalesce(deletes, 0) AS expected, actual FROM b LEFT JOIN c ON b.table_name = c.table_name LEFT JOIN f ON b.table_name = f.table_name""")
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = folded(spark, sf_dir).groupBy(F.concat(F.lit("t"), F.col("id") % 9).alias("table_name")).agg(F.count("*").alias("actual"))
    return f6(spark, sf_dir).join(actual, "table_name", "left")


@query("h5_replication_lag", "SELECT 't' || CAST(id % 9 AS STRING) AS table_name, count(*) AS exported, sum(CASE WHEN vsn <= m THEN 1 ELSE 0 END) AS imported, sum(CASE WHEN vsn <= m THEN 0 ELSE 1 END) AS remaining FROM {cdc_flat} CROSS JOIN (SELECT max(vsn) * 7 // 10 AS m FROM {cdc_flat}) y GROUP BY 1")
def h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    return validate.lag(stats.event_counters(log, ["table_name"]), stats.event_counters(log.where(F.col("vsn") <= mark(log, 7, 10)), ["table_name"]), ["table_name"])


@query("h6_column_differences", """WITH s AS (SELECT CAST(sum(price) AS STRING) AS a, CAST(count(DISTINCT status) AS STRING) AS b, CAST(sum(length(status)) AS STRING) AS c FROM {source_side}), t AS (SELECT CAST(sum(price) AS STRING) AS a, CAST(count(DISTINCT status) AS STRING) AS b, CAST(sum(length(status)) AS STRING) AS c FROM {target_side})
    SELECT 'price' AS column_name, 'sum' AS "check", s.a AS source_value, t.a AS target_value, s.a = t.a AS same FROM s CROSS JOIN t UNION ALL SELECT 'status', 'distinct', s.b, t.b, s.b = t.b FROM s CROSS JOIN t UNION ALL SELECT 'status', 'length', s.c, t.c, s.c = t.c FROM s CROSS JOIN t""")
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.column_differences(read(spark, sf_dir, "source_side"), read(spark, sf_dir, "target_side"), ["price"], ["status"])


@query("h7_constraint_audit", """SELECT 'null' AS "check", 'status' AS column_name, sum(CASE WHEN status IS NULL THEN 1 ELSE 0 END) AS n FROM {target_side} UNION ALL SELECT 'duplicate_key', 'id', sum(n - 1) FROM (SELECT count(*) AS n FROM {target_side} GROUP BY id) x
    UNION ALL SELECT 'orphan', 'cust', count(*) FROM {target_side} WHERE cust NOT IN (SELECT c_custkey FROM {customer} WHERE c_custkey % 3 <> 0)""")
def h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = {"cust": (read(spark, sf_dir, "customer").where("c_custkey % 3 <> 0"), "c_custkey")}
    return validate.audit(read(spark, sf_dir, "target_side"), ["id"], ["status"], parents)


@query("h8_archive_completeness", "SELECT DISTINCT file_no AS segment_no, CASE WHEN file_no % 5 = 0 THEN 'missing' ELSE 'ok' END AS status FROM {ledger}")
def h8(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = read(spark, sf_dir, "ledger").select(F.col("file_no").alias("segment_no")).distinct()
    return validate.archive_completeness(segments, segments.where("segment_no % 5 <> 0"))


@query("t1_multiset_difference", "SELECT 'source' AS side, * FROM (SELECT * FROM {source_side} EXCEPT ALL SELECT * FROM {target_side}) a UNION ALL SELECT 'target' AS side, * FROM (SELECT * FROM {target_side} EXCEPT ALL SELECT * FROM {source_side}) b")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.multiset_difference(read(spark, sf_dir, "source_side"), read(spark, sf_dir, "target_side"))


@query("t5_key_difference", "SELECT id, 'source' AS side FROM {source_side} WHERE id NOT IN (SELECT id FROM {target_side})")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.key_difference(read(spark, sf_dir, "source_side"), read(spark, sf_dir, "target_side"), ["id"])


# A: change-log sources and sinks

@query("a6_change_log_round_trip", "SELECT vsn, op, value, has_k AS sets_k, k FROM {cdc_flat}")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    changelog.write_change_log(change_log(spark, sf_dir).drop("id", "ts"), path, rows=5000, partitions=4)
    got, _ = changelog.read_change_log(spark, path)
    return got.select("vsn", "op", F.try_element_at("fields", F.lit("value")).alias("value"), F.map_contains_key("fields", "k").alias("sets_k"), F.try_element_at("fields", F.lit("k")).alias("k"))


@query("a12_apply_changes", FOLD)
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In three batches, the second of which comes twice."""
    table = VersionedTable(spark, new_path(spark), KEY, COLUMNS, 4)
    table.create(read(spark, sf_dir, "base"))
    log = change_log(spark, sf_dir)
    third = (log.agg(F.max("vsn")).first()[0] or 0) // 3 + 1
    for batch in (0, 1, 1, 2):
        table.apply(log.where(F.floor(F.col("vsn") / third) == batch), batch)
    return table.read()


# L: streams

def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.read_files(spark, sf_dir, "events.parquet", read(spark, sf_dir, "events").schema)


@query("l1_tumbling_counts", "SELECT time_bucket(INTERVAL '10 seconds', ts) AS slot, event_type, count(*) AS n FROM {events} GROUP BY 1, 2")
def l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run.to_table(spark, rates.tumbling_counts(event_stream(spark, sf_dir), ["event_type"]), ["slot", "event_type"], "update")


@query("l2_sliding_rates", """WITH s AS (SELECT time_bucket(INTERVAL '10 seconds', ts) AS slot, event_type, count(*) AS n FROM {events} GROUP BY 1, 2), b AS (SELECT event_type, min(slot) AS began FROM s GROUP BY 1),
    w AS (SELECT slot + INTERVAL (k * 10) SECOND AS ends, event_type, sum(n) AS n_10, sum(CASE WHEN k <= 18 THEN n ELSE 0 END) AS n_3 FROM s CROSS JOIN range(1, 61) r(k) GROUP BY 1, 2),
    m AS (SELECT w.*, least(3, date_diff('second', began, ends) // 60 + 1) AS m_3, least(10, date_diff('second', began, ends) // 60 + 1) AS m_10 FROM w JOIN b USING (event_type))
    SELECT ends, event_type, n_3, n_3 // m_3 AS per_minute_3, n_3 // m_3 // 60 AS per_second_3, n_10, n_10 // m_10 AS per_minute_10, n_10 // m_10 // 60 AS per_second_10 FROM m""")
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.sliding_rates(l1(spark, sf_dir), ["event_type"])


@query("l3_catch_up", "SELECT 't' || CAST(id % 9 AS STRING) AS table_name, CAST(floor(sum(CASE WHEN vsn > 70 * m // 100 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN vsn <= 6 * m // 100 THEN 1 ELSE 0 END), 0)) AS BIGINT) AS minutes FROM {cdc_flat} CROSS JOIN (SELECT max(vsn) AS m FROM {cdc_flat}) y GROUP BY 1")
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir)
    counted = log.groupBy("table_name").agg(F.count_if(F.col("vsn") > mark(log, 70, 100)).alias("remaining"), F.count_if(F.col("vsn") <= mark(log, 6, 100)).alias("rate"))
    return counted.select("table_name", rates.catch_up_minutes(F.col("remaining"), F.col("rate")).alias("minutes"))


#: Segments that lie in one folder.
SHELF = 1000


@query("l4_archive_segments", "SELECT event_id // 50 AS segment_no, CASE WHEN event_id // 50 <= (SELECT max(event_id // 50) - 3 FROM {events}) THEN 'archived' ELSE 'live' END AS place, count(*) AS n_rows FROM {events} GROUP BY 1, 2")
def l4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    rows = read(spark, sf_dir, "events").withColumn("segment_no", F.expr("event_id div 50"))
    shelves.write(rows, f"{path}/log", SHELF)
    segments = rows.select("segment_no").distinct().withColumn("done", F.lit(True))
    archived = shelves.clean(spark, f"{path}/log", rows.schema, SHELF, stats.retained(segments).select("segment_no"), "archive", f"{path}/archive")
    live = shelves.read(spark, f"{path}/log", rows.schema).groupBy("segment_no").agg(F.count("*").alias("n_rows"))
    return archived.withColumn("place", F.lit("archived")).unionByName(live.withColumn("place", F.lit("live")))


@query("l5_stream_dedup", "SELECT event_id, event_type FROM {events}")
def l5(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return run.to_table(spark, rates.dedup(twice)).select("event_id", "event_type")


@query("l6_stream_fold", FOLD)
def l6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as a stream of segments, applied batch by batch to the table."""
    path = new_path(spark)
    changelog.write_change_log(change_log(spark, sf_dir).drop("ts"), f"{path}/log", partitions=2)
    table = VersionedTable(spark, f"{path}/table", KEY, COLUMNS, 4)
    table.create(read(spark, sf_dir, "base"))
    stream, _ = changelog.read_change_log(spark, f"{path}/log", streaming=True)
    keyed = stream.withColumn("id", F.element_at("key", "id").cast("long"))
    run.apply_stream(keyed, table, f"{path}/progress")
    return table.read()


@query("l6_row_state", FOLD)
def l6_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as a stream, each row's state in the state store."""
    path, log = new_path(spark), change_log(spark, sf_dir).select("id", "vsn", "op", "fields")
    run.write_in_order(log, path, "vsn", 25_000)
    base = read(spark, sf_dir, "base")
    with state.state_store(spark):
        states = run.to_table(spark, state.row_states(run.read_in_order(spark, path, log.schema, 16), base, KEY, COLUMNS), KEY, "update")
    return state.latest_rows(base, states, KEY, COLUMNS)


@query("l7_sequence_states", SEQUENCES)
def l7_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sequences of all tables from one stream."""
    log, sequences, start = sequence_columns(spark, sf_dir)
    path, log = new_path(spark), log.select("schema_name", "table_name", "vsn", "op", "fields")
    run.write_in_order(log, path, "vsn", 25_000)
    with state.state_store(spark):
        raised = run.to_table(spark, state.sequence_states(run.read_in_order(spark, path, log.schema, 16), sequences, start), ["sequence_name"], "update")
    return raised.unionByName(start).groupBy("sequence_name").agg(F.max("last_value").alias("last_value"))


@query("l7_stream_sequences", "SELECT 's' AS sequence_name, max(TRY_CAST(k AS BIGINT)) AS last_value FROM {cdc_flat} WHERE op <> 'd'")
def l7(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    there = (op == "c") | ((op == "u") & (F.col("event_id") % 3 == 0) & (F.col("event_id") % 9 != 0))
    log = event_stream(spark, sf_dir).select(op.alias("op"), F.when(there, F.create_map(F.lit("k"), F.regexp_extract("props", "([0-9]+)", 1))).alias("fields"))
    return run.to_table(spark, rates.running_sequences(log, "k", "s"), ["sequence_name"], "update")


@query("l8_batch_limits", "SELECT true AS within_limit, count(*) AS n_events FROM {cdc_flat}")
def l8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of at most 4,000 events, one a batch; in eight lanes by key, whose batches run side by side."""
    path = new_path(spark)
    log, lanes = change_log(spark, sf_dir), 8
    lane = events.channel(events.partition_key("pk"), lanes).alias("lane")
    changelog.write_change_log(log.select("*", lane).drop("id", "ts"), path, rows=4000, partitions=2, lane="lane", lanes=lanes)
    streams = [changelog.read_change_log(spark, f"{path}/lane={k}", streaming=True, files_per_batch=1)[0] for k in range(lanes)]
    return run.batch_sizes(spark, *streams).agg(F.coalesce(F.bool_and(F.col("n_events") <= 4000), F.lit(True)).alias("within_limit"), F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"))


@query("l9_after_snapshot", "SELECT vsn FROM {cdc_flat} WHERE vsn > 300")
def l9(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir).withColumn("op", F.when(F.col("vsn") <= 200, "r").otherwise(F.col("op")))
    path = new_path(spark)
    changelog.write_change_log(log.drop("id", "ts"), path, partitions=2)
    stream, _ = changelog.read_change_log(spark, path, streaming=True)
    return run.to_table(spark, run.after_snapshot(stream, 300).select("vsn"))


HANDED_OVER = """
    WITH x AS (SELECT vsn, 's' || CAST(id % 2 AS STRING) AS source, vsn <= (SELECT max(vsn) // 3 FROM {cdc_flat}) AS early FROM {cdc_flat}),
    e AS (SELECT *, CASE WHEN early AND source = 's0' AND vsn = (SELECT max(vsn) FROM x WHERE early AND source = 's0') THEN 'last' WHEN early THEN 'true' WHEN source = 's0' THEN 'false' END AS snapshot FROM x),
    b AS (SELECT source, coalesce(least(min(CASE WHEN snapshot = 'last' THEN vsn END), min(CASE WHEN snapshot IS NULL OR snapshot = 'false' THEN vsn END) - 1), min(CASE WHEN snapshot IS NULL OR snapshot = 'false' THEN vsn END) - 1) AS boundary FROM e GROUP BY source)
    SELECT source, vsn, boundary, CASE WHEN vsn <= boundary THEN 'loaded' ELSE 'applied' END AS part FROM e JOIN b USING (source)"""


@query("l9_handover", HANDED_OVER)
def l9_handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources whose snapshots end within the stream: one with a mark, the other without."""
    log = change_log(spark, sf_dir).select("vsn", "id", F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source"))
    early = F.col("vsn") <= F.lit((log.agg(F.max("vsn")).first()[0] or 0) // 3)
    last = log.where(early & (F.col("source") == "s0")).agg(F.max("vsn")).first()[0]
    mark = F.when(early & (F.col("vsn") == F.lit(last)), "last").when(early, "true").when(F.col("source") == "s0", "false")
    path, events_ = new_path(spark), log.withColumn("snapshot", mark).drop("id")
    run.write_in_order(events_, f"{path}/log", "vsn", 25_000)

    def into(part: str):
        return lambda df, batch_id: df.withColumn("part", F.lit(part)).write.mode("overwrite").parquet(f"{path}/{part}/b={batch_id}")

    bounds = run.follow(run.read_in_order(spark, f"{path}/log", events_.schema, 16), f"{path}/state", into("loaded"), into("applied"))
    rows = [spark.read.schema("vsn long, source string, part string, b int").parquet(f"{path}/{x}") for x in ("loaded", "applied")]
    return rows[0].unionByName(rows[1]).join(bounds, "source").select("source", "vsn", "boundary", "part")


BY_ROLE = """
    WITH u AS (SELECT l.*, c.id % 9 AS tab, c.has_k, CASE WHEN l.vsn // 400 % 2 = 0 THEN 'source_db_exporter' ELSE 'target_db_exporter_fb' END AS role FROM {uk_log} l JOIN {cdc_flat} c ON c.vsn = l.vsn),
    s AS (SELECT *, CASE WHEN lag(role) OVER (ORDER BY vsn) <> role THEN 1 ELSE 0 END AS turned FROM u), n AS MATERIALIZED (SELECT *, CAST(sum(turned) OVER (ORDER BY vsn) AS BIGINT) AS stretch FROM s),
    t AS (SELECT vsn, pkey, stretch, after_uk AS uk FROM n WHERE role = 'source_db_exporter' AND op IN ('c', 'u') AND after_uk IS NOT NULL UNION SELECT vsn, pkey, stretch, before_uk FROM n WHERE role = 'source_db_exporter' AND op = 'u'),
    f AS (SELECT t.stretch, t.vsn, e.vsn AS blocker FROM t JOIN n e ON e.stretch = t.stretch AND e.before_uk = t.uk AND e.op IN ('u', 'd') AND e.vsn < t.vsn AND e.pkey <> t.pkey
        UNION ALL SELECT l.stretch, l.vsn, e.vsn FROM n l JOIN n e ON e.stretch = l.stretch AND e.tab = l.tab AND e.pkey <> l.pkey AND e.vsn < l.vsn AND (e.op = 'd' OR (e.op = 'u' AND e.has_k AND l.has_k AND l.op <> 'd')) WHERE l.role = 'target_db_exporter_fb')
    SELECT stretch, vsn, max(blocker) AS blocker FROM f GROUP BY stretch, vsn"""


@query("l11_conflicts_by_role", BY_ROLE)
def l11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exporter's role changes every 400 places of the log; the one that follows has no before-values."""
    role = F.when(F.expr("vsn div 400") % 2 == 0, "source_db_exporter").otherwise("target_db_exporter_fb")
    tables = change_log(spark, sf_dir).select("vsn", "table_name", F.array_intersect(F.map_keys("fields"), F.array(F.lit("k"))).alias("columns"))
    log = uk_events(spark, sf_dir).join(tables, "vsn").withColumn("exporter_role", role)
    return conflicts.conflicts_by_role(log, ["target_db_exporter_fb"])
