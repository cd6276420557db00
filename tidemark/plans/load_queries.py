"""Queries on sources and sinks, value conversion, masking and load bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import convert, mask
from ..operators import load
from ..sources import dumps, reports
from ..sources.shared import new_path
from .inputs import change_log
from .inputs import load as read
from .registry import query

ORDERS = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_orderpriority", T.StringType())])
ORDERS_SQL = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS o_orderstatus, o_orderpriority || CASE WHEN o_orderkey % 5 = 0 THEN ', \"now\"' ELSE '' END AS o_orderpriority FROM {orders}"


def odd_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with nulls, delimiters and quotes in texts."""
    named = read(spark, sf_dir, "orders").select(*ORDERS.names)
    return named.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderstatus")), "o_orderpriority": F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, ', "now"').otherwise(""))})


@query("a1_csv_dump", ORDERS_SQL)
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    odd_orders(spark, sf_dir).write.options(sep=",", quote='"', escape='"', nullValue="\\N").csv(path)
    spark.range(1).select(F.lit("\\.").alias("value")).write.mode("append").text(path)
    return dumps.read_csv_dump(spark, path, ORDERS, null="\\N").drop(dumps.CORRUPT)


BROKEN_SQL = ORDERS_SQL.replace("o_orderpriority || CASE", "CASE WHEN o_orderkey % 3 = 0 THEN 'of,' || chr(10) || chr(10) || '\"' ELSE '' END || o_orderpriority || CASE")


@query("a1_quoted_line_breaks", BROKEN_SQL)
def a1_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks within quotes, in files that are split like others."""
    path = new_path(spark)
    rows = odd_orders(spark, sf_dir).withColumn("o_orderpriority", F.concat(F.when(F.col("o_orderkey") % 3 == 0, 'of,\n\n"').otherwise(""), "o_orderpriority"))
    rows.write.options(sep=",", quote='"', escape='"', nullValue="\\N", header=True).csv(path)
    return dumps.read_csv_dump(spark, path, ORDERS, null="\\N", header=True, multiline=True).drop(dumps.CORRUPT)


def copy_text(x) -> F.Column:
    text = x.cast("string")
    for char, mark in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n")):
        text = F.replace(text, F.lit(char), F.lit(mark))
    return F.coalesce(text, F.lit("\\N"))


CUSTOMER = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()), T.StructField("c_mktsegment", T.StringType())])


@query("a2_text_dump", "SELECT c_custkey, c_name || CASE WHEN c_custkey % 3 = 0 THEN chr(9) || 'x' || chr(92) || 'n' || chr(10) ELSE '' END AS c_name, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS c_mktsegment FROM {customer}")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "\tx\\n\n").otherwise("")).alias("c_name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    rows.select(F.concat_ws("\t", *[copy_text(F.col(x)) for x in rows.columns]).alias("value")).write.text(path)
    return dumps.read_text_dump(spark, path, CUSTOMER)


@query("a3_sql_dump", "SELECT 'public.customer' AS table_name, CAST(c_custkey AS STRING) || chr(9) || c_name AS line FROM {customer} UNION ALL SELECT 'public.orders', CAST(o_orderkey AS STRING) || chr(9) || o_orderpriority FROM {orders}")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four files of several COPY blocks each, with other statements between them."""
    path = new_path(spark)

    def block(k: int, name: str, key: str, value: str) -> DataFrame:
        around = [(f, k, part, 0, x) for f in range(4) for part, x in ((0, "SET x = 1;"), (1, f"COPY public.{name} ({key}, {value}) FROM STDIN;"), (3, "\\."), (4, "ANALYZE;"))]
        line = F.concat_ws("\t", F.col(key).cast("string"), value).alias("value")
        rows = read(spark, sf_dir, name).select((F.col(key) % 4).cast("int").alias("f"), F.lit(k).alias("k"), F.lit(2).alias("part"), F.col(key).cast("long").alias("at"), line)
        return load.rows_frame(spark, around, "f int, k int, part int, at long, value string").unionByName(rows)

    dump = block(0, "customer", "c_custkey", "c_name").unionByName(block(1, "orders", "o_orderkey", "o_orderpriority"))
    dump.repartitionByRange(4, "f").sortWithinPartitions("f", "k", "part", "at").select("value").write.text(path)
    return dumps.read_sql_dump(spark, path)


@query("a4_list_inputs", "SELECT DISTINCT 'o_orderpriority=' || o_orderpriority AS folder, true AS has_bytes FROM {orders} WHERE o_orderpriority < '4'")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the folders that a glob names, of a table written in a folder for each priority."""
    path = new_path(spark)
    read(spark, sf_dir, "orders").write.partitionBy("o_orderpriority").parquet(path)
    found = dumps.list_inputs(spark, f"{path}/o_orderpriority=[1-3]-*", "*.parquet")
    return found.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.bool_and(F.col("n_bytes") > 0).alias("has_bytes"))


@query("a5_manifest", "SELECT 'lineitem' AS table_name, count(*) AS n, sum(l_partkey) AS total FROM {lineitem} UNION ALL SELECT 'lines', count(*), sum(l_partkey) FROM {lineitem} WHERE l_linenumber = 2")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of seven files, one of which is also another table."""
    path = new_path(spark)
    rows = read(spark, sf_dir, "lineitem")
    rows.write.partitionBy("l_linenumber").parquet(path)
    schema = T.StructType([x for x in rows.schema if x.name != "l_linenumber"])
    files = [*[("lineitem", k) for k in range(1, 8)], ("lines", 2)]
    tables = dumps.load_manifest(spark, [{"table": name, "path": f"{path}/l_linenumber={k}", "schema": schema, "format": "parquet"} for name, k in files])
    counts = [df.agg(F.count("*").alias("n"), F.sum("l_partkey").alias("total")).select(F.lit(name).alias("table_name"), "n", "total") for name, df in tables.items()]
    return counts[0].unionByName(counts[1])


@query("a10_snapshot_sink", "SELECT 'orders_' || o_orderstatus AS table_name, count(*) AS n, sum(o_orderkey) AS total FROM {orders} GROUP BY 1")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    dumps.write_snapshot(read(spark, sf_dir, "orders").withColumn("table_name", F.concat(F.lit("orders_"), "o_orderstatus")), path)
    return spark.read.parquet(path).groupBy("table_name").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


@query("a14_report", "SELECT l_returnflag, count(*) AS n FROM {lineitem} GROUP BY 1")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    reports.write_report(read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")), path)
    return spark.read.schema("l_returnflag string, n long").json(path)


STATS = "SELECT queryid, query, calls, row_count, CAST(total AS DOUBLE) AS total, CASE WHEN node % 2 = 0 THEN 0 ELSE CAST(least AS DOUBLE) END AS least, CASE WHEN node % 3 = 0 THEN 'replica' ELSE 'primary' END AS source_node FROM {qstats} WHERE calls > 5 AND queryid % 20 <> 3"


@query("a15_query_stats", STATS)
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of them with the old field names, as JSON; some without calls, without a queryid or without a node's name."""
    rows = read(spark, sf_dir, "qstats").withColumns({"calls": F.when(F.col("calls") > 5, F.col("calls")).otherwise(0), "queryid": F.when(F.col("queryid") % 20 != 3, F.col("queryid"))})
    old = F.to_json(F.struct("queryid", "query", "calls", F.col("row_count").alias("rows"), F.col("total").alias("total_time")))
    new = F.to_json(F.struct("queryid", "query", "calls", F.col("row_count").alias("rows"), F.col("total").alias("total_exec_time"), F.col("least").alias("min_exec_time")))
    node = F.when(F.col("node") % 3 == 0, " replica").when(F.col("node") % 3 == 1, " ")
    good, _ = reports.parse_query_stats(rows.select(F.when(F.col("node") % 2 == 0, old).otherwise(new).alias("json"), node.alias("source_node")))
    return good.select("queryid", "query", "calls", "row_count", "total", "least", "source_node")


# B: tables and columns

@query("b1_filter_tables", "SELECT p_brand AS table_name, count(*) AS n FROM {part} WHERE p_brand LIKE 'Brand#1_' AND p_brand <> 'Brand#13' GROUP BY 1")
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").withColumnRenamed("p_brand", "table_name")
    return load.filter_tables(rows, ["Brand#1?"], ["*13"]).groupBy("table_name").agg(F.count("*").alias("n"))


@query("b8_column_types", "SELECT base_type, is_array, severity, count(*) AS n FROM (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'xml' WHEN 1 THEN 'varchar' ELSE 'geometry' END AS base_type, c_nationkey % 2 = 0 AS is_array, CASE c_nationkey % 3 WHEN 0 THEN 'unsupported' WHEN 1 THEN 'ok' ELSE 'unsupported_live' END AS severity FROM {customer}) x GROUP BY 1, 2, 3")
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey") % 3
    kind = F.concat(F.when(k == 0, "pg_catalog.XML").when(k == 1, "varchar(20)").otherwise("public.geometry"), F.when(F.col("c_nationkey") % 2 == 0, "[]").otherwise(""))
    rules = load.rows_frame(spark, [("xml", "unsupported"), ("geometry", "unsupported_live")], "base_type string, severity string")
    return load.flag_column_types(read(spark, sf_dir, "customer").select(kind.alias("data_type")), rules).groupBy("base_type", "is_array", "severity").agg(F.count("*").alias("n"))


@query("b10_select_columns", "SELECT s_suppkey, s_name FROM {supplier}")
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.select_columns(read(spark, sf_dir, "supplier"), ["s_name", "s_suppkey", "absent"])


# D: conversion. Each text is made from a key k; the SQL says what must come out.

def converted(spark: SparkSession, sf_dir: str, text: F.Column, kind: str, length: int | None = None) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).withColumn("x", text)
    return convert.convert_values(rows, {"x": (kind, length)}).select("k", "x")


@query("d1_dates", "SELECT o_orderkey AS k, strftime(DATE '1970-01-01' + CAST(o_orderkey % 30000 - 5000 AS INTEGER), '%Y-%m-%d') AS x FROM {orders}")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return converted(spark, sf_dir, (k % 30000 - 5000).cast("string"), "date")


@query("d2_timestamps", """SELECT o_orderkey AS k, strftime(make_timestamp(o_orderkey * 86399 * 1000000), '%Y-%m-%d %H:%M:%S') AS x, strftime(make_timestamp(o_orderkey * 86399 * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 1000 = 0 THEN '' ELSE '.' || regexp_replace(lpad(CAST(o_orderkey % 1000 * 1000 AS STRING), 6, '0'), '0+$', '') END AS y,
    strftime(make_timestamp(o_orderkey * 86399 * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 1000 = 0 THEN '' ELSE '.' || regexp_replace(lpad(CAST(o_orderkey % 1000 AS STRING), 9, '0'), '0+$', '') END AS z FROM {orders}""")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("o_orderkey") * 86399
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (seconds * 1000 + F.col("o_orderkey") % 1000).cast("string").alias("x"), (seconds * 1_000_000 + F.col("o_orderkey") % 1000 * 1000).cast("string").alias("y"), (seconds.cast("decimal(19,0)") * 1_000_000_000 + F.col("o_orderkey") % 1000).cast("string").alias("z"))
    return convert.convert_values(rows, {"x": ("timestamp", None), "y": ("micro_timestamp", None), "z": ("nano_timestamp", None)})


@query("d3_times", "SELECT o_orderkey AS k, strftime(make_timestamp(o_orderkey % 86400 * 1000000), '%H:%M:%S') AS x, strftime(make_timestamp(o_orderkey % 86400 * 1000000), '%H:%M:%S') || '.' || lpad(CAST(o_orderkey % 1000 * 100 AS STRING), 6, '0') AS y FROM {orders}")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(k.alias("k"), (k % 86400 * 1000 + k % 1000).cast("string").alias("x"), (k % 86400 * 1_000_000 + k % 1000 * 100).cast("string").alias("y"))
    return convert.convert_values(rows, {"x": ("time", None), "y": ("micro_time", None)})


@query("d4_zoned_timestamps", "SELECT o_orderkey AS k, strftime(make_timestamp((o_orderkey * 3601 - 7200) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS x FROM {orders}")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return converted(spark, sf_dir, F.concat(F.date_from_unix_date((k * 3601 / 86400).cast("int")).cast("string"), F.lit("T"), F.format_string("%02d:%02d:%02d", (k * 3601 % 86400 / 3600).cast("int"), (k * 3601 % 3600 / 60).cast("int"), (k * 3601 % 60).cast("int")), F.lit("+02:00")), "zoned_timestamp")


@query("d5_bits", "SELECT o_orderkey AS k, right('0000000000000000' || bin(o_orderkey % 4096), 12) AS x FROM {orders}")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    low, high = F.lpad(F.hex(k % 256), 2, "0"), F.lpad(F.hex(F.floor(k % 4096 / 256).cast("long")), 2, "0")
    return converted(spark, sf_dir, F.base64(F.unhex(F.concat(low, high))), "bits", 12)


@query("d5_varying_bits", "SELECT o_orderkey AS k, bin(o_orderkey % 4096) AS x FROM {orders}")
def d5_varying(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    low, high = F.lpad(F.hex(k % 256), 2, "0"), F.lpad(F.hex(F.floor(k % 4096 / 256).cast("long")), 2, "0")
    return converted(spark, sf_dir, F.base64(F.unhex(F.concat(low, high))), "bits", None)


@query("d6_bytes", "SELECT o_orderkey AS k, chr(92) || 'x' || lower(hex(o_orderpriority)) AS x FROM {orders}")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.base64(F.col("o_orderpriority").cast("binary")).alias("x"))
    return convert.convert_values(rows, {"x": ("bytes", None)})


@query("d7_literals", "SELECT c_custkey AS k, '''' || replace(c_name || '''s', '''', '''''') || '''' AS x FROM {customer}")
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat("c_name", F.lit("'s")).alias("x"))
    return convert.convert_values(rows, {"x": ("text", None)}, quote=True)


@query("d8_hstore", """SELECT c_custkey AS k, '"a' || chr(92) || '"b"=>"' || c_name || chr(92) || chr(92) || '","z"=>' || CASE WHEN c_custkey % 2 = 0 THEN 'NULL' ELSE '"' || c_mktsegment || '"' END AS x FROM {customer}""")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.create_map(F.lit("z"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_mktsegment")), F.lit('a"b'), F.concat("c_name", F.lit("\\")))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), convert.hstore(value).alias("x"))


@query("d9_intervals", """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 AND (o_orderkey % 50 > 0 OR o_orderkey % 12 > 0) THEN '-' ELSE '' END || CAST(o_orderkey % 50 AS STRING) || '-' || CAST(o_orderkey % 12 AS STRING) AS x,
    CASE WHEN o_orderkey % 4 = 0 AND (o_orderkey % 20 > 0 OR o_orderkey % 24 > 0 OR o_orderkey % 59 > 0 OR o_orderkey % 61 > 0) THEN '-' ELSE '' END
    || CAST(o_orderkey % 20 AS STRING) || ' ' || CAST(o_orderkey % 24 AS STRING) || ':' || CAST(o_orderkey % 59 AS STRING) || ':' || CAST(o_orderkey % 61 AS STRING) || CASE WHEN o_orderkey % 5 = 0 THEN '.000000000' ELSE '.000250000' END AS y FROM {orders} WHERE o_orderkey % 61 > 0 OR o_orderkey % 5 = 0""")
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As connectors send them: every part is there, and each carries the sign."""
    k = F.col("o_orderkey")

    def text(form: str, every: int, *values) -> F.Column:
        sign = F.when(k % every == 0, "-").otherwise("")
        return F.format_string(form, *[F.concat(sign, x.cast("string")) for x in values])

    months = text("P%sY%sM0DT0H0M0S", 3, k % 50, k % 12)
    seconds = text("P0Y0M%sDT%sH%sM%sS", 4, k % 20, k % 24, k % 59, F.concat((k % 61).cast("string"), F.when(k % 5 != 0, ".00025").otherwise("")))
    rows = read(spark, sf_dir, "orders").where("o_orderkey % 61 > 0 OR o_orderkey % 5 = 0").select(k.alias("k"), months.alias("x"), seconds.alias("y"))
    return convert.convert_values(rows, {"x": ("year_month", None), "y": ("day_second", None)})


@query("d10_oracle_formats", "SELECT o_orderkey AS k, strftime(DATE '1970-01-01' + CAST(o_orderkey % 30000 AS INTEGER), '%d-%m-%Y') AS x, strftime(make_timestamp(o_orderkey * 1001 * 1000), '%d-%m-%Y %H:%M:%S.') || lpad(CAST(o_orderkey * 1001 % 1000 AS STRING), 3, '0') AS y FROM {orders}")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("k"), convert.oracle_date((k % 30000).cast("string")).alias("x"), convert.oracle_timestamp((k * 1001).cast("string")).alias("y"))


@query("d11_variable_decimals", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '-' END || CAST((o_orderkey % 30000 + 1) // 100 AS STRING) || '.' || lpad(CAST((o_orderkey % 30000 + 1) % 100 AS STRING), 2, '0') AS x FROM {orders}")
def d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    number = (k % 30000 + 1) * F.when(k % 2 == 0, 1).otherwise(-1)
    encoded = F.base64(F.unhex(F.right(F.lpad(F.hex(number), 16, "0"), F.lit(4))))
    return read(spark, sf_dir, "orders").select(k.alias("k"), convert.variable_decimal(F.lit(2), encoded).alias("x"))


@query("d12_units", "SELECT p_partkey AS k, round(p_partkey * 1000000 / 1073741824.0, 6) AS gb, CASE p_size % 2 WHEN 0 THEN 'Table Index' ELSE 'View' END AS title FROM {part}")
def d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.round(convert.gigabytes(F.col("p_partkey") * 1_000_000), 6).alias("gb"), convert.title(F.when(F.col("p_size") % 2 == 0, "table_index").otherwise("view")).alias("title"))


@query("d13_type_resolution", "SELECT c_nationkey AS k, CASE c_nationkey % 3 WHEN 0 THEN 'DATE' WHEN 1 THEN 'micro_time' ELSE 'int64' END AS kind, count(*) AS n FROM {customer} GROUP BY c_nationkey")
def d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("c_nationkey") % 3
    kind = convert.resolve_type(F.when(m == 0, "DATE").otherwise("NUMBER"), F.when(m != 2, "micro_time"), F.lit("int64"), oracle=True)
    return read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k"), kind.alias("kind")).agg(F.count("*").alias("n"))


@query("d14_masking", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'name_' || substr(sha256('namesalt' || c_name), 1, 16) END AS c_name FROM {customer}")
def d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked twice: tokens stay."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name")).alias("c_name"))
    return mask.mask(mask.mask(rows, {"c_name": "name"}, "salt"), {"c_name": "name"}, "salt")


@query("d0_convert_fields", "SELECT vsn, value, CASE WHEN k IS NULL THEN NULL ELSE strftime(DATE '1970-01-01' + CAST(k AS INTEGER), '%Y-%m-%d') END AS k FROM {cdc_flat} WHERE has_k")
def d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = change_log(spark, sf_dir).where(F.map_contains_key("fields", "k"))
    made = convert.convert_fields(log, {"k": ("date", None)})
    return made.select("vsn", F.try_element_at("fields", F.lit("value")).alias("value"), F.try_element_at("fields", F.lit("k")).alias("k"))


# K and M: loads

def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(F.when(k % 19 == 0, F.concat(F.lit("x"), k)).otherwise(k.cast("string")).alias("id"), F.repeat("o_orderpriority", F.when(k % 23 == 0, 20).otherwise(1).cast("int")).alias("note"), (F.col("o_custkey") % 5).alias("file_no"))


@query("k1_stashed_rows", "SELECT o_custkey % 5 AS file_no, 'id is no bigint' AS reason, count(*) AS n_rows, sum(length('x' || CAST(o_orderkey AS STRING)) + length(o_orderpriority) * CASE WHEN o_orderkey % 23 = 0 THEN 20 ELSE 1 END) AS n_bytes FROM {orders} WHERE o_orderkey % 19 = 0 GROUP BY 1")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = load.stash(raw_orders(spark, sf_dir), load.cast_reason({"id": "bigint"}))
    return load.error_counts(bad, ["file_no", "reason"], ["id", "note"])


@query("k2_oversize_rows", "SELECT count(*) AS n_good, sum(CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END) AS n_marked FROM {orders} WHERE length(o_orderpriority) * CASE WHEN o_orderkey % 23 = 0 THEN 20 ELSE 1 END + length(CASE WHEN o_orderkey % 19 = 0 THEN 'x' ELSE '' END || CAST(o_orderkey AS STRING)) <= 60")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = load.stash(raw_orders(spark, sf_dir), load.oversize_reason(["id", "note"], 60))
    return good.agg(F.count("*").alias("n_good"), F.count_if(F.col("id").startswith("x")).alias("n_marked"))


@query("k3_batches", "SELECT true AS within_cap, count(*) AS n_rows, sum(length(CAST(l_orderkey AS STRING)) + length(CAST(l_partkey AS STRING)) + length(l_returnflag)) AS n_bytes FROM {lineitem}")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    ledger = load.write_batches(rows, new_path(spark), 5000, 40_000)
    return ledger.agg(F.bool_and((F.col("n_rows") <= 5000) & (F.col("n_bytes") <= 40_000)).alias("within_cap"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))


@query("k4_unfinished_batches", "SELECT file_path, batch_no FROM {ledger} GROUP BY 1, 2 HAVING max(CASE WHEN state = 'done' THEN 1 ELSE 0 END) = 0")
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = read(spark, sf_dir, "ledger")
    return load.unfinished(ledger.select("file_path", "batch_no").distinct(), ledger)


@query("k5_partial_recovery", "SELECT count(*) AS total, sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS ignored, sum(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END) AS inserted FROM {orders}")
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey")
    return load.recover(rows, rows.where("o_orderkey % 3 = 0"), ["o_orderkey"])


@query("m2_status_rule", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 + o_orderkey % 2 >= 6 THEN CASE WHEN o_orderkey % 2 > 0 THEN 'DONE_WITH_ERRORS' ELSE 'DONE' END WHEN o_orderkey % 7 + o_orderkey % 2 = 0 THEN 'NOT_STARTED' ELSE 'MIGRATING' END AS status FROM {orders}")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.alias("k"), load.status(k % 7, F.lit(6), k % 2).alias("status"))


@query("m3_sequences_to_restore", "SELECT DISTINCT 't' || CAST(id % 9 AS STRING) AS table_name, 's' || CAST(id % 9 AS STRING) AS sequence_name FROM {cdc_flat} WHERE id % 9 IN (2, 4, 6, 8)")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = change_log(spark, sf_dir).select("table_name").distinct()
    number = F.substring("table_name", 2, 1)
    sequences = tables.select("table_name", F.concat(F.lit("s"), number).alias("sequence_name"), F.when(number.cast("int") % 2 == 0, number.cast("long")).otherwise(0).alias("last_value"))
    return load.sequences_to_restore(sequences, tables.where("table_name <> 't0'")).select("table_name", "sequence_name")
