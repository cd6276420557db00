"""Query statistics as they come, and reports as they go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Old and new names of a statistic's fields.
FIELDS = {
    "queryid": ["queryid"], "query": ["query"], "calls": ["calls"], "row_count": ["rows", "row_count"], "total": ["total_exec_time", "total_time", "total"],
    "mean": ["mean_exec_time", "mean_time"], "least": ["min_exec_time", "min_time", "least"], "most": ["max_exec_time", "max_time", "most"],
}
WHOLE = ("queryid", "calls", "row_count")


def parse_query_stats(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statistics from rows with any of the fields' names, or with a JSON object of them in a column named json; and rows
    without a whole queryid, without a query or with no calls above 0, with reason. Missing times are 0; source_node, a column
    beside either form, is primary where it is missing or blank."""
    node = F.trim("source_node") if "source_node" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("__node", F.coalesce(F.nullif(node, F.lit("")), F.lit("primary")))
    if "json" in df.columns:
        df = df.select("__node", F.from_json("json", "map<string,string>").alias("m"))
        get = {x: F.coalesce(*[F.try_element_at("m", F.lit(n)) for n in names]) for x, names in FIELDS.items()}
    else:
        get = {x: F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns] or [F.lit(None).cast("string")], F.lit(None).cast("string")) for x, names in FIELDS.items()}
    cast = {x: F.trim(get[x]) if x == "query" else get[x].try_cast("bigint") if x in WHOLE else F.coalesce(get[x].try_cast("double"), F.lit(0.0)) for x in FIELDS}
    read = df.select(*[cast[x].alias(x) for x in FIELDS], F.col("__node").alias("source_node"))
    calls, query = F.coalesce(F.col("calls") > 0, F.lit(False)), F.coalesce(F.col("query") != "", F.lit(False))
    reason = F.when(F.col("queryid").isNull(), "no queryid").when(~query, "no query").when(~calls, "no calls")
    return read.where(reason.isNull()), read.where(reason.isNotNull()).withColumn("reason", reason)


def write_report(df: DataFrame, path: str) -> None:
    """One small result as one JSON file."""
    df.coalesce(1).write.json(path)
