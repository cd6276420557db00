"""Readers of table dumps: delimited files, COPY text, SQL dumps, tables of a database; and the manifest that names them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quoted import quoted_records

END = "\\."
CORRUPT = "_corrupt_record"


def read_csv_dump(spark: SparkSession, paths: str | list[str], schema: T.StructType, sep: str = ",", header: bool = False, quote: str = '"', escape: str = '"', null: str = "", multiline: bool = False) -> DataFrame:
    """Delimited files; blank lines and the end mark are skipped. A line that doesn't fit the schema keeps its text in
    _corrupt_record. multiline: line breaks may stand within quotes; such files are split like others (quoted_records()). The
    same character can't be both delimiter and quote or escape: Spark's reader would read such files otherwise than they were
    meant."""
    if sep in (quote, escape):
        raise ValueError("the delimiter can be neither the quote nor the escape character")
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"sep": sep, "quote": quote, "escape": escape, "nullValue": null, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if multiline:
        records = quoted_records(spark, paths, quote, escape, header)
        read = records.select(F.from_csv("record", wide.simpleString(), options | {"multiLine": "true"}).alias("x")).select("x.*")
    else:
        read = spark.read.schema(wide).options(**options, header=header).csv(paths)
    return read.where(~F.coalesce(F.col(CORRUPT) == END, F.lit(False)) & ~F.coalesce(F.col(schema.fields[0].name).cast("string") == END, F.lit(False)))


def unescape(x: Column) -> Column:
    """The text of a COPY value: backslash sequences as what they stand for, octal (\\101) and hexadecimal (\\x41) ones of
    single-byte characters too; a backslash before anything else goes; \\N is null. Doubled backslashes part the text first,
    so that what follows one isn't taken for a sequence."""

    def one(part: Column) -> Column:
        # What stands before the first single backslash is plain; each further piece begins with a sequence.
        pieces = F.split(part, r"\\", -1)

        def piece(y: Column, k: Column) -> Column:
            octal, code = F.regexp_extract(y, "^([0-7]{1,3})", 1), F.regexp_extract(y, "^x([0-9A-Fa-f]{1,2})", 1)
            rest = lambda n: F.substring(y, n + 1, F.length(y))
            short = F.lit(None).cast("string")
            for mark, meant in (("t", "\t"), ("n", "\n"), ("r", "\r"), ("b", "\b"), ("f", "\f"), ("v", "\v")):
                short = F.when(F.substring(y, 1, 1) == mark, meant).otherwise(short)
            made = F.when(octal != "", F.concat(F.char(F.conv(octal, 8, 10).cast("int")), rest(F.length(octal)))).when(code != "", F.concat(F.char(F.conv(code, 16, 10).cast("int")), rest(F.length(code) + 1)))
            made = made.when(short.isNotNull(), F.concat(short, rest(F.lit(1)))).otherwise(y)
            return F.when(k == 0, y).otherwise(made)

        return F.array_join(F.transform(pieces, piece), "")

    return F.when(x != "\\N", F.when(~x.contains("\\"), x).otherwise(F.array_join(F.transform(F.split(x, r"\\\\", -1), one), "\\")))


def parse_copy_line(line: Column, schema: T.StructType, sep: str = "\t") -> list[Column]:
    parts = F.split(line, f"(?<=(?<!\\\\)(?:\\\\\\\\){{0,9}}){sep}" if sep != "\t" else "\t", -1)
    return [unescape(F.get(parts, F.lit(k))).try_cast(x.dataType).alias(x.name) for k, x in enumerate(schema.fields)]


def read_text_dump(spark: SparkSession, paths: str | list[str], schema: T.StructType, sep: str = "\t") -> DataFrame:
    """COPY text files: tab between values, \\N for null, \\. at the end."""
    return spark.read.text(paths).where((F.col("value") != END) & (F.col("value") != "")).select(*parse_copy_line(F.col("value"), schema, sep))


COPY = r"(?i)^COPY\s+(\S+)\s*(?:\(.*\))?\s+FROM\s+STDIN"


def read_sql_dump(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """table_name, line of the data lines of SQL dumps, those between COPY ... FROM STDIN and the end mark. Within a split
    the last marker before a line is found by a window; for the lines before its first marker the last one of the splits
    before it counts, of which there is a row each."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", F.monotonically_increasing_id())
    named = F.regexp_extract("value", COPY, 1)
    marked = lines.withColumn("marker", F.when(named != "", named).when(F.col("value") == END, ""))
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    within = marked.withColumn("own", F.last("marker", True).over(inside))
    ends = marked.groupBy("file", "block").agg(F.max_by("marker", F.when(F.col("marker").isNotNull(), F.col("at"))).alias("end"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("file", "block", F.last("end", True).over(before).alias("carried"))
    placed = within.join(carried, ["file", "block"]).withColumn("table_name", F.coalesce("own", "carried"))
    return placed.where(F.col("marker").isNull() & (F.coalesce("table_name", F.lit("")) != "")).select("table_name", F.col("value").alias("line"))


def list_inputs(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, n_bytes of the files under a folder of any store that Spark reads; contents aren't."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("n_bytes"))


def load_manifest(spark: SparkSession, manifest: list[dict]) -> dict[str, DataFrame]:
    """By table the union of its files. Each entry: table, path, schema, format (csv, text or parquet) and options; one
    file may stand for several tables."""
    readers = {"csv": read_csv_dump, "text": read_text_dump, "parquet": lambda spark, path, schema: spark.read.schema(schema).parquet(path)}
    found: dict[str, list[DataFrame]] = {}
    for x in manifest:
        found.setdefault(x["table"], []).append(readers[x["format"]](spark, x["path"], x["schema"], **x.get("options", {})))
    return {table: reduce(DataFrame.unionByName, parts) for table, parts in found.items()}


def read_jdbc_table(spark: SparkSession, url: str, table: str, columns: list[str], split_by: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A table of a database, read by ranges of a column; only the named columns leave the server."""
    names = ", ".join(columns)
    given = {"url": url, "dbtable": f"(SELECT {names} FROM {table}) t", "partitionColumn": split_by, "lowerBound": lower, "upperBound": upper, "numPartitions": partitions, **options}
    return spark.read.format("jdbc").options(**given).load()


def write_snapshot(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A folder for each table_name."""
    df.write.partitionBy("table_name").format(form).save(path)
