"""Profiles that are kept as sketches of each part of a table and merged, so that new parts alone are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values that a part's sketch follows; counts of a column with no more different values than about three quarters of it are exact.
TRACKED = 10_000


def _name(x: str) -> str:
    return "`" + x.replace("`", "``") + "`"


def sketch(df: DataFrame, columns: list[str], part: str, tracked: int = TRACKED) -> DataFrame:
    """part, column_name, n_rows, nulls, distinct and frequent (mergeable sketches of the values as text): a row for each column
    and each value of the column part (null is one). One aggregate over df, combined before the shuffle; a state takes at most
    some hundred kilobytes, however many rows it stands for."""
    def of(x: str) -> list:
        value = f"CAST({_name(x)} AS STRING)"
        frequent = F.expr(f"approx_top_k_accumulate({value}, {tracked}) FILTER (WHERE {_name(x)} IS NOT NULL)")
        return [F.lit(x).alias("column_name"), F.count("*").alias("n_rows"), F.count_if(F.expr(f"{_name(x)} IS NULL")).alias("nulls"), F.hll_sketch_agg(F.expr(value), F.lit(12)).alias("distinct"), frequent.alias("frequent")]

    summed = df.groupBy(F.expr(_name(part)).alias("part")).agg(F.array(*[F.struct(*of(x)) for x in columns]).alias("__columns"))
    return summed.select("part", F.inline("__columns"))


def merged_profile(sketches: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """column_name, n_rows, null_frac, n_distinct (within about 3 %), top_value and top_freq, as profile() has them, from sketches of
    parts, which any number of rows may bring. A count of a value is at most 3.5 / (the power of two from tracked upwards) of the
    rows above the right one; where no more different values are there than are followed, it is right."""
    frequent = F.expr(f"approx_top_k_combine(frequent, {tracked})")
    sums = sketches.groupBy("column_name").agg(F.sum("n_rows").alias("n_rows"), F.sum("nulls").alias("nulls"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"), frequent.alias("__frequent"))
    top = F.array_min(F.transform(F.expr("approx_top_k_estimate(__frequent, 100)"), lambda x: F.struct((-x["count"]).alias("minus"), x["item"].alias("value"))))
    found = sums.withColumn("__top", top)
    return found.select("column_name", "n_rows", (F.col("nulls") / F.col("n_rows")).alias("null_frac"), "n_distinct", F.col("__top.value").alias("top_value"), (-F.col("__top.minus") / F.col("n_rows")).alias("top_freq"))


class StoredProfile:
    """Sketches of a table's parts in a folder, one folder for each part. add() reads those parts of the table that aren't there;
    parts never change once they are added, but replace() sketches some anew. part names a column of few values, that the table is
    partitioned by where it is large, so that parts which are known aren't read."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], part: str, tracked: int = TRACKED) -> None:
        self.spark, self.path, self.columns, self.part, self.tracked = spark, path, columns, part, tracked

    def _exists(self) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def known(self) -> list[str | None]:
        """The parts that are there, as text: as many as the table has, not rows."""
        return [r.part for r in self.read().select("part").distinct().collect()] if self._exists() else []

    def read(self) -> DataFrame:
        none = self.spark.range(0).select(*[F.lit(None).cast("string").alias(x) for x in dict.fromkeys([*self.columns, self.part])])
        return self.spark.read.schema(self._sketched(none).schema).parquet(self.path)

    def _sketched(self, df: DataFrame) -> DataFrame:
        return sketch(df, self.columns, self.part, self.tracked).withColumn("part", F.col("part").cast("string"))

    def _write(self, df: DataFrame) -> None:
        place = F.coalesce(F.concat(F.lit("="), "part"), F.lit("null"))
        self._sketched(df).withColumn("place", place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("place").parquet(self.path)

    def add(self, df: DataFrame) -> None:
        known = self.known()
        column = F.expr(_name(self.part))
        new = df
        if texts := [x for x in known if x is not None]:
            new = new.where(column.isNull() | ~column.cast("string").isin(texts))
        if None in known:
            new = new.where(column.isNotNull())
        self._write(new)

    def replace(self, df: DataFrame) -> None:
        """Takes the parts that are in df as df has them."""
        self._write(df)

    def profile(self) -> DataFrame:
        return merged_profile(self.read(), self.tracked)
