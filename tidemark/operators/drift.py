"""Differences between two snapshots of a schema, as findings."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

TABLE_ATTRIBUTES = {"TABLE_NAME": "table_name", "TABLE_SCHEMA": "schema_name", "TABLE_KIND": "kind", "PARTITION_PARENT": "partition_parent"}
TABLE_LISTS = {"PARTITION_CHILDREN": "partition_children", "INHERITS": "inherits_from", "INHERITED_BY": "inherited_by"}
COLUMN_ATTRIBUTES = {"COLUMN_NAME": "column_name", "COLUMN_TYPE": "data_type", "COLUMN_NULLABILITY": "not_null", "COLUMN_DEFAULT": "default_value"}


def same_list(a: Column, b: Column) -> Column:
    """Equal whatever the order; a null list is an empty one."""
    empty = F.array().cast("array<string>")
    return a.eqNullSafe(b) | (F.sort_array(F.coalesce(a, empty)) == F.sort_array(F.coalesce(b, empty)))


def match(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """on, b (before's row), a (after's row) of everything on either side: matched, dropped (a null) or added (b null)."""
    one = before.select(*on, F.struct(*before.columns).alias("b"))
    two = after.select(*on, F.struct(*after.columns).alias("a"))
    return one.join(two, on, "full")


def _findings(matched: DataFrame, keys: list[str], prefix: str, identity: Column, attributes: dict[str, str], lists: dict[str, str]) -> DataFrame:
    def finding(kind: str, when: Column, old: Column, new: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("finding"), old.cast("string").alias("old_value"), new.cast("string").alias("new_value")))

    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    none = F.lit(None).cast("string")
    rows = [(f"{prefix}_ADDED", F.col("b").isNull(), none, none), (f"{prefix}_DROPPED", F.col("a").isNull(), none, none)]
    for kind, name in attributes.items():
        rows.append((kind, both & ~F.col(f"b.{name}").eqNullSafe(F.col(f"a.{name}")), F.col(f"b.{name}"), F.col(f"a.{name}")))
    for kind, name in lists.items():
        texts = [F.array_join(F.sort_array(F.col(f"{side}.{name}")), ",") for side in ("b", "a")]
        rows.append((kind, both & ~same_list(F.col(f"b.{name}"), F.col(f"a.{name}")), *texts))
    # Most rows are as they were, and only the others are worked on further.
    some = matched.where(functools.reduce(Column.__or__, [when for _, when, _, _ in rows]))
    return some.select(*keys, identity.alias("identity"), F.explode(F.filter(F.array(*[finding(*x) for x in rows]), lambda x: x.isNotNull())).alias("x")).select(*keys, "identity", "x.*")


def drift(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], by_id: bool) -> DataFrame:
    """identity, finding, old_value, new_value, sorted by identity and finding. Each side is its tables and its columns
    (table_id and column_id besides names). Objects are matched by stable ids (the same engine on both sides), so that renamed
    ones are found, or by names."""
    name = F.concat_ws(".", F.coalesce("b.schema_name", "a.schema_name"), F.coalesce("b.table_name", "a.table_name"))
    # The joins sort by these, in which the first eight bytes of the first one decide cheaply.
    keys = ["table_id"] if by_id else ["table_name", "schema_name"]
    tables = match(before[0], after[0], keys)
    columns = match(before[1], after[1], [*keys, "column_id" if by_id else "column_name"])
    # Columns of added and dropped tables aren't findings of their own.
    kept = tables.where("a IS NOT NULL AND b IS NOT NULL").select(*keys)
    column_name = F.concat_ws(".", name, F.coalesce("b.column_name", "a.column_name"))
    of_columns = _findings(columns, keys, "COLUMN", column_name, COLUMN_ATTRIBUTES, {}).join(kept, keys, "left_semi")
    found = _findings(tables, keys, "TABLE", name, TABLE_ATTRIBUTES, TABLE_LISTS).unionByName(of_columns).drop(*keys)
    return cut(found).orderBy("identity", "finding")  # sorting takes a sample first, which would work it all out twice


def filter_findings(findings: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Findings of the included tables (schema.table; all if None) that aren't excluded, of chosen kinds of object (TABLE, COLUMN)."""
    table = F.substring_index("identity", ".", 2)
    out = findings
    if include is not None:
        out = out.where(table.isin(include))
    if exclude:
        out = out.where(~table.isin(exclude))
    if kinds is not None:
        out = out.where(F.when(F.size(F.split("identity", "\\.")) > 2, "COLUMN").otherwise("TABLE").isin(kinds))
    return out
