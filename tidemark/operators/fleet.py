"""Analytics over the catalogs of many databases at once; every table has a db_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .lookups import as_array, ceiling, initial_and_final, nearest, prefix_holds_set, with_lookup
from .stats import best, fits_within, rates

OBJECT = ["db_id", "schema_name", "object_name"]


def index_stats(objects: DataFrame, measured: DataFrame, sizes: DataFrame, counts: DataFrame, seconds: int, partitioned: DataFrame) -> DataFrame:
    """Each object with size, row count and rates of reads and writes; partitioned parents (db_id, schema_name, object_name) are left out."""
    paired = initial_and_final(measured, [*OBJECT, "source_node"], ["seq_reads", "row_writes"])
    found = objects.join(partitioned, OBJECT, "left_anti").join(sizes, OBJECT, "left").join(counts, OBJECT, "left").join(rates(paired, OBJECT, seconds), OBJECT, "left")
    return found.fillna(0, ["reads_per_second", "writes_per_second"])


def redundant_indexes(indexes: DataFrame) -> DataFrame:
    """db_id, schema_name, table_name, redundant, existing: indexes that another of the same table and access method makes
    needless. indexes: db_id, schema_name, table_name, index_name, method, columns (its keys in order), options (class,
    collation and order of each key), included (columns kept beside the keys), predicate (null: none), is_unique,
    nulls_not_distinct, is_constraint.

    The own keys begin the other's, with equal options, and what is left of the other's keys and its included columns holds
    the own included ones. Partial indexes take no part. An index behind a constraint never goes; a unique one only for a
    unique one of equal keys that admits no more nulls. Of two that are equal in all this the one of the larger name goes.
    No pairs of a table's indexes are formed. nulls_not_distinct means nothing for an index that isn't unique. Of several existing ones the smallest name is given."""
    keys = ["db_id", "schema_name", "table_name"]
    facts = {"columns": F.col("columns"), "options": F.col("options"), "beside": F.array_sort(F.array_distinct("included")), "unique": F.col("is_unique"), "strict": F.col("is_unique") & F.col("nulls_not_distinct")}
    whole = indexes.where("predicate IS NULL").select(*keys, "method", "index_name", "is_constraint", *[x.alias(name) for name, x in facts.items()])
    # Equal indexes are one kind, known by its smallest name. A kind says its beginnings, and kinds meet those by equality.
    kinds = cut(whole.withColumn("kind", F.min("index_name").over(Window.partitionBy(*keys, "method", *facts))))
    own = kinds.where(F.col("index_name") == F.col("kind")).drop("index_name", "is_constraint")
    lengths = F.sequence(F.lit(1), F.size("columns"))
    begun = own.where(F.size("columns") > 0).withColumn("__n", F.explode(lengths)).select(
        *keys, "method", F.slice("columns", F.lit(1), F.col("__n")).alias("columns"), F.slice("options", F.lit(1), F.col("__n")).alias("options"), F.col("kind").alias("existing"),
        F.concat(F.slice("columns", F.col("__n") + 1, F.size("columns")), "beside").alias("__rest"), (F.size("columns") == F.col("__n")).alias("__whole"), F.col("unique").alias("__unique"), F.col("strict").alias("__strict"),
    )
    held = F.size(F.array_except("beside", "__rest")) == 0
    as_strong = ~F.col("unique") | (F.col("__unique") & F.col("__whole") & (~F.col("strict") | F.col("__strict")))
    better = own.join(begun, [*keys, "method", "columns", "options"]).where((F.col("kind") != F.col("existing")) & held & as_strong)
    beyond = better.groupBy(*keys, "kind").agg(F.min("existing").alias("__beyond"))
    found = kinds.where("NOT is_constraint").select(*keys, "index_name", "kind").join(beyond, [*keys, "kind"], "left")
    existing = F.least("__beyond", F.when(F.col("kind") < F.col("index_name"), F.col("kind")))  # least() passes over nulls
    return found.select(*keys, F.col("index_name").alias("redundant"), existing.alias("existing")).where("existing IS NOT NULL")


def resolve(pairs: DataFrame, keys: list[str], name: str = "redundant", onward: str = "existing") -> DataFrame:
    """pairs with chains followed to their end (a for b, b for c: a for c), by doubling pointers: rounds grow with the
    logarithm of the longest chain. A circle raises: after a round for each doubling up to the number of pairs, a chain
    that isn't at its end has none."""
    now = pairs
    for _ in range(max(1, pairs.count()).bit_length() + 1):
        step = now.select(*keys, F.col(name).alias(onward), F.col(onward).alias("__further"))
        moved = cut(now.join(step, [*keys, onward], "left").select(*keys, name, F.coalesce("__further", onward).alias(onward), F.col("__further").isNotNull().alias("__moved")))
        now = moved.drop("__moved")
        if moved.where("__moved").isEmpty():
            return now
    raise ValueError("the pairs form a circle")


def missing_fk_indexes(fks: DataFrame, indexes: DataFrame) -> DataFrame:
    """Foreign keys (db_id, schema_name, table_name, fk_name, columns) whose columns no index (columns; no expressions among
    them) begins with, in any order."""
    keys = ["db_id", "schema_name", "table_name"]
    own = indexes.select(*[F.col(x).alias(f"i_{x}") for x in keys], F.col("columns").alias("i_columns"))
    same = prefix_holds_set(F.col("columns"), F.col("i_columns"))
    for x in keys:
        same = same & (F.col(x) == F.col(f"i_{x}"))
    return fks.join(own, same, "left_anti")


def pk_recommendations(tables: DataFrame, uniques: DataFrame, columns: DataFrame) -> DataFrame:
    """db_id, table_name, index_name: unique indexes (columns) that could be a table's primary key: all their columns are not null,
    and the partition columns of all levels below the table are among them. tables: db_id, table_name, has_pk, is_inherited,
    parent (the table that it is a partition of, or null), partition_columns. Only tables that are no partitions themselves and
    don't inherit are given, none if any table of the hierarchy has a primary key, nor a table with partitions that names no
    partition columns. A circle of parents raises. columns: db_id, table_name, column_name, not_null; nulls count as false."""
    keys = ["db_id", "table_name"]
    up = tables.where("parent IS NOT NULL").select("db_id", F.col("table_name").alias("redundant"), F.col("parent").alias("existing"))
    roots = resolve(up, ["db_id"]).select("db_id", F.col("redundant").alias("table_name"), F.col("existing").alias("root"))
    each = tables.join(roots, keys, "left").withColumn("root", F.coalesce("root", "table_name"))
    own = F.col("table_name") == F.col("root")
    columns_of = F.flatten(F.collect_set(F.coalesce("partition_columns", F.array().cast("array<string>"))))
    trees = each.groupBy("db_id", F.col("root").alias("table_name")).agg(
        F.bool_or(F.coalesce("has_pk", F.lit(False))).alias("__pk"), columns_of.alias("__columns"), F.count("*").alias("__n"), F.bool_or(own & F.coalesce("is_inherited", F.lit(False))).alias("__inherits"),
        F.max(F.when(own, F.coalesce(F.size("partition_columns"), F.lit(0)))).alias("__own"),
    )
    bare = trees.where("NOT __pk AND NOT __inherits AND (__n = 1 OR __own > 0)")
    not_null = columns.where("not_null").groupBy(*keys).agg(F.collect_set("column_name").alias("solid"))
    joined = bare.join(uniques, keys).join(not_null, keys)
    solid = F.size(F.array_except("columns", "solid")) == 0
    parts = F.size(F.array_except("__columns", "columns")) == 0
    return joined.where(solid & parts).select(*keys, "index_name")


def fk_type_mismatches(fk_columns: DataFrame, columns: DataFrame) -> DataFrame:
    """Foreign-key columns (db_id, table_name, column_name, ref_table, ref_column) whose type isn't the referenced one's."""
    own = columns.select("db_id", "table_name", "column_name", F.col("data_type").alias("own_type"))
    ref = columns.select("db_id", F.col("table_name").alias("ref_table"), F.col("column_name").alias("ref_column"), F.col("data_type").alias("ref_type"))
    return fk_columns.join(own, ["db_id", "table_name", "column_name"]).join(ref, ["db_id", "ref_table", "ref_column"]).where("own_type <> ref_type")


def hotspots(index_columns: DataFrame) -> DataFrame:
    """Indexes that lead with a timestamp or date: new rows all go to one end."""
    kind = F.regexp_replace(F.lower("data_type"), r"\s*\(\d+\)", "")
    return index_columns.where((F.col("position") == 1) & kind.rlike("^(date|timestamptz|timestamp( with(out)? time zone)?)$")).select("db_id", "table_name", "index_name")


#: Fixed value: indexes from which an object is sharded whatever its size.
MOST_INDEXES = 2


def place(objects: DataFrame, limits: DataFrame) -> DataFrame:
    """Each object and core count with placement, colocated or sharded. objects: db_id, schema_name, object_name, size_gb, reads,
    writes, and of its indexes n_indexes, index_gb, index_reads, index_writes (nulls count as 0). limits: cores, most_gb,
    most_objects, reads_per_core, writes_per_core; a few rows. The objects that are smallest by themselves come first, while
    the size and number of objects with their indexes, and then the cores that their reads and writes need, stay within the
    limits. Objects of more than MOST_INDEXES indexes are sharded and count nowhere."""
    return with_placement(objects, limits).select("db_id", "cores", "schema_name", "object_name", "placement")


def with_placement(objects: DataFrame, limits: DataFrame, *kept: str) -> DataFrame:
    """place()'s rows with n_indexes; gb, reads and writes of the object and its indexes; the kept columns of objects and all
    columns of limits. They lie by db_id and cores."""
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    whole = objects.select(
        *OBJECT, *kept, zero("size_gb").alias("size_gb"), zero("n_indexes").alias("n_indexes"), (zero("size_gb") + zero("index_gb")).alias("gb"),
        (zero("reads") + zero("index_reads")).alias("reads"), (zero("writes") + zero("index_writes")).alias("writes"),
    )
    beside = with_lookup(whole, as_array(limits.withColumn("limit", F.struct(*limits.columns)), "cores", "limit", "__limits"))
    own = beside.select(*whole.columns, F.explode("__limits.value").alias("__limit")).select(*whole.columns, "__limit.*")
    few = F.col("n_indexes") <= MOST_INDEXES
    keys, order = ["db_id", "cores"], ["size_gb", "schema_name", "object_name"]
    counted = own.withColumns({"__gb": F.when(few, F.col("gb")), "__n": F.when(few, F.col("n_indexes") + 1)})
    sized = fits_within(counted, keys, order, {"__gb": F.col("most_gb"), "__n": F.col("most_objects")}).withColumn("__taken", few & F.col("fits"))
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda x: F.sum(F.when(F.col("__taken"), F.col(x))).over(frame)
    need = F.ceil(so_far("reads") / F.col("reads_per_core") + so_far("writes") / F.col("writes_per_core"))
    placed = sized.withColumn("placement", F.when(F.col("__taken") & (need <= F.col("cores")), "colocated").otherwise("sharded"))
    return placed.drop("size_gb", "fits", "__gb", "__n", "__taken")


def nodes_needed(sharded: DataFrame, limits: DataFrame, keys: tuple[str, ...] = ("db_id", "cores")) -> DataFrame:
    """keys, nodes, cores_needed: what the sharded objects' reads and writes need, one node more if any object is colocated, 3 at
    least. sharded: keys (cores among them), reads, writes, n_colocated (sums)."""
    nodes, cores = nodes_for_work(F.col("reads"), F.col("writes"), F.col("n_colocated"))
    return sharded.join(F.broadcast(limits), "cores").select(*keys, nodes.alias("nodes"), cores.alias("cores_needed"))


def nodes_for_work(reads: Column, writes: Column, n_colocated: Column) -> tuple[Column, Column]:
    """nodes_needed()'s nodes and cores_needed."""
    work = F.ceil(reads / F.col("reads_per_core") + writes / F.col("writes_per_core"))
    shared = (n_colocated > 0).cast("int")
    nodes = F.greatest(F.ceil(work / F.col("cores")) + shared, F.lit(3)).cast("long")
    return nodes, F.greatest(work + shared * F.col("cores"), 3 * F.col("cores")).cast("long")


#: Sizes of a tablet (GB) in the three phases, and tablets a node that end the first two; tablets of a table at most.
LOW_GB, HIGH_GB, FINAL_GB = 0.512, 10, 100
LOW_TABLETS, HIGH_TABLETS, MOST_TABLETS = 1, 24, 256


def tablets(size_gb: Column, nodes: Column) -> Column:
    """Tablets of a table or index of that size over so many nodes: none if it is empty. In each phase first the tablets grow to the
    phase's size, then their number grows, up to what the phase allows for each node."""
    low, high, most = LOW_TABLETS * nodes, HIGH_TABLETS * nodes, MOST_TABLETS * nodes
    small = F.ceil(size_gb / LOW_GB)
    more = F.ceil(low + (size_gb - low * HIGH_GB) / HIGH_GB)
    last = F.ceil(high + (size_gb - high * FINAL_GB) / FINAL_GB)
    beyond = F.ceil(MOST_TABLETS + (size_gb - most * FINAL_GB) / FINAL_GB)
    return (
        F.when(small <= low, small).when(size_gb / low <= HIGH_GB, low).when(more <= high, more)
        .when(size_gb / HIGH_TABLETS <= FINAL_GB, high).when(last <= most, last).otherwise(beyond)
    ).cast("long")


def all_tablets(sizes: str, nodes: Column) -> Column:
    """The sum of tablets() of an array of sizes; nulls count as 0."""
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda total, gb: total + tablets(F.coalesce(gb, F.lit(0.0)), nodes))


def nodes_with_tablets(sharded: DataFrame, nodes: DataFrame, limits: DataFrame, keys: tuple[str, ...] = ("db_id", "cores")) -> DataFrame:
    """keys, tablets, nodes: the nodes that hold the tablets of all sharded tables and indexes, or that the work needs if those are
    more. sharded: keys (cores among them), size_gb, a row for each table and each index; nodes: keys, nodes that the work needs;
    limits: cores, most_tablets."""
    zero = F.coalesce(F.col("size_gb"), F.lit(0)).cast("double")
    counted = sharded.join(nodes, list(keys)).groupBy(*keys).agg(F.sum(tablets(zero, F.col("nodes"))).alias("tablets"))
    joined = nodes.join(counted, list(keys), "left").join(F.broadcast(limits), "cores")
    held = F.coalesce("tablets", F.lit(0).cast("long"))
    return joined.select(*keys, held.alias("tablets"), F.greatest("nodes", nodes_for_tablets(held, F.col("most_tablets"))).alias("nodes"))


def nodes_for_tablets(total: Column, limit: Column) -> Column:
    """Nodes for that many tablets, each on three nodes, with room for twice as many."""
    return F.ceil(total * 6 / limit).cast("long")


def object_limit(objects: DataFrame, limit: int) -> DataFrame:
    """db_id, n_objects, ok, reason."""
    counts = objects.groupBy("db_id").agg(F.count("*").alias("n_objects"))
    reason = F.when(F.col("n_objects") > limit, F.format_string(f"%d objects are more than {limit}", F.col("n_objects")))
    return counts.select("db_id", "n_objects", (F.col("n_objects") <= limit).alias("ok"), reason.alias("reason"))


def import_minutes(objects: DataFrame, loads: DataFrame, index_factors: DataFrame, column_factors: DataFrame, throughputs: DataFrame) -> DataFrame:
    """db_id, placement, minutes: how long the objects of each class (colocated, sharded) take to import, in whole minutes.
    objects: db_id, placement, nodes, size_gb, row_count, n_indexes, n_columns. Measured, each for a placement: loads
    (placement, gb, rows, seconds), index_factors and column_factors (placement, n, factor); and throughputs (nodes, mbps).

    An object takes the longer of two times, from the load nearest in size and from the one nearest in rows, each scaled to its
    own and rounded up to seconds; times the factor of the nearest number of indexes, scaled to its own (none: 1); times that
    of the smallest number of columns that isn't below its own (else of the largest), scaled up where its own is above. The
    sharded ones' sum is divided by how much faster that many nodes are than three, by the throughput a node of the nearest
    number. Of equally near ones the smaller counts."""
    classes = ("colocated", "sharded")
    found = objects
    measured = ((loads, "gb", F.struct("gb", "seconds"), "size"), (loads, "rows", F.struct("rows", "seconds"), "rows"), (index_factors, "n", F.struct("n", "factor"), "index"), (column_factors, "n", F.struct("n", "factor"), "column"))
    for table, key, value, name in measured:
        for kind in classes:
            found = with_lookup(found, as_array(table.where(F.col("placement") == kind).withColumn("__value", value), key, "__value", f"__{name}_{kind}"))
    found = with_lookup(found, as_array(throughputs, "nodes", "mbps", "__mbps"))

    def of_class(name: str) -> Column:
        return F.when(F.col("placement") == classes[0], F.col(f"__{name}_{classes[0]}")).otherwise(F.col(f"__{name}_{classes[1]}"))

    found = found.withColumns({"__size": of_class("size"), "__rows": of_class("rows"), "__index": of_class("index"), "__column": of_class("column")})
    found = found.withColumns({"__size": nearest("__size", F.col("size_gb")), "__rows": nearest("__rows", F.col("row_count")), "__index": nearest("__index", F.col("n_indexes")), "__column": ceiling("__column", F.col("n_columns"))})
    seconds = F.ceil(F.greatest(F.col("size_gb") * F.col("__size.seconds") / F.col("__size.gb"), F.col("row_count") * F.col("__rows.seconds") / F.col("__rows.rows")))
    by_indexes = F.when(F.col("n_indexes") == 0, 1.0).otherwise(F.col("n_indexes") * F.col("__index.factor") / F.col("__index.n"))
    by_columns = F.greatest(F.col("__column.factor"), F.col("n_columns") * F.col("__column.factor") / F.col("__column.n"))
    near = F.array_min(F.transform("__mbps", lambda x: F.struct(F.abs(x["key"] - F.col("nodes")), x["key"].alias("nodes"), x["value"].alias("mbps"))))
    three = F.element_at(F.filter("__mbps", lambda x: x["key"] == 3), 1)["value"]
    faster = F.when((F.col("placement") == classes[0]) | (F.col("nodes") == 3), 1.0).otherwise(F.coalesce(F.col("nodes") * near["mbps"] / near["nodes"] / three, F.lit(1.0)))
    timed = found.withColumns({"__seconds": seconds * by_indexes * by_columns, "__faster": faster})
    return timed.groupBy("db_id", "placement").agg(F.ceil(F.round(F.sum("__seconds") / 60 / F.max("__faster"), 6)).cast("long").alias("minutes"))


#: Fixed value: what is said of a database that no plan fits.
NO_PLAN = "no instance type fits"


def plans(placed: DataFrame, objects: DataFrame, indexes: DataFrame, limits: DataFrame) -> DataFrame:
    """db_id, strategy, cores, nodes, cores_needed, failure and sums for the reason: each database by each strategy on each
    instance type. Strategies: mixed, as placed, and sharded, where nothing is colocated. placed: db_id, cores, schema_name,
    object_name, placement; objects: as for place(); indexes: db_id, schema_name, object_name (their table), size_gb; limits: as
    for place(), and most_tablets, most_sharded: the sharded tables and indexes that the type can hold. failure is null where
    they are no more than that; other plans hold no tablets."""
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    facts = objects.select(
        *OBJECT, F.col("size_gb").cast("double").alias("__own"), zero("n_indexes").alias("n_indexes"), (zero("size_gb") + zero("index_gb")).alias("gb"),
        (zero("reads") + zero("index_reads")).alias("reads"), (zero("writes") + zero("index_writes")).alias("writes"),
    )
    beside = indexes.groupBy(*OBJECT).agg(F.collect_list(F.col("size_gb").cast("double")).alias("__beside"))
    sizes = F.concat(F.array("__own"), F.coalesce("__beside", F.array().cast("array<double>")))
    sized = facts.join(beside, OBJECT, "left").withColumn("sizes", sizes).drop("__own", "__beside")
    return plans_of(placed.select(*OBJECT, "cores", "placement").join(sized, OBJECT).join(F.broadcast(limits), "cores"))


def plans_of(placed: DataFrame) -> DataFrame:
    """plans() of with_placement()'s rows, which have sizes too: an array (GB, double; null counts as 0) of the table's size and
    those of its indexes; among the limits are most_tablets and most_sharded. Where the rows lie by db_id and cores, they are
    gone through once: what a database holds stands beside each object, which adds its tablets by both strategies."""
    names = ["n", "n_indexes", "gb", "reads", "writes"]
    kept, strategies = F.col("placement") == "colocated", ("mixed", "sharded")
    of_all = ["db_id", "cores", "reads_per_core", "writes_per_core", "most_tablets", "most_sharded"]
    held = Window.partitionBy("db_id", "cores")
    sums = {f"{x}_{side}": F.sum(F.when(of, F.col(x)).otherwise(0)) for side, of in (("colocated", kept), ("sharded", ~kept)) for x in names}
    seen = placed.withColumn("n", F.lit(1)).select(*of_all, "placement", "sizes", "gb", *[x.over(held).alias(name) for name, x in sums.items() if not name.startswith("gb")])

    def of_strategy(strategy: str) -> dict[str, Column]:
        """The sums by a strategy: where all is sharded, that side holds both."""
        if strategy == "mixed":
            return {name: F.col(name) for name in sums}
        return {f"{x}_colocated": F.lit(0) for x in names} | {f"{x}_sharded": F.col(f"{x}_colocated") + F.col(f"{x}_sharded") for x in names}

    def number(own: dict[str, Column]) -> Column:
        return own["n_sharded"] + own["n_indexes_sharded"]

    def work(own: dict[str, Column]) -> tuple[Column, Column]:
        return nodes_for_work(own["reads_sharded"], own["writes_sharded"], own["n_colocated"])

    needed = {f"__{x}": F.when((number(of_strategy(x)) <= F.col("most_sharded")) & (F.lit(x == "sharded") | ~kept), work(of_strategy(x))[0]) for x in strategies}
    counts = {f"__tablets_{x}": F.when(F.col(f"__{x}").isNotNull(), all_tablets("sizes", F.col(f"__{x}"))).otherwise(0) for x in strategies}
    summed = seen.withColumns(needed).withColumns(counts).groupBy(*of_all).agg(*[(x if name.startswith("gb") else F.max(name)).alias(name) for name, x in sums.items()], *[F.sum(x).alias(x) for x in counts])

    keys = ["db_id", "strategy", "cores"]
    both = F.array(*[F.struct(F.lit(x).alias("strategy"), *[y.alias(name) for name, y in of_strategy(x).items()], F.col(f"__tablets_{x}").alias("tablets")) for x in strategies])
    found = summed.select(*of_all, F.inline(both))
    own = {name: F.col(name) for name in sums}
    failure = F.when(number(own) > F.col("most_sharded"), F.format_string("%d sharded tables and indexes are more than %d", number(own), F.col("most_sharded")))
    nodes, cores = work(own)
    judged = found.withColumns({"failure": failure, "__nodes": nodes, "__cores": cores, "__more": nodes_for_tablets(F.col("tablets"), F.col("most_tablets"))})
    cores = F.when(F.col("__more") > F.col("__nodes"), F.col("__more") * F.col("cores")).otherwise(F.col("__cores"))
    return judged.select(*keys, *sums, "failure", F.greatest("__nodes", "__more").alias("nodes"), cores.alias("cores_needed"), "tablets")


def best_by_strategy(plans: DataFrame) -> DataFrame:
    """Of each db_id's and strategy's plans that don't fail the one that needs fewest cores, then of the larger type; if all
    fail the largest type's, with failure NO_PLAN."""
    fails = F.col("failure").isNotNull()
    chosen = best(plans, ["db_id", "strategy"], fails, F.when(~fails, F.col("cores_needed")), F.desc("cores"))
    return chosen.withColumn("failure", F.when(fails, NO_PLAN))


def choose_strategy(chosen: DataFrame) -> DataFrame:
    """Of best_by_strategy()'s plans one for each db_id, with why: one that fits before one that doesn't; fewer cores in all
    nodes, then the larger type, then sharded. Where neither fits, mixed."""
    fits = F.col("failure").isNull()
    total, sharded = F.col("cores") * F.col("nodes"), F.col("strategy") == "sharded"
    both = Window.partitionBy("db_id")  # two rows
    seen = chosen.withColumns({"total_cores": total, "__fit": F.count_if(fits).over(both), "__types": F.size(F.collect_set("cores").over(both)), "__other": F.sum(total).over(both) - total})
    one = best(seen, ["db_id"], ~fits, F.when(fits, F.col("total_cores")), F.when(fits, -F.col("cores")), F.when(fits, ~sharded).otherwise(sharded))
    why = (
        F.when(F.col("__fit") == 0, "neither fits").when(F.col("__fit") == 1, "the other does not fit").when(F.col("total_cores") < F.col("__other"), F.format_string("%d cores, not %d", F.col("total_cores"), F.col("__other")))
        .when(F.col("__types") == 2, "as many cores on larger nodes").otherwise("as many nodes")
    )
    return one.withColumn("why", why).drop("__fit", "__types", "__other")


def plan_reason() -> Column:
    """What a plan of plans() holds, in words."""
    def part(side: str) -> Column:
        tables, indexes = F.col(f"n_{side}"), F.col(f"n_indexes_{side}")
        return F.format_string(f"%d {side} objects (%d tables, %d indexes) of %.4f GB, %d reads and %d writes a second", tables + indexes, tables, indexes, F.col(f"gb_{side}").cast("double"), F.col(f"reads_{side}").cast("long"), F.col(f"writes_{side}").cast("long"))

    head = F.format_string("%d nodes of %d cores", F.col("nodes"), F.col("cores"))
    return F.concat_ws("; ", head, *[F.when(F.col(f"n_{side}") > 0, part(side)) for side in ("colocated", "sharded")])


def fleet_status(databases: DataFrame) -> DataFrame:
    """status by db_id of its assessments' states: ERROR if any failed, COMPLETE if all are, else IN_PROGRESS."""
    states = databases.groupBy("db_id").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "interrupted").alias("failed"))
    return states.select("db_id", F.when(F.col("failed") > 0, "ERROR").when(F.col("done") == F.col("n"), "COMPLETE").otherwise("IN_PROGRESS").alias("status"))


