"""How far the wording of each source lies from that of the other sources and of the whole language."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, partitions, portions, saved, texts

#: A term: letters without regard to the case of A-Z, and every other character beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of its language that a term must be in; what is added to each count; what shares are multiplied by; terms that are reported.
LEAST_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: About how many terms and sources meet in one task to be compared.
TERMS, SOURCES = 1024, 256
#: Terms that a task counts before it passes them on.
COUNTED = 300_000
#: Rows of a group that are gathered before they are thinned out, and of all groups before they are passed on.
GATHERED, HELD = 4096, 1 << 19
#: Parts of a group whose skybands are merged before the group's own.
SALT = 32

GROUP = ["lang", "source"]
RETAINED = "lang string, source string, term string, n long, lang_n long, value long"


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (places), docs (rows that hold it). Summed up in each task before the shuffle, so that a large
    source sends a row for each of its terms and task. Null columns are read as empty."""
    kind = {"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "docs": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (places, rows) in found.items():
                n = len(places)
                columns = [[lang] * n, [source] * n, list(places), list(places.values()), [rows[x] for x in places]]
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(columns, kind.values(), strict=True)], list(kind))
            found.clear()

        for batch in portions(batches):
            for lang, source, text in zip(*(texts(batch, x) for x in (*GROUP, "text")), strict=True):
                places, rows = found.setdefault((lang, source), (Counter(), Counter()))
                terms = find(lower_ascii(text))
                places.update(terms)
                rows.update(set(terms))
            if sum(len(x) for x, _ in found.values()) > COUNTED:
                yield from passed()
        yield from passed()

    each = docs.select(*GROUP, "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return each.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * terms)), exact."""
    over = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, (total + terms * PRIOR).cast("decimal(20,0)"))


def skyband(n: np.ndarray, lang_n: np.ndarray, terms: np.ndarray, k: int = TOP) -> np.ndarray:
    """Places of the terms that fewer than k others dominate: with at least as large a count in the group, at most as large a
    one in the language, and an earlier term. Whoever k others dominate is dominated by k that stay, so in an order in which
    dominators come first each block is held against those that stayed before it and against itself."""
    _, rank = np.unique(terms, return_inverse=True)
    order = np.lexsort((rank, lang_n, -n))
    n, lang_n, rank = n[order], lang_n[order], rank[order]
    kept = np.empty(0, np.int64)
    for at in range(0, len(order), 256):
        own = np.arange(at, min(at + 256, len(order)))
        rest = np.concatenate([kept, own])
        above = (n[rest, None] >= n[None, own]) & (lang_n[rest, None] <= lang_n[None, own]) & (rank[rest, None] < rank[None, own])
        kept = np.concatenate([kept, own[above.sum(axis=0) < k]])
    return order[kept]


def _retain(k: int):
    """Of each group's rows in a task the skyband. What is held is bounded: beyond that it is passed on, thinned out or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # by group: tables, their rows, and how many stayed when it was last thinned out
        total = 0

        def thin(own: list) -> None:
            joined = pa.concat_tables(own[0]).combine_chunks()
            stay = skyband(joined.column("n").to_numpy(), joined.column("lang_n").to_numpy(), np.array(joined.column("term").to_pylist(), object), k)
            own[:] = [[joined.take(pa.array(stay))], len(stay), len(stay)]

        def passed() -> Iterator[pa.RecordBatch]:
            for own in held.values():
                thin(own)
                yield from own[0][0].to_batches()
            held.clear()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            lang, source = (table.column(x).to_pylist() for x in GROUP)
            by_group: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(lang, source, strict=True)):
                by_group.setdefault(key, []).append(i)
            for key, rows in by_group.items():
                own = held.setdefault(key, [[], 0, 0])
                own[0].append(table.take(pa.array(rows)))
                own[1] += len(rows)
                total += len(rows)
                if own[1] >= 2 * own[2] + GATHERED:
                    total -= own[1]
                    thin(own)
                    total += own[1]
            if total > HELD:
                yield from passed()
                total = 0
        yield from passed()

    return run


def top_terms(joined: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: of each group's rows (term, n, lang_n, value, which grows with n, falls with lang_n)
    the k of the largest value, ties to the earlier term. Each task retains the skyband of its rows of a group; skybands are
    merged in parts and then whole, and what is left is ranked."""
    rows = joined.select("lang", "source", "term", "n", "lang_n", "value")
    local = rows.mapInArrow(_retain(k), RETAINED)
    n = partitions(joined.sparkSession)
    parts = local.repartition(n, *GROUP, F.pmod(F.xxhash64("term"), F.lit(SALT))).mapInArrow(_retain(k), RETAINED)
    merged = parts.repartition(n, *GROUP).mapInArrow(_retain(k), RETAINED)
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "term")
    ranked = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("lang", "source", F.col("term").alias("item"), "value", "rank")


def _distances(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one cell (some terms, two parts of a language's sources): how far apart each two sources are over the terms seen."""
    sources = right.column("source").to_pylist()
    place = {x: i for i, x in enumerate(sources)}
    terms, column = np.unique(np.array(left.column("term").to_pylist(), object), return_inverse=True)
    p = np.repeat(right.column("base").to_numpy()[:, None], len(terms), axis=1)
    p[[place[x] for x in left.column("source").to_pylist()], column] = left.column("p").to_numpy()
    parts = np.array(right.column("part").to_pylist())
    one, two = key[2].as_py(), key[3].as_py()
    out: tuple[list, list, list] = ([], [], [])
    for i in np.flatnonzero(parts == one):
        others = [j for j in np.flatnonzero(parts == two) if j > i or one != two]
        if others:
            apart = np.abs(p[others] - p[i]).sum(axis=1)
            for a, b in ((i, None), (None, i)):  # both directions
                out[0].extend(sources[j if a is None else a] for j in others)
                out[1].extend(sources[j if b is None else b] for j in others)
                out[2].extend(apart.tolist())
    lang = right.column("lang")[0].as_py() if len(right) else ""
    return pa.table({"lang": pa.array([lang] * len(out[0]), pa.string()), "source": pa.array(out[0], pa.string()), "item": pa.array(out[1], pa.string()), "apart": pa.array(out[2], pa.int64()), "seen": pa.array([len(terms)] * len(out[0]), pa.int64())})


def pair_distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: each source's distance from every other of its language. shares: lang, source, term,
    p; groups: lang, source, base (p of a count of 0), n_terms, n_sources. The terms are dealt out in blocks and the sources in parts;
    of each cell only sums leave the task. Terms that neither of two sources holds are made up by number."""
    blocks = F.greatest(F.ceil(F.col("n_terms") / TERMS), F.lit(1)).cast("long")
    parts = F.ceil(F.col("n_sources") / SOURCES).cast("long")
    dealt = groups.withColumns({"blocks": blocks, "parts": parts}).withColumn("part", F.pmod(F.xxhash64("source"), "parts"))

    def to_cells(df: DataFrame) -> DataFrame:
        cells = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        return cells.withColumns({"one": F.least("part", "other"), "two": F.greatest("part", "other")})

    left = to_cells(shares.join(dealt.select(*GROUP, "blocks", "parts", "part"), GROUP).withColumn("block", F.pmod(F.xxhash64("term"), "blocks")))
    right = to_cells(dealt.where("n_terms > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    cell = ["lang", "block", "one", "two"]
    found = left.select(*cell, "source", "term", "p").groupBy(*cell).cogroup(right.select(*cell, "source", "part", "base").groupBy(*cell)).applyInArrow(_distances, "lang string, source string, item string, apart long, seen long")
    sums = found.groupBy(*GROUP, "item").agg(F.sum("apart").alias("apart"), F.sum("seen").alias("seen"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other_base"))
    pairs = groups.join(other, "lang").where(F.col("source") != F.col("item")).join(sums, [*GROUP, "item"], "left")
    zero = F.lit(0).cast("long")
    unseen = (F.col("n_terms") - F.coalesce("seen", zero)) * F.abs(F.col("base") - F.col("other_base"))
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    valued = pairs.select(*GROUP, "item", F.when(F.col("n_terms") > 0, F.coalesce("apart", zero) + unseen).otherwise(zero).alias("value"))
    return valued.withColumn("rank", F.row_number().over(order))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, k: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank. A language keeps the terms that at least least_docs of its rows hold; a group (a
    source in a language) gives each a share by its count (share()). Part pair: each other source of the language, by the
    sum of differences of shares; part term: the k terms whose share in the group is most above that in the language.

    Null text, lang and source are read as empty; a group without terms has pairs alone, of value 0 if its language keeps no
    term; repeated rows count each; an empty table gives no rows. Only these three columns are read."""
    found = saved(counts(docs))
    kept = saved(found.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"))
    in_group = saved(found.select(*GROUP, "term", "n").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("n_terms"))
    every = docs.select(*[F.coalesce(x, F.lit("")).alias(x) for x in GROUP]).distinct()
    sizes = every.groupBy("lang").agg(F.count("*").alias("n_sources"))
    totals = in_group.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    joined = every.join(sizes, "lang").join(langs, "lang", "left").join(totals, GROUP, "left")
    named = joined.select(*GROUP, "n_sources", *[F.coalesce(x, zero).alias(x) for x in ("lang_total", "n_terms", "total")])
    groups = saved(named.withColumn("base", F.when(F.col("n_terms") > 0, share(zero, F.col("total"), F.col("n_terms")))))
    shares = in_group.join(groups.select(*GROUP, "total", "lang_total", "n_terms"), GROUP).withColumn("p", share(F.col("n"), F.col("total"), F.col("n_terms")))
    above = shares.withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))).where("value > 0 AND n > 0")
    parts = {"pair": pair_distances(shares.select(*GROUP, "term", "p"), groups), "term": top_terms(above, k)}
    one, two = (df.select(*GROUP, F.lit(part).alias("part"), "item", "value", "rank") for part, df in parts.items())
    return one.unionByName(two)
