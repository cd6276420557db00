"""Records of delimited files with line breaks within quotes, found in every split at once.

A split doesn't know whether it begins within quotes. So for each line it is worked out where it leads from outside and from
within quotes; a split's lines taken together are such a function too, of which one row leaves the task. Composed in order of
the splits, these give the state that each one begins in, and then each reads its own records. A record that runs on beyond
its split is put together from its pieces, of which a split has two at most."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut

#: Splits whose states are sent to every executor (a few dozen bytes each); more are joined by shuffles.
MOST_SPLITS = 100_000
WHOLE, TAIL, MIDDLE, HEAD = range(4)


def line_ends(quote: str, escape: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """For lines (without their breaks), whether each ends within quotes if it begins outside, and if it begins within."""
    inside = re.compile(f"{re.escape(escape)}.|{re.escape(quote)}", re.DOTALL)

    def end(line: str, within: bool) -> bool:
        at = 0
        while True:
            if not within:
                at = line.find(quote, at) + 1
                if not at:
                    return False
                within = True
            found = inside.search(line, at)
            while found and found[0] != quote:
                found = inside.search(line, found.end())
            if not found:
                return True
            at, within = found.end(), False

    def ends(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        counts = pc.count_substring(lines, quote).to_numpy(zero_copy_only=False)
        if quote == escape:  # a doubled quote leaves quotes and enters them again
            return counts % 2 == 1, counts % 2 == 0
        outside, within = np.zeros(len(counts), bool), np.ones(len(counts), bool)
        for k in np.flatnonzero(counts):
            line = lines[int(k)].as_py()
            outside[k], within[k] = end(line, False), end(line, True)
        return outside, within

    return ends


def states(outside: np.ndarray, within: np.ndarray, start: bool) -> np.ndarray:
    """Whether each line begins within quotes, and at the end whether the last one ends so."""
    fixed = outside == within
    turns = outside & ~within
    if not fixed.any():
        return np.concatenate([[start], (np.cumsum(turns) + start) % 2 == 1])
    # From the last line that leads to the same state from both, turns count.
    total = np.concatenate([[0], np.cumsum(turns)])
    last = np.maximum.accumulate(np.where(np.concatenate([[True], fixed]), np.arange(len(outside) + 1), 0))
    base = np.concatenate([[start], outside])[last]
    return (base + total - total[last]) % 2 == 1


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Batches cut where another split begins."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        files = pc.dictionary_encode(batch.column("file")).indices.to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield (batch.column("file")[a].as_py(), int(blocks[a])), batch.slice(a, b - a)


def _functions(quote: str, escape: str):
    """A row for each split: where it leads from outside and from within quotes."""
    ends = line_ends(quote, escape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, leads = None, (False, True)
        out: list[tuple] = []
        for key, batch in _by_split(batches):
            if key != split and split is not None:
                out.append((*split, *leads))
            if key != split:
                split, leads = key, (False, True)
            own = ends(batch.column("line"))
            leads = tuple(bool(states(*own, x)[-1]) for x in leads)
        if split is not None:
            out.append((*split, *leads))
        columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays(columns, ["file", "block", "from_outside", "from_within"])

    return run


def _records(quote: str, escape: str, header: bool, pieces: bool):
    """With pieces the parts of records that aren't whole within their split, else whole records. Only what stands within
    quotes over several lines goes line by line."""
    ends = line_ends(quote, escape)
    names = ["kind", "file", "block", "record"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split: tuple | None = None
        within = skipping = False
        pending: list[str] = []  # lines of the record that is open
        kind = WHOLE  # of that record: TAIL if it began in another split

        def rows(kinds, records: pa.Array) -> pa.RecordBatch:
            n = len(records)
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([split[0] if pieces else None] * n, pa.string()), pa.array(np.full(n, split[1])), records], names)

        def closed() -> Iterator[pa.RecordBatch]:
            """What is open where the split ends."""
            if pieces and pending:
                yield rows([MIDDLE if kind == TAIL else HEAD], pa.array(["\n".join(pending)], pa.string()))

        for key, batch in _by_split(batches):
            if key != split:
                yield from closed()
                split, within, pending = key, batch.column("within")[0].as_py(), []
                kind, skipping = TAIL if within else WHOLE, header and key[1] == 0
            lines = batch.column("line")
            inside = states(*ends(lines), within)
            within = bool(inside[-1])
            if skipping:
                done = np.flatnonzero(~inside[1:])
                if not len(done):
                    continue
                skipping, lines, inside = False, lines.slice(int(done[0]) + 1), inside[done[0] + 1 :]
            alone = ~inside[:-1] & ~inside[1:]
            if not pieces and alone.any():
                yield rows(np.full(int(alone.sum()), WHOLE), lines.filter(pa.array(alone)))
            found: list[tuple[int, str]] = []
            for k in np.flatnonzero(~alone).tolist():
                pending.append(lines[k].as_py())
                if not inside[k + 1]:
                    if pieces == (kind == TAIL):
                        found.append((kind, "\n".join(pending)))
                    pending, kind = [], WHOLE
            if found:
                yield rows([x for x, _ in found], pa.array([x for _, x in found], pa.string()))
        yield from closed()

    return run


SPLIT = ["file", "block"]
LINES = "kind int, file string, block long, record string"


def quoted_records(spark: SparkSession, paths: str | list[str], quote: str = '"', escape: str = '"', header: bool = False) -> DataFrame:
    """record: the text of each record that isn't blank, its line breaks within quotes kept. A quote enters quotes anywhere
    in a line; within, the next one that isn't escaped leaves them. header: each file's first record is left out. A file that ends within quotes gives what
    it has as its last record."""
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    leads = lines.mapInArrow(_functions(quote, escape), "file string, block long, from_outside boolean, from_within boolean")
    begin = _beginnings(leads)
    if begin.limit(MOST_SPLITS + 1).count() <= MOST_SPLITS:
        placed = lines.join(F.broadcast(begin.select(*SPLIT, "within", "open")), SPLIT)
    else:
        at = lines.withColumn("at", F.monotonically_increasing_id())
        placed = at.join(begin.select(*SPLIT, "within", "open"), SPLIT).repartition(*SPLIT).sortWithinPartitions(*SPLIT, "at")
    placed = placed.select(*SPLIT, "line", "within", "open")
    records = placed.drop("open").mapInArrow(_records(quote, escape, header, False), LINES).select("record")
    if not begin.where("open").isEmpty():
        parts = placed.where("open").drop("open").mapInArrow(_records(quote, escape, header, True), LINES)
        records = records.unionByName(_joined(parts))
    return records.select(F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")


def _beginnings(leads: DataFrame) -> DataFrame:
    """file, block, within (whether the split begins within quotes), open (whether a record runs on into or beyond it)."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.when(F.col("from_outside") == F.col("from_within"), F.col("from_outside"))
    turns = (F.col("from_outside") & ~F.col("from_within")).cast("long")
    counted = leads.withColumns({"fixed": fixed, "total": F.sum(turns).over(earlier.rowsBetween(Window.unboundedPreceding, 0))})
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "total")), True).over(earlier)
    before = counted.withColumns({"last": last, "so_far": F.coalesce(F.lag("total").over(Window.partitionBy("file").orderBy("block")), F.lit(0))})
    base, since = F.coalesce(F.col("last.fixed"), F.lit(False)), F.col("so_far") - F.coalesce(F.col("last.total"), F.lit(0))
    within = F.when(since % 2 == 1, ~base).otherwise(base)
    placed = before.withColumn("within", within)
    end = F.when(F.col("within"), F.col("from_within")).otherwise(F.col("from_outside"))
    return cut(placed.select(*SPLIT, "within", (F.col("within") | end).alias("open")))


def _joined(parts: DataFrame) -> DataFrame:
    """Records from their pieces: a head and what follows it up to a tail. Which pieces belong together is found without their
    text. Pieces without a head belong to a header."""
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    owners = parts.select("file", "block", "kind").withColumn("head", F.last(F.when(F.col("kind") == HEAD, F.col("block")), True).over(order))
    placed = parts.join(owners.where("head IS NOT NULL"), ["file", "block", "kind"])
    whole = placed.groupBy("file", "head").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("x"))
    return whole.select(F.array_join("x.record", "\n").alias("record"))
