"""Near duplicates by MinHash in an LSH forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROLLING, UNIT_HASHES, alone, partitions, portions, saved, spread, texts, unit_hashes
from .components import EDGES, connected_components

WIDTH = 5
#: Hashes of a signature; trees of the forest; hashes by which a tree's labels must agree at least, and those they are sorted by.
HASHES, TREES, LEAST, DEPTH = 128, 32, 4, 8
#: Members of a region of one prefix that are all candidates with one another; larger regions are crowds.
SMALL = 16
#: Share of equal hashes from which a pair is compared in full: at a similarity of 0.75 it falls short about once in ten million.
LIKELY = 0.55
_RANDOM = np.random.default_rng(20)
MULTIPLIERS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
MASKS = _RANDOM.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's runs of width words (A-Z lower-cased, cut at ASCII white space); of all its words if they are fewer."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    return np.unique(ROLLING[0].of(unit_hashes(found), min(width, len(found))))


def signature(items: np.ndarray) -> np.ndarray:
    """Of each of HASHES random orders of the items, a 16-bit digest of the first item."""
    low = (items >> np.uint64(32)).astype(np.uint32)
    first = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):
        part = (low[k : k + 2048, None] ^ MASKS) * MULTIPLIERS
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        first = np.minimum(first, part.min(axis=0))
    return ((first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, whole (a 128-bit digest of the set), hashes (its signature)."""
    alone(UNIT_HASHES)
    for batch in portions(batches):
        sizes, whole, signs = [], [], []
        for text in texts(batch):
            items = shingles(text)
            sizes.append(len(items))
            one = np.bitwise_xor.reduce(items * np.uint64(0x9E3779B97F4A7C15) ^ items >> np.uint64(31)) if len(items) else np.uint64(0)
            whole.append(np.array([items.sum(dtype=np.uint64), one], np.uint64).tobytes() if len(items) else None)
            signs.append(signature(items).tobytes() if len(items) else None)
        columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(whole, pa.binary()), pa.array(signs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "whole", "hashes"])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node and tree: the first LEAST hashes of its label as one number, and the further ones."""
    order = (np.arange(TREES)[:, None] * LEAST + np.arange(DEPTH)) % HASHES
    for batch in portions(batches):
        if not batch.num_rows:
            continue
        signs = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint16).reshape(-1, HASHES)
        labels = np.ascontiguousarray(signs[:, order]).view(np.int64)  # node, tree, half of the label
        nodes = np.repeat(batch.column("node").to_numpy(), TREES)
        trees = np.tile(np.arange(TREES, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(trees), pa.array(labels[:, :, 0].ravel()), pa.array(labels[:, :, 1].ravel()), pa.array(nodes)], ["tree", "prefix", "rest", "node"])


FOUND = "kind int, a long, b long, tree int"
PAIR, CROWD = 0, 1


class Regions:
    """Walks through one part of the sorted orders, portion by portion. A region is a tree's labels of one prefix. Members
    of a small region are candidates with one another. A region of more than SMALL members is a crowd: its members, told of
    as such, are candidates only with the first of those that agree with them to full DEPTH. So is a region at either end of
    the part, which may go on in another part. Of what was walked through, at most SMALL labels are held."""

    def __init__(self):
        self.held = [np.empty(0, x) for x in (np.int32, np.int64, np.int64, np.int64)]
        self.key: tuple[int, int] | None = None  # of the region walked through last, if it is a crowd that may go on
        self.run, self.first = 0, -1  # its last label's rest, and the first node that has it
        self.begun = False

    def walk(self, columns: list[np.ndarray], over: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs, and trees, prefixes and nodes of crowds, as two-dimensional arrays."""
        tree, prefix, rest, node = self.held = [np.concatenate(x) for x in zip(self.held, columns, strict=True)]
        nothing = np.empty((0, 2), np.int64), np.empty((0, 3), np.int64)
        if not len(node):
            return nothing
        new = np.ones(len(node), bool)
        new[1:] = (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])
        starts = np.append(np.flatnonzero(new), len(node))
        size = np.diff(starts)
        crowd = size > SMALL
        goes_on = self.key == (int(tree[0]), int(prefix[0]))
        crowd[0] |= goes_on or not self.begun
        crowd[-1] |= over
        self.begun = True
        if not over and not crowd[-1]:  # the last region may still grow
            cut = starts[-2]
            self.held = [x[cut:] for x in self.held]
            tree, prefix, rest, node = (x[:cut] for x in (tree, prefix, rest, node))
            size, crowd = size[:-1], crowd[:-1]
            self.key = None
            if not len(node):
                return nothing
        else:
            self.held = [x[:0] for x in self.held]
        region = np.repeat(np.arange(len(size)), size)
        crowded = crowd[region]
        pairs = []
        for step in range(1, min(SMALL, int(size[~crowd].max(initial=1)))):
            at = np.flatnonzero((region[step:] == region[:-step]) & ~crowded[step:])
            pairs.append(np.stack([node[at], node[at + step]], 1))
        at = np.flatnonzero(crowded)
        if len(at):
            head = np.ones(len(at), bool)
            head[1:] = (region[at[1:]] != region[at[:-1]]) | (rest[at[1:]] != rest[at[:-1]])
            first = node[at][np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
            if goes_on and at[0] == 0 and rest[0] == self.run:
                first[: int(np.argmax(head[1:])) + 1 if head[1:].any() else len(at)] = self.first
            pairs.append(np.stack([first, node[at]], 1))
            if crowd[-1]:
                self.key, self.run, self.first = (int(tree[-1]), int(prefix[-1])), int(rest[-1]), int(first[-1])
        found = np.concatenate(pairs) if pairs else nothing[0]
        found = found[found[:, 0] != found[:, 1]]
        return np.unique(np.sort(found, axis=1), axis=0), np.stack([tree[at].astype(np.int64), prefix[at], node[at]], 1)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one part of the sorted orders: candidate pairs (kind 0: a, b) and the members b of crowds (kind 1: tree, prefix a)."""
    own = Regions()

    def rows(pairs: np.ndarray, crowds: np.ndarray) -> pa.RecordBatch:
        kind = np.repeat(np.array([PAIR, CROWD], np.int32), [len(pairs), len(crowds)])
        tree = np.concatenate([np.zeros(len(pairs), np.int64), crowds[:, 0]]).astype(np.int32)
        columns = [kind, np.concatenate([pairs[:, 0], crowds[:, 1]]), np.concatenate([pairs[:, 1], crowds[:, 2]]), tree]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["kind", "a", "b", "tree"])

    for batch in batches:
        yield rows(*own.walk([batch.column(x).to_numpy() for x in ("tree", "prefix", "rest", "node")]))
    yield rows(*own.walk([x[:0] for x in own.held], over=True))


def likely(pairs: DataFrame, nodes: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) of whose signatures' hashes at least that share are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint16).reshape(-1, HASHES) for x in ("one", "two"))
                yield batch.select(["a", "b"]).filter(pa.array((one == two).sum(axis=1) >= share * HASHES))

    sign = nodes.select("node", "hashes")
    one = pairs.join(sign.select(F.col("node").alias("a"), F.col("hashes").alias("one")), "a")
    both = one.join(sign.select(F.col("node").alias("b"), F.col("hashes").alias("two")), "b")
    return both.select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    alone(UNIT_HASHES)
    for batch in portions(batches):
        items = [shingles(x).tobytes() for x in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(items, pa.binary())], ["node", "items"])


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            good = []
            for k, (one, two) in enumerate(zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True)):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    good.append(k)
            yield batch.select(["low", "high"]).take(pa.array(good, pa.int64()))

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are so alike, as low, high."""
    one = pairs.select(F.col("a").alias("low"), F.col("b").alias("high")).join(sets.select(F.col("node").alias("low"), F.col("items").alias("one")), "low")
    both = one.join(sets.select(F.col("node").alias("high"), F.col("items").alias("two")), "high")
    return both.select("low", "high", "one", "two").mapInArrow(_compare(percent), "low long, high long")


#: Members of a crowd, and shingles of them, on either side of what one call compares; columns of one product of matrices.
BLOCK, ITEMS, COLUMNS = 1024, 1 << 20, 4096


def common(ones: list[np.ndarray], twos: list[np.ndarray]) -> np.ndarray:
    """How many items each set of ones shares with each of twos: products of 0-1 matrices over the items that both sides hold."""
    sizes = np.array([len(x) for x in [*ones, *twos]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    values, place = np.unique(np.concatenate([*ones, *twos]), return_inverse=True)
    left = np.zeros(len(values), bool)
    right = left.copy()
    left[place[owner < len(ones)]] = True
    right[place[owner >= len(ones)]] = True
    shared = left & right
    keep = shared[place]
    owner, place = owner[keep], (np.cumsum(shared) - 1)[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(ones), len(twos)), np.float32)
    for begin in range(0, int(shared.sum()), COLUMNS):
        low, high = np.searchsorted(place, [begin, begin + COLUMNS])
        held = np.zeros((len(sizes), COLUMNS), np.float32)
        held[owner[low:high], place[low:high] - begin] = 1
        out += held[: len(ones)] @ held[len(ones) :].T
    return out


def _across(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of a crowd's block of minor members and a block of all its members: which components full sets link."""
        component, minor = (table.column(x).to_numpy(zero_copy_only=False) for x in ("component", "minor"))
        items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        rows, others = np.flatnonzero(minor), np.flatnonzero(~minor)
        pairs = np.empty((0, 2), np.int64)
        if len(rows) and len(others):
            sizes = np.array([len(x) for x in items], np.float64)
            both = common([items[k] for k in rows], [items[k] for k in others]).astype(np.float64)
            good = 100 * both >= percent * (sizes[rows][:, None] + sizes[others] - both)
            good &= component[rows][:, None] != component[others]
            x, y = np.nonzero(good)
            pairs = np.unique(np.sort(np.stack([component[rows][x], component[others][y]], 1), axis=1), axis=0)
        return pa.table({"low": pa.array(pairs[:, 0]), "high": pa.array(pairs[:, 1])})

    return run


def rest_of_crowds(crowds: DataFrame, sets: DataFrame, places: DataFrame, percent: int) -> DataFrame:
    """What crowds still link: low, high, two components. Crowds that are one component already (as large groups of near
    copies, but for a few members) need nothing more. In the others, the members outside the largest component are compared
    in full with all members, block by block; of what a block finds, it hands on a spanning forest. crowds: tree, prefix,
    node; sets: node, items; places: node, component of nodes that have links."""
    keys = ["tree", "prefix"]
    placed = crowds.join(places, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counts = placed.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    regions = counts.groupBy(*keys).agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    # Only members of crowds of several components have their sets fetched.
    split = saved(placed.join(spread(regions), keys))
    held = split.join(sets, "node").withColumn("minor", F.col("component") != F.col("main")).withColumn("shingles", F.length("items") / 8)
    held = saved(held.select(*keys, "node", "component", "minor", "shingles", "items"))
    amount = lambda rows, items: F.ceil(F.greatest(rows / BLOCK, items / ITEMS))
    minors = F.col("minor").cast("long")
    blocks = held.groupBy(*keys).agg(amount(F.sum(minors), F.sum(minors * F.col("shingles"))).alias("firsts"), amount(F.count("*"), F.sum("shingles")).alias("seconds"))
    members = held.join(spread(blocks), keys)
    each = lambda x: F.explode(F.sequence(F.lit(0).cast("long"), F.col(x) - 1))
    dealt = lambda x: F.pmod(F.xxhash64("node"), F.col(x))
    names = [*keys, "component", "items"]
    some = members.where("minor").select(*names, dealt("firsts").alias("first"), each("seconds").alias("second"), F.lit(True).alias("minor"))
    everyone = members.select(*names, each("firsts").alias("first"), dealt("seconds").alias("second"), F.lit(False).alias("minor"))
    # As one column: rows dealt out by tree and prefix alone would count as grouped already, all of a crowd in one task.
    block = F.struct(*keys, "first", "second").alias("block")
    return some.unionByName(everyone).select(block, "component", "items", "minor").groupBy("block").applyInArrow(_across(percent), EDGES)


def near_duplicates(docs: DataFrame, percent: int = 75, share: float = LIKELY) -> DataFrame:
    """Every row: doc_id, n_shingles, component_id, kept. Documents are linked when their sets of distinct five-word
    shingles (of all words if they are fewer; A-Z lower-cased) have 100 * intersection >= percent * union; component_id is
    the smallest doc_id that links reach, and the row with that doc_id stays. Null or empty texts have no shingles and no
    links. Rows without doc_id link nothing on their own; they belong to the component of an equal set, else to none
    (null), and stay then. Rows of one doc_id are one document; if they hold the same text, all of them stay or go.

    Candidates come from the forest's sorted orders; those of whose signatures' hashes at least share are equal (0: all)
    are compared in full, and what crowds leave out is made up by rest_of_crowds()."""
    spark = docs.sparkSession
    rows = saved(docs.select("doc_id", "text").mapInArrow(_describe, "doc_id long, n_shingles long, whole binary, hashes binary"))
    nodes = saved(rows.where("whole IS NOT NULL").groupBy("whole").agg(F.min("doc_id").alias("node"), F.first("hashes").alias("hashes")).where("node IS NOT NULL"))
    labels = nodes.select("node", "hashes").mapInArrow(_labels, "tree int, prefix long, rest long, node long")
    ordered = labels.repartitionByRange(partitions(spark), "tree", "prefix", "rest", "node").sortWithinPartitions("tree", "prefix", "rest", "node")
    found = saved(ordered.mapInArrow(_search, FOUND))
    close = saved(likely(found.where(f"kind = {PAIR}").select("a", "b").distinct(), nodes, share))
    crowds = found.where(f"kind = {CROWD}").select("tree", F.col("a").alias("prefix"), F.col("b").alias("node"))
    wanted = close.select(F.col("a").alias("doc_id")).union(close.select("b")).union(crowds.select("node")).distinct()
    sets = saved(docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), "doc_id").mapInArrow(_sets, "node long, items binary"))
    places = connected_components(confirm(close, sets, percent))
    more = connected_components(rest_of_crowds(crowds, sets, places, percent))
    parts = nodes.select("whole", "node").join(places, "node", "left").select("whole", F.coalesce("component", "node").alias("part"))
    classes = parts.join(more.select(F.col("node").alias("part"), "component"), "part", "left").select("whole", F.coalesce("component", "part").alias("component"))
    named = rows.select("doc_id", "n_shingles", "whole").join(classes, "whole", "left")
    component = F.when(F.col("whole").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep; rows without doc_id stay."""
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["__gone"], "left_anti")
