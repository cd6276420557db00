"""Repeated runs of lines, found by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROLLING, Cache, alone, portions, rewrite, row_key, saved, spread, texts, window_minima

SPACE = " \t\n\v\f\r"
#: Characters from which a line by itself is a run.
LONG = 40
KEY = ["own", "doc_id"]
#: Two hashes, as 16 bytes, of lines seen lately.
LINE_HASHES = Cache(lambda line: hashlib.blake2b(line, digest_size=16).digest())


def split_lines(text: str) -> tuple[list[str], list[int], list[str]]:
    """All lines; the places of those that aren't blank, and these trimmed of ASCII white space."""
    lines = text.split("\n")
    trimmed = [x.strip(SPACE) for x in lines]
    places = [k for k, x in enumerate(trimmed) if x]
    return lines, places, [trimmed[k] for k in places]


def fingerprints(docs: DataFrame, run: int, long: int) -> DataFrame:
    """own, doc_id, hashes and others (two hashes of each of the row's lines that aren't blank), picks (the lines with the
    smallest hash of some run in a row, by winnowing, and the long ones: every run that counts holds one), longs (the long
    ones). Rows without runs that count, or without doc_id, are left out: they hold and match none."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(LINE_HASHES)
        for batch in portions(batches):
            keep, out = [], ([], [], [], [])
            for k, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True)):
                lines = split_lines(text)[2] if doc_id is not None else []
                longs = np.array([i for i, x in enumerate(lines) if len(x) >= long], np.int32)
                if len(lines) >= run or len(longs):
                    found = np.frombuffer(b"".join([LINE_HASHES[x.encode("utf-8", "surrogatepass")] for x in lines]), np.uint64).reshape(-1, 2)
                    picks = window_minima(found[:, 0], run) if len(lines) >= run else []
                    keep.append(k)
                    for column, value in zip(out, (found[:, 0].astype(np.int64), found[:, 1].astype(np.int64), np.union1d(picks, longs).astype(np.int32), longs), strict=True):
                        column.append(value)
            taken = batch.take(pa.array(keep, pa.int64()))
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = [taken.column("own"), taken.column("doc_id"), *[pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, ["own", "doc_id", "hashes", "others", "picks", "longs"])

    keyed = docs.select(row_key("doc_id", "text").alias("own"), "doc_id", "text")
    return keyed.mapInArrow(find, "own long, doc_id long, hashes array<long>, others array<long>, picks array<int>, longs array<int>")


def _windows(run: int):
    """From each row's lines and the picks that repeat somewhere: every run of lines that holds such a pick, both ways from
    it, and the long lines among them, by two independent hashes."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("own", "doc_id", "hashes", "others", "longs", "hits")
        for batch in portions(batches):
            out: list[list] = [[], [], [], [], [], []]
            for own, doc_id, hashes, others, longs, hits in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                lines = [np.array(x, np.int64).view(np.uint64) for x in (hashes, others)]
                starts = np.unique(np.add.outer(np.array(hits, np.int64), np.arange(1 - run, 1)))
                starts = starts[(starts >= 0) & (starts <= len(hashes) - run)]
                for size, at in ((run, starts), (1, np.intersect1d(hits, longs).astype(np.int64))):
                    if len(at) and (size > 1 or run > 1 or at is starts):
                        one, two = (x.of(y, size)[at].view(np.int64) for x, y in zip(ROLLING, lines, strict=True))
                        for column, value in zip(out, (np.full(len(at), own), np.full(len(at), doc_id), at, np.full(len(at), size), one, two), strict=True):
                            column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["own", "doc_id", "start", "size", "one", "two"])

    return extend


def repeated(docs: DataFrame, run: int = 2, long: int = LONG) -> DataFrame:
    """own, doc_id, runs: start and size (as places among the row's lines that aren't blank) of its runs of run lines, and of
    its long lines, that also start earlier: in a row of smaller doc_id, or further up in the same one.

    A run that repeats holds a pick that repeats. Around each such pick the runs that hold it, both ways, are told apart by
    their hashes and grouped, which finds for every run the first of all equal ones without forming pairs of positions;
    runs of consecutive lines overlap, so all of a longer match goes."""
    found = saved(fingerprints(docs, run, long).dropDuplicates(KEY))
    picks = found.select(*KEY, F.posexplode("picks").alias("k", "at"), "hashes").select(*KEY, "at", F.expr("hashes[at]").alias("pick"))
    often = picks.groupBy("pick").agg(F.count("*").alias("n")).where("n > 1").select("pick")
    hits = picks.join(spread(often), "pick").groupBy(*KEY).agg(F.collect_list("at").alias("hits"))
    windows = saved(found.drop("picks").join(hits, KEY).mapInArrow(_windows(run), "own long, doc_id long, start long, size long, one long, two long"))
    first = windows.groupBy("one", "two").agg(F.min(F.struct("doc_id", "start", "own")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(spread(first), ["one", "two"]).where(F.struct("doc_id", "start", "own") > F.col("first"))
    return later.groupBy(*KEY).agg(F.collect_list(F.struct("start", "size")).alias("runs"))


def without(text: str, runs: list[dict] | None) -> tuple[str, int, int]:
    """The text without the lines of these runs, how many lines it had, and how many go."""
    lines, places, _ = split_lines(text)
    gone = {places[x["start"] + k] for x in runs or [] for k in range(x["size"])}
    return text if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(places), len(gone)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        out = [without(text, runs) for text, runs in zip(texts(batch), batch.column("runs").to_pylist(), strict=True)]
        digests = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x, _, _ in out]
        columns = [pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[0] for x in out], pa.string()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_lines", "n_removed", "kept_text", "kept_sha256"])


def line_dedup(docs: DataFrame, run: int = 2, long: int = LONG) -> DataFrame:
    """Every row: doc_id, n_lines (that aren't blank), n_removed, kept_text, kept_sha256. A line (blank ones aside, ASCII
    white space trimmed) goes if it lies in a run of run lines in a row that also starts earlier, or has long characters
    and stands earlier by itself: in a row of smaller doc_id or further up in the same one. Runs of one repeated line keep
    their first. A null text counts as empty; rows without doc_id neither lose lines nor cause a loss; rows that repeat
    doc_id and text lose the same lines, as one row; rows that repeat a doc_id with other texts count as one document. An
    empty table gives no rows."""
    keyed = docs.select("doc_id", "text", row_key("doc_id", "text").alias("own"))
    joined = keyed.join(repeated(docs, run, long).hint("shuffle_hash"), KEY, "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_report, "doc_id long, n_lines long, n_removed long, kept_text string, kept_sha256 string")


def clean(docs: DataFrame, run: int = 2, long: int = LONG) -> DataFrame:
    """docs, each text without the lines that line_dedup() removes; other columns stay, whatever they are called, n_chars
    follows the text. A row that loses all its lines stays with an empty text; null texts, rows without doc_id and repeated
    rows are as there; an empty table stays empty."""
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("own"), F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"))
    joined = rows.join(repeated(docs, run, long).hint("shuffle_hash"), KEY, "left").select("row", "runs")
    return rewrite(docs, joined, lambda found, batch: [without(x, y)[0] for x, y in zip(found, batch.column("runs").to_pylist(), strict=True)])
