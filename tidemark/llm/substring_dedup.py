"""Passages of so many words that repeat across documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROLLING, UNIT_HASHES, alone, portions, rewrite, row_key, saved, spread, texts, unit_hashes, window_minima

WINDOW = 50


def words(text: str) -> list[bytes]:
    """Cut at ASCII white space, as bytes.split() does."""
    return text.encode("utf-8", "surrogatepass").split()


def _anchors(window: int):
    """Rabin-Karp hashes of every run of half a window's words; the smallest of those that lie in some window are its
    anchors. Windows that are equal have equal anchors, so one without a repeated anchor repeats nowhere."""
    half = (window + 1) // 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(UNIT_HASHES)
        for batch in portions(batches):
            keep, whole, places, anchors = [], [], [], []
            for k, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True)):
                found = words(text) if doc_id is not None else []
                if len(found) >= window:
                    hashes = ROLLING[0].of(unit_hashes(found), half)
                    at = window_minima(hashes, window - half + 1)
                    keep.append(k)
                    whole.append(hashlib.blake2b(b" ".join(found), digest_size=16).digest())
                    places.append(at.astype(np.int32))
                    anchors.append(hashes[at].view(np.int64))
            taken = batch.take(pa.array(keep, pa.int64()))
            columns = [taken.column("own"), taken.column("doc_id"), pa.array(whole, pa.binary()), pa.array(places, pa.list_(pa.int32())), pa.array(anchors, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["own", "doc_id", "whole", "places", "anchors"])

    return find


def _windows(window: int):
    """Two independent Rabin-Karp hashes of every window that holds one of the row's hits."""
    half = (window + 1) // 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(UNIT_HASHES)
        for batch in portions(batches):
            out: list[list] = [[], [], [], [], []]
            for own, doc_id, text, hits in zip(*(batch.column(x).to_pylist() for x in ("own", "doc_id")), texts(batch), batch.column("hits").to_pylist(), strict=True):
                hashes = unit_hashes(words(text))
                near = np.zeros(len(hashes) - window + 2, np.int64)
                at = np.array(hits, np.int64)
                np.add.at(near, np.clip(at - (window - half), 0, len(near) - 1), 1)
                np.add.at(near, np.clip(at + 1, 0, len(near) - 1), -1)
                starts = np.flatnonzero(np.cumsum(near)[:-1] > 0)
                one, two = (x.of(hashes, window)[starts].view(np.int64) for x in ROLLING)
                for column, value in zip(out, (np.full(len(starts), own), np.full(len(starts), doc_id), starts, one, two), strict=True):
                    column.append(value)
            if out[0]:
                own, doc_id, start, one, two = (np.concatenate(x).astype(np.int64) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(doc_id), pa.array(start.astype(np.int32)), pa.array(one), pa.array(two)], ["own", "doc_id", "start", "one", "two"])

    return find


KEY = ["own", "doc_id"]
#: What texts are joined by: id is doc_id, but never null. Where doc_id may be, an inner join leaves rows out that an outer one
#: needs, and the texts are shuffled for each by itself.
JOINED = ["own", "id"]


def keyed_texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", row_key("doc_id", "text").alias("own"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))


def repeated(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of keyed (keyed_texts()): own, id, whole (all of the row's words stand in this order in a row of smaller
    doc_id, and they fill a window), starts (else: of its windows whose words also start in such a row).

    Rows with equal words are told apart from the others first: only the smallest doc_id of each has its windows counted.
    Then windows without a repeated anchor are left out, which can't repeat; all others are counted."""
    rows = saved(keyed.select("own", "doc_id", "text").mapInArrow(_anchors(window), "own long, doc_id long, whole binary, places array<int>, anchors array<long>"))
    first = rows.groupBy("whole").agg(F.min(F.struct("doc_id", "own")).alias("first")).select("whole", "first.*")
    copies = rows.select(*KEY, "whole").join(spread(first.select("whole", F.col("doc_id").alias("low"))), "whole").where("doc_id > low").select(*KEY, F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts"))
    anchors = rows.join(first.select(*KEY), KEY, "left_semi").select(*KEY, F.explode(F.arrays_zip("places", "anchors")).alias("x")).select(*KEY, "x.places", "x.anchors")
    often = anchors.groupBy("anchors").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchors")
    hits = saved(anchors.join(spread(often), "anchors").groupBy(*KEY).agg(F.collect_set("places").alias("hits")))
    near = keyed.join(hits.select("own", F.col("doc_id").alias("id"), "hits").hint("shuffle_hash"), JOINED)
    windows = near.mapInArrow(_windows(window), "own long, doc_id long, start int, one long, two long")
    lowest = windows.groupBy("one", "two").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high")
    later = windows.join(spread(lowest), ["one", "two"]).where("doc_id > low").groupBy(*KEY).agg(F.collect_set("start").alias("starts"))
    return copies.unionByName(later.select(*KEY, F.lit(False).alias("whole"), "starts")).withColumnRenamed("doc_id", "id")


def intervals(starts: Iterable[int], window: int) -> list[tuple[int, int]]:
    """The maximal runs of words that windows at these starts cover."""
    out: list[tuple[int, int]] = []
    for start in sorted(starts):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], start + window
        else:
            out.append((start, start + window))
    return out


def without(text: str, whole: bool | None, starts: list[int] | None, window: int) -> tuple[list[bytes], list[bytes]]:
    """All words of the text, and those that stay."""
    found, kept, at = words(text), [], 0
    for start, end in intervals(range(len(found) - window + 1) if whole else starts or [], window):
        kept += found[at:start]
        at = end
    return found, kept + found[at:]


def _report(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            out: list[list] = [[], [], [], []]
            for text, whole, starts in zip(texts(batch), batch.column("whole").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                found, kept = without(text, whole, starts, window)
                joined = b" ".join(kept)
                new = text if len(kept) == len(found) else joined.decode("utf-8", "surrogatepass")
                for column, value in zip(out, (len(found), len(found) - len(kept), new, hashlib.sha256(joined).hexdigest()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]], ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return remove


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row: doc_id, n_words, n_removed, kept_text (the text itself where nothing goes, else the kept words joined by
    one space), kept_sha256 (of the kept words joined by one space). A word goes if a window of so many words in a row
    covers it whose words also start in a row of smaller doc_id; all windows are judged on the input. Null texts have no
    words; rows without doc_id neither lose words nor cause a loss; rows that repeat doc_id and text lose the same words;
    repeats within a document stay."""
    keyed = keyed_texts(docs)
    joined = keyed.join(repeated(keyed, window).hint("shuffle_hash"), JOINED, "left").select("doc_id", "text", "whole", "starts")
    return joined.mapInArrow(_report(window), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, each text that substring_dedup() takes words from as the kept words joined by one space; other texts and columns
    stay, whatever they are called, n_chars follows the text. A row that loses all its words stays with an empty text; null
    texts, rows without doc_id and repeated rows are as there; an empty table stays empty."""
    row = F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row")
    rows = docs.select(row, "doc_id", "text").select("row", row_key("doc_id", "text").alias("own"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"))
    joined = rows.join(repeated(keyed_texts(docs), window).hint("shuffle_hash"), JOINED, "left").select("row", "whole", "starts")

    def change(found: list[str], batch: pa.RecordBatch) -> list[str]:
        out = []
        for text, whole, starts in zip(found, batch.column("whole").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            before, kept = without(text, whole, starts, window)
            out.append(text if len(kept) == len(before) else b" ".join(kept).decode("utf-8", "surrogatepass"))
        return out

    return rewrite(docs, joined, change)
