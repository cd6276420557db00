"""Quality of documents by the vote of their nearest labelled neighbours in a latent space."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, alone, portions, saved, texts

#: Labelled documents that vote at most: a bounded sample by hash, so that the vectors that are broadcast take a megabyte.
SAMPLE = 4096
#: Bins that features are hashed to, dimensions of the latent space, neighbours that vote, the power of the similarity they vote with; and how much words weigh.
BINS, SIZE, NEIGHBOURS, POWER = 4096, 64, 15, 8
WORDINESS = 0.4
#: Documents whose similarities are worked out at once.
BLOCK = 256

RUNS = re.compile(r"(A|a|0)\1+|([^Aa0])\2{3,}")


def shape(word: str) -> str:
    """How a word looks: A, a and 0 for runs of upper-case letters, other letters and digits; other characters as they are."""
    drawn = "".join("A" if x.isupper() else "a" if x.isalpha() else "0" if x.isdigit() else x for x in word[:64])
    return RUNS.sub(lambda x: x[0][:1] if x[1] else x[0][:3], drawn)[:12]


def _bin(feature: str, half: int = 0) -> int:
    """The lower half of the bins is for how a text looks, the upper one for its words."""
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % (BINS // 2) + half * (BINS // 2)


def _word(word: str) -> tuple[int, int, str]:
    """Bins of a word's shape and of the word itself, by its first four letters; the shape."""
    drawn = shape(word)
    return _bin(f"s{drawn}"), _bin(word.lower().strip(".,!?*|$%&#")[:4], 1), drawn


#: Words seen lately, in each Python worker; and pairs of shapes.
WORDS, PAIRS = Cache(_word), Cache(lambda x: _bin(f"p{x[0]} {x[1]}"))


def features(text: str) -> Counter:
    """Bins of a text, with how often: of each word its shape and its beginning, of each two neighbours their shapes; of each
    line how many words it has, about; of the text which share of its words repeat the one before. An empty text has a bin of
    its own."""
    found: Counter = Counter()
    words = same = 0
    for line in text.split("\n"):
        chunks = line.split()
        if not chunks:
            continue
        seen = [WORDS[x] for x in chunks]
        found.update([x[0] for x in seen])
        found.update([x[1] for x in seen])
        found.update([PAIRS[a[2], b[2]] for a, b in zip(seen, seen[1:])])
        found[_bin(f"l{len(chunks).bit_length()}")] += 1
        words += len(chunks)
        same += sum(map(str.__eq__, chunks, chunks[1:]))
    if words:
        found[_bin(f"r{-(-10 * same // words)}")] += max(1, words // 4)
    return found or Counter({_bin("empty"): 1})


def bags(docs: DataFrame) -> DataFrame:
    """doc_id, bins, counts of every row; null texts as empty ones."""
    shorts, ints = pa.list_(pa.int16()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(WORDS, PAIRS)
        for batch in portions(batches):
            found = [sorted(features(x).items()) for x in texts(batch)]
            bins, counts = ([[x[i] for x in own] for own in found] for i in range(2))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bins, shorts), pa.array(counts, ints)], ["doc_id", "bins", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, bins array<short>, counts array<int>")


@dataclass
class Model:
    """weight: of each bin; basis: the latent space; vectors: of unit length, and each one's label (0 to 1)."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    share: float

    def dense(self, bins: list, counts: list) -> np.ndarray:
        """Rows of unit length: square roots of counts, weighted by how few documents have the bin; words weigh WORDINESS times as
        much as looks."""
        rows = np.zeros((len(bins), BINS), np.float32)
        for row, b, c in zip(rows, bins, counts, strict=True):
            row[b] = np.sqrt(c)
        rows *= self.weight
        return _unit(np.hstack([_unit(rows[:, : BINS // 2]), WORDINESS * _unit(rows[:, BINS // 2 :])]))

    def votes(self, rows: np.ndarray) -> np.ndarray:
        """The neighbours' labels, weighted by a power of their similarity; the share of label 1 where no one is similar."""
        out = np.full(len(rows), self.share)
        if len(self.vectors):
            near = _unit(rows @ self.basis) @ self.vectors.T
            k = min(NEIGHBOURS, near.shape[1])
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            weights = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(float) ** POWER
            total = weights.sum(axis=1)
            out = np.where(total > 1e-12, (weights * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-12), self.share)
        return np.clip(out, 0.0, 1.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows**2).sum(axis=1, keepdims=True)), 1e-12)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, quality (0 to 1) of at most so many labelled documents, by hash; of equal texts one, with their labels' mean.
    labels needs doc_id and quality; rows with nulls there are left out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality"))
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.xxhash64(text).alias("own"), F.length(text).alias("size")).join(usable, "doc_id")
    one = found.groupBy("own", "size").agg(F.min("doc_id").alias("doc_id"), F.avg("quality").alias("quality"))
    return one.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(bagged: DataFrame, known: DataFrame) -> Model:
    """bagged: bags() of all documents, whose weights of bins are counted over all of them; known: sample()."""
    rows = bagged.count()
    having = bagged.select(F.explode("bins").alias("bin")).groupBy("bin").count().collect()  # BINS rows at most
    weight = np.zeros(BINS, np.float32)
    for x in having:
        weight[x["bin"]] = np.log((1 + rows) / x["count"])
    labelled = bagged.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct("bins", "counts", "quality")).alias("x"))
    taken = labelled.select("x.*", "doc_id").orderBy("doc_id").collect()  # SAMPLE rows at most
    empty = Model(weight, np.zeros((BINS, SIZE), np.float32), np.zeros((0, SIZE), np.float32), np.zeros(0), 0.5)
    if not taken:
        return empty
    empty.share = float(np.mean([x.quality for x in taken]))
    matrix = empty.dense([x.bins for x in taken], [x.counts for x in taken])
    basis = _directions(matrix)
    return Model(weight, basis, _unit(matrix @ basis), np.array([x.quality for x in taken]), empty.share)


def _directions(matrix: np.ndarray) -> np.ndarray:
    """The directions of the largest singular values, by a randomized range finder with power iterations; fixed seed."""
    reach = min(SIZE + 16, *matrix.shape)
    q = np.linalg.qr(matrix @ np.random.default_rng(11).standard_normal((matrix.shape[1], reach)).astype(np.float32))[0]
    for _ in range(4):
        q = np.linalg.qr(matrix @ np.linalg.qr(matrix.T @ q)[0])[0]
    found = np.linalg.svd(q.T @ matrix, full_matrices=False)[2][:SIZE]
    basis = np.zeros((matrix.shape[1], SIZE), np.float32)
    basis[:, : len(found)] = found.T
    return basis


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Every row: doc_id, score (0 to 1, higher: quality 1 likelier), learnt from labels (doc_id, quality). Null and empty
    texts are scored alike; repeated rows and rows without doc_id are scored like others; without labels every score is 0.5.
    Texts are read once, into counts of hashed features; at most `most` labelled documents vote."""
    bagged = saved(bags(docs), "zstd")
    model = fit(bagged, saved(sample(docs, labels, most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, BLOCK):
            rows = model.dense([x.values.to_numpy() for x in batch.column("bins")], [x.values.to_numpy() for x in batch.column("counts")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.votes(rows).astype(float))], ["doc_id", "score"])

    return bagged.mapInArrow(run, "doc_id long, score double")


def held_out():
    """Whether a doc_id is kept from learning."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0
