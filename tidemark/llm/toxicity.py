"""Toxic passages: maximum-scoring segments over token log-odds, and a document score calibrated by their extreme-value law."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, alone, portions, saved, texts

WORD = re.compile(r"\w+").findall
PREFIXES = (6, 5, 4)
#: Labelled documents that the model is fitted on at most, about: a bounded sample by hash, so that the model is bounded too.
SAMPLE = 200_000


def features(word: str) -> list[str]:
    """From the most to the least specific; a prefix, marked by *, stands for words that begin so."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


@dataclass
class Model:
    """log_odds: by feature, 0 where a feature has evidence but no significant leaning to toxic text."""

    log_odds: dict[str, float]
    drift: float
    decay: float
    scale: float = 1.0
    slope: float = 1.0
    offset: float = 0.0
    words: Cache = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        self.words = Cache(self._chunk)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.__post_init__()

    def _chunk(self, chunk: str) -> float:
        best = 0.0
        for word in WORD(chunk.lower()):
            for x in features(word):
                if x in self.log_odds:
                    best = max(best, self.log_odds[x])
                    break
        return best or self.drift

    def scores(self, text: str) -> np.ndarray:
        chunks = text.split()
        return np.fromiter(map(self.words.__getitem__, chunks), np.float64, len(chunks))

    def evidence(self, n_words: int, scores: list[float]) -> float:
        """How far passages' scores lie above what the best passage of clean text of that length reaches, summed up."""
        least = math.log(self.scale) + math.log(max(n_words, 1))
        return sum(max(0.0, x * self.decay - least) for x in scores)

    def probability(self, n_words: int, scores: list[float]) -> float:
        return 1 / (1 + math.exp(-min(max(min(self.evidence(n_words, scores), 1e6) * self.slope + self.offset, -700.0), 700.0)))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one linear scan: Ruzzo and Tompa's candidates, each with the sum
    before it and after it and a link to the nearest one to its left with a smaller sum before it. A new candidate follows
    links, and joins that nearest one unless its sum after is as large; what a link passes over is never looked at again."""
    at = np.flatnonzero(scores > 0)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    starts: list[int] = []
    ends: list[int] = []
    lows: list[float] = []
    highs: list[float] = []
    links: list[int] = []
    for start, low, high in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist(), strict=True):
        end, k = start + 1, len(starts) - 1
        while True:
            while k >= 0 and lows[k] >= low:
                k = links[k]
            if k < 0 or highs[k] >= high:
                break
            start, low, link = starts[k], lows[k], links[k]
            for x in (starts, ends, lows, highs, links):
                del x[k:]
            k = link
        for x, value in ((starts, start), (ends, end), (lows, low), (highs, high), (links, k)):
            x.append(value)
    return [(a, b, high - low) for a, b, low, high in zip(starts, ends, lows, highs, strict=True)]


#: Different words that a task holds counts of before it passes them on.
HELD = 100_000


def _spelled_out(words: Counter) -> Counter:
    """Counts of words as counts of their features."""
    counts: Counter = Counter()
    for word, n in words.items():
        for x in features(word):
            counts[x] += n
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of feature, toxic (its tokens in toxic documents), toxic_docs, clean; the feature '' counts all words. A feature may
    come more than once. Words are counted as they are, and made features of once each; only toxic documents need their own."""
    alone()
    words: tuple[Counter, Counter] = Counter(), Counter()
    docs: Counter = Counter()

    def row_batch() -> pa.RecordBatch:
        clean, toxic = (_spelled_out(x) + Counter({"": x.total()}) for x in words)
        keys = list(clean.keys() | toxic.keys() | docs.keys())
        columns = [pa.array(keys, pa.string()), *[pa.array([x[k] for k in keys], pa.int64()) for x in (toxic, docs, clean)]]
        for x in (*words, docs):
            x.clear()
        return pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "toxic_docs", "clean"])

    for batch in portions(batches):
        for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
            found = WORD(text.lower())
            words[toxic].update(found)
            if toxic:
                docs.update({"", *[x for word in set(found) for x in features(word)]})
        if len(words[0]) + len(words[1]) > HELD:
            yield row_batch()
    yield row_batch()


def _corpus_counts(docs: DataFrame, wanted: list[str]) -> tuple[dict[str, int], int]:
    """How often each wanted feature, and any word (by white space), occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        place = {x: i for i, x in enumerate(wanted)}
        total, words = np.zeros(len(wanted) + 1, np.int64), Counter()

        def add() -> None:
            for word, n in words.items():
                for x in features(word):
                    if x in place:
                        total[place[x]] += n
            words.clear()

        for batch in portions(batches):
            for text in texts(batch):
                words.update(WORD(text.lower()))
                total[-1] += len(text.split())
            if len(words) > HELD:
                add()
        add()
        if total.any():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], ["place", "n"])

    rows = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    found = {r.place: r.n for r in rows}
    return {x: found.get(i, 0) for i, x in enumerate(wanted)}, found.get(len(wanted), 0)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of labelled documents, by hash of doc_id about most of them at most; of equal texts one (copies
    would pass as many witnesses), toxic if any is. labels needs doc_id and toxic; rows with nulls there are left out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = most / max(most, labels.count())
    taken = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    found = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")  # at most about most rows of 12 bytes
    one = found.groupBy(F.xxhash64("text").alias("own"), F.length("text").alias("size")).agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(F.broadcast(saved(one.select("doc_id", "toxic"))), "doc_id")


def fit(docs: DataFrame, known: DataFrame, least_docs: int = 3, significance: float = 3.0, least_lean: float = 2.5) -> Model:
    """Token log-odds of toxic against clean labelled text with an informative Dirichlet prior: pseudo-counts in
    proportion to the counts in all documents, together a tenth as many as there are toxic words. Features whose toxic
    leaning is significant and at least least_lean score their log-odds, all other words a small negative drift. Without labels of both kinds nothing is toxic.
    known: doc_id, text, toxic."""
    counted = known.select("text", "toxic").mapInArrow(_count, "feature string, toxic long, toxic_docs long, clean long")
    counts = saved(counted.groupBy("feature").agg(*[F.sum(x).alias(x) for x in ("toxic", "toxic_docs", "clean")]))
    every = counts.where("feature = ''").first()
    if every is None or not every.toxic or not every.clean:
        return Model({}, -1.0, 1.0, offset=-10.0)
    ratio = 2 * every.toxic / every.clean
    rows = counts.where((F.col("feature") != "") & (F.col("toxic_docs") >= least_docs) & (F.col("toxic") >= ratio * (F.col("clean") + 0.5))).collect()
    corpus, size = _corpus_counts(docs, sorted(r.feature for r in rows))
    strength = every.toxic / 10
    log_odds, hits, stray = {}, 0, 0.0
    for r in rows:
        prior = strength * max(corpus[r.feature], 1) / max(size, 1)
        t, c = r.toxic + prior, r.clean + prior
        lean = math.log(t / (every.toxic + strength - t)) - math.log(c / (every.clean + strength - c))
        clear = lean >= least_lean and lean / math.sqrt(1 / t + 1 / c) >= significance
        log_odds[r.feature] = lean if clear else 0.0
        if clear and not r.feature.endswith("*"):
            hits += r.toxic
        if clear:
            stray += (r.clean + 0.5) / every.clean * lean
    share = min(max(hits, 1) / every.toxic, 0.5)
    drift = min(math.log(1 - share), -2 * stray / max(1, len(log_odds)))
    clean = [((r.clean + 0.5) / every.clean, log_odds[r.feature]) for r in rows if log_odds[r.feature] > 0 and not r.feature.endswith("*")]
    return Model(log_odds, drift, _decay(clean, drift))


def _decay(hits: list[tuple[float, float]], drift: float) -> float:
    """The positive x with E[exp(x * score)] = 1 over clean words: scores of segments decay by it."""
    rest = 1 - sum(p for p, _ in hits)
    low, high = 0.0, 1.0
    total = lambda x: sum(p * math.exp(min(x * s, 700)) for p, s in hits) + rest * math.exp(x * drift)
    while hits and total(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return max(low, 0.05)


PASSAGES = "doc_id long, n_words long, passages array<struct<start:long,end:long,score:double>>, score double"


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every row: doc_id, n_words (by white space), passages (all maximal scoring segments, in words from start up to end),
    score (0 to 1, higher: toxic likelier). Null and empty texts have no passages and the least score; repeated rows and
    rows without doc_id are scored like others."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(model.words)
        for batch in portions(batches):
            sizes, found, scores = [], [], []
            for text in texts(batch):
                words = model.scores(text)
                own = segments(words)
                sizes.append(len(words))
                found.append([{"start": a, "end": b, "score": s} for a, b, s in own])
                scores.append(model.probability(len(words), [s for _, _, s in own]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(scores, pa.float64())], ["doc_id", "n_words", "passages", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, PASSAGES)


def evidence(model: Model):
    """Model.evidence() as a column."""
    least = math.log(model.scale) + F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    return F.aggregate("passages", F.lit(0.0), lambda total, x: total + F.greatest(F.lit(0.0), x["score"] * model.decay - least))


def calibrate(known: DataFrame, model: Model) -> Model:
    """Fits the extreme-value law (Karlin and Altschul's E = scale * n * exp(-decay * score)) to passages of clean labelled
    documents, then a logistic curve from the evidence to the labels, on counts of rounded evidence. known: doc_id, text, toxic."""
    found = saved(passages(known, model).select("doc_id", "n_words", "passages").join(F.broadcast(known.select("doc_id", "toxic")), "doc_id"))
    clean = found.where("toxic = 0").agg(F.sum("n_words").alias("words"), F.sum(F.size("passages")).alias("found")).first()
    least = min((x for x in model.log_odds.values() if x > 0), default=0.0)
    model.scale = min(1.0, (1 + (clean.found or 0)) / (1 + (clean.words or 0)) * math.exp(model.decay * least))
    rows = found.groupBy(F.round(F.least(evidence(model), F.lit(60.0)), 1).alias("x"), "toxic").count().collect()
    x, y, n = (np.array([r[k] for r in rows], float) for k in range(3))
    if not len(rows) or y.min() == y.max():
        return model
    goal = np.where(y > 0, (n[y > 0].sum() + 1) / (n[y > 0].sum() + 2), 1 / (n[y == 0].sum() + 2))
    weights, design = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -40, 40)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (n * (goal - p)) - 1e-3 * weights)
        weights += step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    model.slope, model.offset = float(max(weights[0], 0.0)), float(weights[1])
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """labels (doc_id, toxic) are those to learn from."""
    known = sample(docs, labels, most)
    model = fit(docs, known)
    return calibrate(known, model) if model.log_odds else model


def score(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """passages() by a model learnt from the labels."""
    return passages(docs, train(docs, labels, most))


def held_out():
    """Whether a doc_id is kept from learning."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs, all columns, without the rows that score threshold or more. Rows that repeat or lack a doc_id are scored like
    others; null and empty texts score least and stay where any clean text does; an empty table stays empty."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(model.words)
        for batch in portions(batches):
            keep = []
            for text in texts(batch):
                words = model.scores(text)
                keep.append(model.probability(len(words), [s for _, _, s in segments(words)]) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
