"""Quality votes, divergence of sources and clusters against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import clusters, divergence, quality


# Quality


def _labelled(n=160):
    rnd = random.Random(5)
    words = ["river", "stone", "the", "and", "of", "house", "green", "walks", "under", "light"]
    rows, marks = [], []
    for k in range(n):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 60)))
        good = k % 4 != 0
        rows.append((k, text.capitalize() + "." if good else " ".join(x.upper() + "!!" for x in text.split())))
        marks.append((k, int(good)))
    return rows, marks


def test_quality_separates_what_it_has_not_seen(spark):
    rows, marks = _labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(marks[:100], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score(docs, known).collect()}
    assert all((got[k] >= 0.7) == bool(y) and 0 <= got[k] <= 1 for k, y in marks[100:])


def test_quality_votes_are_those_of_a_plain_loop(spark):
    rows, marks = _labelled(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(quality.bags(docs), spark.createDataFrame([(k, float(y)) for k, y in marks[:40]], "doc_id long, quality double"))
    bags = [sorted(quality.features(x).items()) for _, x in rows]
    having = Counter(b for x in bags for b, _ in x)
    assert all(math.isclose(model.weight[b], math.log((1 + len(rows)) / n), rel_tol=1e-5) for b, n in having.items())
    dense = model.dense([[b for b, _ in x] for x in bags], [[c for _, c in x] for x in bags])
    points = [x / np.linalg.norm(x) for x in dense @ model.basis]
    for point, vote in zip(points[40:], model.votes(dense[40:]), strict=True):
        near = sorted(((float(point @ points[k]), marks[k][1]) for k in range(40)), reverse=True)
        if near[quality.NEIGHBOURS - 1][0] - near[quality.NEIGHBOURS][0] > 1e-5:
            best = near[: quality.NEIGHBOURS]
            want = sum(max(s, 0) ** quality.POWER * y for s, y in best) / sum(max(s, 0) ** quality.POWER for s, _ in best)
            assert abs(vote - want) < 1e-3


def test_quality_of_odd_rows(spark):
    rows, marks = _labelled(40)
    odd = [(100, None), (101, ""), (None, "River stone."), (3, rows[3][1]), (102, "stone " * 60_000), (103, "\n \t\n"), (104, "x" * 200_000), (105, "퟿\U0001f600 é")]
    docs = spark.createDataFrame([(i, x, "extra", 1.0) for i, x in rows + odd], "doc_id long, text string, score string, bins double")
    known = spark.createDataFrame([*marks, (None, 1), (5, None), (7, 1), (999, 0)], "doc_id long, quality int")
    got = quality.score(docs, known)
    assert got.columns == ["doc_id", "score"]
    found = got.collect()
    assert len(found) == len(rows + odd) and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r.score for r in found}
    assert by_id[100] == by_id[101] == by_id[103]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), known).collect() == []
    assert quality.sample(docs, known, 10).count() == 10


# Divergence


def _brute_divergence(rows, least, k):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        seen = Counter(t for x in own for t in set(x[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        sources = sorted({x[1] for x in own})
        counts = {s: Counter(t for x in own if x[1] == s for t in x[2] if t in set(kept)) for s in sources}
        whole = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (c.total() + 5 * len(kept))
        p = {s: {t: share(counts[s], t) for t in kept} for s in sources}
        q = {t: share(whole, t) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1) if part == "pair" or rank <= k]
    return sorted(out)


@pytest.mark.parametrize("terms,sources", [(1024, 256), (3, 2)])
def test_divergence(spark, monkeypatch, terms, sources):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    rnd = random.Random(8)
    words = [f"{a}{b}" for a in ("ka", "Zo", "é", "ü", "\U0001f600", "ﬁ", "mi") for b in "abcdef"]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["s0", "s0", "s0", "s1", "s2", "S1", None, "é"]), " ".join(rnd.choices(words, weights=range(1, len(words) + 1), k=rnd.randint(0, 30)))) for _ in range(400)]
    rows += [("fr", "a", "one two"), ("fr", "b", None), ("fr", "c", "1234 !!"), ("it", "only", None), ("en", "empty", ""), ("en", "long", "kaa " * 50_000 + "x[y]z`w{v}u\x7ft"), *rows[:20]]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "lang string, source string, text string, term int").repartition(5)
    got = sorted(tuple(r) for r in divergence.divergence(docs, least_docs=20, k=7).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == _brute_divergence(rows, 20, 7)
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_skyband_keeps_what_less_than_k_dominate():
    rnd = np.random.default_rng(4)
    for size, spread, k in ((0, 5, 3), (1, 5, 1), (700, 12, 3), (900, 1000, 50)):
        n, lang_n = rnd.integers(1, spread + 1, size), rnd.integers(1, spread + 1, size)
        terms = np.array([f"t{x:04d}" for x in rnd.permutation(size)], object)
        want = {i for i in range(size) if sum(n[j] >= n[i] and lang_n[j] <= lang_n[i] and terms[j] < terms[i] for j in range(size)) < k}
        assert set(divergence.skyband(n, lang_n, terms, k).tolist()) == want


def test_retaining_gives_the_same_top_where_it_overflows(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GATHERED", 5)
    monkeypatch.setattr(divergence, "HELD", 60)
    rows = spark.range(3000).select(F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"), (F.col("id") * 7919 % 101).alias("n"), (F.col("id") * 104729 % 53).alias("lang_n"))
    valued = rows.withColumn("value", F.col("n") * 10 - F.col("lang_n")).repartition(6)
    want: dict = {}
    for r in valued.collect():
        want.setdefault(r.source, []).append((-r.value, r.term))
    got = sorted((r.source, r["rank"], r["item"], r.value) for r in divergence.top_terms(valued, 8).collect())
    assert got == sorted((s, k, term, -v) for s, x in want.items() for k, (v, term) in enumerate(sorted(x)[:8], 1))


# Clusters


def _brute_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(1024 * float(y)) for y in x]) for i, x in rows if x is not None and len(x) == size and all(y is not None and math.isfinite(y) for y in x)]
    start = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"3:{x[0]}".encode()).hexdigest(), x[1]))
    centres = [x for _, x in start[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centres)) for _, x in kept]

    for _ in range(rounds):
        where = assign()
        for j in range(len(centres)):
            mine = [x for (_, x), (_, c) in zip(kept, where) if c == j]
            if mine:
                centres[j] = [sum(y) // len(mine) for y in zip(*mine)]
    where = assign()
    own = Counter()
    for d, c in where:
        own[c] += d
    return sorted(((i is None, i or 0, c, d, own[c], own.total(), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, where)))


def _clustered(spark, rows, **options):
    df = spark.createDataFrame([(*x, "extra") for x in rows], "vec_id long, embedding array<double>, cluster string").repartition(4)
    found = clusters.clusters(df, **options).collect()
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found)


@pytest.mark.parametrize("size,k", [(6, 8), (64, 4), (1, 3)])
def test_clusters(spark, size, k):
    rnd = np.random.default_rng(size)
    base = rnd.standard_normal((5, size))
    rows = [(i, (base[i % 5] + 0.5 * rnd.standard_normal(size)).tolist()) for i in range(240)]
    rows += [(300 + i, rows[3][1]) for i in range(60)] + [rows[7], rows[7], (None, rows[9][1]), (400, [0.0] * size), (401, [-1e-9] * size), (402, [1e300] * size)]
    bad = [(500, None), (501, []), (502, [1.0] * (size + 1)), (503, [None] * size), (504, [float("nan")] * size), (505, [float("inf")] * size)]
    held = [(i, [min(max(y, -131072.0), 131072.0) for y in x]) for i, x in rows]
    assert _clustered(spark, rows + bad, k=k, rounds=4, size=size) == _brute_clusters(held, k, 4, size)


def test_clusters_of_few_or_equal_vectors(spark):
    few = [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, None)]
    assert _clustered(spark, few, size=2) == _brute_clusters(few, 8, 10, 2)
    equal = [(i, [0.5, 0.5]) for i in range(40)]
    assert _clustered(spark, equal, size=2) == _brute_clusters(equal, 8, 10, 2)
    assert _clustered(spark, few[2:], size=2) == []


def test_bounds_hold_and_spare_comparisons():
    rnd = np.random.default_rng(2)
    base = rnd.integers(-4000, 4000, (8, 64))
    rows = base[rnd.integers(0, 8, 3000)] + rnd.integers(-300, 300, (3000, 64))
    for scale in (1, 1 << 14):
        simplex = clusters.Simplex.among(rows[:64] * scale)
        centres = base * scale
        apexes = simplex.apexes(rows * scale)
        low, high = clusters.bounds(apexes, simplex.apexes(centres))
        exact = np.stack([clusters.squares(rows * scale, c) for c in centres], axis=1)
        assert (low <= exact).all() and (exact <= high).all()
        cluster, distance, compared = clusters.nearest(rows * scale, apexes, centres, simplex)
        assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
        assert compared < 2 * len(rows)
    same = clusters.Simplex.among(np.ones((20, 5), np.int64))
    assert len(same.pivots) == 1
