"""Nearest neighbours and components against brute force."""

import random

import numpy as np
import pytest

from tidemark.llm import ann, components


def brute(queries, vectors, k=5):
    best: dict = {}
    out = []
    for q, a in queries:
        found: dict = {}
        for i, b in vectors:
            if i != q and len(a) == len(b):
                x, y = np.array(a), np.array(b)
                found[i] = max(found.get(i, -2), float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))))
        best.setdefault(q, {})
        for i, s in found.items():
            best[q][i] = max(best[q].get(i, -2), s)
    for q, found in best.items():
        out += [(q, rank, i, s) for rank, (i, s) in enumerate(sorted(found.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k], 1)]
    return out


@pytest.mark.parametrize("size", [2, 33, 64])
def test_search(spark, monkeypatch, size):
    rnd = np.random.default_rng(size)
    base = rnd.standard_normal((12, size))
    rows = [(k, (base[k % 12] + 0.7 * rnd.standard_normal(size)).tolist()) for k in range(700)]
    rows += [(800 + k, rows[3][1]) for k in range(40)] + [(900, (np.array(rows[5][1]) * 4).tolist()), (901, (np.array(rows[6][1]) * 1e-100).tolist())]
    bad = [(1000, None), (1050, []), (1100, [0.0] * size), (1150, [float("nan")] * size), (1200, [float("inf")] + [1.0] * (size - 1)), (1250, [None] + [1.0] * (size - 1)), (None, rows[0][1]), (1300, [1.0] * (size + 1)), rows[7]]
    monkeypatch.setattr(ann, "VECTORS", 300)
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(3)
    queries = vectors.where("vec_id % 50 = 0")
    got = ann.search(queries, vectors, 20, len(rows)).collect()
    good = [*rows, (1300, [1.0] * (size + 1))]
    want = brute([x for x in good if x[0] % 50 == 0], good)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(x[:3] for x in want)
    scores = {(q, i): s for q, _, i, s in want}
    assert all(abs(r.score - scores[r.query_id, r.vec_id]) < 1e-12 for r in got)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert ann.search(none, none, 0, 0).collect() == [] and ann.search(some, none, 2, 0).collect() == []
    assert sorted((r.query_id, r.vec_id) for r in ann.search(some, some, 2, 2).collect()) == [(0, 1), (1, 0)]


def test_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(90)] + [(2000, 2001 + k) for k in range(60)] + [(5, 5)]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "low long, high long").repartition(7)).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "low long, high long")).collect() == []
