"""Exact top-k against all products in one place."""

import math

import numpy as np
import pytest

from crawlgrain.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, key string, rid long, d int, score long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 3, "k", 1, 2, 9) for i, v in rows], SCHEMA).repartition(5)


def expected(rows, every, k):
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            found = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def clustered(seed, n, d, centres, spread, norm=False):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    x = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, d))
    if norm:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))]


def run(spark, rows, **options):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(frame(spark, rows), **options).collect())


@pytest.mark.parametrize("spread, norm", [(0.05, True), (1.0, False), (3.0, True)])
def test_search_against_all_products(spark, spread, norm):
    rows = clustered(int(spread * 100), 1500, 16, 30, spread, norm)
    rows += [(5000, None), (5010, [None] * 16), (5020, [float("nan")] * 16), (5030, [float("inf")] * 16), (5040, []), (None, rows[0][1])]
    assert run(spark, rows, every=10, cell=32) == expected(rows, 10, 5)


def test_search_with_copies_ties_lengths_and_signs(spark):
    rows = clustered(7, 300, 6, 4, 0.2)
    hot = rows[11][1]
    rows += [(1000 + i, hot) for i in range(700)]  # a third of all rows and more
    rows += [(2000 + i, [0.0] * 6) for i in range(30)] + [(3000 + i, [float(i), 1.0]) for i in range(8)] + [(4000, [1.0] * 9)]
    rows += [(1000, hot), (0, rows[0][1]), (0, rows[0][1])]  # repeated rows and ids
    rows += [(6000 + i, [-c for c in rows[i][1]]) for i in range(50)]
    assert run(spark, rows, every=10, cell=16) == expected(rows, 10, 5)


def test_rings_are_read_in_several_rounds(spark, monkeypatch):
    rows = clustered(9, 800, 12, 800, 0.0, True)  # no clusters: bounds say little
    monkeypatch.setattr(topk, "FIRST", 1)
    monkeypatch.setattr(topk, "GROWTH", 3)
    assert run(spark, rows, every=40, cell=8) == expected(rows, 40, 5)


def test_bounds_spare_rings(spark, monkeypatch):
    rows = clustered(10, 2000, 16, 40, 0.02, True)
    read = []
    whole = topk._read
    monkeypatch.setattr(topk, "_read", lambda visits, queries, index, k: read.append((visits.count(), queries.count())) or whole(visits, queries, index, k))
    assert run(spark, rows, every=50, cell=32) == expected(rows, 50, 5)
    assert sum(v for v, _ in read) < 12 * read[0][1]  # of 60 cells and more


def test_few_rows_huge_numbers_and_none(spark):
    rows = [(50, [1e30, -1e30]), (51, [1e9, 1.0]), (100, [1.0, 0.5])]
    got = run(spark, rows)
    assert [(q, r) for q, r, _, _ in got] == [(50, 1), (50, 2), (100, 1), (100, 2)]
    assert all(abs(s) < 1 << 63 for *_, s in got) and [v for q, _, v, _ in got if q == 100] == [51, 50]
    assert run(spark, [(50, [1.0])]) == []
    empty = topk.search(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]
