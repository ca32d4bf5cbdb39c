"""Embedding whitening against exact integer arithmetic on all rows in one place."""

import math
import random

import numpy as np
import pytest

from crawlgrain.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int, d int"


def frame(spark, rows, schema=SCHEMA):
    extra = [(7, 8, 9, 1)[: len(schema.split(",")) - 2]] * len(rows)
    return spark.createDataFrame([(i, v, *e) for (i, v), e in zip(rows, extra, strict=True)], schema).repartition(5)


def expected(rows):
    """(n, exact x rows, S, covariance as doubles) of the usable rows."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    y = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    v = np.array([[sum(r[a] * r[b] for r in y) / n**3 for b in range(d)] for a in range(d)])
    return good, n, y, v


def random_rows(count, d, seed=11):
    rng = np.random.default_rng(seed)
    turn = rng.normal(size=(d, d))
    return [(i, [float(np.float32(c)) for c in rng.normal(size=d) @ turn + rng.normal()]) for i in range(count)]


@pytest.mark.parametrize("d", [5, 40])
def test_whitening_against_exact_sums(spark, d):
    rows = random_rows(300, d)
    rows += [(0, rows[0][1]), (None, rows[1][1]), (900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("inf")] + [0.0] * (d - 1)), (904, []), (905, [1.0])]
    used, n, y, v = expected([r for r in rows if r[0] != 905])
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    got = whitening.whiten(frame(spark, rows)).collect()
    k = min(d, 32)
    assert len(got) == len(used) * k
    assert {r["n"] for r in got} == {n}
    wanted = {}
    for (i, _), row in zip(used, y, strict=True):
        wanted.setdefault(i, []).append((sum(c * c for c in row), np.array(row) / n @ basis[:, :k] / np.sqrt(values[:k])))
    signs = {}
    for r in got:
        deviation, w = wanted[r["vec_id"]][0]
        assert r["deviation"] == deviation
        c = r["component"] - 1
        if abs(w[c]) > 1e-3:
            signs.setdefault(c, set()).add(r["whitened"] * w[c] > 0)
        assert abs(r["whitened"]) == pytest.approx(abs(w[c]), abs=1e-8)
        assert r["explained"] == pytest.approx(values[c] / np.trace(v), rel=1e-9)
        assert r["identity_error"] < 1e-9
    assert all(len(s) == 1 for s in signs.values())
    assert sum(r["vec_id"] is None for r in got) == k


def test_residues_give_back_any_integer():
    random.seed(3)
    chosen = whitening.primes(2 * 10**40)
    product = math.prod(chosen)
    wanted = np.array([[random.randint(-(10**40), 10**40) for _ in range(4)] for _ in range(4)] + [[0, 10**40, -(10**40), -1]], object)
    assert product > 2 * 10**40 and all(all(p % q for q in range(2, int(p**0.5) + 1)) for p in chosen)
    back = whitening.remainders_to_integers({p: (wanted % p).astype(np.int64) for p in chosen})
    assert (back == wanted).all()


def test_scatter_is_exact_beyond_a_long(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=3) * 10.0 ** rng.integers(-3, 14)]) for i in range(200)]
    df = frame(spark, rows, "vec_id long, embedding array<double>, label int, n long, component int, d int")
    usable = whitening._usable(df.select("vec_id", "embedding"))
    centre = whitening._centre(usable, 3)
    x = [[math.floor(64 * c) + 1000000 for c in v] for _, v in rows]
    sums = [sum(r[j] for r in x) for j in range(3)]
    y = [[200 * r[j] - sums[j] for j in range(3)] for r in x]
    assert list(centre.sums) == sums and centre.n == 200
    scatter = whitening.exact_scatter(usable, 3, centre)
    assert scatter.tolist() == [[sum(r[a] * r[b] for r in y) for b in range(3)] for a in range(3)]
    assert max(map(abs, scatter.ravel())) > 1 << 90
    assert all(r["deviation"] is None or r["deviation"] < 1 << 63 for r in whitening.whiten(df).collect())


def test_constant_dependent_and_huge_dimensions(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0, (-1.0) ** i]) for i in range(50)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 200
    by = {c: [r for r in got if r["component"] == c] for c in (1, 2, 3, 4)}
    assert all(r["whitened"] is None for c in (3, 4) for r in by[c])
    assert all(r["whitened"] is not None and r["identity_error"] < 1e-9 for c in (1, 2) for r in by[c])
    huge = whitening.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>, label int, n long, component int, d int")).collect()
    assert len(huge) == 6 and all(r["identity_error"] < 1e-4 for r in huge)
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).collect()[0]["whitened"] is None
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []
    empty = whitening.whiten(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
