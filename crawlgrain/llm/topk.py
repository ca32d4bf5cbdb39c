"""Exact top-k by inner product: an index of pivot distances, read ring by ring until the triangle inequality ends it.

Inner products become distances with one more coordinate: v goes to (v, sqrt(M^2 - |v|^2)), M the greatest norm, a query q to (q, 0).
Then |q - v|^2 = |q|^2 + M^2 - 2<q, v>, so the greatest product is the nearest vector. Each vector is keyed by its nearest
pivot and its distance to it, sorted, and cut into rings of about RING rows. For a vector v in a ring [low, high] of pivot p

    |q - v| >= max(low - |q - p|, |q - p| - high, (|q - p| - |q - p'|) / 2),

p' being the query's nearest pivot (v is no nearer to p' than to p). A query first reads rings of its own cell; the k-th best
product so far is a distance, and only rings whose bound doesn't exceed it are read, nearest bounds first and more in each
round, until none is left. Bounds are floating point with a margin; products are integers and exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlgrain.llm.common import drop_table, materialize, only

SCALE, EVERY, K = 256.0, 50, 5
#: Vectors that pivots are fitted on, vectors of a cell on average, most pivots; rows of a ring and queries of a task at most (about).
SAMPLE, CELL, MOST_PIVOTS, RING, QUERIES = 8192, 512, 1024, 2048, 1024
#: Rings that a query reads at home, and in the rounds after: FIRST, then GROWTH times as many each time.
HOME, FIRST, GROWTH = 2, 16, 8
MARGIN = 1e-9


def _numbers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, d, x, key, size): floor(256 * c) of usable vectors; key: a digest of x; size: |x|^2."""
    rows = only(embeddings, vec_id="long", embedding="array<double>")
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", number)
    # no product of two vectors leaves a long
    most = F.least(F.lit(2.0**31 - 1), F.floor(F.sqrt(F.lit(2.0**63 - 4096) / F.size("embedding"))))
    x = F.transform("embedding", lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * SCALE, F.lit(1e18)), F.lit(-1e18))), most), -most).cast("int"))
    rows = rows.where(usable).select("vec_id", F.size("embedding").alias("d"), x.alias("x"))
    size = F.aggregate("x", F.lit(0).cast("long"), lambda acc, c: acc + c.cast("long") * c)
    return rows.withColumn("key", F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")).cast("binary"), 256)).withColumn("size", size)


def fit_pivots(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k means of the rows of x, or fewer."""
    pivots = np.unique(x[np.linspace(0, len(x) - 1, k).astype(int)], axis=0)
    for _ in range(rounds):
        near = ((pivots * pivots).sum(1)[None] - 2 * x @ pivots.T).argmin(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(pivots))
        pivots[n > 0] = sums[n > 0] / n[n > 0, None]
    return pivots


def _lifted(x: np.ndarray, size: np.ndarray, greatest: int | None) -> np.ndarray:
    """Rows of x with their further coordinate; greatest None: queries."""
    more = np.zeros(len(x)) if greatest is None else np.sqrt((greatest - size).astype(np.float64))
    return np.concatenate([x.astype(np.float64), more[:, None]], axis=1)


def _distances(points: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances to all pivots) for a few rows at a time; each the same whatever rows come along."""
    step = max(1, (1 << 21) // pivots.size)
    for at in range(0, len(points), step):
        yield at, np.sqrt(np.square(points[at : at + step, None, :] - pivots[None]).sum(2))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(d, rows, x) for each length of vector in the batch."""
    lengths = batch.column("d").to_numpy()
    for d in np.unique(lengths).tolist():
        part = batch.filter(pa.array(lengths == d))
        yield d, part, part.column("x").flatten().to_numpy().reshape(-1, d)


class Pivots:
    """Pivots and the greatest squared norm for each length of vector."""

    def __init__(self, sample: dict[int, np.ndarray], sizes: dict[int, tuple[int, int]], cell: int):
        self.greatest = {d: m for d, (_, m) in sizes.items()}
        self.at: dict[int, np.ndarray] = {}
        for d, (n, m) in sizes.items():
            if d in sample:
                points = _lifted(sample[d], np.square(sample[d].astype(np.int64)).sum(1), m)
                self.at[d] = fit_pivots(points, int(np.clip(n // cell, 1, min(MOST_PIVOTS, max(1, len(points) // 8)))))
            else:
                self.at[d] = np.zeros((1, d + 1))


def _fit(rows: DataFrame, cell: int) -> Pivots:
    sizes = {r["d"]: (r["n"], r["m"]) for r in rows.groupBy("d").agg(F.count("*").alias("n"), F.max("size").alias("m")).collect()}  # one row for each length
    taken: dict[int, list] = {}
    for x in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "key").limit(SAMPLE).select("x").toPandas()["x"]:
        taken.setdefault(len(x), []).append(x)
    return Pivots({d: np.array(v, np.int64) for d, v in taken.items()}, sizes, cell)


def _index(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """rows with cell, dist and ring: sorted by distance in each cell and cut into rings; a ring is named by its first rid."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, x in _by_length(batch):
                points = _lifted(x, part.column("size").to_numpy(), pivots.greatest[d])
                cell, dist = np.zeros(len(x), np.int32), np.zeros(len(x))
                for at, far in _distances(points, pivots.at[d]):
                    near = far.argmin(1)
                    cell[at : at + len(far)] = near
                    dist[at : at + len(far)] = far[np.arange(len(far)), near]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rid", "vec_id", "d", "x")), pa.array(cell), pa.array(dist)], names=["rid", "vec_id", "d", "x", "cell", "dist"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ring, held = None, 0, 0
        for batch in batches:
            names = np.zeros(batch.num_rows, np.int64)
            rid = batch.column("rid").to_numpy()
            for i, own in enumerate(zip(batch.column("d").to_pylist(), batch.column("cell").to_pylist(), strict=True)):
                if own != last or held == RING:
                    last, ring, held = own, int(rid[i]), 0
                names[i] = ring
                held += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names)], names=[*batch.schema.names, "ring"])

    keyed = rows.select("rid", "vec_id", "d", "x", "size").mapInArrow(assign, "rid long, vec_id long, d int, x array<int>, cell int, dist double")
    ordered = keyed.repartitionByRange("d", "cell", "dist", "rid").sortWithinPartitions("d", "cell", "dist", "rid")
    return ordered.mapInArrow(cut, "rid long, vec_id long, d int, x array<int>, cell int, dist double, ring long")


CELLS = "key string, d int, cell int, far double, half double, reach double"


def _cells(queries: DataFrame, pivots: Pivots, home: bool, spans: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(key, d, cell, far, half, reach) of each query: the nearest of its cells that hold rows, or all that its reach may touch.

    far: distance to the pivot; half: what the nearest pivot alone says of the cell's vectors. queries has key, d, x, size, reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, x in _by_length(batch):
                low, high = spans[d]  # of every cell; inf, -inf where it is empty
                reach = part.column("reach").to_numpy()
                for at, far in _distances(_lifted(x, None, None), pivots.at[d]):
                    near = np.where(low <= high, far, np.inf)
                    half = (far - far.min(1)[:, None]) / 2
                    if home:
                        q, cell = np.arange(len(far)), near.argmin(1)
                    else:
                        least = np.maximum(np.maximum(low - far, far - high), half)
                        q, cell = np.nonzero(np.isfinite(near) & (least <= reach[at : at + len(far), None]))
                    taken = part.take(pa.array(at + q))
                    yield pa.RecordBatch.from_arrays(
                        [taken.column("key"), taken.column("d"), pa.array(cell.astype(np.int32)), pa.array(far[q, cell]), pa.array(half[q, cell]), taken.column("reach")],
                        names=["key", "d", "cell", "far", "half", "reach"],
                    )

    return queries.select("key", "d", "x", "reach").mapInArrow(run, CELLS)


def best_of_ring(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """(key, score, vec_id, rid): the k best rows for each query, ties to smaller vec_id, then rid."""
    out = {"key": [], "score": [], "vec_id": [], "rid": []}
    if queries.num_rows and rows.num_rows:
        rows = rows.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
        q, v = (t.column("x").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (queries, rows))
        fits = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < 2.0**52
        kind = np.float64 if fits else np.int64  # either is exact
        scores = (q.astype(kind) @ v.astype(kind).T).astype(np.int64)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        n = order.shape[1]
        of = order.ravel()
        out = {
            "key": queries.column("key").take(pa.array(np.repeat(np.arange(len(q)), n))),
            "score": np.take_along_axis(scores, order, 1).ravel(),
            "vec_id": rows.column("vec_id").take(pa.array(of)),
            "rid": rows.column("rid").take(pa.array(of)),
        }
    return pa.table(out, schema=pa.schema([("key", pa.string()), ("score", pa.int64()), ("vec_id", pa.int64()), ("rid", pa.int64())]))


def _read(visits: DataFrame, queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """The best of each visited ring for each visitor. A ring's queries are dealt to as many tasks as they need."""
    counts = visits.groupBy("ring").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("tasks"))
    asked = visits.join(counts, "ring").join(queries.select("key", "x"), "key").select("ring", F.pmod(F.xxhash64("key"), "tasks").cast("int").alias("task"), "key", "x")
    held = index.select("ring", "rid", "vec_id", "x").join(counts, "ring").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    best = lambda q, r: best_of_ring(q, r, k)
    return asked.groupBy("ring", "task").cogroup(held.groupBy("ring", "task")).applyInArrow(best, "key string, score long, vec_id long, rid long")


def _kept(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, once each: key, best (array of score, vec_id, rid in order)."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "rid")
    ranked = found.dropDuplicates(["key", "rid"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    best = F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id", "rid")))
    return ranked.groupBy("key").agg(F.transform(best, lambda b: F.struct(b["score"].alias("score"), b["vec_id"].alias("vec_id"), b["rid"].alias("rid"))).alias("best"))


def _reach(k: int) -> Column:
    """The distance of the k-th best, with the margin; infinite for fewer."""
    big = lambda c: F.col(c).cast("decimal(38,0)") if isinstance(c, str) else c.cast("decimal(38,0)")
    square = (big("size") + big("greatest") - F.lit(2) * big(F.element_at("best", k)["score"])).cast("double")
    margin = MARGIN * (F.sqrt(F.col("size").cast("double")) + F.sqrt(F.col("greatest").cast("double")) + 1)
    return F.when(F.size("best") >= k, F.sqrt(F.greatest(square, F.lit(0.0))) + margin).otherwise(F.lit(float("inf")))


def search(embeddings: DataFrame, every: int = EVERY, k: int = K, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by every, the k rows with the highest inner product
    of floor(256 * x), its own row left out, ties to the smaller vec_id; all rows if there are fewer.

    embeddings: vec_id, embedding; other columns are not read. Rows with a null vec_id, or whose embedding is null, empty or holds a null,
    NaN or infinite component, take no part. Vectors meet those of their own length only. A repeated row is a candidate each time, and
    a query each time: rows with equal vec_id are told apart, and one's twin may be its best match. Numbers too large for products to fit a long
    (beyond 2^31 - 1, or the root of 2^63 by the length) count as the largest that do. An empty table gives an empty one.

    Of equal vectors only the k + 1 smallest ids can be among the best, and equal queries share one search, so a group of copies of any
    size costs no more than k + 1 rows. Every other vector is in the index.
    """
    rows = _numbers(embeddings)
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "topk-rows")
    top = k + 1  # the row itself may be among them
    order = Window.partitionBy("key").orderBy("vec_id", "rid")
    candidates = rows.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= top).drop("copy")
    pivots = _fit(rows, cell)
    index = materialize(_index(candidates, pivots), "topk-index")
    rings = materialize(index.groupBy("ring").agg(F.first("d").alias("d"), F.first("cell").alias("cell"), F.min("dist").alias("low"), F.max("dist").alias("high")), "topk-rings")
    spans = {d: (np.full(len(p), np.inf), np.full(len(p), -np.inf)) for d, p in pivots.at.items()}
    for r in rings.groupBy("d", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():  # MOST_PIVOTS for each length at most
        spans[r["d"]][0][r["cell"]], spans[r["d"]][1][r["cell"]] = r["low"], r["high"]
    asking = rows.where(F.col("vec_id") % every == 0)
    greatest = F.element_at(F.create_map(*(F.lit(v) for d, m in (pivots.greatest or {0: 0}).items() for v in (d, m))), F.col("d"))
    queries = asking.groupBy("key").agg(*(F.first(c).alias(c) for c in ("d", "x", "size"))).withColumn("greatest", greatest)
    queries = materialize(queries, "topk-queries")

    # at home: rings of the nearest cell around the query's own distance
    near = _cells(queries.withColumn("reach", F.lit(float("inf"))), pivots, True, spans).join(rings, ["d", "cell"])
    gap = F.greatest(F.col("low") - F.col("far"), F.col("far") - F.col("high"), F.lit(0.0))
    at_home = Window.partitionBy("key").orderBy(gap, "ring")
    visits = near.withColumn("turn", F.row_number().over(at_home)).where(F.col("turn") <= HOME).select("key", "ring")
    best = materialize(_kept(_read(visits, queries, index, top), top), "topk-best")

    # then every ring whose bound is within reach, the nearest first
    bound = F.greatest(gap, F.col("half"))
    place = F.struct(bound.alias("bound"), F.col("far").alias("far"), F.col("ring").alias("ring"))
    none = F.struct(F.lit(-1.0).alias("bound"), F.lit(0.0).alias("far"), F.lit(0).cast("long").alias("ring"))
    open_ = queries.join(best, "key", "left").withColumn("done", none)
    width = FIRST
    while True:
        open_ = open_.withColumn("reach", _reach(top))
        due = _cells(open_, pivots, False, spans).join(rings, ["d", "cell"]).where(bound <= F.col("reach"))
        due = due.join(open_.select("key", "done"), "key").withColumn("place", place).where(F.col("place") > F.col("done"))
        turn = F.row_number().over(Window.partitionBy("key").orderBy("place"))
        visits = materialize(due.withColumn("turn", turn).where(F.col("turn") <= width).select("key", "ring", "place"), "topk-visits")
        if visits.isEmpty():
            drop_table(visits)
            break
        old = best.select("key", F.explode("best").alias("b")).select("key", "b.score", "b.vec_id", "b.rid")
        better = materialize(_kept(_read(visits.select("key", "ring"), queries, index, top).unionByName(old), top), "topk-best")
        drop_table(best)
        best = better
        # a query that read less than it was allowed has no ring left
        again = visits.groupBy("key").agg(F.max("place").alias("done"), F.count("*").alias("n")).where(F.col("n") == width).drop("n")
        open_ = materialize(queries.join(again, "key").join(best, "key", "left"), "topk-open")
        drop_table(visits)
        width *= GROWTH
    for table in (index, rings):
        drop_table(table)
    others = F.filter("best", lambda b: b["rid"] != F.col("own"))
    out = asking.select("key", F.col("vec_id").alias("query_id"), F.col("rid").alias("own")).join(best, "key").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
