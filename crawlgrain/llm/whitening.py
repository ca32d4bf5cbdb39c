"""Embedding whitening: an exact scatter matrix by residue numbers, then eigenvectors in double precision.

Entries become integers, so n*x - S (S: sums per dimension) is an integer too and centred without rounding. Each
partition multiplies its rows' residues modulo several primes, in blocks whose sums stay below 2^53, so that a product
of floating point matrices is exact. Sums of residues are added over partitions, and the Chinese remainder theorem
gives the scatter as integers of any size. The primes are chosen so that their product exceeds what the scatter can reach.

The covariance goes through eigh twice: as it is in double precision, and then, from the exact integers in longer floats, rotated
into the first eigenvectors, which takes the first one's rounding out of components with small eigenvalues.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrain.llm.common import only

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
#: Entries beyond are taken as this, so that each is a whole number that a double holds exactly.
LARGEST = 1 << 53
#: Rows of a block: residues lie within 2^19 of zero, so a sum of 2^14 products stays below 2^53.
BLOCK, PRIME_BITS = 1 << 13, 20
#: An eigenvalue below this share of the greatest counts as zero.
ZERO = 1e-13


def primes(least_product: int) -> list[int]:
    """Primes below 2^PRIME_BITS, greatest first, with a product above least_product."""
    sieve = np.ones(1 << PRIME_BITS, bool)
    sieve[:2] = False
    for i in range(2, 1 << (PRIME_BITS // 2)):
        if sieve[i]:
            sieve[i * i :: i] = False
    out, product = [], 1
    for p in np.flatnonzero(sieve)[::-1].tolist():
        if product > least_product:
            break
        out.append(p)
        product *= p
    return out


def remainders_to_integers(residues: dict[int, np.ndarray]) -> np.ndarray:
    """The integers (object array) nearest to zero that leave these residues modulo each prime."""
    product = 1
    for p in residues:
        product *= p
    total = 0
    for p, r in residues.items():
        rest = product // p
        total = total + r.astype(object) * (rest * pow(rest, -1, p))
    total = total % product
    return np.where(total > product // 2, total - product, total)


def _usable(rows: DataFrame) -> DataFrame:
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", number))


def _integers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """x = floor(64 * c) + 1000000 of each entry, as rows."""
    c = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(SCALE * c), -LARGEST, LARGEST - SHIFT).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


@dataclass(frozen=True)
class Centre:
    """Rows, sums per dimension, the greatest |n*x - S| and the greatest |x|."""

    n: int
    sums: tuple[int, ...]
    reach: int
    largest: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact: int64 where it fits, else Python integers."""
        fits = self.n * self.largest < 1 << 62  # |S| is no greater, so the difference fits too
        return self.n * (x if fits else x.astype(object)) - np.array(self.sums, np.int64 if fits else object)


def _centre(rows: DataFrame, d: int) -> Centre | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, np.zeros(d, object), None, None
        for batch in _blocks(batches):
            x = _integers(batch, d)
            n += len(x)
            total = total + x.sum(0, dtype=object) if np.abs(x).max() > 1 << 49 else total + x.sum(0).astype(object)
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_pydict(
                {"dim": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "total": [str(v) for v in total], "low": low, "high": high}
            )

    parts = rows.mapInArrow(run, "dim int, n long, total string, low long, high long")
    found = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    each = sorted(found.collect())  # one row for each dimension
    if not each:
        return None
    n = each[0]["n"]
    sums = tuple(int(r["total"]) for r in each)
    reach = max(max(abs(n * r["low"] - s), abs(n * r["high"] - s)) for r, s in zip(each, sums, strict=True))
    return Centre(n, sums, reach, max(max(abs(r["low"]), abs(r["high"])) for r in each))


def _residues(y: np.ndarray, p: int) -> np.ndarray:
    r = np.mod(y, p).astype(np.int64)
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def exact_scatter(rows: DataFrame, d: int, centre: Centre) -> np.ndarray:
    """Sum over rows of (n*x - S)(n*x - S)^T, as Python integers."""
    chosen = primes(2 * centre.n * centre.reach**2 + 1)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {p: np.zeros((d, d), np.int64) for p in chosen}
        some = False
        for batch in _blocks(batches):
            some = True
            y = centre.centred(_integers(batch, d))
            for p in chosen:
                r = _residues(y, p)
                sums[p] = (sums[p] + (r.T @ r).astype(np.int64)) % p
        for p in chosen if some else []:
            yield pa.RecordBatch.from_arrays([pa.array([p] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(sums[p].tolist(), pa.list_(pa.int64()))], names=["prime", "i", "row"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(d, np.int64)
        for chunk in table.column("row").chunks:
            total += chunk.flatten().to_numpy().reshape(-1, d).sum(0)
        p = table.column("prime")[0].as_py()
        return pa.table({"prime": pa.array([p], pa.int32()), "i": table.column("i").slice(0, 1), "row": pa.array([(total % p).tolist()], pa.list_(pa.int64()))})

    schema = "prime int, i int, row array<long>"
    reduced = rows.mapInArrow(multiply, schema).groupBy("prime", "i").applyInArrow(add, schema)
    residues = {p: np.zeros((d, d), np.int64) for p in chosen}
    for r in reduced.collect():  # d rows of d numbers for each prime, whatever the number of vectors
        residues[r["prime"]][r["i"]] = r["row"]
    return remainders_to_integers(residues)


def _long_doubles(m: np.ndarray, unit: int) -> np.ndarray:
    """m / unit, each quotient as the sum of two doubles."""
    high = np.array([[int(v) / unit for v in row] for row in m])
    low = [[(int(v) * b - a * unit) / (unit * b) for v, (a, b) in zip(row, (h.as_integer_ratio() for h in near), strict=True)] for row, near in zip(m, high.tolist(), strict=True)]
    return high.astype(np.longdouble) + np.array(low, np.longdouble)


def eigen(scatter: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, falling; unit eigenvectors as columns; trace) of scatter / n^3."""
    v = _long_doubles(scatter, n**3)
    trace = sum(int(scatter[i, i]) for i in range(len(scatter))) / n**3
    _, u = np.linalg.eigh(v.astype(np.float64))
    turned = (u.T.astype(np.longdouble) @ v @ u).astype(np.float64)
    e, q = np.linalg.eigh((turned + turned.T) / 2)
    u = u @ q
    u /= np.linalg.norm(u, axis=0)
    order = np.argsort(-e, kind="stable")
    return e[order], u[:, order], trace


def _common_length(rows: DataFrame) -> int | None:
    found = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else None


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable vector and component.

    vectors: vec_id, embedding; other columns are not read. Rows whose embedding is null, empty or holds a null, NaN or
    infinite entry are left out. So are those of another length than the commonest one (the greater of two equally
    common), since a scatter needs one length. A repeated row counts each time and is returned each time; a null vec_id stays null.
    With fewer dimensions than components there are as many components as dimensions. A component whose
    eigenvalue is zero (constant or dependent dimensions, one row) can't be scaled: its whitened is null, and identity_error
    is over the others, null if there is none; explained is null where the trace is zero. Entries beyond 2^53 / 64 in size count as that. A deviation
    that no long holds is null. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = _usable(only(vectors, vec_id="long", embedding="array<double>"))
    d = _common_length(rows)
    if d is None:
        return spark.createDataFrame([], OUT)
    rows = rows.where(F.size("embedding") == d)
    centre = _centre(rows, d)
    values, vectors_, trace = eigen(exact_scatter(rows, d, centre), centre.n)
    k = min(components, d)
    e = values[:k]
    live = e > ZERO * max(float(values[0]), 0.0) if values[0] > 0 else np.zeros(k, bool)
    turn = vectors_[:, :k][:, live] / np.sqrt(e[live])
    explained = [float(v) / trace for v in np.maximum(e, 0.0)] if trace > 0 else [None] * k
    n = centre.n

    def projected(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        y = centre.centred(_integers(batch, d))
        return y, (y / n).astype(np.float64) @ turn

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows, means and centred products of a partition, merged block by block
        m, mean, products = 0, np.zeros(turn.shape[1]), np.zeros((turn.shape[1],) * 2)
        for batch in _blocks(batches):
            w = projected(batch)[1]
            own = w.mean(0)
            w = w - own
            apart, both = own - mean, m + len(w)
            products += w.T @ w + np.outer(apart, apart) * (m * len(w) / both)
            mean = mean + apart * (len(w) / both)
            m = both
        if m:
            yield pa.RecordBatch.from_pydict({"m": [m], "mean": [mean.tolist()], "products": [products.ravel().tolist()]})

    def merge(table: pa.Table) -> pa.Table:
        m, mean, products = 0, np.zeros(turn.shape[1]), np.zeros(turn.shape[1] ** 2)
        for r in table.to_pylist():
            apart, both = np.array(r["mean"]) - mean, m + r["m"]
            products = products + np.array(r["products"]) + np.outer(apart, apart).ravel() * (m * r["m"] / both)
            mean, m = mean + apart * (r["m"] / both), both
        return pa.table({"m": [m], "mean": [mean.tolist()], "products": [products.tolist()]})

    error = None
    if live.any():
        schema = "m long, mean array<double>, products array<double>"
        spread = rows.mapInArrow(moments, schema).withColumn("part", F.spark_partition_id() % 64)
        some = spread.groupBy("part").applyInArrow(lambda table: merge(table.drop_columns("part")), schema)
        whole = merge(some.toArrow())  # 64 rows at most
        products = np.array(whole.column("products")[0].as_py()).reshape(turn.shape[1], -1)
        error = float(np.abs(products / n - np.eye(turn.shape[1])).max())

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            y, w = projected(batch)
            m = len(y)
            small = d * centre.reach**2 < 1 << 62
            square = (y * y).sum(1) if small else (y.astype(object) ** 2).sum(1)
            deviation = pa.array([v if v < 1 << 63 else None for v in square.tolist()], pa.int64())
            out = np.zeros((m, k))
            out[:, live] = w
            which = pa.array(np.repeat(np.arange(m), k))
            dead = np.tile(~live, m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(which), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                    deviation.take(which), pa.array(out.ravel(), mask=dead), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(apply, OUT)
