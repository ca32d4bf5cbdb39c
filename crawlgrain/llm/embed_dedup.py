"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells, one kept per group.

Equal vectors are one class. Centroids are fitted on at most SAMPLE classes; every class is then
assigned to its nearest cell and visits those cells whose border it is close to, so that links
across a border are found as well. A large cell is cut into blocks, and each pair of blocks is one
task. A task returns counts and a spanning forest of its links, never the links themselves.

How close counts: a vector y with cosine t to x differs from t*x by sqrt(1-t*t) in a direction that is
as good as any of the d orthogonal ones, so along the normal of a border by about sqrt((1-t*t)/d).
MARGIN_SIGMAS of these are allowed for; a link is missed only if x, too, is near the border and y is
farther beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrain.llm.common import materialize, only
from crawlgrain.llm.components import connected_components

COSINE = 0.9
#: Classes that centroids are fitted on, vectors of a cell on average, most cells, vectors of a block.
SAMPLE, CELL, MOST_CELLS, BLOCK = 16384, 512, 2048, 2048
MARGIN_SIGMAS = 3.0


def _finite(column: str):
    good = F.col(column).isNotNull() & (F.size(column) > 0)
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return good & F.forall(column, number) & F.exists(column, lambda v: v != 0)


def _scaled(vec: Column) -> Column:
    """vec, or where its largest component is out of 1e-100 to 1e100, vec times a power of two that brings it near 1."""
    most = F.array_max(F.transform(vec, F.abs))
    half = F.pow(F.lit(2.0), -F.floor(F.log2(most) / 2))
    return F.when((most > 0) & (most < float("inf")) & ~most.between(1e-100, 1e100), F.transform(vec, lambda v: v * half * half)).otherwise(vec)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k unit centroids of the unit rows of x; an empty cell keeps its centroid."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        cell = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        norms = np.linalg.norm(sums, axis=1)
        moved = norms > 1e-12
        centroids[moved] = sums[moved] / norms[moved, None]
    return centroids


def fit_cells(classes: DataFrame) -> dict[int, np.ndarray]:
    """Centroids by dimension, fitted on the SAMPLE classes whose ids have the smallest hashes."""
    n = classes.count()
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").toPandas()["vec"]
    by_size: dict[int, list] = {}
    for v in rows:
        by_size.setdefault(len(v), []).append(v)
    out = {}
    for d, vectors in by_size.items():
        x = np.array(vectors, np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        share = n * len(vectors) / len(rows)
        out[d] = spherical_kmeans(x, int(np.clip(share / CELL, 1, min(MOST_CELLS, max(1, len(x) // 4)))))
    return out


def _assign(classes: DataFrame, cells: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """(d, cell, rep, size, home, visits, vec): each class in its own cell, home, and in those that it visits, one bit each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lengths = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
                for d in np.unique(lengths).tolist():
                    part = batch.filter(pa.array(lengths == d))
                    x = part.column("vec").flatten().to_numpy().reshape(-1, d)
                    if d in cells:
                        c = cells[d]
                        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                        near = unit @ c.T
                        home = near.argmax(1)
                        apart = np.sqrt(np.maximum(2 - 2 * c[home] @ c.T, 0))
                        gap = (near[np.arange(len(x)), home][:, None] - near) / np.maximum(apart, 1e-12)
                        visits = gap <= MARGIN_SIGMAS * np.sqrt((1 - cosine * cosine) / d)
                        visits[np.arange(len(x)), home] = True
                    else:
                        visits, home = np.ones((len(x), 1), bool), np.zeros(len(x), int)
                    bits = [v.tobytes() for v in np.packbits(visits, axis=1)]
                    row, cell = np.nonzero(visits)
                    taken = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), d), pa.int32()), pa.array(cell, pa.int32()), taken.column("rep"), taken.column("size"), pa.array(home[row], pa.int32()), pa.array([bits[k] for k in row], pa.binary()), taken.column("vec")],
                        names=["d", "cell", "rep", "size", "home", "visits", "vec"],
                    )

    return classes.select("rep", "size", "vec").mapInArrow(run, "d int, cell int, rep long, size long, home int, visits binary, vec array<double>")


def block_links(table: pa.Table, cosine: float) -> pa.Table:
    """Of one pair of blocks: (a, null, links of a) for each home row and each visitor whose own cell the
    home row doesn't visit, so that both ends of a pair count it once, and forest edges (a, b, 0)."""
    role = table.column("role").to_numpy()
    rep, size = table.column("rep").to_numpy(), table.column("size").to_numpy()
    vec = table.column("vec").combine_chunks()
    vec = (vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec).flatten().to_numpy().reshape(table.num_rows, -1)
    norm = np.linalg.norm(vec, axis=1)
    h, o = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    home = table.column("home").to_numpy()
    visits = np.unpackbits(np.frombuffer(b"".join(table.column("visits").to_pylist()), np.uint8).reshape(table.num_rows, -1), axis=1)
    visitor = home[o] != table.column("cell")[0].as_py()
    counts, rows, columns, unseen = [], [], [], np.zeros(o.size, np.int64)
    for at in range(0, h.size, 256):
        part = h[at : at + 256]
        linked = (vec[part] @ vec[o].T) / (norm[part][:, None] * norm[o][None, :]) >= cosine
        linked &= rep[part][:, None] != rep[o][None, :]
        counts.append(linked.astype(np.int64) @ size[o])
        i, j = np.nonzero(linked)
        far = visitor[j]
        far[far] = visits[part[i[far]], home[o[j[far]]]] == 0
        np.add.at(unseen, j[far], size[part[i[far]]])
        rows.append(part[i])
        columns.append(o[j])
    a, b = np.concatenate([*rows, np.zeros(0, int)]), np.concatenate([*columns, np.zeros(0, int)])
    names, of = np.unique(rep, return_inverse=True)  # a row may stand here in both roles
    a, b = of[a], of[b]
    u, v = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(u, kind="stable")
    u, v = u[order], v[order]
    starts = np.flatnonzero(np.diff(u, prepend=-1))
    label = np.arange(names.size)
    while u.size:
        least = label.copy()
        least[u[starts]] = np.minimum(least[u[starts]], np.minimum.reduceat(label[v], starts))
        least = least[least]
        if (least == label).all():
            break
        label = least
    joined = np.flatnonzero(label != np.arange(names.size))
    counted = np.flatnonzero(unseen)
    home_counts = np.concatenate([*counts, unseen[counted]])
    return pa.table(
        {
            "a": pa.array(np.concatenate([rep[h], rep[o[counted]], names[joined]]), pa.int64()),
            "b": pa.array([None] * (h.size + counted.size) + names[label[joined]].tolist(), pa.int64()),
            "n": pa.array(np.concatenate([home_counts, np.zeros(joined.size, np.int64)]), pa.int64()),
        }
    )


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    as do vectors of different lengths, and rows with a null vec_id, whose component_id is null. Very small and very large
    vectors are scaled by powers of two, so that no product of norms vanishes or overflows. Equal vectors are linked; rows of one vec_id count as rows.
    Links are those found (recall is measured in the tests); none is below the threshold. Other
    columns are not read. An empty table gives an empty table.
    """
    rows = only(embeddings, vec_id="long", embedding="array<double>")
    rows = rows.withColumn("vec", _scaled(F.transform("embedding", lambda v: v + F.lit(0.0))))  # -0.0 and 0.0 are one
    keyed = rows.withColumn("key", F.when(F.col("vec_id").isNotNull() & _finite("vec"), F.sha2(F.array_join(F.transform("vec", lambda v: v.cast("string")), ","), 256)))
    classes = materialize(
        keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.min("vec").alias("vec")), "embed-classes"
    )
    cells = fit_cells(classes)
    placed = materialize(_assign(classes, cells, cosine), "embed-cells")
    sizes = placed.groupBy("d", "cell").agg(F.count("*").alias("n"), F.count_if(F.col("home") == F.col("cell")).alias("n_home"))  # MOST_CELLS rows for each length at most
    rows = placed.join(sizes, ["d", "cell"])
    # home rows of block i meet all rows of block j; a cell has one home block unless it is large
    blocks, home_blocks = (F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int") for c in ("n", "n_home"))
    own, own_home = (F.pmod(F.xxhash64("rep"), b).cast("int") for b in (blocks, home_blocks))
    as_other = F.transform(F.sequence(F.lit(0), home_blocks - 1), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(2).alias("role")))
    as_home = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(own_home.alias("i"), j.alias("j"), F.lit(1).alias("role")))
    at_home = F.col("home") == F.col("cell")
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(at_home, 3).otherwise(2).alias("role")))
    to = F.when(blocks == 1, alone).when(at_home, F.concat(as_other, as_home)).otherwise(as_other)
    tasks = rows.withColumn("to", F.explode(to)).select("d", "cell", "to.i", "to.j", "to.role", "rep", "size", "home", "visits", "vec")
    # a plain function of the table: the group's key is in its columns
    found = materialize(
        tasks.groupBy("d", "cell", "i", "j").applyInArrow(lambda table: block_links(table, cosine), "a long, b long, n long"), "embed-links"
    )
    counts = materialize(found.where("b is null").groupBy("a").agg(F.sum("n").alias("others")), "embed-counts")
    comps = connected_components(found.where("b is not null").select("a", "b"))
    known = classes.join(counts, classes.rep == counts.a, "left").drop("a").join(comps, F.col("rep") == comps.id, "left")
    known = materialize(known.select("key", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("comp")), "embed-known")
    out = keyed.select("vec_id", "key").join(known, "key", "left")
    comp = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(False)).alias("kept"))
