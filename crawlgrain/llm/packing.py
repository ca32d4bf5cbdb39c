"""Bulk-synchronous best-fit packing of token sequences.

A round takes the waiting pieces and the gaps in the order of their sizes and sweeps over both: a gap takes the longest
piece that fits and that no smaller gap has taken, as often as it fits, so that every piece goes to the smallest gap it can
get. Pieces that meet at gaps of one size are told apart by rank. Then the gaps are updated, pieces longer than every gap open
sequences, and the next round begins. All pieces that have a gap move in one round, so rounds are few (13 for
256,410 documents) however many documents there are.

A piece has one of `capacity` lengths only, so pieces of a length and gaps of a size are runs:
"rank 400 to 900 of length 17". A round moves runs, not rows: it is a DataFrame of a few thousand rows at most, which doesn't
grow with the number of documents, sorted and swept by one task and written to the shared folder, so a lost executor repeats
one round. The rows stay on the executors; they are ranked within their length by a salted two-step count, and each row finds
its run by a join on (length, block of ranks).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlgrain.llm.bpe import _ENCODERS, SLICE, encoder, pieces_of
from crawlgrain.llm.common import as_bytes, drop_table, materialize, only, slices, spread, tidied

CAPACITY = 2048
SALTS = 256


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut where longer than capacity.

    A null or empty text is end_id alone.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text", SLICE):
            rows: list[list[int]] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode_all(as_bytes(batch.column("text"))), strict=True):
                for piece in pieces_of(ids + end, capacity):
                    for column, value in zip(rows, (doc_id, *piece), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return only(docs, doc_id="long", text="string").mapInArrow(tidied(run, _ENCODERS), "doc_id long, piece int, start long, length long, ids_crc32 long")


#: (length, first rank, number) of waiting pieces, (size, first sequence, number) of gaps.
Run = tuple[int, int, int]


def sweep(waiting: list[Run], gaps: list[Run], sequences: int, capacity: int) -> tuple[list[tuple[int, ...]], list[Run], list[Run], int]:
    """One round: (placements, waiting pieces, gaps, number of sequences) after it.

    A placement (length, first rank, number, first sequence, offset) puts pieces of following ranks into following
    sequences, all at one offset. waiting has one run for each length.
    """
    placed: list[tuple[int, ...]] = []
    after: list[Run] = []
    stack: list[list[int]] = []  # pieces that fit the gaps to come, the longest last
    pieces = sorted(waiting)
    at = 0
    for size, first, n in sorted(gaps):
        while at < len(pieces) and pieces[at][0] <= size:
            stack.append(list(pieces[at]))
            at += 1
        while n and stack:
            length, rank, left = stack[-1]
            times = min(size // length, left)
            taken = min(n, left // times)
            for k in range(times):
                placed.append((length, rank + k * taken, taken, first, capacity - size + k * length))
            if size > times * length:
                after.append((size - times * length, first, taken))
            first, n = first + taken, n - taken
            stack[-1][1:] = rank + times * taken, left - times * taken
            if not stack[-1][2]:
                stack.pop()
        if n:
            after.append((size, first, n))
    # pieces longer than every gap open sequences: each one above half the capacity, else as many as their tokens fill
    largest = max((size for size, _, _ in after), default=0)
    rest = {length: [rank, n] for length, rank, n in [*stack, *pieces[at:]]}
    stuck = [length for length in rest if length > largest]
    opened = sum(rest[x][1] for x in stuck if 2 * x > capacity) or -(-sum(x * rest[x][1] for x in stuck) // capacity)
    for length in sorted(stuck, reverse=True):
        rank, n = rest[length]
        taken = min(n, opened)
        if not taken:
            break
        placed.append((length, rank, taken, sequences, 0))
        if length < capacity:
            after.append((capacity - length, sequences, taken))
        sequences, opened = sequences + taken, opened - taken
        rest[length] = [rank + taken, n - taken]
    return placed, [(x, rank, n) for x, (rank, n) in rest.items() if n], after, sequences


STATE = "kind string, size long, first long, n long, sequence long, offset long"


def _round(capacity: int):
    """A round over the rows of STATE: piece (length, rank, n), gap (size, sequence, n), open (n sequences); placements come out as run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("kind", "size", "first", "n")), strict=True)]
        of = {kind: [tuple(r[1:]) for r in rows if r[0] == kind] for kind in ("piece", "gap", "open")}
        placed, waiting, gaps, sequences = sweep(of["piece"], of["gap"], sum(r[2] for r in of["open"]), capacity)
        out = [("run", *x) for x in placed] + [("piece", *x, 0, 0) for x in waiting] + [("gap", *x, 0, 0) for x in gaps] + [("open", 0, 0, sequences, 0, 0)]
        kinds = [pa.string()] + [pa.int64()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["kind", "size", "first", "n", "sequence", "offset"])

    return run


def plan(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Placements (r_length, r_first, r_n, r_sequence, r_offset) of counts (length, n), after as many rounds as it takes."""
    zero = F.lit(0).cast("long")
    state = counts.select(F.lit("piece").alias("kind"), F.col("length").cast("long").alias("size"), zero.alias("first"), F.col("n").cast("long").alias("n"), zero.alias("sequence"), zero.alias("offset"))
    rounds: list[DataFrame] = []
    while True:
        swept = state.where("kind <> 'run'").coalesce(1).sortWithinPartitions("size", "first")
        state = materialize(swept.mapInArrow(_round(capacity), STATE), "pack-round")
        rounds.append(state)
        if not state.where("kind = 'piece'").limit(1).count():
            break
    runs = reduce(DataFrame.union, (r.where("kind = 'run'").drop("kind") for r in rounds)).coalesce(1)
    found = materialize(runs.toDF("r_length", "r_first", "r_n", "r_sequence", "r_offset"), "pack-plan")
    for done in rounds:
        drop_table(done)
    return found


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset; pieces needs doc_id, piece and length (1 to capacity).

    A piece that fills a sequence has one of its own, with a negative number, and needs no rank. Every row is placed once, repeated rows too. Ties in length go by (doc_id, piece), a null doc_id first. An empty
    table gives an empty table. Null lengths and lengths out of range raise an error.
    """
    whole = F.col("length").eqNullSafe(capacity)
    full = pieces.where(whole).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rows = pieces.where(~whole).withColumn("salt", spread("doc_id", SALTS))
    tally = materialize(rows.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-tally")  # capacity x SALTS rows at most
    if tally.where(F.col("length").isNull() | ~F.col("length").between(1, capacity)).limit(1).count():
        raise ValueError(f"lengths must be from 1 to {capacity}")
    before = tally.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "before")
    placed = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")
    ranked = rows.withColumn("rank", F.row_number().over(placed) - 1).join(before, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")
    runs = plan(tally.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    # each run and each row goes to a block of ranks, so that a common length is no single key
    block = 4096
    runs = runs.withColumn("r_block", F.explode(F.sequence(F.floor(F.col("r_first") / block), F.floor((F.col("r_first") + F.col("r_n") - 1) / block))))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / block))
    inside = (F.col("length") == F.col("r_length")) & (F.col("block") == F.col("r_block")) & (F.col("rank") >= F.col("r_first")) & (F.col("rank") < F.col("r_first") + F.col("r_n"))
    out = ranked.join(runs, inside)
    out = out.withColumn("sequence_id", F.col("r_sequence") + F.col("rank") - F.col("r_first")).withColumn("offset", F.col("r_offset")).drop(
        "r_length", "r_first", "r_n", "r_sequence", "r_offset", "r_block", "block", "rank"
    )
    return out.unionByName(full)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents, null texts as empty ones."""
    return pack(materialize(token_pieces(docs, path, capacity), "pack-pieces"), capacity)
