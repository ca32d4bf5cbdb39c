"""N-gram Jaccard self-join by parity sketches.

A document's shingles are hashed into the blocks of a sketch, and a block is the XOR of the 64-bit hashes of
all shingles in it. A shingle that only one of two documents has changes one block at most, so the number of blocks
in which two sketches differ (their Hamming distance in blocks) is at most the size of the symmetric difference
of the sets. Documents of n and m shingles that link have a symmetric difference of at most D = (n + m) / 7, so of any
D + 1 blocks of one that aren't empty, one is the same in the other (pigeonhole).

* Sketches have as many blocks as their size band says, and two sketches are compared in one band only. A band goes
  from a size to four times that size; a document is sketched in its own band, and in the one below if it may link with a smaller
  document there. Bands below LEAST_BAND shingles have 2^32 blocks, others two or four for each shingle of the least size.
* Blocks are taken in one order for all: those that hold frequent shingles only come last, of the others those with more
  shingles first. Both sketches of a link have a block in common among their first D + 1 in this order, D being the most that a
  partner in the band allows. (band, block, bits) is the join key. A document would have too few blocks for that
  if nearly all its shingles fell into a third of them: probability under 1e-50.
* Bit sketches, the same idea with bits for blocks and at least two bits a shingle, are compared by Hamming distance: a
  pair that differs in more bits than two linked sets of their sizes may is dropped before its sets are read.

Documents with equal sets are one class. Keys first give stars (every class of a key with the
smallest one), which are verified; then only keys that still hold several components are searched
for links between components, in blocks. A block with many pairs gives a forest of them, and is searched again when
components have grown by its links, until few pairs are left or none of the forest links; then all go out.
Verification counts the common shingles of both sets.
A key of frequent shingles, such as those of a large group of copies, is dealt out with a salt: the parts have a star each, and their
centres make one more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrain.llm.common import as_bytes, drop_table, free, int_list, materialize, mix64, only, shingle_sets, slices, tidied
from crawlgrain.llm.components import connected_components

#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 75
FOLD = 1024
#: Bits of the sketches that go through the search between components, at most.
WIDEST = 16384
#: Bits of the table that keeps texts which no pair needs out of a shuffle: FILTER_EACH for an id, but within these bounds (16 MB broadcast at most).
FILTER_EACH, LEAST_FILTER, MOST_FILTER = 16, 1 << 20, 1 << 27
#: Frequent shingles are those whose bucket (of BUCKETS) one task sees in one of COMMON of its documents.
BUCKETS, COMMON, LEAST_SEEN = 1 << 20, 256, 32
#: A size band goes from a size to BAND times that size; below LEAST_BAND shingles there is one.
BAND, LEAST_BAND = 4, 64
#: Parts that a key of frequent shingles is dealt out to.
SALTS = 64
#: Rows of a block in the search between components; pairs for each of them that go out at once.
BLOCK, FEW = 1024, 4


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, "text"):
        yield batch, shingle_sets(as_bytes(batch.column("text")))


def fold(bits: np.ndarray, width: int = FOLD) -> np.ndarray:
    """The parity sketch of width bits (a power of 2, 64 at least), as words."""
    odd = np.bincount((bits & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def width_for(n: int) -> int:
    """Bits of the bit sketch of n shingles: two a shingle at least."""
    return max(FOLD, 1 << (2 * n - 1).bit_length()) if n else FOLD


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    """Distance of two sketches; the wider one is folded to the width of the other."""
    while a.size > b.size:
        a = a[: a.size // 2] ^ a[a.size // 2 :]
    while b.size > a.size:
        b = b[: b.size // 2] ^ b[b.size // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def band_of(n: np.ndarray) -> np.ndarray:
    """0 below LEAST_BAND shingles, then 1 up to BAND times that, and so on."""
    band, edge = np.zeros(n.size, np.int64), LEAST_BAND
    while (n >= edge).any():
        band += n >= edge
        edge *= BAND
    return band


def blocks_of(band: np.ndarray) -> np.ndarray:
    """Blocks of the sketches of a band."""
    least = LEAST_BAND * BAND ** np.maximum(band - 1, 0)
    return np.where(band == 0, 1 << 32, np.where(band == 1, 4, 2) * least).astype(np.uint64)


def block_keys(sets: list[np.ndarray], often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the set, join key, whether its block has frequent shingles only) for the blocks that each sorted set is joined by."""
    n = np.array([x.size for x in sets], np.int64)
    found = []
    for below in (False, True):
        band = band_of(n) - below
        edge = LEAST_BAND * BAND ** np.maximum(band, 0)  # above the sizes of this band
        # own band: partners up to 4/3 n; band below: partners smaller than its edge, if 3/4 n is
        use = (n > 0) & (band >= 0) & (~np.bool_(below) | (PERCENT * n <= 100 * (edge - 1)))
        most = ((100 - PERCENT) * (n + np.where(below, edge - 1, 100 * n // PERCENT)) // (100 + PERCENT)) + 1
        at = np.flatnonzero(use)
        if not at.size:
            continue
        x = np.concatenate([sets[k] for k in at.tolist()])
        of = np.repeat(at, n[at])
        block = ((x >> np.uint64(32)) * blocks_of(band)[of]) >> np.uint64(32)
        first = np.ones(x.size, bool)
        first[1:] = (block[1:] != block[:-1]) | (of[1:] != of[:-1])
        starts = np.flatnonzero(first)
        loads = np.diff(np.append(starts, x.size))
        bits = np.bitwise_xor.reduceat(mix64(x + np.uint64(0x9E3779B97F4A7C15)), starts)
        rare = ~np.logical_and.reduceat(often[(x & np.uint64(BUCKETS - 1)).astype(np.int64)], starts)
        of, block = of[starts], block[starts]
        key = mix64(mix64(bits) + block * np.uint64(64) + band[of].astype(np.uint64))
        order = np.lexsort((key, -loads, ~rare, of))
        of = of[order]
        rank = np.arange(of.size) - np.searchsorted(of, of)
        kept = order[rank < most[of]]
        found.append((of[rank < most[of]], key[kept], ~rare[kept]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k1, k2, sketch, wide, often): set size, a 128-bit digest of the set, bit sketches (wide is null where it is the same).

    A task ends with one row of nulls but for often, the buckets of its frequent shingles. They set the order of blocks, never the result.
    """
    names = ["doc_id", "n", "k1", "k2", "sketch", "wide", "often"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs_seen = np.zeros(BUCKETS, np.int32), 0
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
        for batch, sets in _batches(batches):
            docs_seen += batch.num_rows
            n = np.array([x.size for x in sets], np.int64)
            every = np.concatenate(sets)
            np.add.at(seen, (every & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
            ends = np.cumsum(n)
            sums = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(every ^ np.uint64(salt)), dtype=np.uint64)]) for salt in (0, 0xA5A5A5A5A5A5A5A5))
            k1, k2 = ((x[ends] - x[ends - n]).view(np.int64) for x in sums)
            wide = [fold(x, width_for(x.size)) for x in sets]
            cut = [w if 64 * w.size <= WIDEST else fold(x, WIDEST) for w, x in zip(wide, sets, strict=True)]
            columns = [batch.column("doc_id"), n, k1, k2, [x.tobytes() for x in cut], [None if w is c else w.tobytes() for w, c in zip(wide, cut, strict=True)], [None] * n.size]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        most = max(LEAST_SEEN, docs_seen / COMMON + 8 * seen.sum(dtype=np.int64) / BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([None if k < 6 else np.flatnonzero(seen >= most)], kind) for k, kind in enumerate(kinds)], names=names)

    return docs.mapInArrow(tidied(run), "doc_id long, n int, k1 long, k2 long, sketch binary, wide binary, often array<int>")


def join_keys(docs: DataFrame, flags: np.ndarray) -> DataFrame:
    """(key, salt, id): the join keys of every document; salt is 0 unless the key is of frequent shingles.

    A class that this task has seen gives no more keys: its documents are known as copies by their digests.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(flags))  # BUCKETS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(shared.value).astype(bool)
        seen: set[bytes] = set()
        for batch, sets in _batches(batches):
            ids = batch.column("doc_id").to_numpy()
            for k, x in enumerate(sets):
                mark = x.tobytes() if x.size < 2 else mix64(x).sum(dtype=np.uint64).tobytes() + x[:1].tobytes()
                if mark in seen:
                    sets[k] = x[:0]
                elif len(seen) < 1 << 18:
                    seen.add(mark)
            of, key, frequent = block_keys(sets, often)
            salt = np.where(frequent, 1 + (mix64(ids[of].astype(np.uint64)) % np.uint64(SALTS)).astype(np.int16), 0)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(salt, pa.int16()), pa.array(ids[of])], names=["key", "salt", "id"])

    return docs.mapInArrow(tidied(run), "key long, salt short, id long")


def _group_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, salt, id) sorted so: (gid, salted, rep, ids) for keys with two ids or more, and for every salt of a salted key.

    Keys without a salt that have the same few ids are one group. Ids of a long group come in several rows with its first id.
    """
    most = 4096
    seen: set[int] = set()
    going: tuple[int, int, int] | None = None  # key, salt and first id of a group that has been put out in part
    key, salt, ids = np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.int64)

    def groups(starts: np.ndarray, end: int, all_in: bool) -> Iterator[pa.RecordBatch]:
        nonlocal going
        sizes = np.diff(np.append(starts, end))
        digest = mix64(np.add.reduceat(mix64(ids[:end].view(np.uint64)), starts) + sizes.astype(np.uint64)).view(np.int64)
        open_end = going is not None and (key[0], salt[0]) == going[:2]
        wanted = (sizes > 1) | (salt[starts] > 0)
        wanted[0] |= open_end
        rows: list[list] = [[], [], [], []]
        for k in np.flatnonzero(wanted).tolist():
            part = ids[starts[k] : starts[k] + sizes[k]]
            gid, first = int(key[starts[k]]), int(part[0])
            if k == 0 and open_end:
                first = going[2]
            elif salt[starts[k]] == 0 and part.size < most:
                if int(digest[k]) in seen:
                    continue
                if len(seen) >= 1 << 18:
                    seen.clear()
                gid = int(digest[k])
                seen.add(gid)
            for column, value in zip(rows, (gid, bool(salt[starts[k]] > 0), first, part), strict=True):
                column.append(value)
        going = None
        if not all_in:
            at = int(starts[-1])
            going = int(key[at]), int(salt[at]), (rows[2][-1])
        if rows[0]:
            offsets = np.concatenate([[0], np.cumsum([x.size for x in rows[3]])])
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2], pa.int64()), int_list(offsets, np.concatenate(rows[3]))], names=["gid", "salted", "rep", "ids"])

    def starts_of() -> np.ndarray:
        first = np.ones(key.size, bool)
        first[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        return np.flatnonzero(first)

    for batch in batches:
        key, salt, ids = (np.concatenate([old, batch.column(c).to_numpy()]) for old, c in ((key, "key"), (salt, "salt"), (ids, "id")))
        if not key.size:
            continue
        starts = starts_of()
        last = int(starts[-1])
        if key.size - last >= most:  # a long group goes out in parts
            yield from groups(starts, key.size, False)
            last = key.size
        elif last:
            yield from groups(starts[:-1], last, True)
        key, salt, ids = key[last:], salt[last:], ids[last:]
    if key.size:
        yield from groups(starts_of(), key.size, True)


def _groups(keys: DataFrame) -> DataFrame:
    """(gid, rep, ids) of the documents that share a key: ids have rep, the smallest of them, in common."""
    dealt = keys.repartition("key", "salt").sortWithinPartitions("key", "salt", "id")
    found = materialize(dealt.mapInArrow(tidied(_group_rows), "gid long, salted boolean, rep long, ids array<long>"), "ngram-parts")
    # SALTS centres a key at most
    centres = found.where("salted").groupBy("gid").agg(F.collect_set("rep").alias("ids")).where(F.size("ids") > 1)
    return found.select("gid", "rep", "ids").union(centres.select("gid", F.array_min("ids").alias("rep"), "ids"))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, n_a, n_b, w_a, w_b): the pairs (a, b) whose sizes and sketches allow a link."""
    for batch in batches:
        na, nb = batch.column("n_a").to_numpy().astype(np.int64), batch.column("n_b").to_numpy().astype(np.int64)
        good = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
        of_a, of_b = batch.column("w_a"), batch.column("w_b")
        for k in np.flatnonzero(good).tolist():
            x, y = (np.frombuffer(w[k].as_buffer(), np.uint64) for w in (of_a, of_b))
            good[k] = (100 + PERCENT) * hamming(x, y) <= (100 - PERCENT) * int(na[k] + nb[k])
        yield batch.select(["a", "b"]).filter(pa.array(good))


def _joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join whose sides both grow with the data: never a broadcast, at any size."""
    return left.join(right.hint("merge"), on, how)


def _may_link(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and Hamming distance allow a link."""
    of_a, of_b = (info.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.coalesce("wide", "sketch").alias(f"w_{x}")) for x in "ab")
    both = _joined(_joined(pairs, of_a, "a"), of_b, "b")
    return both.select("a", "b", "n_a", "n_b", "w_a", "w_b").mapInArrow(tidied(_near), "a long, b long").distinct()


def _only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids, without sending most other texts through a shuffle.

    A bit table, made on the executors, is broadcast and drops nearly all others at the scan; a join decides. Its size
    goes by the number of ids, up to MOST_FILTER bits; a full table drops nothing and costs nothing.
    """
    bits = min(MOST_FILTER, max(LEAST_FILTER, 1 << (FILTER_EACH * ids.count()).bit_length()))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    each = 32768  # bits of one of Spark's bitmaps
    maps = ids.select(F.floor(bit / each).cast("int").alias("_map"), (bit % each).alias("_bit")).groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    rows = docs.withColumn("_map", F.floor(bit / each).cast("int")).withColumn("_bit", (bit % each).cast("int")).join(F.broadcast(maps), "_map")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = rows.where((byte.bitwiseAND(F.expr("shiftleft(1, _bit % 8)"))) != 0).drop("_map", "_bit", "_bits")
    return _joined(rows, ids, "doc_id")  # ids are distinct; a semi-join would be pushed below the bit table


def _verified(docs: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    """The pairs (a, b) that link; the sets of their documents are made again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _batches(batches):
            offsets = np.concatenate([[0], np.cumsum([x.size for x in sets])])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), int_list(offsets, np.concatenate(sets))], names=["id", "bits"])

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    ids = materialize(ids, label + "-ids")
    sets = _only_ids(docs.select("doc_id", "text"), ids).mapInArrow(tidied(run), "id long, bits array<long>")
    sets = materialize(sets, label + "-sets")
    of_a, of_b = (sets.select(F.col("id").alias(x), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    shared = F.size(F.array_intersect("bits_a", "bits_b"))
    linked = 100 * shared >= PERCENT * (F.size("bits_a") + F.size("bits_b") - shared)
    out = materialize(_joined(_joined(pairs, of_a, "a"), of_b, "b").where(linked).select("a", "b").distinct(), label + "-links")
    drop_table(sets)
    drop_table(ids)
    return out


def _forest(comp_a: np.ndarray, comp_b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Numbers of the edges of a forest of least distances that joins all components which the edges join."""
    names, of = np.unique(np.concatenate([comp_a, comp_b]), return_inverse=True)
    x, y = of[: comp_a.size], of[comp_a.size :]
    label, taken = np.arange(names.size), []
    left = np.lexsort((y, x, apart))
    while left.size:
        ends = np.stack([label[x[left]], label[y[left]]], axis=1).ravel()
        _, first = np.unique(ends, return_index=True)  # each component's nearest edge
        chosen = np.unique(left[first // 2])
        taken.append(chosen)
        while True:
            p, q = label[x[chosen]], label[y[chosen]]
            least = label.copy()
            np.minimum.at(least, np.maximum(p, q), np.minimum(p, q))
            least = least[least]
            least = least[label]
            if (least == label).all():
                break
            label = least
        left = left[label[x[left]] != label[y[left]]]
    return np.unique(np.concatenate(taken))


def _across(every: bool):
    """Of rows (gid, i, j, id, comp, n, sketch) sorted by (gid, i, j): pairs (a, b) of different components that may link.

    Where a block has more than FEW pairs a row and not every one is asked for, the pairs of a forest go out, and more is true.
    """

    def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        gid, i, j, ids, comp, n = (rows.column(c).to_numpy() for c in ("gid", "i", "j", "id", "comp", "n"))
        sketches = rows.column("sketch").to_pylist()
        words = np.frombuffer(b"".join(sketches), np.uint64)
        widths = np.array([len(x) for x in sketches], np.int64) // 8
        at = np.cumsum(widths) - widths
        change = (np.diff(gid) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
        starts = np.append(0, np.flatnonzero(change) + 1)
        found: list[tuple[np.ndarray, ...]] = []

        def bits(of: np.ndarray, width: int) -> np.ndarray:
            return words[at[of][:, None] + np.arange(width)]

        def compare(x: np.ndarray, bx: np.ndarray, y: np.ndarray, by: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
            step = max(1, (1 << 21) // max(1, by.size))  # 16 MB of words at once
            for k in range(0, x.size, step):
                part = x[k : k + step]
                apart = np.bitwise_count(bx[k : k + step, None, :] ^ by[None, :, :]).sum(2, dtype=np.int64)
                least, most = np.minimum(n[part, None], n[None, y]), np.maximum(n[part, None], n[None, y])
                good = ((100 + PERCENT) * apart <= (100 - PERCENT) * (least + most)) & (100 * least >= PERCENT * most) & (comp[part, None] != comp[None, y])
                p, q = np.nonzero(good)
                yield part[p], y[q], apart[p, q]

        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), gid.size], strict=True):
            if e - s < 2 or (comp[s:e] == comp[s]).all():
                continue
            pairs = []
            # sizes within 3/4 to 4/3 of each other have widths that are equal or one step apart
            for width in np.unique(widths[s:e]).tolist():
                x, y = s + np.flatnonzero(widths[s:e] == width), s + np.flatnonzero(widths[s:e] == 2 * width)
                bx = bits(x, width)
                pairs += compare(x, bx, x, bx)
                if y.size:
                    by = bits(y, 2 * width)
                    pairs += compare(x, bx, y, by[:, :width] ^ by[:, width:])
            p, q, apart = (np.concatenate(v) for v in zip(*pairs, strict=True))
            more = not every and p.size > FEW * (e - s)
            if more:
                kept = _forest(comp[p], comp[q], apart)
                p, q = p[kept], q[kept]
            p, q = ids[p], ids[q]
            found.append((np.minimum(p, q), np.maximum(p, q), np.full(p.size, gid[s]), np.full(p.size, more)))
        if found:
            a, b, of, more = (np.concatenate(v) for v in zip(*found, strict=True))
            order = np.lexsort((of, ~more, b, a))
            a, b, of, more = a[order], b[order], of[order], more[order]
            first = np.ones(a.size, bool)
            first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (more[1:] & (of[1:] != of[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(v[first]) for v in (of, a, b, more)], names=["gid", "a", "b", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            if not rows.num_rows:
                continue
            same = np.ones(rows.num_rows, bool)
            for c in ("gid", "i", "j"):
                v = rows.column(c).to_numpy()
                same &= v == v[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from search(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and held.num_rows:
            yield from search(held)

    return tidied(run)


def _between_components(groups: DataFrame, nodes: DataFrame, info: DataFrame, every: bool) -> DataFrame:
    """(gid, a, b, more): pairs (a, b) of different components that share a group and may link; nodes: (doc_id, rep, comp).

    A group's largest component stays in blocks of about BLOCK rows. Up to BLOCK other rows go to every
    block; if there are more, every pair of blocks is a task. more: the block has other pairs, see _across().
    """
    rows = _joined(groups.select("gid", F.explode("ids").alias("doc_id")), nodes, "doc_id")
    rows = materialize(rows.select("gid", F.col("rep").alias("id"), "comp").distinct(), "ngram-members")
    by_comp = rows.groupBy("gid", "comp").agg(F.count("*").alias("rows"))
    shape = by_comp.groupBy("gid").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.sum("rows").alias("all"), (F.sum("rows") - F.max("rows")).alias("others"))
    mixed = _joined(rows, shape.where("others > 0"), "gid").withColumn("blocks", F.ceil(F.col("all") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    alone = F.array(F.struct(own.alias("i"), own.alias("j")))
    to = (
        F.when(F.col("blocks") == 1, alone)
        .when(F.col("others") > BLOCK, F.transform(each, lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j"))))
        .when(F.col("comp") == F.col("main"), alone)
        .otherwise(F.transform(each, lambda x: F.struct(x.alias("i"), x.alias("j"))))
    )
    tasks = _joined(mixed, info.select("id", "n", "sketch"), "id").withColumn("to", F.explode(to)).select("gid", "to.i", "to.j", "id", "comp", "n", "sketch")
    tasks = tasks.repartition("gid", "i", "j").sortWithinPartitions("gid", "i", "j")
    out = materialize(tasks.mapInArrow(_across(every), "gid long, a long, b long, more boolean"), "ngram-across")
    drop_table(rows)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; all links are found.

    Null, empty and wordless texts have no shingles and link with nothing. Repeated rows give
    repeated results. Rows of one doc_id with different texts keep their own n_shingles; as a node
    they are one and link where one of the texts does. Other columns are not read. A null doc_id is left out.
    An empty table gives an empty table. A text is read whole, however long it is.
    """
    docs = only(docs, doc_id="long", text="string").where("doc_id is not null")
    made = materialize(sketches(docs), "ngram-sketches")
    flags = np.zeros(BUCKETS, bool)
    often = made.where("doc_id is null").select(F.explode("often").alias("bucket")).distinct().toPandas()  # BUCKETS rows at most
    flags[often["bucket"].to_numpy(np.int64)] = True
    rows = made.where("doc_id is not null")
    sets = ["n", "k1", "k2"]
    copies = rows.where("n > 0").groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where("size > 1")
    copies = materialize(copies, "ngram-copies")
    of_copy = copies.select(*(F.col(c).alias(f"c_{c}") for c in sets), "rep")
    with_rep = _joined(rows.select("doc_id", *sets), of_copy, [F.col(c) == F.col(f"c_{c}") for c in sets], "left")
    members = materialize(with_rep.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "ngram-classes")
    nodes = members.where("n > 0").select("doc_id", "rep")
    info = rows.where("n > 0").select(F.col("doc_id").alias("id"), "n", "sketch", "wide", "k1", "k2")
    same_ids = nodes.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("rep").alias("a"), F.max("rep").alias("z")).where("n > 1")
    same_ids = materialize(same_ids, "ngram-ids")
    bound = None  # classes that one doc_id holds together
    if same_ids.limit(1).count():
        nodes, info = nodes.distinct(), materialize(info.dropDuplicates(["id", *sets]), "ngram-info")
        bound = _joined(nodes, same_ids.where("a <> z").select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    groups = materialize(_groups(join_keys(docs, flags)), "ngram-groups")
    stars = groups.select("rep", F.explode("ids").alias("other")).where("rep <> other").distinct()
    of_a, of_b = nodes.select(F.col("doc_id").alias("rep"), F.col("rep").alias("p")), nodes.select(F.col("doc_id").alias("other"), F.col("rep").alias("q"))
    stars = _joined(_joined(stars, of_a, "rep"), of_b, "other").where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    stars = materialize(_may_link(stars, info), "ngram-stars")
    links = _verified(docs, stars, "ngram-stars")
    known = links if bound is None else links.union(bound)
    comps = connected_components(known)
    done, every = [made, stars], False
    while True:
        labelled = _joined(nodes, comps.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "rep", F.coalesce("comp", "rep").alias("comp"))
        across = _between_components(groups, labelled, info, every)
        near = materialize(across.select("a", "b").distinct(), "ngram-near")
        linked = False
        if near.limit(1).count():
            new = _verified(docs, near, "ngram-across")
            linked = bool(new.limit(1).count())
            if linked:
                known = known.union(new)
                comps = connected_components(known)
        done += [groups, across, near]
        again = across.where("more").select("gid").distinct()
        if not again.limit(1).count():
            break
        # blocks with many pairs are searched again, between the components that are left
        groups = materialize(_joined(groups, again, "gid", "left_semi"), "ngram-groups")
        every = not linked
    for table in done:
        drop_table(table)
    comps = comps.withColumnRenamed("id", "rep")
    return _joined(members, comps, "rep", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the documents that are linked, directly or not, to one with a smaller doc_id; columns and other rows stay."""
    name = free(docs, "_dropped_id")
    found = near_duplicates(docs).where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    found = materialize(found, "ngram-dropped")
    return docs.join(found, F.col("doc_id") == F.col(name), "left_anti").select(*docs.columns)
