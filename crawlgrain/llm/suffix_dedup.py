"""Suffix-array dedup: bytes covered by a 200-byte string that starts anywhere else are removed.

The collection's Burrows-Wheeler transform with common prefixes is built column by column: each
round puts one more symbol in front of every string. Over whole documents that takes as many
rounds, each rewriting the whole transform, as the longest document has bytes. So the collection
is first cut into strings of bounded length, without losing a match: every 200-byte window has an
anchor, its 64-byte string with the least hash, and equal windows have equal anchors at equal
places. The windows with one anchor form a segment of at most 336 bytes.

1. Segments are dealt out by anchor, as 128-bit cryptographic digests of their bytes. A segment that occurs twice
   is removed as a whole, and an anchor with one segment needs nothing more. This settles nearly all of the text.
2. Where an anchor has several different segments, one of each is read as text and cut into parts
   whose windows share a core of 166 bytes. Texts that have the same core, byte for byte, go through the column-wise
   construction together, the core being one symbol of it: at most 69 rounds, each a sequential merge of the new
   symbols into the sorted run of the last. Windows whose suffix shares 35 symbols with a neighbour occur elsewhere.
   A core with more than BATCH texts is split first, into longer cores that still have every window.
3. An anchor with more than HOT different segments is no group of one task: its windows are counted one by one,
   combined before the shuffle.
4. The runs found come back to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrain.llm.bpe import _inverse_powers
from crawlgrain.llm.common import BYTE_VALUE, as_bytes, drop_table, free, materialize, mix64, only, powers, slices, tidied
from crawlgrain.session import ship

SPAN = 200
ANCHOR = 64
#: Places of the anchor that a part of a segment spans.
STEP = 35
#: Texts that go through one column-wise construction.
BATCH = 512
#: Different segments of an anchor beyond which its windows are counted one by one.
HOT = 1 << 16
#: Bytes of text that segments are made of at once; a longer text is read in pieces that have all its windows.
PIECE = 1 << 20
_PLACE_BITS = 28


def _prefix_sums(buf: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[buf] * powers(buf.size), dtype=np.uint64)])


def segments(texts: list[bytes], span: int = SPAN, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor's place in the first, anchor hash, digest as two numbers) of every run of windows with one anchor.

    Places are bytes from the start of the text. Texts shorter than span have none. All texts together have less than 2^28 bytes.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    joined = b"".join(texts)
    buf = np.frombuffer(joined, np.uint8)
    n = buf.size
    if n >= 1 << _PLACE_BITS:
        raise ValueError(f"{n} bytes at once")
    none = np.zeros(0, np.int64)
    if n < span:
        return (none,) * 7
    starts = np.concatenate([[0], np.cumsum(sizes)])
    sums, inverse = _prefix_sums(buf), _inverse_powers(n)
    grams = mix64((sums[anchor:] - sums[:-anchor]) * inverse[: n - anchor + 1])
    width = span - anchor + 1
    low = np.uint64((1 << _PLACE_BITS) - 1)
    ranked = (grams & ~low) | np.arange(grams.size, dtype=np.uint64)
    # least of every `width` neighbours: prefix minima and suffix minima of blocks
    padded = np.full(-(-ranked.size // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: ranked.size] = ranked
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - span + 1
    at = (np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows]) & low).astype(np.int64)
    text = np.repeat(np.arange(sizes.size), sizes)[:windows]
    inside = np.arange(windows) + span <= starts[text + 1]
    places = np.flatnonzero(inside)
    if not places.size:
        return (none,) * 7
    at, text = at[places], text[places]
    first = np.ones(places.size, bool)
    first[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    runs = np.flatnonzero(first)
    lo = places[runs]
    hi = places[np.append(runs[1:], places.size) - 1]
    p, text = at[runs], text[runs]
    digests = b"".join([hashlib.blake2b(joined[i:j], digest_size=16).digest() for i, j in zip(lo.tolist(), (hi + span).tolist(), strict=True)])
    whole = np.frombuffer(digests, "<i8").reshape(-1, 2)
    return text, lo - starts[text], hi - starts[text], p - lo, grams[p].view(np.int64), whole[:, 0], whole[:, 1]


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments as rows; of equal ones in a slice the first, with the others packed in more."""

    def rows(row_id: np.ndarray, texts: list[bytes], shift: int) -> pa.RecordBatch:
        text, lo, hi, a, h, seg, seg2 = segments(texts)
        row_id, lo, hi = row_id[text], lo + shift, hi + shift
        order = np.lexsort((seg2, seg, h))
        same = np.zeros(order.size, bool)
        same[1:] = (h[order[1:]] == h[order[:-1]]) & (seg[order[1:]] == seg[order[:-1]]) & (seg2[order[1:]] == seg2[order[:-1]])
        firsts = np.flatnonzero(~same)
        packed = np.stack([row_id, lo, hi], axis=1).astype("<i8")[order]
        sizes = np.diff(np.append(firsts, order.size))
        more: list[bytes | None] = [None] * firsts.size
        for k in np.flatnonzero(sizes > 1).tolist():
            more[k] = packed[firsts[k] + 1 : firsts[k] + sizes[k]].tobytes()
        at = order[firsts]
        columns = [pa.array(row_id[at]), pa.array(lo[at], pa.int32()), pa.array(hi[at], pa.int32()), pa.array(a[at], pa.int16()), pa.array(h[at]), pa.array(seg[at]), pa.array(seg2[at])]
        return pa.RecordBatch.from_arrays([*columns, pa.array(more, pa.binary())], names=["row_id", "lo", "hi", "a", "h", "seg", "seg2", "more"])

    for batch in slices(batches, "text", PIECE):
        row_id, texts = batch.column("row_id").to_numpy(), as_bytes(batch.column("text"))
        if len(texts) == 1:
            for shift in range(0, max(1, len(texts[0])), PIECE):
                yield rows(row_id, [texts[0][shift : shift + PIECE + SPAN - 1]], shift)
        else:
            yield rows(row_id, texts, 0)


def _sort_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, seg, seg2): keep those that occur twice (twice) and one of each where an anchor has several (read)."""
    schema = ["row_id", "lo", "hi", "a", "h", "twice", "read"]
    held: pa.Table | None = None  # the last row, whose successor isn't known yet
    state = (None, None, None, False)  # h, seg and seg2 of the row before the held one; whether it is in the first run of its h

    def work(rows: pa.Table, before: tuple, more: bool) -> tuple[pa.RecordBatch | None, pa.Table, tuple]:
        h, seg, seg2 = (rows.column(c).to_numpy() for c in ("h", "seg", "seg2"))
        n = h.size
        same_h, same_seg = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # of row i and row i-1
        same_h[1:n] = h[1:] == h[:-1]
        same_seg[1:n] = same_h[1:n] & (seg[1:] == seg[:-1]) & (seg2[1:] == seg2[:-1])
        if before[0] is not None:
            same_h[0] = h[0] == before[0]
            same_seg[0] = same_h[0] and (seg[0], seg2[0]) == before[1:3]
        run_start = ~same_seg[:n]
        # a run is the first of its anchor if no row of the anchor stands before it
        run_first = np.where(run_start, ~same_h[:n], False)
        runs = np.cumsum(run_start)
        firsts = np.concatenate([[before[3]], run_first[run_start]])
        first_of_h = firsts[runs]
        done = n if not more else n - 1
        others = rows.column("more")
        twice = same_seg[:n] | same_seg[1:] | others.is_valid().to_numpy()
        ends = same_h[1:] & ~same_seg[1:]  # last row of its run, another run of the anchor follows
        read = np.where(first_of_h, ends, run_start & same_h[:n])
        keep = (twice | read)[:done]
        index = np.flatnonzero(keep)
        out = None
        if index.size:
            part = rows.take(pa.array(index)).combine_chunks()
            columns = [part.column(c).combine_chunks() for c in schema[:5]]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            out = pa.RecordBatch.from_arrays([*columns, pa.array(twice[index]), pa.array(read[index])], names=schema)
            packed = b"".join(x for x in part.column("more").to_pylist() if x)
            if packed:
                m = np.frombuffer(packed, "<i8").reshape(-1, 3)
                none, true = np.zeros(len(m)), np.ones(len(m), bool)
                extra = [pa.array(m[:, 0]), pa.array(m[:, 1], pa.int32()), pa.array(m[:, 2], pa.int32()), pa.array(none, pa.int16()), pa.array(none, pa.int64()), pa.array(true), pa.array(~true)]
                out = pa.Table.from_batches([out, pa.RecordBatch.from_arrays(extra, names=schema)]).combine_chunks().to_batches()[0]
        after = before
        if more:
            after = (h[n - 2], seg[n - 2], seg2[n - 2], bool(first_of_h[n - 2])) if n > 1 else before
        return out, rows.slice(n - 1, 1), after

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        out, held, state = work(rows, state, True)
        if out is not None:
            yield out
    if held is not None:
        out, _, _ = work(held, state, False)
        if out is not None:
            yield out


def column_wise(strings: list[bytes] | list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place, common prefix with the suffix before) of all suffixes of strings (bytes, or symbols up to 65534) in sorted order.

    Each round puts one more symbol in front of each string. The transform of the last round, with
    the new symbols filled in, is read in the order of its symbols: that is the order of the
    suffixes that they begin. A suffix is new if its symbol is. Two neighbours of one symbol share
    one symbol more than the least common prefix between the places that their rests have. End marks
    are smaller than symbols, differ from each other, and go by string.
    """
    m = len(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    buf = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(x, np.uint8) if isinstance(x, bytes) else x for x in strings)]).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum(lengths)
    symbol = np.zeros(m, np.uint16)  # before each suffix, in sorted order; 0: none yet, or the string's start
    prefix = np.zeros(m, np.int64)
    owner = np.arange(m)
    place = lengths.copy()
    current = np.arange(m)  # where each string's longest suffix stands
    alive = np.arange(m)
    for r in range(1, int(lengths.max(initial=0)) + 1):
        alive = alive[lengths[alive] >= r]
        spot = current[alive]
        symbol[spot] = buf[ends[alive] - r]
        order = np.argsort(symbol, kind="stable")
        order = order[np.searchsorted(symbol[order], 1) :]
        new_spot = np.zeros(symbol.size, bool)
        new_spot[spot] = True
        new = new_spot[order]
        old = ~new
        size = m + order.size
        grown = [np.zeros(size, x.dtype) for x in (symbol, prefix, owner, place)]
        for g, x in zip(grown, (symbol, prefix, owner, place), strict=True):
            g[:m] = x[:m]
            g[m:][old] = x[m:]
        of = owner[order[new]]
        grown[2][m:][new] = of
        grown[3][m:][new] = lengths[of] - r
        current[of] = m + np.flatnonzero(new)
        # common prefixes change next to new suffixes only
        near = np.flatnonzero(new | np.append(False, new[:-1]))
        near = near[near > 0]
        first, second = order[near - 1], order[near]
        together = symbol[first] == symbol[second]
        value = np.zeros(near.size, np.int64)
        if together.any():
            lo, hi = first[together] + 1, second[together] + 1
            by = np.argsort(lo)
            pairs = np.stack([lo[by], hi[by]], axis=1).ravel()
            least = np.empty(by.size, np.int64)
            least[by] = np.minimum.reduceat(np.append(prefix, 0), pairs)[::2]
            value[together] = 1 + least
        grown[1][m + near] = value
        if order.size and new[0]:
            grown[1][m] = 0
        symbol, prefix, owner, place = grown
    return owner, place, prefix


def repeated_windows(strings: list[bytes] | list[np.ndarray], span: int = SPAN) -> list[np.ndarray]:
    """For each string, the places of its windows of span symbols that occur again in strings."""
    owner, place, prefix = column_wise(strings)
    tied = prefix >= span
    twice = tied | np.append(tied[1:], False)
    owner, place = owner[twice], place[twice]
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    cuts = np.searchsorted(owner, np.arange(len(strings) + 1))
    return [place[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive places."""
    if not places.size:
        return places, places
    gaps = np.flatnonzero(np.diff(places) > 1)
    return places[np.append(0, gaps + 1)], places[np.append(gaps, places.size - 1)]


def _read_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, row_id, lo, head, text) of the segments in reads, an array of struct(h, lo, hi, a, hot) beside each text.

    A segment is cut by the place of its anchor in its windows, STEP places to a part. All windows
    of a part hold the same core around the anchor, so equal windows meet under (anchor, part, core). The core begins
    head bytes into the text. Hot segments are left to _read_windows.
    """
    import xxhash

    for batch in slices(batches, "text"):
        rows: list[list] = [[], [], [], [], []]
        for row_id, text, reads in zip(batch.column("row_id").to_pylist(), as_bytes(batch.column("text")), batch.column("reads").to_pylist(), strict=True):
            for r in reads:
                if r["hot"]:
                    continue
                lo, hi, p = r["lo"], r["hi"], r["lo"] + r["a"]
                for j in range((p - hi) // STEP, (p - lo) // STEP + 1):
                    near = p - j * STEP
                    first, last = max(lo, near - STEP + 1), min(hi, near)
                    key = xxhash.xxh3_64_intdigest(text[near : near - STEP + 1 + SPAN], (r["h"] + j) & ((1 << 64) - 1))
                    for column, value in zip(rows, (key - (1 << 63), row_id, first, near - first, text[first : last + SPAN]), strict=True):
                        column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=["key", "row_id", "lo", "head", "text"])


def _read_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, row_id, lo) of every window of the hot segments in reads."""
    for batch in slices(batches, "text", 1 << 18):
        rows: list[list] = [[], [], []]
        for row_id, text, reads in zip(batch.column("row_id").to_pylist(), as_bytes(batch.column("text")), batch.column("reads").to_pylist(), strict=True):
            for r in reads:
                for lo in range(r["lo"], r["hi"] + 1) if r["hot"] else ():
                    for column, value in zip(rows, (hashlib.blake2b(text[lo : lo + SPAN], digest_size=16).digest(), row_id, lo), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32())], names=["digest", "row_id", "lo"])


#: A text with a core: row, place of its first byte, bytes before the core, bytes after it.
Held = tuple[int, int, bytes, bytes]


def _small_groups(group: list[Held], slack: int, core: bytes) -> Iterator[tuple[list[Held], int, bytes]]:
    """Groups (texts, slack, core) of BATCH texts at most, or with slack 0, that have every pair of equal windows of group.

    slack is what a window has besides the core. A window with half of that before the core is in the
    group of a core that begins there, any other in that of a core that ends as much later.
    """
    if len(group) < 2:
        return
    if len(group) <= BATCH or not slack:
        yield group, slack, core
        return
    before = slack // 2 + 1
    after = slack + 1 - before
    heads: dict[bytes, list[Held]] = {}
    tails: dict[bytes, list[Held]] = {}
    for row_id, lo, head, tail in group:
        if len(head) >= before:
            heads.setdefault(head[-before:], []).append((row_id, lo, head[:-before], tail[: slack - before]))
        if len(tail) >= after:
            keep = head[max(0, len(head) - before + 1) :]
            tails.setdefault(tail[:after], []).append((row_id, lo + len(head) - len(keep), keep, tail[after:]))
    for x, part in heads.items():
        yield from _small_groups(part, slack - before, x + core)
    for x, part in tails.items():
        yield from _small_groups(part, slack - after, core + x)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, row_id, lo, head, text) sorted by key: (row_id, lo, hi) runs of windows that occur in two texts of a key."""
    group: list[tuple[int, int, int, bytes]] = []
    waiting: list[tuple[list[Held], int]] = []
    count = 0
    last = None

    def found(groups: list[tuple[list[Held], int]]) -> Iterator[pa.RecordBatch]:
        out: list[list[int]] = [[], [], []]
        by_slack: dict[int, list[list[Held]]] = {}
        for texts, slack in groups:
            by_slack.setdefault(slack, []).append(texts)
        for slack, several in by_slack.items():
            flat = [x for texts in several for x in texts]
            if slack:
                names = np.repeat(np.arange(256, 256 + len(several), dtype=np.uint16), [len(x) for x in several])  # a symbol for each core
                strings = [np.concatenate([np.frombuffer(x[2], np.uint8), names[k : k + 1], np.frombuffer(x[3], np.uint8)]) for k, x in enumerate(flat)]
                places = repeated_windows(strings, slack + 1)
            else:
                places = [np.zeros(1, np.int64)] * len(flat)  # the window is the core
            for (row_id, lo, _, _), p in zip(flat, places, strict=True):
                for a, b in zip(*_runs(p), strict=True):
                    for column, value in zip(out, (row_id, lo + int(a), lo + int(b)), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["row_id", "lo", "hi"])

    def grouped() -> Iterator[tuple[list[Held], int]]:
        cores: dict[bytes, list[Held]] = {}
        for row_id, lo, head, text in group:
            end = head + SPAN - STEP + 1
            cores.setdefault(text[head:end], []).append((row_id, lo, text[:head], text[end:]))
        for core, texts in cores.items():
            for small, slack, _ in _small_groups(texts, STEP - 1, core):
                yield small, slack

    def settled(more: bool) -> Iterator[pa.RecordBatch]:
        nonlocal waiting, count
        if len(group) > 1:
            for texts, slack in grouped():
                waiting.append((texts, slack))
                count += len(texts)
                if count >= BATCH:
                    yield from found(waiting)
                    waiting, count = [], 0
        if not more and waiting:
            yield from found(waiting)

    for batch in batches:
        for h, row_id, lo, head, text in zip(*(batch.column(c).to_pylist() for c in ("key", "row_id", "lo", "head", "text")), strict=True):
            if h != last:
                yield from settled(True)
                group, last = [], h
            group.append((row_id, lo, head, text))
    yield from settled(False)


def _cut(text: bytes, runs: list) -> tuple[bytes, int, int]:
    """(bytes that stay, bytes removed, maximal runs removed) for window runs (lo, hi)."""
    kept, at, removed, spans = [], 0, 0, 0
    end = -1
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs or []):
        if lo > end:
            if end >= 0:
                removed += end - begin
                spans += 1
                at = end
            kept.append(text[at:lo])
            begin, end = lo, hi + SPAN
        else:
            end = max(end, hi + SPAN)
    if end >= 0:
        removed += end - begin
        spans += 1
        at = end
    kept.append(text[at:])
    return b"".join(kept), removed, spans


def repeated_runs(rows: DataFrame) -> DataFrame:
    """(row_id, runs: array<struct(lo, hi)>) of the windows of rows (row_id, text) that occur twice or more."""
    made = rows.mapInArrow(tidied(_segment_rows), "row_id long, lo int, hi int, a short, h long, seg long, seg2 long, more binary")
    dealt = made.repartition("h").sortWithinPartitions("h", "seg", "seg2")
    hits = materialize(dealt.mapInArrow(tidied(_sort_out), "row_id long, lo int, hi int, a short, h long, twice boolean, read boolean"), "suffix-hits")
    read = hits.where("read")
    hot = materialize(read.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(F.col("h").alias("hot_h")), "suffix-hot")
    some_hot = bool(hot.limit(1).count())
    if some_hot:
        read = read.join(hot.hint("merge"), F.col("h") == F.col("hot_h"), "left").withColumn("hot", F.col("hot_h").isNotNull())
    else:
        read = read.withColumn("hot", F.lit(False))
    reads = read.groupBy("row_id").agg(F.collect_list(F.struct("h", "lo", "hi", "a", "hot")).alias("reads"))
    texts = rows.join(reads.hint("merge"), "row_id")
    parts = texts.mapInArrow(tidied(_read_segments), "key long, row_id long, lo int, head short, text binary")
    partial = materialize(parts.repartition("key").sortWithinPartitions("key").mapInArrow(tidied(_compare), "row_id long, lo int, hi int"), "suffix-partial")
    both = hits.where("twice").select("row_id", "lo", "hi").union(partial)
    if some_hot:
        windows = materialize(texts.where(F.exists("reads", lambda r: r["hot"])).mapInArrow(tidied(_read_windows), "digest binary, row_id long, lo int"), "suffix-windows")
        again = windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
        both = both.union(windows.join(again.hint("merge"), "digest").select("row_id", "lo", F.col("lo").alias("hi")))
    runs = materialize(both.groupBy("row_id").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "suffix-runs")
    for done in (hits, hot, partial):
        drop_table(done)
    if some_hot:
        drop_table(windows)
    return runs


def _with_rows(docs: DataFrame, name: str = "_row_id") -> DataFrame:
    """docs with a column of that name, one value for each row: doc_id itself where no doc_id repeats or is null."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    odd = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").limit(1).count()
    if not odd:
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "suffix-rows")


def dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs.

    Texts are UTF-8 bytes, null counts as empty; texts under 200 bytes lose nothing. Matches are
    judged on the input, within one text and between texts, and never cross texts. Repeated rows,
    or rows of one doc_id, are texts of their own, so repeated long texts lose everything.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows: list[list] = [[], [], [], []]
            for text, runs in zip(as_bytes(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
                kept, removed, spans = _cut(text, runs)
                for column, value in zip(rows, (len(text), removed, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    rows = _with_rows(only(docs, doc_id="long", text="string")).withColumnRenamed("_row_id", "row_id")
    runs = repeated_runs(rows.select("row_id", "text"))
    return rows.join(runs, "row_id", "left").select("doc_id", "text", "runs").mapInArrow(tidied(digest), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes out of text, and n_chars (if there) counted anew.

    What remains is read as UTF-8; a character that lost some of its bytes is dropped. Documents of
    which nothing is left stay, with an empty text. Rows without repeats, null texts too, are unchanged.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [
                t if not runs or t is None else _cut(t.encode(), runs)[0].decode("utf-8", "ignore")
                for t, runs in zip(batch.column("text").to_pylist(), batch.column(found).to_pylist(), strict=True)
            ]
            columns = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                old = batch.column("n_chars")
                columns["n_chars"] = pa.array([o if not r else len(t or "") for o, r, t in zip(old.to_pylist(), batch.column(found).to_pylist(), texts, strict=True)], old.type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    ship(docs.sparkSession)
    row_id, found = free(docs, "_row_id"), free(docs, "_runs")
    rows = _with_rows(docs, row_id)
    runs = repeated_runs(rows.select(F.col(row_id).alias("row_id"), F.col("text").cast("string").alias("text")))
    runs = runs.select(F.col("row_id").alias(row_id), F.col("runs").alias(found))
    return rows.join(runs, row_id, "left").select(*names, found).mapInArrow(tidied(run), docs.schema)


