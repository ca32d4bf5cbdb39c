"""N-gram join and suffix dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from crawlgrain.llm import ngram_join, suffix_dedup
from crawlgrain.llm.common import shingle_sets, word_hashes
from crawlgrain.llm.components import connected_components
from tests.llm.helpers import components, cut_repeats, docs_frame

random.seed(11)
VOCAB = ["".join(random.choices("abcdefgh", k=random.randint(1, 7))) for _ in range(400)]


def text(n):
    return " ".join(random.choices(VOCAB, k=n))


def near(base, edits):
    w = base.split()
    for _ in range(edits):
        w[random.randrange(len(w))] = random.choice(VOCAB)
    return " ".join(w)


def corpus():
    passage = text(70)
    rows, base = [], text(120)
    rows += [(i, near(base, random.randint(0, 6))) for i in range(25)]
    rows += [(100 + i, base.upper() if i % 2 else base) for i in range(5)]  # letter case doesn't count
    rows += [(200 + i, text(40) + " " + passage + " " + text(60)) for i in range(25)]  # a passage alone makes no link
    big = text(3000)
    rows += [(300, big), (301, near(big, 100)), (302, near(big, 250))]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one two"), (404, "ONE  two"), (405, "one"), (406, "a b c d e"), (407, "a b c d e")]
    rows += [(500 + i, text(random.randint(1, 30))) for i in range(20)]
    return rows


def test_ngram_join_finds_all_links(spark):
    rows = corpus()
    found = ngram_join.near_duplicates(docs_frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == components(rows)


def test_ngram_join_links_only_through_the_blocks(spark, monkeypatch):
    """Small blocks and no star that helps: the search between components finds the rest."""
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rows = corpus()
    found = ngram_join.near_duplicates(docs_frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == components(rows)


def test_ngram_join_empty_and_repeated(spark):
    assert ngram_join.near_duplicates(docs_frame(spark, [])).collect() == []
    rows = [(1, text(50))] * 3 + [(2, text(50))]
    found = ngram_join.near_duplicates(docs_frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in found) == [(1, 1)] * 3 + [(2, 2)]


def test_keep_one(spark):
    rows = corpus()
    df = docs_frame(spark, rows)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in components(rows).items() if i == c}


def test_hamming_bounds_the_difference():
    for _ in range(200):
        n, m = random.randint(1, 3000), random.randint(0, 300)
        a = np.unique(np.array([random.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.unique(np.concatenate([a[m:], np.array([random.getrandbits(64) for _ in range(m)], np.uint64)]))
        x, y = (ngram_join.fold(v, ngram_join.width_for(v.size)) for v in (a, b))
        assert ngram_join.hamming(x, y) <= np.setxor1d(a, b).size


def linked_sets(n, apart):
    """Two sets whose symmetric difference has `apart` members, of n and about n."""
    both = [random.getrandbits(64) for _ in range(n)]
    more = [random.getrandbits(64) for _ in range(apart)]
    k = random.randint(0, apart)
    a, b = both[: n - k // 2] + more[:k], both[: n - k // 2] + more[k:]
    return tuple(np.unique(np.array(x, np.uint64)) for x in (a, b))


def test_linked_sets_share_a_block():
    """(band, block, bits) keys meet for every pair that may link, over all bands and the borders between them."""
    often = np.zeros(ngram_join.BUCKETS, bool)
    often[::3] = True
    tried = 0
    for n in [1, 2, 3, 4, 7, 9, 20, 47, 48, 55, 63, 64, 65, 80, 86, 150, 190, 250, 256, 300, 340, 700, 1000, 1030, 1300, 5000]:
        for _ in range(25):
            a, b = linked_sets(n, random.randint(0, (2 * n) // 6))
            both = np.intersect1d(a, b).size
            if not both or 100 * both < 75 * (a.size + b.size - both):
                continue
            tried += 1
            of, keys, _ = ngram_join.block_keys([a, b], often)
            assert set(keys[of == 0].tolist()) & set(keys[of == 1].tolist()), (a.size, b.size, both)
            assert np.bincount(of, minlength=2).max() <= 2 + a.size // 3 + b.size // 3 + 2 * max(a.size, b.size) // 7 + 2
    assert tried > 300


def test_blocks_differ_no_more_than_sets():
    for _ in range(50):
        a, b = linked_sets(random.randint(60, 900), random.randint(0, 90))
        if ngram_join.band_of(np.array([a.size]))[0] != ngram_join.band_of(np.array([b.size]))[0]:
            continue
        blocks = ngram_join.blocks_of(ngram_join.band_of(np.array([a.size])))[0]
        sketches = []
        for x in (a, b):
            sketch = Counter()
            for v in x.tolist():
                sketch[((v >> 32) * int(blocks)) >> 32] ^= v
            sketches.append({k: v for k, v in sketch.items() if v})
        x, y = sketches
        assert sum(x.get(k) != y.get(k) for k in x.keys() | y.keys()) <= np.setxor1d(a, b).size


def test_words_of_like_structure_differ():
    """The two halves of a doubled Thue-Morse word have equal polynomial hashes modulo 2^64; they are no equal words."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    hashes, _ = word_hashes([word.encode(), other.encode(), b"a", b"b", b"A", b"aa", b"a\x00", b"abcdefgh", b"abcdefghi"])
    assert len(set(hashes.tolist())) == 8 and hashes[2] == hashes[4]
    assert not np.intersect1d(*shingle_sets([word.encode(), other.encode()])).size


def test_ngram_join_forest_rounds(spark, monkeypatch):
    """With no pair a row allowed at once, every block gives a forest first; components are the same."""
    rows = corpus() + [(700 + i, near(rows_base, random.randint(4, 9))) for rows_base in [text(130)] for i in range(40)]
    df = docs_frame(spark, rows)
    there = components(rows)
    monkeypatch.setattr(ngram_join, "FEW", 0)
    found = ngram_join.near_duplicates(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == there


def test_forest_joins_what_edges_join():
    for _ in range(100):
        n, m = random.randint(2, 12), random.randint(1, 30)
        edges = [(random.randrange(n), random.randrange(n)) for _ in range(m)]
        edges = np.array([e for e in edges if e[0] != e[1]] or [(0, 1)])
        kept = ngram_join._forest(edges[:, 0], edges[:, 1], np.random.randint(0, 5, len(edges)))
        assert kept.size < n

        def parts(edges):
            label = list(range(n))
            for _ in range(n):
                for a, b in edges:
                    label[a] = label[b] = min(label[a], label[b])
            return label

        assert parts(edges.tolist()) == parts(edges[kept].tolist())


def test_ngram_join_salted_keys(spark, monkeypatch):
    """Frequent shingles: their keys are dealt out with a salt, and parts meet again through their centres."""
    monkeypatch.setattr(ngram_join, "SALTS", 8)
    base = text(90)
    rows = [(i, near(base, random.randint(0, 4))) for i in range(120)] + [(1000 + i, text(40) + " " + base[:200]) for i in range(30)]
    df = docs_frame(spark, rows).repartition(2)
    assert ngram_join.sketches(df.select("doc_id", "text")).where("size(often) > 0").count()
    found = ngram_join.near_duplicates(df).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == components(rows)


def test_ngram_join_same_id_with_other_texts(spark):
    """Rows of one doc_id are one node: it links what any of its texts links."""
    a, b = text(60), text(80)
    rows = [(5, a), (5, b), (1, a), (9, near(b, 1)), (9, near(b, 1)), (7, text(50))]
    found = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(docs_frame(spark, rows)).collect())
    assert found == [(1, 1), (5, 1), (5, 1), (7, 7), (9, 1), (9, 1)]


def test_ngram_join_long_text(spark):
    long = text(60000)
    rows = [(1, long), (2, near(long, 1200)), (3, text(60000)), (4, "w" * 200000), (5, "w" * 200000 + " x")]
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs_frame(spark, rows)).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (101, 102), (200, 200)]
    found = {r["id"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def suffix_corpus():
    passage, other = text(120), text(90)
    rows = [(i, text(30) + " " + passage[: 250 + 20 * i] + " " + text(20)) for i in range(8)]
    rows += [(20 + i, passage[40 * i :] + "é" * i + other) for i in range(6)]
    rows += [(40, "x" * 1000), (41, "ab" * 500), (42, None), (43, ""), (44, passage[:199]), (45, "é" * 150), (46, text(400))]
    rows += [(50, text(50) * 3), (51, rows[-1][1])]
    same = text(60)
    rows += [(60 + i, same) for i in range(5)]
    return rows


def test_suffix_dedup_is_exact(spark):
    rows = suffix_corpus()
    found = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup(docs_frame(spark, rows)).collect()}
    there = cut_repeats([(t or "").encode() for _, t in rows])
    assert found == {i: w for (i, _), w in zip(rows, there)}


def test_suffix_dedup_small_slices(spark, monkeypatch):
    """Equal segments in one slice and in several give the same."""
    rows = suffix_corpus() * 1
    df = docs_frame(spark, rows).repartition(5)
    found = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup(df).collect()}
    assert found == {i: w for (i, _), w in zip(rows, cut_repeats([(t or "").encode() for _, t in rows]))}


def test_suffix_dedup_hot_anchors(spark, monkeypatch):
    """Anchors with several segments are counted by window where they are many; the result is the same."""
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    test_suffix_dedup_is_exact(spark)


def test_suffix_dedup_long_texts(spark):
    """Texts of several pieces, with repeats across the borders of pieces."""
    long = "".join(random.choices("abcdefgh ", k=(5 << 19) + 77))
    rows = [(1, long), (2, "q" + long[(1 << 20) - 300 : (1 << 20) + 500]), (3, "y" * 300 + long[-250:])]
    found = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.dedup(docs_frame(spark, rows)).collect()}
    assert {i: (f[1], f[2]) for i, f in found.items()} == {1: (1050, 2), 2: (800, 1), 3: (550, 1)}


@pytest.mark.parametrize("batch", [2, 3, 512])
def test_texts_of_one_core(monkeypatch, batch):
    """Groups that are split into longer cores find what a direct comparison of windows finds."""
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    core = bytes(random.choices(b"ab", k=suffix_dedup.SPAN - suffix_dedup.STEP + 1))
    side = suffix_dedup.STEP - 1
    for _ in range(10):
        heads, tails = ([bytes(random.choices(b"abc", k=side)) for _ in range(4)] for _ in range(2))
        rows = []
        for k in range(random.randint(2, 25)):
            head, tail = random.choice(heads), random.choice(tails)
            i, j = random.randint(0, side), random.randint(0, side)
            i = max(i, side - j)  # a window at least
            head = bytes(random.choices(b"xyz", k=random.randint(0, i))) + head
            rows.append((7, k, 1000 * k, i, head[-i:][:i].rjust(i, b"q") + core + tail[:j]))
        columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary()))]
        batches = suffix_dedup._compare(iter([pa.RecordBatch.from_arrays(columns, names=["key", "row_id", "lo", "head", "text"])]))
        found = {(r["row_id"], p) for b in batches for r in b.to_pylist() for p in range(r["lo"], r["hi"] + 1)}
        windows = [(t[p : p + suffix_dedup.SPAN], k, lo + p) for _, k, lo, _, t in rows for p in range(len(t) - suffix_dedup.SPAN + 1)]
        counts = Counter(w for w, _, _ in windows)
        assert found == {(k, p) for w, k, p in windows if counts[w] > 1}


def test_suffix_dedup_repeated_rows_and_empty(spark):
    assert suffix_dedup.dedup(docs_frame(spark, [])).collect() == []
    long = text(100)
    rows = [(1, long), (1, long), (2, text(100))]
    found = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.dedup(docs_frame(spark, rows)).collect())
    assert found == [(1, len(long)), (1, len(long)), (2, 0)]


def test_remove_repeats_keeps_columns(spark):
    rows = suffix_corpus()
    df = docs_frame(spark, rows)
    kept = suffix_dedup.remove_repeats(df)
    assert kept.columns == df.columns
    got = {r["doc_id"]: r for r in kept.collect()}
    assert got[42]["text"] is None and all(r["row_id"] == 1 and r["found"] == "x" for r in got.values())
    assert got[40]["text"] == "" and got[40]["n_chars"] == 0
    assert got[44]["text"] == dict(rows)[44]


@pytest.mark.parametrize("alphabet", [b"ab", b"abcdefghij"])
def test_column_wise_construction(alphabet):
    for _ in range(60):
        strings = [bytes(random.choices(alphabet, k=random.randint(0, 15))) for _ in range(random.randint(1, 7))]
        owner, place, prefix = suffix_dedup.column_wise(strings)
        order = sorted(((i, j) for i, s in enumerate(strings) for j in range(len(s) + 1)), key=lambda x: [(c + 1, 0) for c in strings[x[0]][x[1] :]] + [(0, x[0])])
        assert list(zip(owner.tolist(), place.tolist())) == order
        for k in range(1, len(order)):
            a, b = (strings[i][j:] for i, j in order[k - 1 : k + 1])
            common = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert prefix[k] == common
