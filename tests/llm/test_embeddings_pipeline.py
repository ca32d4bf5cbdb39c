"""Embedding near-duplicates, and the pipeline stage by stage."""

import numpy as np

import corpus_pipeline
from crawlgrain.llm import embed_dedup, packing, secrets
from crawlgrain.llm.queries import TOKENIZER
from tests.llm.helpers import components, cut_repeats


def brute(rows, cosine=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _ in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    found = set()
    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                found.add((i, j))
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i, _ in rows}, found


def vectors(n, d, rng):
    rows, k = [], 0
    for _ in range(n):
        base = rng.normal(size=d)
        for _ in range(int(rng.integers(1, 5))):
            rows.append((k, [float(x) for x in (base + rng.normal(size=d) * rng.uniform(0.05, 0.4)).astype(np.float32)]))
            k += 1
    return rows


def test_embeddings_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL", 64)
    rng = np.random.default_rng(1)
    rows = vectors(400, 32, rng)
    dup = rows[0][1]
    rows += [(5000 + i, dup) for i in range(30)] + [(6000, None), (6001, []), (6002, [0.0] * 32), (6003, [float("nan")] + [1.0] * 31), (6004, [None] + [1.0] * 31), (6005, [1.0, 0.0]), (6006, [2.0, 0.1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, key string")
    found = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    there, links = brute(rows)
    assert set(found) == set(there)
    assert sum(r["n_links"] for r in found.values()) >= 0.99 * 2 * len(links)
    assert all(found[i]["n_links"] <= n for i, (n, _) in there.items())
    assert np.mean([found[i]["component_id"] == c for i, (_, c) in there.items()]) >= 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())
    for i in (6000, 6001, 6002, 6003, 6004):
        assert (found[i]["n_links"], found[i]["component_id"]) == (0, i)
    assert found[6005]["component_id"] == found[6006]["component_id"] == 6005


def test_large_group_is_whole_across_cells(spark, monkeypatch):
    """A third of the rows are one group (mean cosine 0.92) that the cells cut into many slices."""
    monkeypatch.setattr(embed_dedup, "CELL", 64)
    rng = np.random.default_rng(5)
    n, d = 3000, 64
    x = rng.normal(size=(n, d))
    base = rng.normal(size=d)
    x[: n // 3] = base / np.linalg.norm(base) + rng.normal(size=(n // 3, d)) * np.sqrt((1 / 0.92 - 1) / d)
    x = x[rng.permutation(n)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    there = (unit @ unit.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(df).collect()}
    assert all(found[i] <= there[i] for i in range(n))
    assert sum(found.values()) >= 0.99 * there.sum()


def test_link_with_a_visitor_counts_at_both_ends(spark, monkeypatch):
    """The rows at 40 degrees visit the cell of the row at 60 degrees, which doesn't visit theirs."""
    monkeypatch.setattr(embed_dedup, "MARGIN_SIGMAS", 0.5)
    monkeypatch.setattr(embed_dedup, "fit_cells", lambda classes: {2: np.eye(2)})
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    df = spark.createDataFrame([(1, at(40)), (2, at(60)), (3, at(40)), (4, at(-80))], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df).collect()}
    assert found == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True)}


def test_embedding_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = vectors(60, 16, rng)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(embed_dedup, "BLOCK", 17)
    assert sorted(map(tuple, embed_dedup.near_duplicates(df).collect())) == whole
    assert embed_dedup.near_duplicates(df.where("false")).collect() == []


def test_tiny_huge_and_nameless_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e-200, 0.0]), (3, [0.5, 0.5]), (4, [1e200, 1e200]), (5, [5e-324, 5e-324]), (None, [1.0, 0.0]), (7, [0.0, 0.0]), (7, [3.0, 3.0]), (9, [float("nan"), 1.0])]
    found = sorted(map(tuple, embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert found == sorted([(1, 1, 1, True), (2, 1, 1, False), (3, 3, 3, True), (4, 3, 3, False), (5, 3, 3, False), (7, 3, 3, False), (7, 0, 7, True), (9, 0, 9, True), (None, 0, None, False)], key=str)


ODD = [(1, None), (2, ""), (3, " \n"), (4, "word " * 300), (4, "word " * 300), (None, "one two three"), (5, "é" * 30000), (6, "x y " * 8000), (7, "token = abcdefgh12345678 and more words"), (8, None)]


def odd_docs(spark, rows):
    """Rows with nulls, empty and long texts, repeated ids, and columns named like those that stages make."""
    full = [(i, t, None if t is None else len(t), "_b", ["_f"], 1, 2, "c") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, n_chars long, _base string, _found array<string>, _row_id int, _dropped_id int, component_id string")


def test_stages_with_odd_rows(spark, sf):
    rows = odd_docs(spark, ODD)
    for name, stage in corpus_pipeline.STAGES:
        found, none = stage(spark, rows, sf), stage(spark, rows.where("false"), sf)
        assert none.count() == 0, name
        if name != "best-fit packing":
            assert found.columns == none.columns == rows.columns, name
    texts = {name: sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in stage(spark, rows, sf).collect()), key=str) for name, stage in corpus_pipeline.STAGES[:-1]}
    known = sorted(((i, t, None if t is None else len(t)) for i, t in ODD), key=str)
    assert {i for i, _, _ in texts["quality rules"]} <= {4, 5, 6}
    assert texts["n-gram Jaccard join"] == known
    cut = {i: (t, n) for i, t, n in texts["suffix-array dedup"]}
    assert len(texts["suffix-array dedup"]) == len(ODD) and cut[1] == (None, None) and cut[4] == ("", 0) and cut[5] == ("", 0) and cut[7][0] == ODD[8][1]
    masked = {i: t for i, t, _ in texts["secret scans"]}
    assert len(texts["secret scans"]) == len(ODD) and masked[7] == "[secret] and more words" and masked[8] is None
    packed = dict(corpus_pipeline.STAGES)["best-fit packing"](spark, rows, sf)
    assert packed.where("doc_id is null").count() == 1 and packed.where("doc_id = 1").select("length").collect()[0][0] == 1


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, sf).cache()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    one = stages["n-gram Jaccard join"](spark, good, sf).cache()
    assert {r["doc_id"] for r in one.collect()} == {i for i, (_, c) in components(rows).items() if i == c}
    cut = stages["suffix-array dedup"](spark, one, sf).cache()
    before = [(r["doc_id"], r["text"]) for r in one.collect()]
    after = {r["doc_id"]: r["text"] for r in cut.collect()}
    for (i, t), (n, removed, _, _) in zip(before, cut_repeats([t.encode() for _, t in before])):
        assert n - removed - 3 <= len(after[i].encode()) <= n - removed
    clean = stages["secret scans"](spark, cut, sf).cache()
    assert clean.columns == docs.columns and clean.count() == cut.count()
    assert all(not r["spans"] or "password" not in r["spans"] for r in secrets.report(clean).collect())
    packed = stages["best-fit packing"](spark, clean, sf)
    assert packed.count() == packing.token_pieces(clean, TOKENIZER).count()


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
