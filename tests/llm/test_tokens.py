"""BPE codec and packing."""

import hashlib
import random
import sys
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from crawlgrain.llm import bpe, packing
from crawlgrain.llm.common import tidied
from crawlgrain.llm.queries import TOKENIZER
from tests.llm.helpers import docs_frame

PIECES = list("abABIJKE'st re12 \t\n\r\x0b\x0c\x1c\x85\xa0́̌̇ẛ̣ΣσςéÉ語\U0001f600İ$%.,") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'ll", " the ", ". ", ", ", "..", " ", "a. ", "b, ", "c.", "9,\n", ".d", "e.,"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def texts():
    random.seed(2)
    out = ["".join(random.choices(PIECES, k=random.randint(0, 400))) for _ in range(300)]
    shared = "".join(random.choices(PIECES, k=3000))
    return out + [shared, "x" + shared, shared + " y " + shared, "語" * 5000, "", "a" * 3000, " " * 2000]


def test_encode_and_decode_agree_with_the_library(spark, library):
    rows = list(enumerate(texts())) + [(9999, None)]
    found = {r["doc_id"]: r for r in bpe.encode_documents(docs_frame(spark, rows), TOKENIZER, keep_ids=False).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found[i]["n_tokens"] == len(ids), repr(t)[:200]
        assert found[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_small_stores_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORD_BYTES", 4000)
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 2000)
    e = bpe.Encoder(TOKENIZER)
    rows = [t.encode() for t in texts()]
    for k in range(0, len(rows), 7):
        for t, ids in zip(rows[k : k + 7], e.encode_all(rows[k : k + 7])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t.decode(), add_special_tokens=False).ids


def test_marks_and_letters_agree_with_the_library(library):
    """Words of ASCII letters with every mark that there is, and with characters that decompose."""
    random.seed(9)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    odd = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.normalize("NFC", chr(c)) != chr(c)]
    letters = "ATKIYoumtswhj.,'"
    rows = ["T\u0344", "A\u0340 e\u0343K"] + [c + m for m in marks + odd for c in random.sample(letters, 3)]
    rows += ["".join(random.choices(letters, k=2)) + "".join(random.choices(marks, k=2)) + random.choice(odd) + random.choice(letters) for _ in range(20000)]
    e = bpe.Encoder(TOKENIZER)
    for k in range(0, len(rows), 500):
        part = rows[k : k + 500]
        for t, ids, own in zip(part, e.encode_all([t.encode() for t in part]), library.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == own.ids, ascii(t)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_encode_empty_table(spark):
    assert bpe.encode_documents(docs_frame(spark, []), TOKENIZER, keep_ids=False).collect() == []


def test_shared_chunks_are_reused():
    random.seed(3)
    passage = " ".join("".join(random.choices("abcdefghij", k=6)) for _ in range(2000)).encode()
    e = bpe.Encoder(TOKENIZER)
    e.encode(b"one " + passage)
    before = e.reused
    e.encode(b"something else before " + passage)
    assert e.reused - before > 10


def test_other_operators_empty_the_stores(spark):
    """A task of another operator leaves no encoder in its worker."""

    def look(batches):
        n = len(sys.modules["crawlgrain.llm.bpe"]._ENCODERS) if "crawlgrain.llm.bpe" in sys.modules else 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([n] * b.num_rows)], names=["n"])

    df = docs_frame(spark, [(1, "a b c"), (2, "d")]).coalesce(1)
    bpe.encode_documents(df, TOKENIZER, keep_ids=False).collect()
    assert [r["n"] for r in df.mapInArrow(tidied(look, {}), "n long").collect()] == [1, 1]
    assert [r["n"] for r in df.mapInArrow(tidied(look), "n long").collect()] == [0, 0]


def test_round_trip_frames(spark):
    rows = [(1, "the quick fox"), (2, None), (1, "the quick fox")]
    encoded = bpe.encode_documents(docs_frame(spark, rows), TOKENIZER)
    assert sorted((r["doc_id"], r["text"]) for r in bpe.decode_documents(encoded, TOKENIZER).collect()) == [(1, "the</w> quick</w> fox</w>")] * 2 + [(2, "")]


def check_packing(rows, capacity):
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_pack_documents(spark, library):
    random.seed(4)
    rows = [(i, " ".join(random.choices(["the", "fox", "a,", "dogs"], k=random.choice([0, 5, 300, 900, 2047, 2048, 5000])))) for i in range(80)] + [(500, None), (3, "the same id")]
    found = packing.pack_documents(docs_frame(spark, rows), TOKENIZER).collect()
    n = check_packing(found, 2048)
    total = sum(r["length"] for r in found)
    assert n <= 1.02 * total / 2048 + 1
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        if i == 3:
            continue
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == list(range(0, len(ids), 2048))
        for r in parts:
            part = np.array(ids[r["start"] : r["start"] + 2048], "<u4")
            assert (r["length"], r["ids_crc32"]) == (part.size, zlib.crc32(part.tobytes()))
    assert packing.pack_documents(docs_frame(spark, []), TOKENIZER).collect() == []


def rounds(counts, capacity):
    """Rows of all placements, made by sweeps without Spark, and the number of rounds."""
    waiting, gaps, sequences, rows, n_rounds = [(k, 0, n) for k, n in counts.items()], [], 0, [], 0
    while waiting:
        placed, waiting, gaps, sequences = packing.sweep(waiting, gaps, sequences, capacity)
        n_rounds += 1
        for length, rank, n, sequence, offset in placed:
            rows += [{"length": length, "rank": rank + k, "sequence_id": sequence + k, "offset": offset} for k in range(n)]
    return rows, n_rounds


def best_fit_decreasing(counts, capacity):
    """Sequences that brute force makes: one piece at a time, the longest first, into the smallest gap that holds it."""
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(capacity - length)
    return len(gaps)


def test_sweeps_place_every_rank_once():
    random.seed(6)
    for _ in range(150):
        counts = {random.randint(1, 64): random.randint(1, 50) for _ in range(random.randint(1, 30))}
        rows, n_rounds = rounds(counts, 64)
        assert sorted((r["length"], r["rank"]) for r in rows) == sorted((k, i) for k, n in counts.items() for i in range(n))
        least = max(sum(k * n for k, n in counts.items()) / 64, sum(n for k, n in counts.items() if k > 32))
        n = check_packing(rows, 64)
        assert n <= 1.3 * least + 1 and n <= 1.1 * best_fit_decreasing(counts, 64) + 1
        assert n_rounds < 40


def test_a_gap_takes_the_longest_piece_left_by_smaller_gaps():
    placed, waiting, gaps, n = packing.sweep([(3, 0, 2), (5, 0, 1), (9, 0, 1)], [(4, 0, 1), (6, 1, 1), (6, 2, 1)], 3, 10)
    assert sorted(placed) == [(3, 0, 1, 0, 6), (3, 1, 1, 2, 4), (5, 0, 1, 1, 4), (9, 0, 1, 3, 0)]
    assert (waiting, sorted(gaps), n) == ([], [(1, 0, 1), (1, 1, 1), (1, 3, 1), (3, 2, 1)], 4)


def test_plan_in_spark_is_the_sweeps(spark):
    random.seed(8)
    counts = {random.randint(1, 64): random.randint(1, 900) for _ in range(30)}
    found = packing.plan(spark.createDataFrame(list(counts.items()), "length long, n long"), 64)
    rows = [{"length": r[0], "rank": r[1] + k, "sequence_id": r[3] + k, "offset": r[4]} for r in found.collect() for k in range(r[2])]
    key = lambda r: (r["length"], r["rank"])
    assert sorted(rows, key=key) == sorted(rounds(counts, 64)[0], key=key)


def test_lengths_out_of_range(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 0, 65)], "doc_id long, piece int, start long, length long"), 64)
