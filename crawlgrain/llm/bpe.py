"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes hits a mask, so equal passages of different
documents give equal chunks wherever they stand. A worker encodes each distinct chunk once and
keeps what its inner part gives; the pieces of words at both ends of a chunk stay open. Where two
chunks meet, the open ends are put together and encoded again. The window of that repair grows
over as many chunks as needed, until it ends at white space on both sides: the tokenizer drops
white space and no pre-token crosses it, so there both readings agree exactly with the reading of
the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crawlgrain.llm.common import BASE, BYTE_VALUE, IS_SPACE, STORES, as_bytes, only, powers, slices, tidied

#: A cut after a byte with probability 2^-CUT_BITS: chunks of 512 bytes on average.
CUT_BITS, WINDOW = 9, 24
#: Bytes of words and of chunks that a worker keeps at once.
WORD_BYTES, CHUNK_BYTES = 224 << 20, 16 << 20
MOST_CHUNK = 1 << 16
#: Bytes of text that are encoded at once.
SLICE = 1 << 20

#: Latin-1 letters with simple case pairs; none of them composes with another.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _byte_level() -> dict[int, int]:
    """Byte to character of the byte-level form: printable bytes are themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in own)}


BYTE_LEVEL = _byte_level()
# What a tokenizer file must say before and about pre-tokens. It follows that white space is dropped, that letters
# a-z and those of Latin-1 pass but for their case, and that a word of letters is one pre-token in byte-level form.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_INVERSE = pow(int(BASE), -1, 1 << 64)
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
_ENCODERS: dict[str, Encoder] = {}
STORES.append(_ENCODERS)


_STOP, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[ord("."), ord(",")]] = True
_ALNUM[[ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True


def set_apart(texts: list[bytes]) -> list[bytes]:
    """texts with a space before each . and , that ends a word of ASCII letters and digits: a pre-token ends there anyway."""
    joined = b"\n".join([*texts, b""])
    buf = np.frombuffer(joined, np.uint8)
    stops = np.flatnonzero(_STOP[buf])
    stops = stops[(stops > 0) & _ALNUM[buf[stops - 1]] & IS_SPACE[buf[np.minimum(stops + 1, buf.size - 1)]]]
    if not stops.size:
        return texts
    out = np.full(buf.size + stops.size, 32, np.uint8)
    kept = np.ones(out.size, bool)
    kept[stops + np.arange(stops.size)] = False
    out[kept] = buf
    changed = out.tobytes()
    ends = np.cumsum([len(t) + 1 for t in texts])
    ends = (ends + np.searchsorted(stops, ends)).tolist()
    return [changed[i : j - 1] for i, j in zip([0, *ends], ends, strict=False)]


def cut_places(texts: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each text: after each byte where the hash of the last WINDOW bytes has CUT_BITS zeros, and its own end."""
    joined = b"".join(texts)
    buf = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    hits = np.zeros(0, np.int64)
    if (n := buf.size) > WINDOW:
        sums = np.cumsum(BYTE_VALUE[buf] * powers(n), dtype=np.uint64)
        window = sums[WINDOW:] - sums[:-WINDOW]  # of the bytes i+1 .. i+WINDOW, times BASE^(i+1)
        # dividing by BASE^(i+1) makes it independent of the place
        window *= _inverse_powers(n)[1 : n - WINDOW + 1]
        hits = np.flatnonzero((window >> np.uint64(64 - CUT_BITS)) == 0) + WINDOW + 1
    bounds = np.searchsorted(hits, ends, "right").tolist()
    out, start, i = [], 0, 0
    for end, j in zip(ends.tolist(), bounds, strict=True):
        places = [x - start for x in hits[i:j].tolist() if x - start > WINDOW]  # the window is all in this text
        if end > start and (not places or places[-1] != end - start):
            places.append(end - start)
        out.append(places)
        start, i = end, j
    return out


_INV = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _INV
    if _INV.size < n:
        steps = np.full(max(n, 4096), _INVERSE, np.uint64)
        steps[0] = 1
        _INV = np.cumprod(steps, dtype=np.uint64)
    return _INV[:n]


class Encoder:
    """One tokenizer file with the worker's stores of words and chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.names: dict[int, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.word_bytes = 0
        self.chunks: dict[bytes, list | None] = {}
        self.chunk_bytes = 0
        self.reused = 0
        form = json.loads(self.tokenizer.to_str())
        if form["normalizer"] != NORMALIZER or form["pre_tokenizer"] != PRE_TOKENIZER:
            raise ValueError(f"{path}: white space has to separate pre-tokens as NORMALIZER and PRE_TOKENIZER have it")

    def name(self, i: int) -> bytes:
        if i not in self.names:
            self.names[i] = self.tokenizer.id_to_token(i).encode()
        return self.names[i]

    def learn(self, words: set[bytes]) -> None:
        """Put words into the store; those that are in use move on from the older half."""
        rest, apart = self._read(words)
        if apart:  # a letter or digit ends a pre-token before . and , so those are read apart
            more, _ = self._read({x for base, end in apart.values() for x in (base, end)}, split=False)
            rest += more
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False), strict=True):
                self._put(w, struct.pack(f"<{len(e.ids)}I", *e.ids))
        store = self.words
        for w, (base, end) in apart.items():
            self._put(w, store[base] + store[end])

    def _read(self, words: set[bytes], split: bool = True) -> tuple[list[bytes], dict[bytes, tuple[bytes, bytes]]]:
        """Words that the library has to read whole, and those that end in . or , with their parts; the others are put in store."""
        rest, apart = [], {}
        old, tokenize, store = self.old_words, self.tokenizer.model.tokenize, self.words
        before = len(store)
        size = 0
        for w in words.difference(store):
            if w in old:
                store[w] = old[w]
            elif w.isalpha() and w.islower():  # ASCII letters only
                ids = [t.id for t in tokenize(w.decode())]
                store[w] = _PACK[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)
            elif split and (base := w.rstrip(b".,")) and len(base) < len(w) and base[-1:].isalnum():
                apart[w] = base, w[len(base) :]
                continue
            elif m := LATIN.fullmatch(w.decode()):
                ids = [t.id for t in tokenize(m[0].lower().encode().decode("latin-1").translate(BYTE_LEVEL))]
                store[w] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                rest.append(w)
                continue
            size += len(w) + len(store[w])
        self.word_bytes += size + 170 * (len(store) - before)
        return rest, apart

    def _put(self, word: bytes, packed: bytes) -> None:
        self.words[word] = packed
        self.word_bytes += len(word) + len(packed) + 170

    def _open(self, piece: bytes) -> list | None:
        """[open head, inner words, open tail] of a chunk; None if it has no white space.

        The head ends and the tail begins at white space, so either may be empty.
        """
        parts = piece.split()
        first, last = IS_SPACE[piece[0]], IS_SPACE[piece[-1]]
        if len(parts) == 1 and not first and not last:
            return None
        head = b"" if first else parts.pop(0)
        tail = b"" if last or not parts else parts.pop()
        return [head, parts, tail]

    def prepare(self, text: bytes) -> bytes:
        """text with A-Z lower-cased where the normaliser would do it with the same result.

        Composition comes before lower-casing there, so a text with U+0300 to U+037F (first bytes CC and CD: all marks that
        compose with ASCII letters, and those that decompose to such marks) stays, and one that may hold a special token.
        """
        return text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.lower()

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts as little-endian uint32.

        The words of all chunks that aren't in store, and those that joins make, are looked up together.
        """
        if self.word_bytes > WORD_BYTES // 2:
            self.old_words, self.words, self.word_bytes = self.words, {}, 0
        store, chunks = self.chunks, {}
        wanted: set[bytes] = set()
        plans: list[list] = []
        texts = set_apart(list(map(self.prepare, texts)))
        for text, places in zip(texts, cut_places(texts), strict=True):
            plan: list = []
            open_end: list[bytes] = []
            at = 0
            for end in places:
                piece = text[at:end]
                at = end
                got = chunks.get(piece, 0)
                if got == 0:
                    got = store.get(piece, 0)
                    if got == 0:
                        got = self._open(piece)
                        if got is not None:
                            wanted.update(got[1])
                    else:
                        self.reused += 1
                    chunks[piece] = got
                else:
                    self.reused += 1
                if got is None:
                    open_end.append(piece)
                    continue
                open_end.append(got[0])
                if w := b"".join(open_end):
                    wanted.add(w)
                    plan.append(w)
                plan.append(got)
                open_end = [got[2]]
            if w := b"".join(open_end):
                wanted.add(w)
                plan.append(w)
            plans.append(plan)
        self.learn(wanted)
        ids = self.words.__getitem__
        for piece, got in chunks.items():
            if got is not None and type(got[1]) is list:
                got[1] = b"".join(map(ids, got[1]))
            if piece not in store and len(piece) <= MOST_CHUNK:
                store[piece] = got
                self.chunk_bytes += 2 * len(piece) + (len(got[1]) if got else 0) + 500
        if self.chunk_bytes > CHUNK_BYTES:
            store.clear()
            self.chunk_bytes = 0
        return [b"".join([ids(x) if type(x) is bytes else x[1] for x in plan]) for plan in plans]

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of what the library's decode gives: without a decoder it joins the tokens' names by one space."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
        names = self.names
        try:
            return b" ".join([names[i] for i in ids.tolist()])
        except KeyError:
            return b" ".join([self.name(i) for i in ids.tolist()])


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file that drops white space and has no pre-token across it."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_DECIMAL: list[bytes] = []


def decimals(ids: np.ndarray) -> bytes:
    """Ids in decimal, joined by one space."""
    global _DECIMAL
    values = ids.tolist()
    if values and (most := max(values)) >= len(_DECIMAL):
        _DECIMAL = [b"%d" % i for i in range(most + 1 + 1024)]
    return b" ".join([_DECIMAL[i] for i in values])


def encode_documents(docs: DataFrame, path: str, *, keep_ids: bool = True) -> DataFrame:
    """(doc_id, ids array<int>) or, with keep_ids false, (doc_id, n_tokens, ids_sha256, decoded_sha256).

    docs needs doc_id and text; other columns are not read. A null or empty text has no ids. Rows
    are taken one by one, so repeated rows give repeated results. A text without white space is
    one word and is encoded whole, however long it is.
    """

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text", SLICE):
            found = [np.frombuffer(x, "<u4") for x in enc.encode_all(as_bytes(batch.column("text")))]
            offsets = np.concatenate([[0], np.cumsum([f.size for f in found])])
            values = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], names=["doc_id", "ids"]
            )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, "text", SLICE):
            n, a, b = [], [], []
            for x in enc.encode_all(as_bytes(batch.column("text"))):
                ids = np.frombuffer(x, "<u4")
                n.append(ids.size)
                a.append(hashlib.sha256(decimals(ids)).hexdigest())
                b.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    docs = only(docs, doc_id="long", text="string")
    if keep_ids:
        return docs.mapInArrow(tidied(ids_of, _ENCODERS), "doc_id long, ids array<int>")
    return docs.mapInArrow(tidied(digests, _ENCODERS), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the library's decode with special tokens kept. Null ids give ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode(np.array(ids or [], np.uint32)).decode() for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return only(encoded, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")


def pieces_of(ids: bytes, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of ids cut into pieces of size; only longer ones are cut."""
    n = len(ids) // 4
    for k, start in enumerate(range(0, n, size)):
        part = ids[4 * start : 4 * (start + size)]
        yield k, start, len(part) // 4, zlib.crc32(part)


