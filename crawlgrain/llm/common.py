"""Shared pieces of the training-data operators: tables in the shared folder, batches, text hashing."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlgrain.session import shared_dir, ship


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends at replicated files.

    Shuffle files that only the finished job needed are released for cleaning.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "crawlgrain", f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nobody holds."""
    gc.collect()
    spark._jvm.System.gc()


def drop_table(df: DataFrame) -> None:
    """Delete a table made by materialize() that no later plan reads."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def only(df: DataFrame, **types: str) -> DataFrame:
    """The named columns with their types; other columns, clashing names or not, stay out."""
    ship(df.sparkSession)
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in types.items()))


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about most_bytes of the string column, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


#: What operators keep in a worker from task to task.
STORES: list[dict] = []


def clear_stores() -> None:
    """Empty the STORES of this process. A function of the module, so that a task means its worker's own ones."""
    for store in STORES:
        store.clear()


def tidied(run: Callable[[Iterator], Iterator], keep: dict | None = None) -> Callable[[Iterator], Iterator]:
    """run as it is, but with other operators' STORES emptied before, and what it freed given back to the system at the end.

    Workers are used again and again, by tasks of any operator.
    """
    kept = keep is not None

    def wrapped(batches: Iterator) -> Iterator:
        if not kept:
            clear_stores()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:  # not in every C library
                trim(0)

    return wrapped


def as_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 of each string, b'' for null."""
    return [v or b"" for v in array.cast(pa.binary()).to_pylist()]


# --- hashing, the same on every machine -------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 over uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _table(seed: int) -> np.ndarray:
    return mix64(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


BYTE_VALUE = _table(0x243F6A8885A308D3)
BASE = np.uint64(0xD1342543DE82EF95)  # odd, so it has an inverse modulo 2^64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE^0 ... BASE^(n-1) modulo 2^64."""
    global _POWERS
    if _POWERS.size < n:
        steps = np.full(max(n, 4096), BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, A-Z lower-cased, and the first word of each text.

    The second array has len(texts) + 1 entries. A word is read eight bytes at a time; each of these
    goes through mix64 with its place, so no two words of like structure have like hashes.
    """
    joined = b"\n".join([b"", *texts, b""]).lower()
    buf = np.frombuffer(joined + bytes(8), np.uint8)
    edges = np.flatnonzero(np.diff((~IS_SPACE[buf[: len(joined)]]).view(np.int8)))
    starts, lengths = edges[0::2] + 1, edges[1::2] - edges[0::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)]) if texts else np.zeros(1, np.int64)
    if not starts.size:
        return np.zeros(0, np.uint64), bounds
    parts = (lengths + 7) >> 3
    first = np.cumsum(parts) - parts
    place = np.arange(int(parts.sum())) - np.repeat(first, parts)
    eights = np.ndarray(len(joined) + 1, "<u8", buf, strides=(1,))[np.repeat(starts, parts) + 8 * place]
    last = first + parts - 1
    spare = (8 * parts - lengths).astype(np.uint64) * np.uint64(8)
    eights[last] = (eights[last] << spare) >> spare
    mixed = mix64(eights + mix64(place.astype(np.uint64) + np.uint64(1)))
    return mix64(np.add.reduceat(mixed, first) + lengths.astype(np.uint64) * _M2), bounds


SHINGLE = 5


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; the whole sequence if it is shorter; none without words."""
    words, bounds = word_hashes(texts)
    out = []
    if words.size >= k:
        n = words.size - k + 1
        rolled = np.full(n, k, np.uint64)
        for i in range(k):
            rolled = rolled * BASE + words[i : i + n]
        rolled = mix64(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for i in range(a, b):
                h = h * BASE + words[i : i + 1]
            out.append(mix64(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def int_list(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """An Arrow list<int64> array from offsets and (u)int64 values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64()))


def spread(key: Column | str, n: int) -> Column:
    """A salt from 0 to n-1 that depends on the key only."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
