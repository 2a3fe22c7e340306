"""Shared pieces: bounded Arrow batches, text access, vectorised words and hashes; tables in the folder all executors see come from tessera.storage."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..storage import discard, shared_dir, stored

__all__ = ["discard", "shared_dir", "stored"]

U64 = np.uint64
#: Bytes of text handled at once by the vectorised kernels; longer documents are cut between words.
CHUNK = 1 << 18
#: Bytes and rows of an Arrow batch between the JVM and Python (one row at least).
BATCH_BYTES, BATCH_ROWS = 2 << 20, 4096
#: Word separators of the contracts: space and bytes 9 to 13.
SEP = np.zeros(256, bool)
SEP[[0x20, *range(9, 14)]] = True
#: The same separators as a regular expression for Spark's functions.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII lower-casing.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Units of a hashed stretch from which its hash is cryptographic: long inputs that collide in polynomials modulo 2**64 are known.
STRONG = 512
_P = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def tidy() -> None:
    """Gives memory that Arrow and the C library hold unused back to the system, for the next stage's sake."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow over batches of bounded bytes (from here on in the session); workers hold no spare memory after a task."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            conf.set(key, str(most))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(it)
        finally:
            tidy()

    return df.mapInArrow(run, schema)


def fresh(columns: list[str], name: str) -> str:
    """name, lengthened until it is none of columns (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (rows + 1) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, over uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n of each at least."""
    have = _tables.get("p")
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            a = np.full(size, base, U64)
            a[0] = 1
            _tables[key] = np.multiply.accumulate(a)
    return _tables["p"], _tables["q"]


def strong(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, units: np.ndarray) -> np.ndarray:
    """hashes of the stretches units[starts:ends], those of the long ones (rare, as a rule) by BLAKE2."""
    for i in np.flatnonzero(ends - starts >= STRONG).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(units[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Byte ranges of about size bytes that begin and end at separators or ends of documents."""
    at, end = 0, len(data)
    while at < end:
        to = min(end, at + size)
        if to < end:
            back = np.flatnonzero(SEP[data[max(at, to - 4096) : to]])
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if len(back):
                to = max(at, to - 4096) + int(back[-1]) + 1
            elif offsets[k] > at:
                to = int(offsets[k])
            else:  # one very long word: on to its end
                stop = int(offsets[k + 1])
                while to < stop and not SEP[data[to]]:
                    step = np.flatnonzero(SEP[data[to : min(stop, to + size)]])
                    to = to + int(step[0]) if len(step) else min(stop, to + size)
        yield at, to
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data[at:to], counted from at; no word crosses documents."""
    on = ~SEP[data[at:to]]
    edge = np.empty(len(on) + 1, bool)
    edge[0] = on[0] if len(on) else False
    edge[-1] = on[-1] if len(on) else False
    np.not_equal(on[1:], on[:-1], out=edge[1:-1])
    cuts = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to, "left")] - at
    cuts = np.unique(cuts)
    cuts = cuts[(cuts > 0) & (cuts < len(on))]
    cuts = cuts[on[cuts] & on[cuts - 1]]  # two words that touch between documents
    where = np.flatnonzero(edge)
    if len(cuts):
        where = np.sort(np.concatenate([where, cuts, cuts]))
    return where[::2], where[1::2]


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, how many each document has, and their starts and ends in data.

    fold lower-cases A-Z first. Equal words have equal hashes everywhere.
    """
    hs, ss, es = [], [], []
    for at, to in pieces(data, offsets):
        s, e = spans(data, offsets, at, to)
        if not len(s):
            continue
        p, q = powers(to - at + 1)
        part = data[at:to]
        c = np.empty(to - at + 1, U64)
        c[0] = 0
        np.multiply((LOWER[part] if fold else part), p[: to - at], out=c[1:], dtype=U64, casting="unsafe")
        np.cumsum(c, out=c)
        h = mix((c[e] - c[s]) * q[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        hs.append(strong(h, s, e, LOWER[part] if fold else part) if len(s) and (e - s).max() >= STRONG else h)
        ss.append(s + at)
        es.append(e + at)
    if not hs:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), np.zeros(len(offsets) - 1, np.int64), z, z
    h, s, e = map(np.concatenate, (hs, ss, es))
    return h, np.diff(np.searchsorted(s, offsets)), s, e


def batches_by_bytes(it: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about most bytes of column (one row at least)."""
    for b in it:
        if not b.num_rows:
            continue
        size = np.concatenate([[0], np.cumsum(np.diff(text_buffers(b.column(column))[1]))])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(size, size[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to
