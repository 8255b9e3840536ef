"""Helpers shared by the operators of this package: spreading rows, whole-table input,
byte-level words and their hashes.

Words are found on the UTF-8 bytes of an Arrow column with numpy, a slice of documents at a
time, so memory follows the slice (or the longest single text) and never the table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage, ensure_checkpoint_dir, keep  # noqa: F401

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Bytes of text that a task handles at once (one longer text is handled alone).
SLICE_BYTES = 1 << 20
BITMAP = 1 << 22

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1, _MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)          # digits, letters and every byte outside ASCII
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_LETTER = IS_WORD.copy()
IS_LETTER[48:58] = False
NOT_SPACE = np.ones(256, bool)         # all but blank, tab, line feed, VT, FF, CR
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def on_workers(spark: SparkSession) -> None:
    """Python workers find this package also when the driver was not started in its folder."""
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by the hash of ``keys``; adaptive execution then cuts and merges the
    partitions by bytes, so a few large row groups or one hot key don't make long tasks."""
    return df.hint("rebalance", *[F.col(k) for k in keys])


@contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the actions inside; the session's own setting
    holds again after them. For rows of several whole texts each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that ``columns`` doesn't have."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if len(arr) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset:arr.offset + len(arr) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes (a longer row is a range of its own)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * _MIX1
    h ^= h >> U(27)
    h *= _MIX2
    h ^= h >> U(31)
    return h


def bitmap(df: DataFrame, col: str) -> np.ndarray:
    """Bits set for the values of a long column: a filter of fixed size that saves rows before
    an exact join. At most BITMAP / 8 small rows reach the driver, whatever the column holds."""
    slot = F.pmod(F.col(col), F.lit(BITMAP))
    rows = df.groupBy(F.floor(slot / 8).cast("int").alias("at")).agg(
        F.bit_or(F.pow(F.lit(2), slot % 8).cast("int")).alias("bits")).toArrow()
    out = np.zeros(BITMAP // 8, np.uint8)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint8)
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = np.mod(values.view(np.int64), BITMAP)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


class Words:
    """Words of the documents in one slice of bytes.

    ``start``/``end``: byte places; ``first``: index of each document's first word (and the
    total at the end); ``hash``: 64-bit hash of the word's bytes with A-Z in lower case.
    """

    __slots__ = ("data", "offsets", "start", "end", "first", "hash")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray = IS_WORD):
        self.data, self.offsets = LOWER[data], offsets
        n = len(data)
        inside = member[data]
        cut = offsets[(offsets > 0) & (offsets < n)]
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        before[cut] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(n + 1, bool)
        after[:-1] = inside
        after[cut] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        total = np.zeros(n + 1, U)
        np.cumsum((self.data.astype(U) + U(1)) * _power("up", _BASE, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * _power("down", _BASE_INV, n + 1)[self.start]
        self.hash = mix(h + (self.end - self.start).astype(U))

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of every ``size`` consecutive words, index of each document's first one).

        A document of fewer words has one gram of all its words, if it has any."""
        n = np.diff(self.first)
        per = np.maximum(n - size + 1, (n > 0).astype(n.dtype))
        first = np.concatenate(([0], np.cumsum(per)))
        at = np.repeat(self.first[:-1] - first[:-1], per) + np.arange(first[-1])
        left = np.repeat(self.first[1:], per) - at
        g = np.zeros(len(at), U)
        for k in range(size):
            g = np.where(left > k, (g ^ (g >> U(29))) * _MIX1 + self.hash[np.minimum(at + k, len(self.hash) - 1)], g)
        return mix(g), first

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def word_slices(arr: pa.Array, member: np.ndarray = IS_WORD, limit: int = SLICE_BYTES):
    """(first row, last row, Words) for each slice of a string column."""
    data, offsets = text_bytes(arr)
    for a, b in slices(offsets, limit):
        yield a, b, Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], member)


def hash_of(words: list[str]) -> np.ndarray:
    """Hashes that ``Words`` gives these words."""
    if not words:
        return np.zeros(0, U)
    raw = [w.encode() for w in words]
    off = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    return Words(np.frombuffer(b"".join(raw), np.uint8), off, np.ones(256, bool)).hash
