"""A sieve of byte strings: a Bloom filter that finds the pieces of longer texts which may be one of the strings.

Its size is bounded whatever the number of strings, so it can be sent to all tasks. It never misses a string; what it lets
through wrongly is for an equality join to drop, and that grows only once there are more than some 10^8 strings and beginnings.

A piece is looked for step by step: each string is entered whole, and by its beginnings of 4, 8, 12, ... bytes; a place of the
text where no string begins is given up after its first four bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = 4  #: bytes by which a beginning grows
LEAST_WORDS, MOST_WORDS = 1 << 10, 1 << 22  #: of 64 bits; 32 MB at most
PART = 1 << 16  #: words that are put together in one row
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_OF_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


class _Text:
    """A column of byte strings; the hash of any piece of it takes a few steps. Powers are kept for the next column."""

    kept = (_powers(1, _BASE), _powers(1, _INVERSE))

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.bytes = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if len(column) and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0] if len(column) else np.zeros(1, np.int64)
        n = len(self.bytes)
        if len(_Text.kept[0]) <= n:
            _Text.kept = (_powers(2 * n + 1, _BASE), _powers(2 * n + 1, _INVERSE))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[self.bytes] * _Text.kept[0][:n])])

    def hashes(self, place: np.ndarray, length: int | np.ndarray, whole: bool) -> np.ndarray:
        h = (self.sums[place + length] - self.sums[place]) * _Text.kept[1][place]
        h ^= np.asarray(2 * np.asarray(length) + whole).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def _bits(h: np.ndarray) -> np.ndarray:
    """Four of the 64 bits of its word."""
    one, six = np.uint64(1), np.uint64(63)
    m = one << (h >> np.uint64(40) & six)
    for k in (46, 52, 58):
        m |= one << (h >> np.uint64(k) & six)
    return m


def _entries(column: pa.Array) -> np.ndarray:
    """Distinct hashes of strings and their beginnings."""
    t = _Text(column)
    start, size = t.at[:-1], np.diff(t.at)
    start, size = start[size > 0], size[size > 0]
    out = [t.hashes(start, size, True)]
    n = STEP
    while len(start := start[size >= n]):
        size = size[size >= n]
        out.append(np.unique(t.hashes(start, n, False)))
        n += STEP
    return np.unique(np.concatenate(out))


class Sieve:
    def __init__(self, words: np.ndarray, least: int, most: int):
        self.words, self.least, self.most = words, least, most

    def _has(self, h: np.ndarray) -> np.ndarray:
        m = _bits(h)
        return self.words[(h & np.uint64(len(self.words) - 1)).astype(np.int64)] & m == m

    def holds(self, strings: pa.Array) -> np.ndarray:
        """Which may be among the strings of the sieve."""
        t = _Text(strings)
        return self._has(t.hashes(t.at[:-1], np.diff(t.at), True))

    def pieces(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Row and bytes of each piece of a text that may be one of the strings."""
        t = _Text(texts)
        row = np.repeat(np.arange(len(t.at) - 1), np.diff(t.at))
        place, left = np.arange(len(t.bytes)), t.at[1:][row] - np.arange(len(t.bytes))
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def whole(n: int) -> None:
            if self.least <= n <= self.most:
                p = place[left >= n]
                p = p[self._has(t.hashes(p, n, True))]
                found.append((p, np.full(len(p), n)))

        for n in range(1, self.most + 1):
            if n % STEP == 0:
                place, left = place[left >= n], left[left >= n]
                on = self._has(t.hashes(place, n, False))
                place, left = place[on], left[on]
            if not len(place):
                break
            whole(n)
        p = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        size = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(p, kind="stable")
        p, size = p[order], size[order]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        taken = t.bytes[np.repeat(p - ends[:-1], size) + np.arange(ends[-1])]
        low = pa.Array.from_buffers(pa.large_binary(), len(p), [None, pa.py_buffer(ends), pa.py_buffer(taken)]).cast(pa.binary())
        return pa.array(row[p]), low


def of(strings: DataFrame) -> Broadcast:
    """The sieve of a column of byte strings, sent to all tasks. What the driver holds is bounded, the strings stay where they are."""
    spark, name = strings.sparkSession, strings.columns[0]
    size = F.octet_length(name)
    n, least, most = strings.agg(F.count("*"), F.min(size), F.max(size)).first()
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (max(1, n) // 2).bit_length()))  # two entries a string, about; 16 bits an entry

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = _entries(b.column(0))
            part = (h & np.uint64(words - 1)) // np.uint64(PART)
            yield pa.record_batch({"part": pa.array(part.astype(np.int32)), "h": pa.array(h.view(np.int64))})

    def put(rows: pd.DataFrame) -> pd.DataFrame:
        h = rows["h"].to_numpy().view(np.uint64)
        own = np.zeros(min(PART, words), np.uint64)
        np.bitwise_or.at(own, (h & np.uint64(len(own) - 1)).astype(np.int64), _bits(h))
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "words": [own.tobytes()]})

    all_ = np.zeros(words, np.uint64)
    made = strings.mapInArrow(entries, "part int, h bigint").groupBy("part").applyInPandas(put, "part int, words binary")
    for r in made.collect() if n else []:
        own = np.frombuffer(bytes(r["words"]), np.uint64)
        all_[r["part"] * len(own) : (r["part"] + 1) * len(own)] = own
    return spark.sparkContext.broadcast(Sieve(all_, least or 0, most or 0))
