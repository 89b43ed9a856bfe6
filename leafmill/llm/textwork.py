"""Vectorised work on the UTF-8 bytes of Arrow string arrays.

Everything here is numpy over flat byte buffers: no Python object is made per word.  Batches are
cut into pieces of bounded bytes first, so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; numpy's temporaries take about 50 times as much (12 times for what a
#: single text has beyond that).
PIECE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def pieces(batch: pa.RecordBatch, column: int = 0, limit: int = PIECE_BYTES, most_rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``limit`` bytes of text in ``column`` (one row at least)."""
    if batch.num_rows == 0:
        return
    offsets = text_offsets(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), start + most_rows, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def text_offsets(array: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    raw = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32) if array.buffers()[1] else np.zeros(1, np.int32)
    return raw[array.offset : array.offset + len(array) + 1].astype(np.int64)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the array's strings, and each row's offset in them; null counts as empty."""
    if array.null_count:
        array = array.fill_null("")
    offsets = text_offsets(array)
    data = array.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


@dataclass
class Words:
    """Words of some rows, in order: byte spans in ``data``, row numbers and 64-bit hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    rows: int

    def text(self, first: int, last: int) -> bytes:
        """Words first..last-1, joined by spaces."""
        raw = self.data
        return b" ".join(raw[self.start[i] : self.end[i]].tobytes() for i in range(first, last))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def class_table(words: bytes, lower: bool = True, above: bool = True) -> np.ndarray:
    """A 256-entry map: 0 for separators, else the byte itself, A-Z lowered on request."""
    out = np.zeros(256, np.uint8)
    keep = set(words) | (set(range(0x80, 0x100)) if above else set())
    for b in keep:
        out[b] = b + 32 if lower and 65 <= b <= 90 else b
    return out


_ALNUM = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of 0-9, a-z (A-Z lowered first) and everything outside ASCII.
ALNUM = class_table(_ALNUM)


def _spans(flag: np.ndarray, offsets: np.ndarray, change: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true bytes; runs never cross rows, nor a true ``change``."""
    n = len(flag)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    if change is not None:
        first |= change
    before = np.zeros(n, bool)
    before[1:] = flag[:-1]
    start = np.flatnonzero(flag & (~before | first))
    after = np.zeros(n, bool)
    after[:-1] = flag[1:] & ~first[1:]
    end = np.flatnonzero(flag & ~after) + 1
    return start, end


def tokenize(array: pa.Array, table: np.ndarray = ALNUM, prefixes: tuple[int, ...] = ()) -> tuple[Words, list[np.ndarray]]:
    """Words by a :func:`class_table`; also hashes of each word's first k bytes for k in ``prefixes``."""
    flat, offsets = text_bytes(array)
    mapped = table[flat]
    start, end = _spans(mapped != 0, offsets)
    hashes = _run_hashes(mapped, start, end, prefixes)
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(mapped, start, end, row, hashes[0], len(array)), hashes[1:]


def _run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Hashes of the runs, and of their first k bytes; runs of about ``PIECE_BYTES`` at a time, so that
    one very long text needs no more."""
    out = [np.zeros(len(start), np.uint64) for _ in range(1 + len(prefixes))]
    upto = np.cumsum(end - start)
    at = 0
    while at < len(start):
        done = upto[at - 1] if at else 0
        stop = max(int(np.searchsorted(upto, done + PIECE_BYTES, "right")), at + 1)
        first, size = start[at:stop], end[at:stop] - start[at:stop]
        begin = np.zeros(len(size), np.int64)
        np.cumsum(size[:-1], out=begin[1:])
        rel = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(begin, size)
        value = (data[rel + np.repeat(first, size)].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[rel]
        out[0][at:stop] = mix(np.add.reduceat(value, begin))
        for i, k in enumerate(prefixes, 1):
            part = np.add.reduceat(np.where(rel < k, value, np.uint64(0)), begin)
            out[i][at:stop] = mix(part + np.uint64(k))
        at = stop
    return out


#: Byte classes for :func:`runs`: 0 white space, 1 letters, digits and non-ASCII, 2 other ASCII.
RUN_CLASS = np.full(256, 2, np.uint8)
RUN_CLASS[list(b" \t\n\r\x0b\x0c")] = 0
RUN_CLASS[list(_ALNUM)] = 1
RUN_CLASS[0x80:] = 1


def runs(array: pa.Array) -> Words:
    """Alternating runs of word characters and of punctuation, case kept."""
    flat, offsets = text_bytes(array)
    kind = RUN_CLASS[flat]
    change = np.zeros(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    start, end = _spans(kind != 0, offsets, change)
    row = np.searchsorted(offsets, start, "right") - 1
    return Words(flat, start, end, row, _run_hashes(flat, start, end)[0], len(array))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether all k are in one row."""
    n = len(words.hash)
    if n < k:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    out = np.zeros(n, np.uint64)
    last = n - k + 1
    acc = np.zeros(last, np.uint64)
    for j in range(k):
        acc = acc * _BASE + words.hash[j : j + last]
    out[:last] = mix(acc + np.uint64(k))
    ok = np.zeros(n, bool)
    ok[:last] = words.row[:last] == words.row[k - 1 :]
    return out, ok
