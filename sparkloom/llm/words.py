"""Vectorised words: boundaries, 64-bit word hashes and window hashes over Arrow string columns.

A word is a maximal run of bytes other than \\x20 and \\x09-\\x0D in the UTF-8 form of one text, which is what
``bytes.split()`` returns and what the pattern ``[^\\x20\\x09-\\x0D]+`` matches. Hashes depend only on the bytes
and on constants in this file, so every executor computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BLOCK = 1 << 20


def word_bytes() -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    return table


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every output bit depends on all input bits."""
    x = x + U64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 11)
_BASE = 0xD1342543DE82EF95
_STEP = (0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (base is odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        room = max(1024, 1 << (n - 1).bit_length())
        up = np.full(room, base, np.uint64)
        down = np.full(room, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have[0][:n], have[1][:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copying them, and the len + 1 offsets of its texts; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return raw, at - at[0]


def spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word crosses the end of a text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hash_prefixes(raw: np.ndarray, starts: np.ndarray, ends: list[np.ndarray], fold: np.ndarray | None = None) -> list[np.ndarray]:
    """64-bit hashes of the bytes from each start to each of several ends; the first ends are the furthest.

    Works in blocks of BLOCK bytes (more only if one word is longer). fold maps bytes first, for instance to lower case.
    """
    out = [np.empty(len(starts), np.uint64) for _ in ends]
    values = _BYTE if fold is None else _BYTE[fold]
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends[0], at + BLOCK, "right")))
        part = raw[at : ends[0][j - 1]]
        up, down = powers(_BASE, len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(values[part] * up[:-1], out=total[1:])
        s = starts[i:j] - at
        first, scale = total[s], down[s]
        for k, end in enumerate(ends):
            e = end[i:j] - at
            out[k][i:j] = mix((total[e] - first) * scale + (e - s).astype(np.uint64), 1)
        i = j
    return out


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    return hash_prefixes(raw, starts, [ends], fold)[0]


def range_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of each run of word hashes [start, end); which picks one of two independent families."""
    up, down = powers(_STEP[which], len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64), 3 + which)


def window_hashes(hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A hash of every run of width consecutive word hashes (len - width + 1 of them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return range_hashes(hashes, at, at + width, which)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every width consecutive values, by doubling."""
    have, least = 1, values
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    return least


def batches(batch: pa.RecordBatch, text: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each, one row at least."""
    _, at = column_bytes(batch.column(text))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
