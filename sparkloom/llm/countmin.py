"""Count-min sketches merged across partitions, as the bits of counters that reached two.

Counts are never too low, so what the sketch calls single is single. The memory is bounded by the width, whatever the
number of keys; a width too small for the keys makes more of them look repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import words as W

SEGMENT = 1 << 20
ROWS = 2


def power(n: int) -> int:
    """The least power of two that is n or more."""
    return 1 << max(0, n - 1).bit_length()


def twice(keys: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """Whether each key's estimate is two or more in a sketch of ROWS rows that counts all keys by their weights."""
    out = np.ones(len(keys), bool)
    for row in range(ROWS):
        at = cells(keys, row, width)
        out &= np.bincount(at, weight, width)[at] >= 2
    return out


def width_for(keys: int, most: int = 1 << 26) -> int:
    """Counters a row: about four a key, a power of two between SEGMENT and most."""
    return min(most, max(SEGMENT, 1 << max(0, 4 * keys - 1).bit_length()))


def cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return (W.mix(keys, 20 + row) & W.U64(width - 1)).astype(np.int64)


def repeated_bits(docs: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """ROWS x width / 8 bytes. keys gives the uint64 keys of a slice of docs, each as often as it counts; docs has a column text.

    Every partition counts in a sketch of its own; segments are merged on the executors as a stream, and ROWS * width /
    SEGMENT rows of 128 KB at most reach the driver.
    """
    schema = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("once", T.BinaryType()), T.StructField("twice", T.BinaryType())])
    size = SEGMENT // 8

    def shut(bits: np.ndarray) -> bytes:
        return pa.compress(bits.tobytes(), codec="zstd", asbytes=True)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((ROWS, width), np.uint8)
        for batch in parts:
            for part in W.batches(batch, "text"):
                got = keys(part)
                for row in range(ROWS):
                    at, n = np.unique(cells(got, row, width), return_counts=True)
                    table[row, at] = np.minimum(table[row, at] + n, 2)
        flat = table.reshape(-1, SEGMENT)
        for k in range(len(flat)):
            if flat[k].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([shut(np.packbits(flat[k] >= 1))]), pa.array([shut(np.packbits(flat[k] >= 2))])], schema.names)

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in parts:
            for k, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                o, t = (np.frombuffer(pa.decompress(x, size, codec="zstd", asbytes=True), np.uint8) for x in (once, twice))
                if k in held:
                    had = held[k]
                    had[1] = had[1] | t | (had[0] & o)
                    had[0] = had[0] | o
                else:
                    held[k] = [o, t]
        for k, (o, t) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b""], pa.binary()), pa.array([shut(t)])], schema.names)

    n_segments = ROWS * width // SEGMENT
    merged = docs.mapInArrow(count, schema).repartition(min(n_segments, 64), "segment").mapInArrow(merge, schema)
    bits = np.zeros((n_segments, size), np.uint8)
    for row in merged.select("segment", "twice").toLocalIterator():
        bits[row.segment] = np.frombuffer(pa.decompress(bytes(row.twice), size, codec="zstd", asbytes=True), np.uint8)
    return bits.reshape(ROWS, -1)


def repeated(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """True for the keys whose estimate is two or more."""
    out = np.ones(len(keys), bool)
    for row in range(ROWS):
        at = cells(keys, row, bits.shape[1] * 8)
        out &= (bits[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out
