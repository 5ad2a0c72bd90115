"""Byte-level BPE with a hierarchical-bitmap rank queue.

All uncached pre-tokens of a block are merged together in one linked list whose pieces are not joined. The queue has
one bucket of list positions per merge rank; a three-level bitmap marks the buckets in use, and find-first-set on it
gives the lowest rank. A position whose pair has changed since it was pushed is stale and is skipped. Each merge costs
a constant number of steps however long a pre-token is.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import words as W

_SHIFT = 20
#: A space before anything but white space starts a pre-token, so texts may be cut there and the parts cached.
_CUT = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Buckets of positions by rank under a bitmap of three levels of 64 bits (up to 262,144 ranks)."""

    def __init__(self, size: int) -> None:
        self.buckets: list[list[int] | None] = [None] * size
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.buckets[rank] = [position]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.append(position)

    def put(self, rank: int, positions: list[int]) -> None:
        """Adds a list of positions to a bucket."""
        self.push(rank, positions[0])
        self.buckets[rank].extend(positions[1:])

    def pop(self) -> tuple[int, list[int]] | None:
        """Takes out the bucket of the lowest rank: find-first-set on each level."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1
        bucket, self.buckets[rank] = self.buckets[rank], None
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return rank, bucket


class Encoder:
    """Encodes and decodes by a rank table and a pattern; caches are bounded by cache entries."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 300_000) -> None:
        self.ranks, self.cache = ranks, cache
        # White space as Unicode has it, whatever the regex library takes \s for.
        self.find = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.table = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.lengths = np.array(list(map(len, self.tokens)), np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << _SHIFT | b] = rank
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)
        self.first = np.full((256, 256), -1, np.int64)
        for a in range(256):
            for b in range(256):
                self.first[a, b] = self.ranks.get(bytes([a, b]), -1)
        self.queue = RankQueue(self.size)
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece; all pieces share one linked list and one queue. Large blocks are merged a bucket at a time."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        token = self._merge_buckets(data, ends) if len(data) >= 20_000 else self._merge_positions(data, ends)
        kept = token >= 0
        at = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
        ids = token[kept].tolist()
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _links(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, next and previous positions (-1: none) and the rank of each position's pair with the next (-1: none)."""
        n = len(data)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends[:-1]] = -1
        rank = np.full(n, -1, np.int64)
        rank[:-1] = self.first[data[:-1], data[1:]]
        rank[ends - 1] = -1
        return self.bytes[data], after, before, rank

    def _start(self, rank: np.ndarray) -> None:
        at = np.flatnonzero(rank >= 0)
        self._push_all(at, rank[at])

    def _push_all(self, at: np.ndarray, rank: np.ndarray) -> None:
        if len(at) == 1:
            self.queue.push(int(rank[0]), int(at[0]))
        elif len(at):
            order = np.argsort(rank, kind="stable")
            at, rank = at[order].tolist(), rank[order]
            cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
            rank = rank.tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                self.queue.put(rank[a], at[a:b])

    def _merge_positions(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        token, after, before, rank_of = self._links(data, ends)
        self._start(rank_of)
        token, after, before = token.tolist(), after.tolist(), before.tolist()
        queue, pairs, push = self.queue, self.pairs, self.queue.push
        while (got := queue.pop()) is not None:
            rank, bucket = got
            bucket.sort()
            for k, p in enumerate(bucket):
                left = token[p]
                n = after[p]
                if left < 0 or n < 0 or pairs.get(left << _SHIFT | token[n]) != rank:
                    continue  # stale
                token[p] = rank
                token[n] = -1
                after[p] = nn = after[n]
                least = rank
                if nn >= 0:
                    before[nn] = p
                    r = pairs.get(rank << _SHIFT | token[nn])
                    if r is not None:
                        push(r, p)
                        least = min(least, r)
                b = before[p]
                if b >= 0:
                    r = pairs.get(token[b] << _SHIFT | rank)
                    if r is not None:
                        push(r, b)
                        least = min(least, r)
                if least < rank and k + 1 < len(bucket):  # a lower rank has come up: it goes first
                    queue.put(rank, bucket[k + 1 :])
                    break
        return np.array(token, np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 where there is none."""
        key = left << _SHIFT | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.values[i], -1)

    def _merge_buckets(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        token, after, before, pair = self._links(data, ends)
        self._start(pair)
        queue = self.queue
        while (got := queue.pop()) is not None:
            rank, bucket = got
            p = np.array(bucket)
            p.sort()
            p = p[pair[p] == rank]  # the others are stale
            if not len(p):
                continue
            if len(p) > 1:
                if (p[1:] == p[:-1]).any():
                    p = np.unique(p)
                chained = np.concatenate([[False], after[p[:-1]] == p[1:]])
                if chained.any():  # of overlapping pairs the leftmost goes first, so every other one
                    i = np.arange(len(p))
                    p = p[(i - np.maximum.accumulate(np.where(chained, 0, i))) % 2 == 0]
            n = after[p]
            nn, b = after[n], before[p]
            r, l = np.flatnonzero(nn >= 0), np.flatnonzero(b >= 0)
            whole = np.full(max(len(r), len(l)), rank)
            if len(p) > 1:
                early = self._look(whole[: len(r)], token[nn[r]]), self._look(token[b[l]], whole[: len(l)])
                if any(((x >= 0) & (x < rank)).any() for x in early):  # a merge here makes a lower rank, which must go next
                    queue.put(rank, p[1:].tolist())
                    p, n, nn, b = p[:1], n[:1], nn[:1], b[:1]
                    r, l = np.flatnonzero(nn >= 0), np.flatnonzero(b >= 0)
            token[p] = rank
            token[n] = -1
            pair[n] = -1
            after[p] = nn
            before[nn[r]] = p[r]
            b = before[p]  # a neighbour may have been merged too
            l = np.flatnonzero(b >= 0)
            right = np.full(len(p), -1)
            right[r] = self._look(token[p[r]], token[after[p[r]]])
            pair[p] = right
            left = self._look(token[b[l]], token[p[l]])
            pair[b[l]] = left
            r, k = np.flatnonzero(right >= 0), np.flatnonzero(left >= 0)
            self._push_all(np.concatenate([p[r], b[l][k]]), np.concatenate([right[r], left[k]]))
        return token

    def _pieces(self, units: list[str], spaced: bool) -> tuple[list[str], list[int]]:
        """The pre-tokens of all units, and the len + 1 places where each unit's begin. Units that begin with a space before
        something else are matched as one text, as no match crosses into such a space."""
        if spaced:
            pieces = self.find("".join(units))
            ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            cuts = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
            at = np.searchsorted(ends, cuts) + 1
            if not len(at) or at[-1] == len(pieces) and (ends[at - 1] == cuts).all():
                return pieces, [0, *at.tolist()]
        each = [self.find(u) for u in units]
        return [p for ps in each for p in ps], np.cumsum([0, *map(len, each)]).tolist()

    def _ids(self, pieces: list[str]) -> None:
        """self.pieces gets the ids of every one of these pre-tokens as little-endian unsigned 32-bit integers."""
        known, ranks = self.pieces, self.ranks
        block: list[str] = []
        room = 0

        def flush() -> None:
            for p, ids in zip(block, self.merge([p.encode() for p in block]), strict=True):
                known[p] = struct.pack(f"<{len(ids)}I", *ids)
            block.clear()

        for p in set(pieces) - known.keys():
            rank = ranks.get(p.encode())
            if rank is not None:
                known[p] = rank.to_bytes(4, "little")
                continue
            block.append(p)
            room += len(p)
            if room >= 1 << 22:
                flush()
                room = 0
        if block:
            flush()

    def _fill(self, units: list[str], spaced: bool) -> list[bytes]:
        """The ids of every unit; spaced: all begin with a space before something else."""
        pieces, at = self._pieces(units, spaced)
        if len(self.pieces) > self.cache:
            self.pieces.clear()
        self._ids(pieces)
        ids = list(map(self.pieces.__getitem__, pieces))
        out = [ids[a] if b - a == 1 else b"".join(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        for p in pieces:
            if len(p) > 64:
                self.pieces.pop(p, None)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        parts = [_CUT.split(t) if _ODD.search(t) else t.split(" ") for t in texts]
        seen: set[str] = set()
        for p in parts:
            seen.update(p[1:])
        if len(self.units) > self.cache:
            self.units.clear()
        units = self.units
        new = [u for u in seen if u not in units]
        units.update(zip(new, self._fill([" " + u for u in new], True), strict=True))
        heads = [p[0] for p in parts]
        first = dict(zip(set(heads), self._fill(list(set(heads)), False), strict=True))
        get = units.__getitem__
        out = [first[p[0]] + b"".join(map(get, p[1:])) for p in parts]
        for u in new:
            if len(u) > 64:
                del units[u]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids given as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_all(self, rows: list[bytes], limit: int = 1 << 20) -> Iterator[bytes]:
        """decode() of each of these; some are gathered at once from one table of all tokens' bytes."""
        a = 0
        while a < len(rows):
            b, size = a, 0
            while b < len(rows) and (b == a or size + len(rows[b]) <= limit):
                size += len(rows[b])
                b += 1
            if size > limit:  # one very long row
                yield self.decode(rows[a])
                a = b
                continue
            ids = np.frombuffer(b"".join(rows[a:b]), "<u4")
            n = self.lengths[ids]
            ends = np.cumsum(n)
            at = np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
            data = self.table[at].tobytes()
            stops = np.append(0, ends)[np.cumsum([len(r) // 4 for r in rows[a:b]])].tolist()
            for x, y in zip([0, *stops[:-1]], stops, strict=True):
                yield data[x:y]
            a = b


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(read_ranks(path), pattern)


def encoded(batch: pa.RecordBatch, text: str, path: str, pattern: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with the ids of their texts (null: empty)."""
    for part in W.batches(batch, text, 1 << 24):
        yield part, encoder(path, pattern).encode([t or "" for t in part.column(text).to_pylist()])


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs and the array of token ids of every whole text.

    A null or empty text has no ids; repeated rows are encoded alike; other columns pass through, and one named as
    ids is replaced. Very long texts are encoded whole: time grows with their length, memory too.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != ids])
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, got in encoded(batch, text, path, pattern):
            at = np.cumsum([0, *(len(x) // 4 for x in got)], dtype=np.int32)
            flat = pa.array(np.frombuffer(b"".join(got), "<i4"), pa.int32())
            kind = pa.list_(pa.field("element", pa.int32(), False))
            made = pa.ListArray.from_arrays(pa.array(at), flat).cast(kind)
            yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, ids])

    return common.arrow_map(docs, run, schema)


def decode_documents(rows: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """rows and the decoded bytes of the ids (null ids: null)."""
    schema = T.StructType([*rows.schema.fields, T.StructField(data, T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = encoder(path, pattern).tokens
        made = [None if x is None else b"".join([tokens[i] for i in x]) for x in batch.column(ids).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, data])

    return common.arrow_map(rows, run, schema)


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's columns: encodes every whole text of docs(doc_id, text), decodes the ids, and digests both.

    A null text is encoded as an empty one and has no ids; null ids and repeated rows are rows like others; a text or a
    pre-token of any length is encoded whole; other columns play no part; an empty table gives an empty table.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, got in encoded(batch, "text", path, pattern):
            decoded = encoder(path, pattern).decode_all(got)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), pa.array([len(x) // 4 for x in got], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in got]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.arrow_map(docs.select(F.col("doc_id"), F.col("text")), run, schema)
