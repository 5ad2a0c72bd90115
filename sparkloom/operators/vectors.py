"""Quantised vector search: int8 codes, sign bits, a Hamming shortlist and exact rescoring.

Vectors cross to numpy in Arrow batches; sums run in the order of the components, as they do in SQL.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: Score floors, shortlist pool, common-name share and least count.
QUERY_FLOOR = 0.20
KIN_FLOOR = 0.65
LEVELS = 127


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(at, pa.array(rows.reshape(-1))).cast(pa.list_(pa.field("element", kind, False)))


def _with(df: DataFrame, fields: list[T.StructField], make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """df with further columns made of each record batch."""
    schema = T.StructType([*df.schema.fields, *fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part)], schema.names)

    return df.mapInArrow(run, schema)


def _array(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, T.ArrayType(kind, False))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Every row over its length; a zero row stays as it is."""
    n = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
    return np.divide(x, n[:, None], out=x.copy(), where=n[:, None] > 0)


def codes_of(unit: np.ndarray, scale: float) -> np.ndarray:
    """Rounded (half away from zero) and clamped codes."""
    y = unit * scale
    return np.clip(np.trunc(y + np.copysign(0.5, y)), -LEVELS, LEVELS).astype(np.int32)


def sign_words(unit: np.ndarray) -> np.ndarray:
    """Sign bits (1 where positive or zero) in words of 64, the first component in the lowest bit."""
    n, dim = unit.shape
    bits = np.zeros((n, -(-dim // 64) * 64), np.uint8)
    bits[:, :dim] = unit >= 0
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Vectors without nulls, NaN or infinities, of the length most rows have (ties to the shorter)."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(embedding).isNotNull()).filter(finite & (F.size(embedding) > 0))
    usual = rows.groupBy(F.size(embedding).alias("d")).count().orderBy(F.desc("count"), "d").limit(1)
    return rows.join(F.broadcast(usual.select("d")), F.size(embedding) == F.col("d"), "left_semi")  # one row


def index(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vectors with unit, code, bits and scale, as a written table: it is built once and searched many times.

    The scale is 127 over the largest component of all unit vectors; it is one number, found by a first pass.
    """
    from ..sources import shared

    def largest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max((float(np.abs(unit_rows(_matrix(part.column(0), np.float64))).max(initial=0)) for part in parts if part.num_rows), default=0.0)
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["m"])

    most = vectors.select(F.col(embedding).cast("array<double>")).mapInArrow(largest, "m double").agg(F.max("m")).first()[0] or 0.0
    scale = LEVELS / most if most > 0 else float(LEVELS)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        unit = unit_rows(_matrix(part.column(embedding), np.float64))
        return [_lists(unit, pa.float64()), _lists(codes_of(unit, scale), pa.int32()), _lists(sign_words(unit), pa.int64()), pa.array(np.full(len(unit), scale))]

    fields = [_array("unit", T.DoubleType()), _array("code", T.IntegerType()), _array("bits", T.LongType()), T.StructField("scale", T.DoubleType())]
    return shared.written(_with(vectors, fields, make), "vectors")


def scored(rows: DataFrame, query: DataFrame, column: str, name: str, id_: str = "vec_id") -> DataFrame:
    """rows but the query's own with a score to the query's one row: idot over codes, or hamming over bits."""
    found = query.select(F.col(id_).alias("id"), column).limit(1).collect()  # one vector
    if not found:
        return rows.limit(0).withColumn(name, F.lit(0).cast("long" if name == "idot" else "int"))
    q = np.array(found[0][1], np.int64)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        x = _matrix(part.column(column), np.int64)
        if name == "idot":
            return [pa.array(x @ q)]
        return [pa.array(np.bitwise_count((x ^ q).view(np.uint64)).sum(1).astype(np.int32))]

    field = T.StructField(name, T.LongType() if name == "idot" else T.IntegerType())
    return _with(rows.filter(F.col(id_) != found[0][0]), [field], make)


def neighbours(rows: DataFrame, query: DataFrame, k: int, id_: str = "vec_id") -> DataFrame:
    """The k rows with the highest integer dot product to the query's one row, itself excepted; ties to the smaller id."""
    return scored(rows, query, "code", "idot", id_).orderBy(F.desc("idot"), id_).limit(k)


def relatedness(pairs: DataFrame, rows: DataFrame, id_: str = "vec_id") -> DataFrame:
    """pairs(a, b) with score: the dot product of their codes over the squared scale, null where either has no vector."""
    side = lambda c: rows.select(F.col(id_).alias(c), F.col("code").alias(f"_{c}"), F.col("scale").alias(f"_s{c}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("_has", F.col("_a").isNotNull() & F.col("_b").isNotNull())

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        has = np.flatnonzero(part.column("_has").to_numpy(zero_copy_only=False))
        score, mask = np.zeros(part.num_rows), np.ones(part.num_rows, bool)
        if len(has):
            x, y = (_matrix(part.column(c).take(pa.array(has)), np.int64) for c in ("_a", "_b"))
            scale = part.column("_sa").take(pa.array(has)).to_numpy()
            score[has], mask[has] = (x * y).sum(1) / (scale * scale), False
        return [pa.array(score, mask=mask)]

    return _with(both, [T.StructField("score", T.DoubleType())], make).select(*pairs.columns, "score")


class HashingEmbedder:
    """Texts to unit vectors without a model: signed counts of their words and word pairs by the bits of their MD5.

    Texts that share words are near; a text without words has the zero vector. It stands where a model would: anything
    that maps a list of texts to a matrix can be given to embedded().
    """

    WORD = re.compile(r"[^\W]+")

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim
        self.known: dict[str, tuple[int, float]] = {}

    def place(self, unit: str) -> tuple[int, float]:
        found = self.known.get(unit)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            h = int(hashlib.md5(unit.encode()).hexdigest()[:8], 16)
            found = self.known[unit] = h % self.dim, 1.0 if h & 0x80000000 else -1.0
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            words = self.WORD.findall(text.translate(X.FOLD))
            for unit in (*words, *map(" ".join, zip(words, words[1:], strict=False))):
                at, sign = self.place(unit)
                out[i, at] += sign
        return unit_rows(out)


def embedded(rows: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]] = HashingEmbedder, text: str = "text", name: str = "embedding", some: int = 512) -> DataFrame:
    """rows with an embedding (array<double>) of a text column; a null text is embedded as an empty one.

    make builds the embedder once a task, so a model is loaded where it runs; it gets `some` texts at a time.
    """
    schema = T.StructType([*rows.schema.fields, _array(name, T.DoubleType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = None
        for batch in parts:
            for a in range(0, batch.num_rows, some):
                embed = embed or make()
                part = batch.slice(a, some)
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(embed([t or "" for t in part.column(text).to_pylist()]), pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)


#: The kinds of symbols that are embedded.
SEMANTIC_KINDS = ("fn", "type", "trait", "heading")


def semantic(symbols: DataFrame) -> DataFrame:
    """The symbols that an index of meanings holds."""
    return symbols.filter(F.col("kind").isin(*SEMANTIC_KINDS))


def pool(k: int) -> int:
    return max(32 * k, 128)


def shortlist(rows: DataFrame, query: DataFrame, k: int, id_: str = "vec_id") -> DataFrame:
    """The pool(k) rows nearest to the query by sign bits."""
    return scored(rows, query, "bits", "hamming", id_).orderBy("hamming", id_).limit(pool(k))


def query(rows: DataFrame, q: DataFrame, k: int, floor: float = QUERY_FLOOR, id_: str = "vec_id") -> DataFrame:
    """Shortlist, rescore by integer dot product, drop scores under the floor, keep k."""
    near = scored(shortlist(rows, q, k, id_), q, "code", "idot", id_)
    near = near.withColumn("score", F.col("idot") / (F.col("scale") * F.col("scale"))).filter(F.col("score") >= floor)
    return near.orderBy(F.desc("idot"), id_).limit(k)


def common_names(rows: DataFrame, name: str = "name") -> DataFrame:
    """Names that max(n / 40, 5) rows or more share."""
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("c"))
    return counts.join(F.broadcast(total)).filter(F.col("c") >= F.greatest(F.floor(F.col("n") / 40), F.lit(5))).select(name, "c")  # one row


def kin(rows: DataFrame, q: DataFrame, language: str, name: str, k: int = 16, shown: int = 5, id_: str = "vec_id") -> DataFrame:
    """Of the k nearest neighbours those with a score of KIN_FLOOR, an uncommon name and another language; the first `shown`."""
    own = F.broadcast(q.select(F.col(language).alias("own_language")).limit(1))
    near = neighbours(rows, q, k, id_).withColumn("score", F.col("idot") / (F.col("scale") * F.col("scale")))
    near = near.join(own).filter((F.col("score") >= KIN_FLOOR) & (F.col(language) != F.col("own_language")))
    return near.join(common_names(rows, name), name, "left_anti").orderBy(F.desc("idot"), id_).limit(shown)


def split_cache(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Hits, with the cached columns, and misses."""
    return wanted.join(cache, key), wanted.join(cache.select(key), key, "left_anti")
