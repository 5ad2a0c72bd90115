"""Toxicity: a convolutional text classifier trained in numpy.

Words (runs of letters, lower-cased) are embedded as the sum of hashed rows: one for the word and one for each of its
beginnings of 4, 5 and 6 bytes, so that compounds and endings share what is learnt, and a rare word shares all rows with
another almost never. Filters of widths 1, 2 and 3 slide over the whole text, each is max-pooled, and a
logistic layer scores the pooled values. Labels are learnt from a bounded, balanced sample of labelled rows; a part of
it sets the operating point and a threshold for each language. Scores depend on the text alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import words as W

BUCKETS = 1 << 16
DIM = 16
FILTERS = 8
WIDTHS = (1, 2, 3)
BEGINNINGS = (4, 5, 6)
TABLES = 1 + len(BEGINNINGS)
#: The score from which the contract predicts 1.
CUT = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def token_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A bucket in each table for every word, (words, TABLES), and the word offsets of the texts."""
    raw, offsets = W.column_bytes(column)
    starts, ends = W.spans(raw, offsets, _LETTER)
    hashes = W.hash_prefixes(raw, starts, [ends, *(np.minimum(ends, starts + n) for n in BEGINNINGS)], _LOWER)
    ids = np.stack([h & W.U64(BUCKETS - 1) for h in hashes], 1).astype(np.int32)
    return ids, np.searchsorted(starts, offsets)


@dataclass
class Model:
    """The parameters; embedding has TABLES tables of BUCKETS rows, about 17 MB.

    A row that training never moved is the seed's, so a pickled model holds the others alone, which are as many as the
    bounded sample has words; the rest is drawn again where it is read.
    """

    embedding: np.ndarray
    kernels: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    seed: int = 7

    @staticmethod
    def new(seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        kernels = [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return Model(rng.normal(0, 0.07, (TABLES, BUCKETS, DIM)).astype(np.float32), kernels, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), seed=seed)

    def __getstate__(self) -> dict:
        moved = (self.embedding != Model.new(self.seed).embedding).any(-1)
        return self.__dict__ | {"embedding": (np.flatnonzero(moved).astype(np.int32), self.embedding[moved])}

    def __setstate__(self, state: dict) -> None:
        at, rows = state["embedding"]
        embedding = Model.new(state["seed"]).embedding
        embedding.reshape(-1, DIM)[at] = rows
        self.__dict__.update(state | {"embedding": embedding})

    def embed(self, ids: np.ndarray) -> np.ndarray:
        """The sum of the rows of each word."""
        x = self.embedding[0, ids[:, 0]]
        for t in range(1, TABLES):
            x += self.embedding[t, ids[:, t]]
        return x

    def convolve(self, x: np.ndarray) -> np.ndarray:
        """Filter values at every position; what lies beyond the last row of x is zero."""
        n = len(x)
        z = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        for i, kernel in enumerate(self.kernels):
            at = slice(i * FILTERS, (i + 1) * FILTERS)
            for k in range(len(kernel)):
                z[: n - k, at] += x[k:] @ kernel[k]
        return z

    def pooled(self, ids: np.ndarray, offsets: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """Max-pooled, rectified filter values of each text; 0 for a text without words. Memory is bounded by block."""
        n_texts = len(offsets) - 1
        best = np.full((n_texts, FILTERS * len(WIDTHS)), -np.inf, np.float32)
        longest = WIDTHS[-1] - 1
        i = 0
        while i < n_texts:
            if offsets[i + 1] - offsets[i] > block:  # one long text, in overlapping parts
                for a in range(offsets[i], offsets[i + 1], block):
                    b = min(a + block, offsets[i + 1])
                    more = min(b + longest, offsets[i + 1])
                    x = self.embed(ids[a:more])
                    best[i] = np.maximum(best[i], self.convolve(x)[: b - a].max(0))
                i += 1
                continue
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, "right")) - 1)
            size = np.diff(offsets[i : j + 1])
            full = np.flatnonzero(size)
            if len(full):
                # Rows of zeros part the texts.
                first = np.cumsum(np.append(0, size[full][:-1] + longest))
                at = np.arange(offsets[j] - offsets[i]) + np.repeat(first - np.cumsum(np.append(0, size[full][:-1])), size[full])
                x = np.zeros((int(first[-1] + size[full][-1] + longest), DIM), np.float32)
                x[at] = self.embed(ids[offsets[i] : offsets[j]])
                z = self.convolve(x)[at]
                best[i + full] = np.maximum.reduceat(z, np.cumsum(np.append(0, size[full][:-1])), axis=0)
            i = j
        return np.where(np.isfinite(best), np.maximum(best + self.bias, 0), 0)

    def scores(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        logit = self.pooled(ids, offsets).astype(float) @ self.out.astype(float) + self.shift
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))

    def step(self, texts: list[np.ndarray], y: np.ndarray, rate: float, memory: dict) -> float:
        """One Adagrad step on a batch; gradients flow through the pooled positions alone."""
        longest = WIDTHS[-1] - 1
        n = FILTERS * len(WIDTHS)
        pools = np.zeros((len(texts), n), np.float32)
        where = np.zeros((len(texts), n), np.int64)
        xs = []
        for d, ids in enumerate(texts):
            x = np.zeros((len(ids) + longest, DIM), np.float32)
            x[: len(ids)] = self.embed(ids)
            z = self.convolve(x)[: len(ids)]
            where[d] = z.argmax(0)
            pools[d] = z[where[d], np.arange(n)]
            xs.append(x)
        hidden = np.maximum(pools + self.bias, 0)
        logit = hidden @ self.out + self.shift
        p = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
        err = ((p - y) / len(y)).astype(np.float32)
        back = err[:, None] * self.out * (hidden > 0)

        def adagrad(name: str, value: np.ndarray, grad: np.ndarray) -> None:
            memory[name] = memory.get(name, 0) + grad * grad
            value -= rate * grad / np.sqrt(memory[name] + 1e-8)

        rows: list[np.ndarray] = []
        grads: list[np.ndarray] = []
        for i, kernel in enumerate(self.kernels):
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            change = np.zeros_like(kernel)
            for d, x in enumerate(xs):
                for k in range(len(kernel)):
                    at = where[d, cols] + k
                    change[k] += (x[at] * back[d, cols][:, None]).T
                    inside = at < len(texts[d])
                    rows.append(texts[d][at[inside]])
                    grads.append((kernel[k] * back[d, cols]).T[inside])
            adagrad(f"kernel{i}", kernel, change)
        adagrad("out", self.out, hidden.T @ err + 1e-4 * self.out)
        adagrad("bias", self.bias, back.sum(0))
        shift = np.array([err.sum()])
        memory["shift"] = memory.get("shift", 0) + shift**2
        self.shift -= float(rate * shift[0] / np.sqrt(memory["shift"][0] + 1e-8))
        row, grad = np.concatenate(rows), np.concatenate(grads)
        seen = memory.setdefault("embedding", np.full((TABLES, BUCKETS), 1e-6, np.float32))
        for t in range(TABLES):
            used, back_to = np.unique(row[:, t], return_inverse=True)
            total = np.zeros((len(used), DIM), np.float32)
            np.add.at(total, back_to, grad)
            seen[t, used] += (total * total).mean(1)
            self.embedding[t, used] -= rate * total / np.sqrt(seen[t, used])[:, None]
        return float(-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean())


def best_cut(score: np.ndarray, y: np.ndarray) -> float:
    """The score that maximises F1, midway to the next lower one; at the top if nothing is toxic."""
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    s = score[order]
    ok = np.append(s[1:] < s[:-1], True)
    k = int(np.argmax(np.where(ok, f1, -1)))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2)


def train(texts: list[np.ndarray], y: np.ndarray, langs: list[str | None], epochs: int = 6, batch: int = 32, rate: float = 0.05, seed: int = 3) -> Model:
    """Fits on four fifths; the fifth part sets the operating point (moved to CUT) and thresholds by language."""
    model, rng, memory = Model.new(seed), np.random.default_rng(seed), {}
    usable = np.flatnonzero([len(t) > 0 for t in texts])
    order = rng.permutation(usable)
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    if not len(fit) or y[fit].min() == y[fit].max():
        model.out[:] = 0
        model.shift = -2.0
        return model
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(fit), -(-len(fit) // batch)):
            model.step([texts[i] for i in part], y[part].astype(np.float32), rate / (1 + epoch / 2), memory)
    at = held if len(held) >= 50 and 0 < y[held].sum() < len(held) else order
    size = np.array([len(texts[i]) for i in at])
    score = model.scores(np.concatenate([texts[i] for i in at]), np.append(0, np.cumsum(size)))
    cut = min(max(best_cut(score, y[at]), 1e-6), 1 - 1e-6)
    move = float(np.log(CUT / (1 - CUT)) - np.log(cut / (1 - cut)))
    model.shift += move
    moved = 1 / (1 + np.exp(-(np.log(np.clip(score, 1e-12, 1 - 1e-12) / (1 - np.clip(score, 1e-12, 1 - 1e-12))) + move)))
    names = np.array([langs[i] or "" for i in at])
    for lang in sorted(set(names.tolist()) - {""}):
        mine = names == lang
        if 20 <= y[at][mine].sum() < mine.sum():
            # Never far from the common operating point, as a language has few labels.
            model.thresholds[lang] = min(max(best_cut(moved[mine], y[at][mine]), CUT / 2), 1.5 * CUT)
    return model


def held_out() -> Column:
    """Rows kept for evaluation: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, most: int = 3000, most_bytes: int = 1 << 16) -> DataFrame:
    """(doc_id, toxic, lang, ids): word buckets, labels and languages of at most `most` rows of each class, those whose ids
    hash lowest.

    Held-out rows, texts over most_bytes and rows with nulls are left out; an id with several labels takes the largest.
    """
    chosen = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lowest = [chosen.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    ids = lowest[0].union(lowest[1])
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    rows = docs.select("doc_id", "text", lang).join(F.broadcast(ids), "doc_id").filter(F.octet_length("text") <= most_bytes)  # 2 * most ids
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("ids", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, at = token_ids(batch.column("text"))
        made = [ids[a:b].astype("<u2").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), batch.column("lang").cast(pa.string()), pa.array(made, pa.binary())], schema.names)

    return common.arrow_map(rows.select("doc_id", "toxic", "lang", "text"), run, schema)


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000) -> Model:
    """Trains on sample() in one task, as the sample is bounded by `most`; the driver gets the parameters alone."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for part in parts for r in zip(*(part.column(c).to_pylist() for c in ("doc_id", "ids", "toxic", "lang")), strict=True)), key=lambda r: r[:2])
        texts = [np.frombuffer(ids, "<u2").reshape(-1, TABLES) for _, ids, _, _ in rows]
        model = train(texts, np.array([r[2] for r in rows], np.int64), [r[3] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = sample(docs, labels, most).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(got[0]) if got else train([], np.zeros(0, np.int64), [])  # an empty table may have no partition


def score_documents(docs: DataFrame, model: Model, score: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs named in keep (default: all) and the score of every whole text.

    A null or empty text has the score of no words; repeated rows score alike; a column named as score is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != score]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some MB whatever the corpus
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(score, T.DoubleType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in W.batches(batch, "text"):
            made = shared.value.scores(*token_ids(part.column("text")))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(made)], [*keep, score])

    return common.arrow_map(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])]), run, schema)


def threshold(model: Model) -> Column:
    """The threshold of a row's language; CUT for other languages and nulls."""
    out = F
    for lang, value in model.thresholds.items():
        out = out.when(F.col("lang") == lang, F.lit(value))
    return F.lit(CUT) if out is F else out.otherwise(F.lit(CUT))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, and the language's threshold with what it predicts.

    Every row of docs(doc_id, text[, lang]) is scored: a null text as an empty one, a text of any length whole, repeated
    rows alike; a null id is not held out; without lang, or where it is null, the threshold is CUT. Without labels of both
    classes all scores are one low value. An empty table gives an empty table; other columns play no part.
    """
    model = fit(docs, labels)
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    rows = score_documents(docs, model, keep=["doc_id", "lang"])
    rows = rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), threshold(model).alias("lang_threshold"))
    return rows.withColumn("lang_predicted", (F.col("score") >= F.col("lang_threshold")).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows whose score reaches the threshold of their language; columns of any name pass through."""
    rows, names = common.shielded(docs, "text", "lang")
    limit = threshold(model) if "lang" in docs.columns else F.lit(CUT)
    return common.unshielded(score_documents(rows, model).filter(F.col("score") < limit), names)
