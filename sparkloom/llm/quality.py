"""Quality rules: text statistics and a learned decision list emitted as Spark conditional expressions.

Sequential covering (Cohen's RIPPER family): rules for the bad class are grown one condition at a time by FOIL
gain on two thirds of the labelled rows, pruned from the end on the other third, accepted while they stay precise,
and their rows removed before the next rule is grown. The list is read top down; the first rule that holds decides.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import words as W

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_bytes")
#: Ratios that rules may use: name -> (count, per count).
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "words_per_line": ("n_words", "n_lines"),
}


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(mask, offsets[full], dtype=np.int64)
    return out


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_WORD = W.word_bytes()
_POINT = _WORD & ((np.arange(256) & 0xC0) != 0x80)
_SYMBOL = _table(SYMBOLS)
_UPPER = _table(bytes(range(65, 91)))
_DIGIT = _table(bytes(range(48, 58)))
_MARK = _table(b"!?")
_BLANK = " \t\n\v\f\r"


def repeated_words(hashes: np.ndarray, word_offsets: np.ndarray, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text, how many words lie in windows of width words that the text holds twice or more."""
    n_texts = len(word_offsets) - 1
    window = W.window_hashes(hashes, width)
    if not len(window):
        return np.zeros(n_texts, np.int64)
    owner = np.repeat(np.arange(n_texts), np.diff(word_offsets))
    ends = word_offsets[1:][owner]
    at = np.flatnonzero(np.arange(len(window)) + width <= ends[: len(window)])
    key = window[at] ^ W.mix(owner[at].astype(np.uint64), 7)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + width, -1)
    covered = np.cumsum(change[:-1]) > 0
    return _per_text(covered, word_offsets)


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS for every text of an Arrow string column (null: empty)."""
    raw, offsets = W.column_bytes(column)
    starts, ends = W.spans(raw, offsets, _WORD)
    word_offsets = np.searchsorted(starts, offsets)
    hashes = W.hash_spans(raw, starts, ends)
    lines, dup = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    for i, text in enumerate(column.to_pylist()):
        if text:
            held = [x for x in text.split("\n") if x.strip(_BLANK)]
            lines[i], dup[i] = len(held), len(held) - len(set(held))
    masks = {"word_chars": _POINT, "n_symbols": _SYMBOL, "n_upper": _UPPER, "n_digits": _DIGIT, "n_marks": _MARK}
    out = {k: _per_text(table[raw], offsets) for k, table in masks.items()}
    return out | {
        "n_words": np.diff(word_offsets),
        "n_dup_lines": dup,
        "n_lines": lines,
        "n_repeat_words": repeated_words(hashes, word_offsets),
        "n_bytes": np.diff(offsets),
    }


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs named in keep (default: all), and COUNTS, prefixed q_, in place of columns of these names."""
    keep = docs.columns if keep is None else keep
    names = [f"q_{c}" for c in COUNTS]
    keep = [c for c in keep if c not in names]
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, T.LongType()) for n in names])

    def run(batch: pa.RecordBatch):
        for part in W.batches(batch, text):
            got = statistics(part.column(text))
            yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(got[c], pa.int64()) for c in COUNTS], [*keep, *names])

    return common.arrow_map(source, run, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, features: dict[str, Column]) -> Column:
        return features[self.feature] >= F.lit(self.threshold) if self.above else features[self.feature] <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class Rule:
    conditions: list[Condition]
    covered: int = 0
    precision: float = 0.0

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    """Ordered rules that reject; a row that none covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def first(self, features: dict[str, Column]) -> Column:
        """The 1-based number of the first rule that holds, 0 if none does."""
        out: Column | None = None
        for i, rule in enumerate(self.rules, 1):
            cond = F.lit(True)
            for c in rule.conditions:
                cond = cond & c.column(features)
            out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """True where a rule rejects."""
        out = np.zeros(len(next(iter(x.values()))), bool)
        for rule in self.rules:
            out |= rule.holds(x)
        return out


def _cuts(values: np.ndarray, most: int = 64) -> np.ndarray:
    distinct = np.unique(values)
    if len(distinct) > most:
        distinct = np.unique(np.quantile(distinct, np.linspace(0, 1, most)))
    return (distinct[1:] + distinct[:-1]) / 2


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> Rule:
    """Adds the condition of the highest FOIL gain until only bad rows are left, no condition gains, or there are `most`."""
    rule, inside = Rule([]), np.ones(len(bad), bool)
    while len(rule.conditions) < most:
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        if not p or not n:
            break
        best: tuple[float, Condition | None] = (1e-9, None)
        was = np.log2(p / (p + n))
        for name, values in x.items():
            v, y = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            good_until, bad_until = np.concatenate([[0], np.cumsum(~y)]), np.concatenate([[0], np.cumsum(y)])
            for cut in _cuts(v):
                k = int(np.searchsorted(v, cut, "right"))
                for above in (False, True):
                    p2 = bad_until[-1] - bad_until[k] if above else bad_until[k]
                    n2 = good_until[-1] - good_until[k] if above else good_until[k]
                    if p2:
                        gain = p2 * (np.log2(p2 / (p2 + n2)) - was)
                        if gain > best[0]:
                            best = (float(gain), Condition(name, above, float(cut)))
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        inside &= best[1].holds(x)
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drops final conditions while (p - n) / (p + n) on the pruning rows does not fall."""
    best, kept = -2.0, rule.conditions
    for k in range(len(rule.conditions), 0, -1):
        inside = Rule(rule.conditions[:k]).holds(x)
        p, n = int((bad & inside).sum()), int((~bad & inside).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth >= best:
            best, kept = worth, rule.conditions[:k]
    return Rule(kept)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.85, least: int = 4, most_rules: int = 12, seed: int = 5) -> DecisionList:
    """Sequential covering. A rule is accepted if on all rows left it covers least bad rows with this precision; the list ends
    with the first that is not, or with most_rules. Both bounds shape the model and drop no row."""
    out, left = DecisionList(), np.ones(len(bad), bool)
    rng = np.random.default_rng(seed)
    part = rng.permutation(len(bad)) % 3
    while len(out.rules) < most_rules and (bad & left).sum() >= least:
        g, p = left & (part > 0), left & (part == 0)
        rule = grow({k: v[g] for k, v in x.items()}, bad[g])
        if not rule.conditions:
            break
        rule = prune(rule, {k: v[p] for k, v in x.items()}, bad[p])
        inside = rule.holds(x) & left
        rule.covered = int(inside.sum())
        rule.precision = float((bad & inside).sum() / max(1, rule.covered))
        if rule.precision < precision or (bad & inside).sum() < least:
            break
        out.rules.append(rule)
        left &= ~inside
    return out


def ratio_columns() -> dict[str, Column]:
    """RATIOS over the q_ columns; 0 where the divisor is 0."""
    return {k: F.when(F.col(f"q_{d}") > 0, F.col(f"q_{n}") / F.col(f"q_{d}")).otherwise(F.lit(0.0)) for k, (n, d) in RATIOS.items()}


def labelled_statistics(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Statistics of at most `most` labelled documents, those whose id hashes lowest; the least label of an id counts."""
    chosen = (
        labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # most rows of two numbers
    return with_statistics(rows, keep=["doc_id", "quality"])


def fit(docs: DataFrame, labels: DataFrame, most: int = 12000) -> DecisionList:
    """Learns the list from a bounded sample of labelled rows (most), in one task; the driver gets the list alone."""
    columns = ["doc_id", "quality", *RATIOS]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [part for part in parts if part.num_rows]
        table = {c: np.concatenate([part.column(c).to_numpy(zero_copy_only=False) for part in got]) if got else np.zeros(0) for c in columns}
        order = np.array(sorted(range(len(table["doc_id"])), key=lambda i: (zlib.crc32(str(int(table["doc_id"][i])).encode()), table["doc_id"][i])), np.int64)
        rules = learn({k: table[k][order].astype(float) for k in RATIOS}, table["quality"][order] == 0) if len(order) else DecisionList()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(rules)], pa.binary())], ["rules"])

    rows = labelled_statistics(docs, labels, most).select("doc_id", "quality", *[c.alias(k) for k, c in ratio_columns().items()])
    got = rows.repartition(1).mapInArrow(run, "rules binary").first()
    return pickle.loads(got[0]) if got else DecisionList()  # an empty table may have no partition


def base_failed() -> Column:
    """Fewer than 20 words, or more than 30 % of the words in repeated windows."""
    return (F.col("q_n_words") < 20) | (100 * F.col("q_n_repeat_words") > 30 * F.col("q_n_words"))


def apply_rules(docs: DataFrame, rules: DecisionList, keep: list[str] | None = None) -> DataFrame:
    """Every row of docs with its statistics (q_*), q_rule (the rule that rejected it, 0: none), q_base_failed and q_kept.

    Nulls: a null text has no words and fails the base rules; other nulls pass through. Empty tables give no rows;
    repeated rows are judged alike; further columns pass through, and those named as the columns made here are replaced.
    """
    rows = with_statistics(docs, keep=keep)
    rows = rows.withColumn("q_base_failed", base_failed()).withColumn("q_rule", rules.first(ratio_columns()))
    return rows.withColumn("q_kept", ~F.col("q_base_failed") & (F.col("q_rule") == 0))


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """docs without the rows that the base rules or the list reject; columns of any name pass through."""
    rows, names = common.shielded(docs, "text")
    return common.unshielded(apply_rules(rows, rules).filter("q_kept"), names)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs(doc_id, text); see apply_rules() on nulls, repeats, long texts and empty tables."""
    rows = apply_rules(docs, fit(docs, labels), keep=["doc_id"])
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in cols], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"), F.col("q_rule").alias("rule"))
