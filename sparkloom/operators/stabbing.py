"""Points in spans and neighbours of points, by dyadic buckets: equi-joins in place of ranges.

The line is cut into nodes (level k, place i): node (k, i) holds the points i * 2^k to (i + 1) * 2^k - 1. A span is the union of
at most two nodes a level, and a point lies in one node a level, so that a point and a span that holds it share exactly one
of the span's nodes. All points before p are the union of the nodes left of p's own ones, at most one a level. What is asked
is a least or greatest value, which a node keeps for all its spans, so nothing grows with the product of points and
spans, and a key with all the rows is many nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def levels(*ranges: tuple[DataFrame, Column, Column]) -> tuple[int, int]:
    """The least position of (frame, from, to) ranges and how many levels it takes to hold them all."""
    every = None
    for df, low, high in ranges:
        part = df.agg(F.min(low).cast("long").alias("low"), F.max(high).cast("long").alias("high"))
        every = part if every is None else every.unionByName(part)
    row = every.agg(F.min("low").alias("low"), F.max("high").alias("high")).first()  # one row a frame
    if row["low"] is None or row["high"] is None:
        return 0, 1
    return row["low"], max(1, (row["high"] - row["low"] + 1).bit_length())


def _at_levels(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n))))


def span_nodes(spans: DataFrame, start: Column, end: Column, low: int, n: int) -> DataFrame:
    """spans with k and i: a row for each node that start..end (both included) is the union of; spans that end before they start have none."""
    rows = _at_levels(spans.withColumn("_a", start.cast("long") - low).withColumn("_b", end.cast("long") - low + 1), n)
    first, after = F.expr("shiftright(_a + shiftleft(1L, k) - 1, k)"), F.expr("shiftright(_b, k)")
    rows = rows.withColumn("_l", first).withColumn("_r", after).filter("_l < _r")
    odd = lambda c: F.col(c).bitwiseAND(1) == 1
    return rows.withColumn("i", F.explode(F.array(F.when(odd("_l"), F.col("_l")), F.when(odd("_r"), F.col("_r") - 1)))).filter("i is not null").drop("_a", "_b", "_l", "_r")


def _over(points: DataFrame, at: Column, low: int, n: int) -> DataFrame:
    """points with k and i: the node of each level that holds them."""
    return _at_levels(points.withColumn("_p", at.cast("long") - low), n).withColumn("i", F.expr("shiftright(_p, k)")).drop("_p")


def least_holding(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: Column, end: Column, value: Column) -> DataFrame:
    """The distinct points(by, at) that a span holds, with `least`, the least value of those spans."""
    asked = points.select(*by, at).distinct()
    low, n = levels((asked, F.col(at), F.col(at)), (spans, start, end))
    nodes = span_nodes(spans.select(*by, start.alias("_s"), end.alias("_e"), value.alias("_v")), F.col("_s"), F.col("_e"), low, n)
    nodes = nodes.groupBy(*by, "k", "i").agg(F.min("_v").alias("_v"))
    return _over(asked, F.col(at), low, n).join(nodes, [*by, "k", "i"]).groupBy(*by, at).agg(F.min("_v").alias("least"))


#: Fixed value: positions that one mask of 64 bits holds.
WORD = 64


def _mask(first: Column, last: Column) -> Column:
    """The bits first..last of a word; none if last is before first."""
    below = lambda n: F.when(n >= WORD, F.lit(-1).cast("long")).otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n.cast("int"))))
    return below(last + 1).bitwiseAND(F.bitwise_not(below(first)))


def held(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: Column, end: Column) -> DataFrame:
    """The distinct points(by, at) that a span holds.

    Points of a word are one mask, and so are the ends of spans, which words keep as what they hold in all; only words that lie
    wholly inside a span are looked for in dyadic nodes. So a point is shuffled about once, not once a level.
    """
    low, _ = levels((points, F.col(at), F.col(at)), (spans, start, end))
    asked = points.filter(F.col(at).isNotNull()).withColumn("_p", F.col(at).cast("long") - low)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_p") % WORD).cast("int"))
    asked = asked.select(*by, F.expr(f"_p div {WORD}").alias("_w"), bit.alias("_m")).groupBy(*by, "_w").agg(F.bit_or("_m").alias("_m"))
    s = spans.select(*by, (start.cast("long") - low).alias("_a"), (end.cast("long") - low).alias("_b")).filter("_a <= _b")
    s = s.withColumn("_l", F.expr(f"_a div {WORD}")).withColumn("_r", F.expr(f"_b div {WORD}"))
    a, b = F.col("_a") % WORD, F.col("_b") % WORD
    head = F.struct(F.col("_l").alias("_w"), _mask(a, F.when(F.col("_l") == F.col("_r"), b).otherwise(WORD - 1)).alias("_s"))
    tail = F.struct(F.col("_r").alias("_w"), _mask(F.lit(0), b).alias("_s"))
    ends = s.select(*by, F.explode(F.when(F.col("_l") == F.col("_r"), F.array(head)).otherwise(F.array(head, tail))).alias("_e")).select(*by, "_e._w", "_e._s")
    rows = asked.join(ends.groupBy(*by, "_w").agg(F.bit_or("_s").alias("_s")), [*by, "_w"], "left")
    inner = s.filter("_r - _l > 1")
    if not inner.isEmpty():
        whole = least_holding(asked, inner, by, "_w", F.col("_l") + 1, F.col("_r") - 1, F.lit(1))
        rows = rows.join(whole, [*by, "_w"], "left").withColumn("_s", F.when(F.col("least").isNotNull(), F.lit(-1).cast("long")).otherwise(F.col("_s")))
    both = F.coalesce("_s", F.lit(0).cast("long")).bitwiseAND(F.col("_m"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftright", both, i).bitwiseAND(F.lit(1)) == 1)
    place = (F.col("_w") * WORD + F.col("_i") + low).cast(points.schema[at].dataType).alias(at)
    return rows.select(*by, "_w", F.explode(bits).alias("_i")).select(*by, place)


def last_before(points: DataFrame, marks: DataFrame, by: list[str], at: str, place: Column, value: Column) -> DataFrame:
    """The distinct points(by, at) with a mark at or before them, with `last`, the greatest value of those marks; the value
    should begin with the place for the nearest one."""
    asked = points.select(*by, at).distinct()
    low, n = levels((asked, F.col(at), F.col(at)), (marks, place, place))
    nodes = _over(marks.select(*by, place.alias("_m"), value.alias("_v")), F.col("_m"), low, n).groupBy(*by, "k", "i").agg(F.max("_v").alias("_v"))
    # Points before at + 1: the left neighbour at each level where at + 1 is a right one.
    left = _at_levels(asked.withColumn("_p", F.col(at).cast("long") - low + 1), n).withColumn("i", F.expr("shiftright(_p, k)"))
    left = left.filter(F.col("i").bitwiseAND(1) == 1).withColumn("i", F.col("i") - 1).drop("_p")
    return left.join(nodes, [*by, "k", "i"]).groupBy(*by, at).agg(F.max("_v").alias("last"))


def nearest(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: Column, end: Column) -> DataFrame:
    """The distinct points(by, at) of keys that have spans, with `distance`: how far the nearest one is, 0 inside one."""
    p = points.select(*by, at).distinct()
    spans = spans.select(*by, start.alias("_s"), F.greatest(start, end).alias("_e"))
    inside = held(p, spans, by, at, F.col("_s"), F.col("_e")).withColumn("_in", F.lit(0))
    ended = last_before(p, spans, by, at, F.col("_e"), F.col("_e"))
    mirror = p.withColumn("_neg", -F.col(at).cast("long"))
    begins = last_before(mirror, spans, by, "_neg", -F.col("_s").cast("long"), -F.col("_s").cast("long")).withColumnRenamed("last", "_next")
    rows = mirror.join(inside, [*by, at], "left").join(ended, [*by, at], "left").join(begins, [*by, "_neg"], "left")
    distance = F.least(F.col("_in"), F.col(at) - F.col("last"), -F.col("_next") - F.col(at))
    return rows.filter("_in is not null or last is not null or _next is not null").select(*by, at, distance.alias("distance"))
