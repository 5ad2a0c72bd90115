"""Intervals, runs and differences of ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stabbing


def _islands(rows: DataFrame, by: list[str], order: list[Column], new: Column) -> DataFrame:
    """rows with `island`: how many rows that open one come before or at each."""
    return rows.withColumn("island", F.sum(new.cast("long")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def coalesce(spans: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Unions of spans that overlap or touch (start <= last end + 1). Repeats change nothing, so one sort is all a task holds."""
    w = Window.partitionBy(*by).orderBy(start, end)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = spans.select(*by, start, end).withColumn("reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    same = F.struct(start, end).eqNullSafe(F.lag(F.struct(start, end)).over(w))  # matters where spans end before they start
    rows = rows.withColumn("new", ~same & (F.col("reach").isNull() | (F.col(start) > F.col("reach") + 1)))
    rows = _islands(rows, by, [F.col(start), F.col(end)], F.col("new"))
    # Islands are numbered upwards, so the greatest (island, x) so far is the island's own; its last row has the whole island.
    rows = rows.withColumn("low", F.max(F.struct("island", (-F.col(start).cast("long")).alias("low"))).over(so_far)["low"]).withColumn("high", F.max(F.struct("island", end)).over(so_far)[end])
    rows = rows.withColumn("next", F.lead("island").over(w)).filter("next is null or next <> island")
    return rows.select(*by, (-F.col("low")).cast(spans.schema[start].dataType).alias(start), F.col("high").alias(end))


def runs(points: DataFrame, by: list[str], at: str = "line") -> DataFrame:
    """Maximal runs of consecutive lines. Repeats change nothing, so one sort is all a task holds."""
    w = Window.partitionBy(*by).orderBy(at)
    rows = points.select(*by, at).withColumn("_was", F.lag(F.struct(at)).over(w)).withColumn("_next", F.lead(F.struct(at)).over(w))

    def apart(a: Column, b: Column) -> Column:  # a null comes before all lines
        return F.coalesce(b - a > 1, a.isNull() & b.isNotNull())

    first = F.col("_was").isNull() | apart(F.col(f"_was.{at}"), F.col(at))
    last = F.col("_next").isNull() | apart(F.col(at), F.col(f"_next.{at}"))
    # The ends alone: behind the first line of a run comes its last one.
    ends = rows.withColumn("_first", first).withColumn("_last", last).filter("_first or _last")
    ends = ends.withColumn("end", F.when(F.col("_last"), F.col(at)).otherwise(F.lead(at).over(w)))
    return ends.filter("_first").select(*by, F.col(at).alias("start"), "end")


def line_shift(edits: DataFrame, by: list[str], at: str = "old_start", delta: str = "delta") -> DataFrame:
    """The running sum of line shifts after each edit; edits that shift nothing are left out."""
    total = F.sum(delta).over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return edits.withColumn("shift", total).filter(F.col(delta) != 0)


def hunk_groups(edits: DataFrame, by: list[str], start: str, end: str, context: int = 3) -> DataFrame:
    """Edits whose gap to all earlier ones is over twice the context open a new group; group from 1."""
    reach = F.max(end).over(Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    rows = edits.withColumn("reach", reach)
    return _islands(rows, by, [F.col(start), F.col(end)], F.col("reach").isNull() | (F.col(start) - F.col("reach") > 2 * context)).withColumnRenamed("island", "hunk").drop("reach")


def struct_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, removed or modified."""
    both = old.select(key, F.col(digest).alias("a"), F.lit(True).alias("in_old")).join(new.select(key, F.col(digest).alias("b"), F.lit(True).alias("in_new")), key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return both.select(key, change.alias("change")).filter(F.col("change").isNotNull())


def unseen(touched: DataFrame, seen: DataFrame, by: list[str]) -> DataFrame:
    """touched(by, line) that no seen(by, start, end) run holds."""
    return touched.join(stabbing.held(touched, seen, by, "line", F.col("start"), F.col("end")), [*by, "line"], "left_anti")


def overlaps(edits: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Lines that two edits of a file target."""
    lines = edits.select(*by, F.explode(F.sequence(start, end)).alias("line"))
    return lines.groupBy(*by, "line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def seen_text(ranges: Column) -> Column:
    """Sorted (start, end) runs as `a-b,c`."""
    return F.array_join(F.transform(ranges, lambda r: F.when(r["start"] == r["end"], r["start"].cast("string")).otherwise(F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string")))), ",")


def seen_ranges(text: Column) -> Column:
    """`a-b,c` as runs; bad tokens are skipped and reversed ends clamped."""
    tokens = F.filter(F.split(text, ","), lambda t: t.rlike(r"^\s*\d+(-\d+)?\s*$"))

    def run(t: Column) -> Column:
        a, b = F.regexp_extract(t, r"^\s*(\d+)", 1).cast("int"), F.regexp_extract(t, r"-(\d+)", 1)
        return F.struct(a.alias("start"), F.greatest(a, F.when(b != "", b.cast("int")).otherwise(a)).alias("end"))

    return F.transform(tokens, run)


def distance(points: DataFrame, regions: DataFrame, by: list[str], at: str = "line") -> DataFrame:
    """points(by, at) with the distance to the nearest of regions(by, start, end); 0 inside. Files without a region drop out."""
    return stabbing.nearest(points, regions, by, at, F.col("start"), F.col("end"))
