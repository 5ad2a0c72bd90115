"""An exploration as one result: what the terms select, who calls it, what it reaches, what is related."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared
from . import graph

#: Lines shown of a symbol, lines from which the view is compact, callers by name shown, literal hits that
#: need no further ones, further ones taken by meaning.
LINE_CAP = 160
LINE_BUDGET = 400
NAMED_SHOWN = 8
ENOUGH_LITERAL = 3
FILL = 5


def filled(literal: DataFrame, near: DataFrame, most: int = 12) -> DataFrame:
    """(place, id, score): the literal hits(place, id) in their order and, if they are fewer than ENOUGH_LITERAL, the first
    FILL of near(id, score) behind them, by score and id, without repeats; `most` in all."""
    n = literal.agg(F.count(F.lit(1)).alias("n"))  # one row
    best = near.orderBy(F.desc("score"), "id").limit(FILL)
    extra = best.join(F.broadcast(n), F.lit(True)).filter(F.col("n") < ENOUGH_LITERAL).join(literal.select("id"), "id", "left_anti")
    order = Window.orderBy("meant", "place", F.desc("score"), "id")  # a few rows
    both = literal.select(F.lit(0).alias("meant"), "place", "id", F.lit(None).cast("double").alias("score")).unionByName(extra.select(F.lit(1).alias("meant"), F.lit(0).alias("place"), "id", "score"), allowMissingColumns=True)
    return both.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).select(F.col("rn").alias("place"), "id", "score")


def size(shown: DataFrame, *by: str) -> DataFrame:
    """How many source lines shown(start_line, end_line) would take, and whether the view is compact for it."""
    lines = F.least(F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0)) + 1, F.lit(LINE_CAP))
    return shown.groupBy(*by).agg(F.sum(lines).alias("lines")).withColumn("compact", F.col("lines") > LINE_BUDGET)


def named_callers(callers: DataFrame, related: DataFrame, most: int = NAMED_SHOWN) -> DataFrame:
    """The `most` callers by name alone of each symbol: callers(dst, src) by related(dst, src, score), those without a score last."""
    order = Window.partitionBy("dst").orderBy(F.desc_nulls_last("score"), "src")
    rows = callers.select("dst", "src").distinct().join(related, ["dst", "src"], "left")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def reach(edges: DataFrame, symbols: DataFrame, starts: DataFrame, depth: int = graph.BLAST_DEPTH) -> DataFrame:
    """(start, file, n): how many symbols of each file reach each start over confirmed edges; symbols without a row in
    symbols have no file (null)."""
    found = graph.blast_radius(edges, starts, depth).filter("not dyn")
    return found.join(symbols.select("id", "file").distinct(), "id", "left").groupBy("start", "file").agg(F.count_distinct("id").alias("n"))


def report(shown: DataFrame, symbols: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A row for each of shown(place, id, ...): its callers by tier (numbers), how many symbols it reaches back to within
    the blast depth, the files they are in as `file (n), ...`, and those reached through traits (number). names(id, node)
    are given if edges are those of resolve.keyed_edges()."""
    ids = shown.select(F.col("id").alias("dst")).distinct()
    known = symbols.select(F.col("id").alias("src")).distinct()
    callers = graph.caller_rows(edges, ids, names).join(known, "src", "left_semi")
    count = lambda tier: F.count_distinct(F.when(F.col("tier") == tier, F.col("src"))).alias(tier)
    tiers = shared.written(callers.groupBy(F.col("dst").alias("id")).agg(count("confirmed"), count("dynamic"), count("named")), "tiers")
    starts = ids.select(F.col("dst").alias("start"))
    blast = shared.written(graph.blast_radius(edges, starts, names=names), "blast")
    files = blast.filter("not dyn").join(symbols.select("id", "file").distinct(), "id", "left").groupBy("start", "file").agg(F.count_distinct("id").alias("n"))
    each = F.when(F.col("file").isNotNull(), F.struct("file", F.format_string("%s (%d)", "file", "n").alias("text")))
    reached = files.groupBy(F.col("start").alias("id")).agg(F.sum("n").alias("blast"), F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["text"]), ", ").alias("blast_files"))
    through = blast.filter("dyn").groupBy(F.col("start").alias("id")).agg(F.count_distinct("id").alias("blast_dynamic"))
    out = shown.join(tiers, "id", "left").join(reached, "id", "left").join(through, "id", "left")
    return out.fillna(0, ["confirmed", "dynamic", "named", "blast", "blast_dynamic"]).fillna("", ["blast_files"])
