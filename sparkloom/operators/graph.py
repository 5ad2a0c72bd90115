"""Reachability over edges(src, dst, kind, confidence, detail) and interval lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..sources import shared
from . import stabbing

#: Fixed value: how far a blast radius reaches.
BLAST_DEPTH = 3


def caller_rows(edges: DataFrame, targets: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """(dst, tier, src, detail): a row for every caller of all symbols or of targets(dst); tier is confirmed, dynamic or
    named, detail the trait of a dynamic one. Rows, not lists: a function that everything calls is no group in memory.
    names(id, node) are those of resolve.keyed_edges()."""
    calls = edges.filter("kind = 'call'")
    if names is not None:
        means = names if targets is None else names.join(targets.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        through = calls.join(means.withColumnRenamed("node", "dst"), "dst").withColumn("dst", F.col("id")).select(calls.columns)
        calls = calls.filter(~F.startswith("dst", F.lit("\x00"))).unionByName(through)
    if targets is not None:
        calls = calls.join(targets.select("dst").distinct(), "dst", "left_semi")
    tier = F.when(F.col("confidence").isin("direct", "typed"), "confirmed").when(F.col("confidence") == "dyn", "dynamic").otherwise("named")
    return calls.select("dst", tier.alias("tier"), "src", F.when(F.col("confidence") == "dyn", F.col("detail")).otherwise("").alias("detail")).distinct()


def callers_of(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(dst, confirmed, dynamic, named): the sorted callers by tier of a few targets(dst), such as one exploration shows."""
    def of(name: str):
        return F.array_sort(F.collect_set(F.when(F.col("tier") == name, F.col("src")))).alias(name)

    return caller_rows(edges, targets).groupBy("dst").agg(of("confirmed"), of("dynamic"), of("named"))


def blast_radius(edges: DataFrame, starts: DataFrame, depth: int = BLAST_DEPTH, names: DataFrame | None = None) -> DataFrame:
    """(start, id, hops): what reaches each of starts(start) within `depth` steps against call and method_of edges.

    Direct and typed edges are followed; dyn edges are counted but not followed; the name tier is ignored. The start is
    not visited beforehand, so a cycle can count it. One join a step; repeated nodes are dropped at every step. names(id, node)
    are those of resolve.keyed_edges(): a step then goes through the names of the symbols that it leaves from.
    """
    back = edges.filter("kind in ('call', 'method_of') and confidence in ('direct', 'typed', 'dyn')").select(F.col("dst").alias("at"), F.col("src").alias("id"), (F.col("confidence") == "dyn").alias("dyn")).distinct()
    frontier = starts.select("start", F.col("start").alias("at")).distinct()
    out = None
    for hop in range(1, depth + 1):
        if names is not None:
            frontier = frontier.unionByName(frontier.join(names.withColumnRenamed("id", "at"), "at").select("start", F.col("node").alias("at")).distinct())
        step = frontier.join(back, "at").groupBy("start", "id").agg(F.min("dyn").alias("dyn"), F.lit(hop).alias("hops"))
        if out is not None:
            step = step.join(out.filter("not dyn").select("start", "id"), ["start", "id"], "left_anti")
        step = shared.written(step, "step")  # else each step's plan has those of all steps before it several times
        out = step if out is None else out.unionByName(step)
        frontier = step.filter("not dyn").select("start", F.col("id").alias("at"))
    return out.groupBy("start", "id").agg(F.min("hops").alias("hops"), F.min("dyn").alias("dyn"))


def _searched(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, int]:
    """The levels of a breadth-first search over call edges of all tiers for all pairs(a, b) at once: (a, id, parent, confidence,
    hops), a row for each node that a search from a reaches, and the last level. parent is the smallest of the level before.

    Searches from one node are one search. A level is counted by the job that writes it; a search stops when it has met
    all its targets or a level finds nothing.
    """
    hops = shared.written(edges.filter("kind = 'call'").groupBy("src", "dst").agg(F.min("confidence").alias("confidence")), "calls")
    wanted = pairs.select("a", F.col("b").alias("id")).distinct()

    def settle(rows: DataFrame) -> tuple[DataFrame, int]:
        seen = Observation()
        return shared.written(rows.observe(seen, F.count(F.lit(1)).alias("n")), "level"), seen.get["n"]

    start = pairs.select("a").distinct().select("a", F.col("a").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("confidence"), F.lit(0).alias("hops"))
    level, n = settle(start)
    reached, depth = level, 0
    while n:
        open_ = wanted.join(reached.select("a", "id"), ["a", "id"], "left_anti").select("a").distinct()
        near = level.join(open_, "a", "left_semi").select("a", F.col("id").alias("src")).join(hops, "src").groupBy("a", F.col("dst").alias("id")).agg(F.min(F.struct("src", "confidence")).alias("by"))
        fresh = near.join(reached.select("a", "id"), ["a", "id"], "left_anti").select("a", "id", F.col("by.src").alias("parent"), F.col("by.confidence").alias("confidence"), F.lit(depth + 1).alias("hops"))
        level, n = settle(fresh)
        depth += 1 if n else 0
        reached = reached.union(level)
        if depth % 16 == 15:
            reached = shared.written(reached, "reached")
    return reached, depth


def call_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, hop, id, confidence): for each of pairs(a, b) the fewest-hop path over call edges of all tiers, hop 0 being a with
    confidence '', the others with that of the hop that leads to them; through the smallest parents. A pair without a path
    has no rows. All pairs are searched and traced together.
    """
    reached, depth = _searched(edges, pairs)
    at = pairs.select("a", "b").distinct().join(reached.withColumnRenamed("id", "b"), ["a", "b"]).select("a", "b", F.col("hops").alias("hop"), F.col("b").alias("id"), "confidence", "parent")
    out = at = shared.written(at, "ends")
    for k in range(depth):  # one hop back for every pair; a long path makes a long plan, which is cut now and then
        back = at.filter("parent is not null").select("a", "b", F.col("parent").alias("id"))
        at = back.join(reached, ["a", "id"]).select("a", "b", F.col("hops").alias("hop"), "id", "confidence", "parent")
        out = out.union(at)
        if k % 8 == 7:
            out, at = shared.written(out, "paths"), shared.written(at, "ends")
    return out.select("a", "b", "hop", "id", "confidence")


def call_path(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The fewest-hop path of call_paths() from one of sources(id) to one of targets(id); of several the one to the smallest
    target, from the smallest source."""
    every = sources.select(F.col("id").alias("a")).distinct().crossJoin(targets.select(F.col("id").alias("b")).distinct())  # the few functions that two names mean
    paths = shared.written(call_paths(edges, every), "paths")
    best = paths.groupBy("a", "b").agg(F.max("hop").alias("hops")).orderBy("hops", "b", "a").limit(1).select("a", "b")
    return paths.join(F.broadcast(best), ["a", "b"]).select("hop", "id", "confidence")


def path_directions(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, hops, leads_back): how many hops it is from a to b, null without a path, and if so whether one leads from b to a."""
    both = pairs.select("a", "b").distinct()
    ways = both.union(both.select("b", "a")).distinct()
    lengths = shared.written(call_paths(edges, ways).groupBy("a", "b").agg(F.max("hop").alias("hops")), "lengths")
    back = lengths.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("back"))
    return both.join(lengths, ["a", "b"], "left").join(back, ["a", "b"], "left").select("a", "b", "hops", (F.col("hops").isNull() & F.coalesce("back", F.lit(False))).alias("leads_back"))


def named(symbols: DataFrame, text: str, most: int = 16) -> DataFrame:
    """(id) of the functions that text names: those whose name or qualified name it is, among the first `most` matches of a search for it."""
    from .search import symbols_matching

    return symbols_matching(symbols, text, most).filter((F.col("kind") == "fn") & ((F.col("name") == text) | (F.col("qualified") == text))).select("id")


def enclosing(points: DataFrame, spans: DataFrame, by: str = "file") -> DataFrame:
    """points(by, line) with the span(by, start, end, id) that holds the line: the smallest, the first of equals; else the
    last span that starts at or before the line, even if it has ended. Both by dyadic buckets."""
    key = [by, "line"]
    size = F.struct((F.col("end") - F.col("start")).alias("size"), "start", "id")
    small = stabbing.least_holding(points, spans.select(by, "start", "end", "id"), [by], "line", F.col("start"), F.col("end"), size).select(*key, F.col("least.id").alias("inner_id"))
    last = stabbing.last_before(points, spans, [by], "line", F.col("start"), F.struct("start", "id")).select(*key, F.col("last.id").alias("last_id"))
    return points.join(small, key, "left").join(last, key, "left").withColumn("enclosing_id", F.coalesce("inner_id", "last_id")).withColumn("exact", F.col("inner_id").isNotNull()).drop("inner_id", "last_id")


def precise_callers(precise: DataFrame, spans: DataFrame, most: int = 12) -> DataFrame:
    """precise(def_file, def_line, ref_file, ref_line) -> the functions around the first `most` references of each definition."""
    w = Window.partitionBy("def_file", "def_line").orderBy("ref_file", "ref_line")
    refs = precise.distinct().withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).drop("rn")
    return enclosing(refs.withColumn("file", F.col("ref_file")).withColumn("line", F.col("ref_line")), spans, "file").drop("file", "line")
