"""Session and supervision logic over ordered event rows (batch forms; see streaming for the others)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Commands in flight, solo reads before a hint, crash gap in seconds and crashes, misses before action.
IN_FLIGHT = 8
SOLO_READS = 3
CRASH_GAP = 11
CRASHES = 6
MISSES = 5
EFFECTS = ("context", "mutate", "verify")
MUTATING = (
    "multi-op", "macro.save", "macro.run", "state.put", "state.stop", "state.reload",
    "verify.build", "verify.diagnose", "session.request",
)


def debounce(events: DataFrame, by: list[str], ts: str, gap: str) -> DataFrame:
    """Batches of events that silences longer than `gap` part: (by, start, end, n). A pause of exactly `gap` does not part them."""
    w = Window.partitionBy(*by).orderBy(ts)
    late = F.col(ts) > F.lag(ts).over(w) + F.expr(f"interval {gap}")
    rows = events.withColumn("new", F.coalesce(late, F.lit(True)).cast("int"))
    rows = rows.withColumn("batch", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "batch").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n")).drop("batch")


def hint_first(events: DataFrame, by: list[str], order: list[Column], solo: Column) -> DataFrame:
    """The position (from 1) at which the first SOLO_READS consecutive solo reads are complete: the hint is given once."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = events.withColumn("rn", F.row_number().over(w)).withColumn("k", F.sum(solo.cast("int")).over(w.rowsBetween(-(SOLO_READS - 1), 0)))
    return rows.filter(F.col("k") == SOLO_READS).groupBy(*by).agg(F.min("rn").alias("hint_at"))


def chains(events: DataFrame, by: list[str], ts: str, gap_seconds: int = CRASH_GAP, least: int = CRASHES, id_: str = "event_id") -> DataFrame:
    """Rows that are the `least`-th or a later one of a chain whose gaps are each under `gap_seconds`: a crash loop."""
    w = Window.partitionBy(*by).orderBy(ts, id_)
    gap = F.col(ts).cast("timestamp_ltz").cast("double") - F.lag(F.col(ts).cast("timestamp_ltz").cast("double")).over(w)
    rows = events.withColumn("new", F.coalesce(gap >= gap_seconds, F.lit(True)).cast("int"))
    rows = rows.withColumn("chain", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*by, "chain").orderBy(ts, id_))
    return rows.withColumn("place", place).filter(F.col("place") >= least).drop("new")


def miss_runs(events: DataFrame, by: list[str], order: list[Column], miss: Column, least: int = MISSES) -> DataFrame:
    """Runs of `least` or more consecutive misses: (by, run, n)."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = events.withColumn("miss", miss).withColumn("run", F.sum((~F.col("miss")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("miss").groupBy(*by, "run").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def in_flight(events: DataFrame, by: list[str], order: list[Column], begin: Column, finish: Column, block: int = 512) -> DataFrame:
    """events with `open`, the commands that run after each, and `refused`: a begin while IN_FLIGHT commands run.

    A refused begin opens nothing, and a finish while nothing runs does nothing. So every event moves the count by one and
    clamps it to 0..IN_FLIGHT. Such moves compose to one move and clamp (least, most, by), which is how the rows of a key
    are folded: each block of rows to its own move, the blocks of a key to the count that each begins with, and the rows
    of a block from there. No array holds more than a block's rows or a key's blocks.
    """
    def clamp(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(IN_FLIGHT), x))

    def then(f: Column, least: Column, most: Column, by_: Column) -> Column:
        """f and after it another move."""
        inside = lambda x: F.greatest(least, F.least(most, x + by_))
        return F.struct(inside(f["least"]).alias("least"), inside(f["most"]).alias("most"), (f["by"] + by_).alias("by"))

    def moved(f: Column, x: Column) -> Column:
        return F.greatest(f["least"], F.least(f["most"], x + f["by"]))

    nothing = F.struct(F.lit(0).alias("least"), F.lit(IN_FLIGHT).alias("most"), F.lit(0).alias("by"))
    rows = events.withColumn("_step", F.when(begin, 1).when(finish, -1).otherwise(0))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).withColumn("_block", F.floor(F.col("_at") / block))
    own = F.struct("_at", "_step", F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("row"))
    blocks = rows.groupBy(*by, "_block").agg(F.array_sort(F.collect_list(own)).alias("_rows"))
    blocks = blocks.withColumn("_move", F.aggregate("_rows", nothing, lambda f, r: then(f, F.lit(0), F.lit(IN_FLIGHT), r["_step"])))
    moves = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_block", "_move"))).alias("_moves"))
    first = F.aggregate(
        "_moves", F.struct(F.lit(0).alias("open"), F.array().cast("array<struct<_block:bigint,_open:int>>").alias("out")),
        lambda s, m: F.struct(moved(m["_move"], s["open"]).alias("open"), F.array_append(s["out"], F.struct(m["_block"].alias("_block"), s["open"].alias("_open"))).alias("out")),
    )["out"]
    starts = moves.select(*by, F.explode(first).alias("x")).select(*by, "x.*")
    kind = f"array<struct<open:int,refused:boolean,row:{events.schema.simpleString()}>>"
    folded = F.aggregate(
        "_rows", F.struct(F.col("_open").alias("open"), F.array().cast(kind).alias("out")),
        lambda s, r: F.struct(
            clamp(s["open"] + r["_step"]).alias("open"),
            F.array_append(s["out"], F.struct(clamp(s["open"] + r["_step"]).alias("open"), ((r["_step"] == 1) & (s["open"] >= IN_FLIGHT)).alias("refused"), r["row"].alias("row"))).alias("out"),
        ),
    )["out"]
    out = blocks.select(*by, "_block", "_rows").join(starts, [*by, "_block"]).select(F.explode(folded).alias("x"))
    return out.select("x.row.*", F.col("x.open").cast("long").alias("open"), "x.refused")


def expired(rows: DataFrame, touched: str, now: Column, ttl: str) -> DataFrame:
    """Rows last touched more than `ttl` before now."""
    return rows.filter(F.col(touched) < now - F.expr(f"interval {ttl}"))


def effect(op: Column) -> Column:
    """context, mutate, verify or other, by the op's first part."""
    out = F
    for name in EFFECTS:
        out = out.when(op.startswith(name + "."), F.lit(name))
    return out.otherwise("other")


def mutating(op: Column) -> Column:
    return op.startswith("mutate.") | op.isin(*MUTATING)


def gate(commands: DataFrame, by: list[str], order: list[Column], op: str = "op") -> DataFrame:
    """commands with `admitted`: the session has asked for the grammar before, or does so now."""
    prompt = (F.col(op) == "context.prompt").cast("int")
    return commands.withColumn("admitted", F.max(prompt).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) == 1)
