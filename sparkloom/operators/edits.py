"""Edits: hunks applied as joins on lines, what must not be applied, files made, moved and deleted, anchors and cited texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Where inserted lines go, in the order of a file: before all, before a line, in place of it, after it, after all.
BOF, BEFORE, AT, AFTER, EOF = range(5)


def apply_hunks(lines: DataFrame, hunks: DataFrame, path: str = "path") -> DataFrame:
    """lines(path, line, text) after hunks(path, seq, action, start, end, body array<string>), lines numbered anew.

    Actions: replace (start..end by body), cut, insert_before, insert_after, bof, eof. Removed lines go by an anti-join
    on exploded ranges; inserted lines get the sort key (line, phase, seq, place in body), and each file is numbered by it.
    """
    cut = hunks.filter("action in ('replace', 'cut')").select(path, F.explode(F.sequence("start", "end")).alias("line"))
    kept = lines.join(cut, [path, "line"], "left_anti").select(path, F.col("line").alias("k1"), F.lit(AT).alias("k2"), F.lit(0).alias("k3"), F.lit(0).alias("k4"), "text")
    phase = F.when(F.col("action") == "bof", BOF).when(F.col("action") == "insert_before", BEFORE).when(F.col("action") == "replace", AT).when(F.col("action") == "insert_after", AFTER).otherwise(EOF)
    at = F.when(F.col("action") == "bof", 0).when(F.col("action") == "eof", 2**31 - 1).otherwise(F.col("start"))
    new = hunks.filter("action <> 'cut'").select(path, at.cast("int").alias("k1"), phase.alias("k2"), (F.col("seq") + 1).cast("int").alias("k3"), F.posexplode("body").alias("k4", "text"))
    return kept.unionByName(new).withColumn("line", F.row_number().over(Window.partitionBy(path).orderBy("k1", "k2", "k3", "k4"))).select(path, "line", "text")


def changes_of(hunks: DataFrame, path: str = "path") -> DataFrame:
    """(path, changes): the hunks of a file in one row, for applied()."""
    kind = F.col("action")
    phase = F.when(kind == "bof", BOF).when(kind == "insert_before", BEFORE).when(kind.isin("replace", "cut"), AT).when(kind == "insert_after", AFTER).otherwise(EOF)
    at = F.when(kind == "bof", 0).when(kind == "eof", 2**31 - 1).otherwise(F.col("start"))
    # The last line that comes before what a hunk inserts, and the lines that it removes.
    upto = F.when(kind == "insert_before", F.col("start") - 1).otherwise(at).cast("int")
    cuts = kind.isin("replace", "cut")
    change = F.struct(at.cast("int").alias("at"), phase.alias("phase"), "seq", upto.alias("upto"), F.when(cuts, F.col("start")).cast("int").alias("cut"), F.when(cuts, F.col("end")).cast("int").alias("to"), F.when(kind == "cut", F.array().cast("array<string>")).otherwise(F.col("body")).alias("body"))
    return hunks.groupBy(path).agg(F.array_sort(F.collect_list(change)).alias("changes"))


def applied(lines: Column, changes: str) -> Column:
    """The array lines after a file's changes_of(), which may be null: as apply_hunks(), within the row."""
    c, n = F.col(changes), F.size(lines)

    def kept(after: Column, upto: Column) -> Column:
        some = F.slice(lines, after + 1, F.greatest(F.least(upto, n) - after, F.lit(0)))
        return F.filter(some, lambda _, i: ~F.exists(c, lambda x: x["cut"].isNotNull() & (i + after + 1 >= x["cut"]) & (i + after + 1 <= x["to"])))

    def piece(x: Column, k: Column) -> Column:
        return F.concat(kept(F.least(F.coalesce(F.get(c, k - 1)["upto"], F.lit(0)), n), x["upto"]), x["body"])

    whole = F.concat(F.flatten(F.transform(c, piece)), kept(F.least(F.element_at(c, -1)["upto"], n), n))
    return F.when(c.isNull(), lines).otherwise(whole)


def refused(lines: DataFrame, hunks: DataFrame, seen: DataFrame | None = None, path: str = "path") -> DataFrame:
    """(path, line, reason) of edits that must not be applied: out of bounds, overlapping, or on lines never shown."""
    ranged = hunks.filter("action not in ('bof', 'eof')").select(path, "seq", "action", "start", F.when(F.col("action").isin("replace", "cut"), F.col("end")).otherwise(F.col("start")).alias("end"))
    count = lines.groupBy(path).agg(F.max("line").alias("n"))
    out = ranged.join(count, path, "left").filter("n is null or start < 1 or `end` > n or `end` < start").select(path, F.col("start").alias("line"), F.lit("out of bounds").alias("reason"))
    touched = ranged.filter("`end` >= start").select(path, "action", F.explode(F.sequence("start", "end")).alias("line"))
    twice = touched.filter("action in ('replace', 'cut')").groupBy(path, "line").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(path, "line", F.lit("overlap").alias("reason"))
    out = out.unionByName(twice)
    if seen is not None:
        from .intervals import unseen

        out = out.unionByName(unseen(touched.select(path, "line").distinct(), seen, [path]).select(path, "line", F.lit("not shown").alias("reason")))
    return out


def joined(lines: DataFrame, path: str = "path") -> DataFrame:
    """(path, text) of numbered lines, each ended by a line break."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    return lines.groupBy(path).agg(F.concat(F.array_join(rows, "\n"), F.lit("\n")).alias("text"))


def create(files: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files after creating new ones (ended by a line break), and those of new whose path exists."""
    ended = new.withColumn("text", F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n"))))
    return files.unionByName(ended.join(files.select("path"), "path", "left_anti")), new.join(files.select("path"), "path", "left_semi")


def delete(files: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files left, the removed ones as journal rows (path, tag, text), and paths that do not exist."""
    gone = files.join(paths.select("path").distinct(), "path", "left_semi")
    return files.join(paths.select("path"), "path", "left_anti"), gone.select("path", X.tag(F.col("text")).alias("tag"), "text"), paths.join(files.select("path"), "path", "left_anti")


def balance(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with braces, parens and brackets: how many more open than close."""
    x: Column = F.col(text)
    return texts.select("*", X.balance(x, "{}").alias("braces"), X.balance(x, "()").alias("parens"), X.balance(x, "[]").alias("brackets"))


def anchored(symbols: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(file, anchor) with n, how many lines of the file begin a symbol of that name or qualified name, and line, the one if n is 1."""
    names = symbols.filter("kind <> 'file'").select("file", F.explode(F.array_distinct(F.array("name", "qualified"))).alias("anchor"), "start_line")
    hits = asked.join(names, ["file", "anchor"], "left").groupBy("file", "anchor").agg(F.count_distinct("start_line").alias("n"), F.min("start_line").alias("line"))
    return hits.withColumn("line", F.when(F.col("n") == 1, F.col("line")))


def blocks_at(spans: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(file, line) with the widest of spans(file, start, end) that starts there: state is block, single (it ends on its own
    line, so an edit of the line is meant) or missing; end is null unless block."""
    widest = spans.groupBy("file", F.col("start").alias("line")).agg(F.max("end").alias("last"))
    state = F.when(F.col("last").isNull(), "missing").when(F.col("last") == F.col("line"), "single").otherwise("block")
    return asked.join(widest, ["file", "line"], "left").select("file", "line", state.alias("state"), F.when(state == "block", F.col("last")).alias("end"))


def cited_states(cites: DataFrame, live: DataFrame, objects: DataFrame) -> DataFrame:
    """cites(path, cited) with what an edit on that tag starts from: live (the file is that), or a stored object that is found,
    several (ambiguous) or none (missing); base is the full tag. Tags meet by their first four digits."""
    head = lambda c: X.ascii_lower(F.substr(c, F.lit(1), F.lit(4)))
    asked = cites.select("path", "cited").distinct()
    now = asked.join(live.select("path", F.col("tag").alias("now")), "path", "left")
    kept = objects.select("tag").distinct().withColumn("head", head(F.col("tag")))
    near = asked.withColumn("head", head(F.col("cited"))).join(kept, "head").filter(X.tag_matches(F.col("tag"), F.col("cited")))
    counts = near.groupBy("path", "cited").agg(F.count(F.lit(1)).alias("n"), F.min("tag").alias("tag"))
    rows = now.join(counts, ["path", "cited"], "left")
    state = F.when(X.tag_matches(F.col("now"), F.col("cited")), "live").when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    base = F.when(state == "live", F.col("now")).when(state == "found", F.col("tag"))
    return rows.select("path", "cited", state.alias("state"), base.alias("base"))


def moved(files: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(path, text) after moves(path, dest), and the moves refused: of a file that is not there, onto one that is, or onto
    a place that another move takes too."""
    places = moves.groupBy("dest").agg(F.count(F.lit(1)).alias("n"))
    rows = moves.join(places, "dest").join(files.select("path", F.lit(True).alias("there")), "path", "left").join(files.select(F.col("path").alias("dest"), F.lit(True).alias("taken")), "dest", "left")
    fine = F.col("there").isNotNull() & F.col("taken").isNull() & (F.col("n") == 1)
    good = rows.filter(fine).select("path", "dest")
    after = files.join(good, "path", "left").withColumn("path", F.coalesce("dest", "path")).select(files.columns)
    return after, rows.filter(~fine).select("path", "dest")


def verified(files: DataFrame, staged: DataFrame) -> DataFrame:
    """staged(path, read_tag, text) whose file is no longer what was read: (path, read_tag, now); now is null if it is gone.
    A null read_tag says that the file was not there. Nothing may be committed while there are any."""
    now = files.select("path", X.tag(F.col("text")).alias("now"))
    return staged.join(now, "path", "left").filter(~F.col("now").eqNullSafe(F.col("read_tag"))).select("path", "read_tag", "now")
