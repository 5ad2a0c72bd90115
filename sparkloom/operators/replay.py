"""Sections of patches applied in their order: on the live text, or replayed on the text they cite and merged onto the live one.

A patch belongs to a workspace (ws), whose files it may change in several sections. Section k of all workspaces is one round of
joins: a section sees what earlier ones of its patch have made of the files, moved and removed ones too. One that cites the text
a file has now is applied to it; one that cites an older, stored text is applied to that, and what it changes there is merged by
lines onto the text of now. A section that cannot be carried out refuses its patch: all files of the workspace stay as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import shared
from . import diffs, edits

#: How a file is named in a round: workspace and path in one.
_KEY = "file"


def _key(path: str = "path"):
    return F.concat_ws("\x00", "ws", path)


def _round(state: DataFrame, sections: DataFrame, hunks: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, ws, path, text, how) that a round's sections make, a null text for a file that goes, and (ws, reason) of those refused.

    state(file, ws, path, text, how) has the files that there are; sections has one row a workspace.
    """
    s = sections.withColumn(_KEY, _key()).withColumn("to", F.when(F.col("file_op") == "move", _key("dest")))
    s = s.join(state.select(_KEY, F.col("text").alias("live")), _KEY, "left").join(state.select(F.col(_KEY).alias("to"), F.lit(True).alias("taken")), "to", "left")
    fresh = F.col("cited") == "new"
    early = (
        F.when(fresh & F.col("file_op").isNotNull(), "moves a new file").when(F.col("taken"), "destination exists").when(fresh & F.col("live").isNotNull(), "file exists")
        .when(~fresh & F.col("live").isNull(), "no such file")
    )
    s = shared.written(s.withColumn("reason", early), "round")
    asked = s.filter("reason is null and cited <> 'new'")
    now = asked.select(F.col(_KEY).alias("path"), X.tag(F.col("live")).alias("tag"))
    cited = edits.cited_states(asked.select(F.col(_KEY).alias("path"), "cited"), now, objects).select(F.col("path").alias(_KEY), "state", F.col("base").alias("base_tag"))
    texts = objects.select(F.col("tag").alias("base_tag"), F.col("text").alias("stored")).dropDuplicates(["base_tag"])
    s = s.join(cited, _KEY, "left").join(texts, "base_tag", "left")
    same = F.coalesce(F.col("state") == "live", F.lit(False))  # then the text is written once
    base = F.when(fresh, F.lit("")).when(F.col("state") == "found", F.col("stored"))
    s = s.withColumn("base", base).withColumn("reason", F.coalesce("reason", F.when(F.col("state").isin("ambiguous", "missing"), F.concat("state", F.lit(" tag")))))
    s = shared.written(s.select(_KEY, "ws", "path", "section", "file_op", "dest", "to", "live", "base", same.alias("same"), "reason"), "based")

    good = s.filter("reason is null")
    mine = hunks.join(good.select("ws", "section", _KEY), ["ws", "section"]).select(F.col(_KEY).alias("path"), "seq", "action", "start", "end", "body")
    base = F.when(F.col("same"), F.col("live")).otherwise(F.col("base"))
    count = good.select(F.col(_KEY).alias("path"), F.size(X.split_lines(base)).alias("line")).filter("line > 0")
    # Lines that replace or cut nothing of an empty file are out of bounds, so such a file only takes insertions at its ends.
    bad = edits.refused(count, mine).select(F.col("path").alias(_KEY), F.col("reason").alias("bad")).groupBy(_KEY).agg(F.min("bad").alias("bad"))
    changes = edits.changes_of(mine).withColumnRenamed("path", _KEY)
    s = s.join(bad, _KEY, "left").join(changes, _KEY, "left").withColumn("reason", F.coalesce("reason", "bad"))
    s = s.withColumn("was", X.split_lines(base)).withColumn("lines", F.when(F.col("reason").isNull(), edits.applied(F.col("was"), "changes")))
    stale = F.col("reason").isNull() & F.col("live").isNotNull() & (F.col("live") != base)
    about = [_KEY, "ws", "path", "file_op", "dest", "to", "reason", F.col("live").isNull().alias("new"), F.coalesce(stale, F.lit(False)).alias("stale")]
    s = shared.written(s.select(*about, "lines", F.when(stale, F.col("was")).alias("base"), F.when(stale, X.split_lines(F.col("live"))).alias("ours")), "edited")
    merged = diffs.merged_lines(s.filter("stale").select(_KEY, "base", "ours", F.col("lines").alias("theirs")), _KEY)
    over = s.filter("stale").drop("base", "ours", "lines").join(merged, _KEY).withColumn("reason", F.when(F.col("conflicts") > 0, F.lit("conflict"))).drop("conflicts")
    s = s.filter("not stale").drop("base", "ours").unionByName(over)
    ended = F.when(F.size("lines") > 0, F.concat(F.array_join("lines", "\n"), F.lit("\n")))
    s = shared.written(s.withColumn("text", ended).drop("lines"), "done")

    good = s.filter("reason is null")
    text = F.coalesce("text", F.lit(""))
    how = F.when(F.col("new"), "created").when(F.col("stale"), "merged").otherwise("applied")
    stay = good.filter("file_op is null").select(_KEY, "ws", "path", text.alias("text"), how.alias("how"))
    gone = good.filter("file_op is not null").select(_KEY, "ws", "path", F.lit(None).cast("string").alias("text"), F.when(F.col("file_op") == "move", "moved").otherwise("removed").alias("how"))
    there = good.filter("file_op = 'move'").select(F.col("to").alias(_KEY), "ws", F.col("dest").alias("path"), text.alias("text"), F.when(F.col("stale"), "merged").otherwise("applied").alias("how"))
    return stay.unionByName(gone).unionByName(there), s.filter("reason is not null").select("ws", "reason")


def replayed(files: DataFrame, sections: DataFrame, hunks: DataFrame, objects: DataFrame) -> DataFrame:
    """(ws, path, state, text) of every file of files(ws, path, text) and every new one after all patches.

    sections(ws, section, path, cited, file_op, dest): cited is the tag of the text that its hunks(ws, section, seq, action, start, end,
    body) count lines in, or 'new'; objects(tag, text) are the stored texts. state is kept, applied, merged, created, moved or
    removed (with a null text), or the reason why the workspace's patch is refused. Texts have \\n line ends and end in one.
    """
    state = files.select(_key().alias(_KEY), "ws", "path", "text", F.lit("kept").alias("how"))
    left = sections.withColumn("round", F.row_number().over(_by_section()))
    rounds = left.agg(F.max("round")).first()[0] or 0  # as many as the longest patch has sections
    refused = None
    for k in range(1, rounds + 1):
        mine = left.filter(F.col("round") == k).drop("round")
        if refused is not None:
            mine = mine.join(refused.select("ws"), "ws", "left_anti")
        made, bad = _round(state.filter("text is not null"), mine, hunks, objects)
        state = state.join(made.select(_KEY), _KEY, "left_anti").unionByName(made.select(state.columns))
        if k < rounds:  # the last one is read once
            state = shared.written(state, "state")
        bad = shared.written(bad, "bad")
        refused = bad if refused is None else refused.unionByName(bad)
    if refused is None:
        return state.select("ws", "path", F.col("how").alias("state"), "text")
    done = state.join(refused.select("ws"), "ws", "left_anti").select("ws", "path", F.col("how").alias("state"), "text")
    kept = files.join(refused, "ws").select("ws", "path", F.col("reason").alias("state"), "text")
    return done.unionByName(kept)


def _by_section():
    from pyspark.sql import Window

    return Window.partitionBy("ws").orderBy("section")
