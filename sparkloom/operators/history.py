"""Content-addressed objects and journals of versions, as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

MAX_OBJECT = 8 * 1024 * 1024


def put(objects: DataFrame, new: DataFrame, most: int = MAX_OBJECT) -> DataFrame:
    """objects(tag, content, saved_at) after putting new ones: a tag's latest content wins; contents over `most` bytes are refused."""
    both = objects.withColumn("o", F.lit(0)).unionByName(new.filter(F.octet_length("content") <= most).withColumn("o", F.lit(1)))
    return both.groupBy("tag").agg(F.max(F.struct("o", "saved_at", "content")).alias("x")).select("tag", "x.content", "x.saved_at")


def journal(versions: DataFrame, by: list[str], order: list[Column], tag: str = "tag") -> DataFrame:
    """versions without those equal to the version before (A, A, B, A keeps A, B, A), with revision from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    kept = versions.withColumn("was", F.lag(tag).over(w)).filter(F.col("was").isNull() | (F.col("was") != F.col(tag))).drop("was")
    return kept.withColumn("revision", F.row_number().over(w) - 1)


def resolve(objects: DataFrame, cited: str) -> tuple[str, DataFrame]:
    """("found" | "ambiguous" | "missing", matching objects) for a cited tag prefix of four hex digits or more."""
    hits = objects.filter(X.tag_matches(F.col("tag"), F.lit(cited)))
    n = hits.select("tag").distinct().limit(2).count()
    return ("missing", "found", "ambiguous")[n], hits


def history(rows: DataFrame, arg: str | None = None, tag: str | None = None, since: int | None = None, until: int | None = None, most: int = 20, offset: int = 0) -> tuple[DataFrame, int, int | None]:
    """A page of rows(path, tag, revision, saved_at as epoch seconds, may be null): newest first, rows without a time
    last; and the total and the next offset. A time filter drops rows without a time."""
    if not 1 <= most <= 200 or offset < 0:
        raise ValueError("most must be in 1..200 and offset at least 0")
    if since is not None and until is not None and since > until:
        raise ValueError("since is after until")
    if tag is not None and not (4 <= len(tag) <= 64 and all(c in "0123456789abcdefABCDEF" for c in tag)):
        raise ValueError("tag must have 4 to 64 hex digits")
    hit = rows
    if arg is not None:
        hit = hit.filter(F.col("path") == arg)
    if tag is not None:
        hit = hit.filter(X.tag_matches(F.col("tag"), F.lit(tag)))
    if since is not None:
        hit = hit.filter(F.col("saved_at") >= since)
    if until is not None:
        hit = hit.filter(F.col("saved_at") <= until)
    total = hit.count()
    page = hit.orderBy(F.desc_nulls_last("saved_at"), "path", F.desc("revision")).offset(offset).limit(most)
    return page, total, offset + most if offset + most < total else None


def overview(journals: DataFrame) -> DataFrame:
    """(path, tags in order, modified), a row a path, newest first; paths without versions are left out."""
    rows = journals.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("revision", "tag"))), lambda x: x["tag"]).alias("tags"), F.max("modified").alias("modified"))
    return rows.filter(F.size("tags") > 0).orderBy(F.desc("modified"), "path")


def changelog(journals: DataFrame, most: int = 20, tags: int = 3) -> DataFrame:
    """The last `tags` versions, newest first, of the paths changed last; no more versions than that are gathered."""
    newest = journals.groupBy("path").agg(F.max("modified").alias("modified")).orderBy(F.desc("modified"), "path").limit(most)
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("revision")))
    recent = journals.join(newest.select("path"), "path", "left_semi").withColumn("rank", rank).filter(F.col("rank") <= tags)
    shown = recent.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))
    return newest.join(shown, "path").select("path", "tags", "modified").orderBy(F.desc("modified"), "path")


def undo_target(versions: DataFrame, live: DataFrame, by: str = "path") -> DataFrame:
    """For each path the newest version whose tag is not the live one's."""
    other = versions.join(live.select(by, F.col("tag").alias("live")), by).filter(F.col("tag") != F.col("live"))
    return other.groupBy(by).agg(F.max(F.struct("revision", "tag")).alias("x")).select(by, "x.revision", "x.tag")


def stale(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return known.join(found.select(key), key, "left_anti")


def unchanged(files: DataFrame, written: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose (path, tag) has been written, and the others."""
    return files.join(written.select("path", "tag"), ["path", "tag"], "left_semi"), files.join(written.select("path", "tag"), ["path", "tag"], "left_anti")


def archive(journals: DataFrame, objects: DataFrame, workspace: str) -> tuple[DataFrame, DataFrame]:
    """A workspace's journal, and its objects that no other workspace's journal cites."""
    mine = journals.filter(F.col("workspace") == workspace)
    own = mine.select("tag").distinct().join(journals.filter(F.col("workspace") != workspace).select("tag"), "tag", "left_anti")
    return mine, objects.join(own, "tag", "left_semi")


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: a hash of all (path, tag), whatever their order, and their number."""
    return files.agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), F.sum(F.xxhash64("path", "tag").cast("decimal(38,0)")).cast("string"), F.expr("bit_xor(xxhash64(tag, path))").cast("string")), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


def fan_out(items: DataFrame) -> DataFrame:
    """items(ord, workspace, tag, item) merged by tag: the first item, and the workspaces in the order met.

    First one row for each tag and workspace, in partial sums, so a tag that all items share gathers its workspaces alone.
    """
    each = items.groupBy("tag", "workspace").agg(F.min(F.struct("ord", "item")).alias("x"))
    rows = each.groupBy("tag").agg(F.min("x").alias("x"), F.array_sort(F.collect_list(F.struct("x.ord", "workspace"))).alias("ws"))
    return rows.select("tag", F.col("x.ord").alias("ord"), F.col("x.item").alias("item"), F.transform("ws", lambda w: w["workspace"]).alias("workspaces"))


def first_equal(items: DataFrame, digest: str = "digest") -> DataFrame:
    """items with first_root: the first root that has an item of the same digest."""
    first = items.groupBy(digest).agg(F.min(F.struct("ord", "root")).alias("x")).select(digest, F.col("x.root").alias("first_root"))
    return items.join(first, digest)


def saved(journals: DataFrame, objects: DataFrame) -> DataFrame:
    """journals(path, tag, revision) with saved_at, when the object of each tag was stored; null if it is not."""
    return journals.join(objects.groupBy("tag").agg(F.max("saved_at").alias("saved_at")), "tag", "left")


def lookup(objects: DataFrame, cited: DataFrame) -> DataFrame:
    """(tag, state) for full tags: found if an object of that tag hashes to it, damaged if one does not, else missing."""
    found = objects.join(cited.select("tag").distinct(), "tag").groupBy("tag").agg(F.max(F.sha2("content", 256) == F.col("tag")).alias("whole"))
    state = F.when(F.col("whole"), "found").when(~F.col("whole"), "damaged").otherwise("missing")
    return cited.select("tag").distinct().join(found, "tag", "left").select("tag", state.alias("state"))


def recovery_target(versions: DataFrame, by: str = "path") -> DataFrame:
    """For each path the newest version of versions(by, revision, tag, valid) whose text parses."""
    return versions.filter("valid").groupBy(by).agg(F.max(F.struct("revision", "tag")).alias("x")).select(by, "x.revision", "x.tag")


def cited_version(versions: DataFrame, cited: DataFrame, by: str = "path") -> DataFrame:
    """For each of cited(by, cited) the newest version of that path whose tag begins with it."""
    hit = versions.join(cited, by).filter(X.tag_matches(F.col("tag"), F.col("cited")))
    return hit.groupBy(by, "cited").agg(F.max(F.struct("revision", "tag")).alias("x")).select(by, "cited", "x.revision", "x.tag")
