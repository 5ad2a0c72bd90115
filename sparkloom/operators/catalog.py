"""Tables about workspaces: registries that expire, selection by name, archives, vector packs and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Bytes of a vector, hours that a pack lives, extensions and directories of precise references, their cap.
MAX_VECTOR = 64 * 1024
PACK_HOURS = 48
PRECISE_EXTENSIONS = {"python": ("py", "pyi"), "javascript": ("js", "jsx", "mjs", "cjs"), "typescript": ("ts", "mts", "cts"), "tsx": ("tsx",), "java": ("java",)}
PRECISE_SKIPPED = ("target", "node_modules", "__pycache__", "build", "dist", "vendor")
PRECISE_BYTES = 1_000_000


def touched(registry: DataFrame, seen: DataFrame, key: str = "root", at: str = "touched") -> DataFrame:
    """A registry(key, at, ...) after further sightings(key, at): the latest counts, keys not known yet are added."""
    both = registry.unionByName(seen, allowMissingColumns=True)
    others = [c for c in both.columns if c not in (key, at)]
    return both.groupBy(key).agg(F.max(at).alias(at), *[F.max_by(c, F.struct(F.col(c).isNotNull(), F.col(at))).alias(c) for c in others])


def live(registry: DataFrame, now: Column, ttl: str, at: str = "touched") -> DataFrame:
    """The rows touched within the time to live."""
    return registry.filter(F.col(at) >= now - F.expr(f"interval {ttl}"))


def select_workspace(roots: DataFrame, selectors: DataFrame) -> DataFrame:
    """(selector, state, root): the root that a selector names exactly, else the one that ends in it as whole segments; state is
    found, ambiguous or missing, and root is null unless found. Every root meets the selectors by each of its endings."""
    segments = F.split("root", "/", -1)
    endings = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "/"))
    ends = roots.select("root").distinct().select("root", F.explode(F.array_distinct(endings)).alias("selector"))
    rows = selectors.select("selector").distinct().join(ends, "selector", "left")
    exact = F.max(F.when(F.col("root") == F.col("selector"), F.col("root")))
    found = rows.groupBy("selector").agg(exact.alias("exact"), F.count("root").alias("n"), F.min("root").alias("one"))
    state = F.when(F.col("exact").isNotNull() | (F.col("n") == 1), "found").when(F.col("n") == 0, "missing").otherwise("ambiguous")
    return found.select("selector", state.alias("state"), F.when(state == "found", F.coalesce("exact", "one")).alias("root"))


def archived(journal: DataFrame, objects: DataFrame, workspace: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(journal left, objects left, journal rows archived, objects archived) after a workspace is put away.

    The archive holds every object that its journal cites; an object that another workspace cites too stays where it is as well.
    """
    mine, rest = journal.filter(F.col("workspace") == workspace), journal.filter(F.col("workspace") != workspace)
    cited = mine.select("tag").distinct()
    own = cited.join(rest.select("tag"), "tag", "left_anti")
    return rest, objects.join(own, "tag", "left_anti"), mine, objects.join(cited, "tag", "left_semi")


def restored(journal: DataFrame, objects: DataFrame, kept_journal: DataFrame, kept_objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables with an archive's rows back; objects that are there already come once."""
    return journal.unionByName(kept_journal), objects.unionByName(kept_objects.join(objects.select("tag"), "tag", "left_anti"))


def pack(stored: DataFrame, new: DataFrame) -> DataFrame:
    """A vector pack(model, key, vector, saved_at) after new rows are put: the latest row of a model and key wins; empty
    vectors, those over MAX_VECTOR bytes and those with components that are null or not finite are not taken."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = new.filter((F.size("vector") > 0) & (F.size("vector") * 4 <= MAX_VECTOR) & fine)
    both = stored.withColumn("o", F.lit(0)).unionByName(taken.withColumn("o", F.lit(1)))
    return both.groupBy("model", "key").agg(F.max(F.struct("saved_at", "o", "vector")).alias("x")).select("model", "key", "x.vector", "x.saved_at")


def packs(stored: DataFrame) -> DataFrame:
    """(model, n, saved_at): the packs there are, and when each was last written."""
    return stored.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max("saved_at").alias("saved_at"))


def precise_sources(files: DataFrame, path: str = "path", n_bytes: str = "n_bytes") -> DataFrame:
    """The files that precise references are looked for in, with their language: by extension, within PRECISE_BYTES, not below
    a hidden or skipped directory."""
    ext = X.extension(X.basename(F.col(path)))
    language = F
    for name, extensions in PRECISE_EXTENSIONS.items():
        language = language.when(ext.isin(*extensions), F.lit(name))
    folders = F.slice(F.split(path, "/", -1), F.lit(1), F.size(F.split(path, "/", -1)) - 1)
    hidden = F.exists(folders, lambda d: d.startswith(".") | d.isin(*PRECISE_SKIPPED))
    return files.withColumn("language", language.otherwise(F.lit(None))).filter(F.col("language").isNotNull() & ~hidden & (F.col(n_bytes) <= PRECISE_BYTES))


def stable_rebuilds(samples: DataFrame, by: list[str], ts: str, fingerprint: str, seconds: int = 10) -> DataFrame:
    """The samples at which an index is built anew: the first of a run of equal fingerprints that comes `seconds` or more after
    the run's first, unless the index is of that fingerprint already. A key's first sample is what is indexed at the start."""
    w = Window.partitionBy(*by).orderBy(ts)
    at = F.col(ts).cast("timestamp_ltz").cast("double")
    rows = samples.withColumn("_new", F.coalesce((F.lag(fingerprint).over(w) != F.col(fingerprint)).cast("int"), F.lit(1)))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*by, "_run")
    rows = rows.withColumn("_age", at - F.min(at).over(run))
    ready = rows.filter(F.col("_age") >= seconds).withColumn("_k", F.row_number().over(run.orderBy(ts))).filter("_k = 1")
    # What is indexed before such a run is the fingerprint of the run that was built before it.
    first = samples.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(*by, F.col(fingerprint).alias("_start"))
    built = ready.join(first, by).withColumn("_was", F.coalesce(F.lag(fingerprint).over(Window.partitionBy(*by).orderBy("_run")), F.col("_start")))
    return built.filter(F.col("_was") != F.col(fingerprint)).select(*by, ts, fingerprint)


def cached(cache: DataFrame, fingerprint: DataFrame) -> DataFrame:
    """The rows of a cache(fingerprint, ...) that were made of what fingerprint(fingerprint) tells now; none if that has changed."""
    return cache.join(F.broadcast(fingerprint.select("fingerprint").limit(1)), "fingerprint", "left_semi")  # one row
