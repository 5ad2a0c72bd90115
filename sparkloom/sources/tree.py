"""Scan of a source tree: recursive, without links, with pruned directories, an extension list and a size cap."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def ignored_names(lines: list[str]) -> set[str]:
    """The literal one-segment entries of an ignore file; globs, negations and longer paths are not read."""
    out = set()
    for line in lines:
        name = line.strip().rstrip("/").lstrip("/")
        if name and not name.startswith(("#", "!")) and not any(c in name for c in "*?[]/\\"):
            out.add(name)
    return out


def segments(path: Column) -> Column:
    """The directories of a relative path."""
    parts = F.split(path, "/", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def prune(files: DataFrame, skipped: list[str], path: str = "path") -> DataFrame:
    """files without those under a skipped directory name or under a virtual environment (a directory that holds its marker)."""
    rows = files.filter(~F.exists(segments(F.col(path)), lambda d: d.isin(skipped)))
    marks = files.filter(X.basename(F.col(path)) == X.VIRTUALENV_MARKER).select(F.regexp_replace(path, "[^/]*$", "").alias("venv")).distinct()
    ups = rows.select(path, F.explode(F.transform(F.sequence(F.lit(0), F.size(segments(F.col(path)))), lambda i: F.array_join(F.slice(segments(F.col(path)), F.lit(1), i), "/"))).alias("up"))
    inside = ups.select(path, F.when(F.col("up") == "", "").otherwise(F.concat("up", F.lit("/"))).alias("venv")).join(marks, "venv", "left_semi").select(path).distinct()
    return rows.join(inside, path, "left_anti")


def scan(spark: SparkSession, root: str, max_bytes: int = X.MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files(path, text, tag, n_bytes), counts(files, oversized)) of a tree that Spark can read.

    Files over the cap are counted, not read: the content column is pruned from the count. Hidden and empty files are no
    part of what Spark lists.
    """
    base = root.rstrip("/")
    if base in ("", os.path.expanduser("~")):
        raise ValueError("a workspace is neither / nor the home directory")
    names = set(X.SKIPPED) | {X.OWN_DIRECTORY}
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    for name in X.IGNORE_FILES:  # Spark's listing leaves hidden files out, so these two are asked for by name
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(at):
            stream = fs.open(at)
            names |= ignored_names(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n"))
            stream.close()
    relative = F.regexp_replace(F.col("path"), "^.*?" + _quoted(base) + "/", "")
    rows = prune(raw.select(relative.alias("path"), "length", "content"), sorted(names)).filter(X.is_indexable(F.col("path")))
    counts = rows.agg(F.count_if(F.col("length") <= max_bytes).alias("files"), F.count_if(F.col("length") > max_bytes).alias("oversized"))
    kept = rows.filter(F.col("length") <= max_bytes).filter(F.is_valid_utf8(F.col("content")))
    text = X.normalize_lf(F.decode("content", "UTF-8"))
    return kept.select("path", text.alias("text"), X.tag(text).alias("tag"), F.col("length").alias("n_bytes")), counts


def _quoted(path: str) -> str:
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in path.split(":", 1)[-1].lstrip("/"))


#: Build commands by marker file, in order of priority.
BUILD_COMMANDS = (
    ("Cargo.toml", "cargo build"), ("go.mod", "go build ./..."), ("Makefile", "make"), ("package.json", "npm run build"),
    ("pyproject.toml", "python -m compileall -q ."), ("setup.py", "python -m compileall -q ."),
)


def markers(paths: DataFrame, path: str = "path") -> DataFrame:
    """The build command of the marker file that comes first in priority, one row at most."""
    found = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(name).alias("marker"), F.lit(command).alias("command")) for i, (name, command) in enumerate(BUILD_COMMANDS)])
    hits = paths.select(F.explode(F.filter(found, lambda x: x["marker"] == F.col(path))).alias("x")).select("x.*")
    return hits.orderBy("rank").limit(1)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def walk(root: str) -> Iterator[str]:
    """Paths under a local root in name order, without links; for tests of scan."""
    for where, dirs, files in os.walk(root):
        dirs.sort()
        for f in sorted(files):
            full = os.path.join(where, f)
            if not os.path.islink(full):
                yield os.path.relpath(full, root)
