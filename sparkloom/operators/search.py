"""Scans and ranked lookups over files, lines and symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Matches kept of a pattern, lines a function must have to be folded, hits of a term, hits shown.
PATTERN_CAP = 200
FOLD_LINES = 7
TERM_CAP = 8
SHOWN = 12


def matches(rows: DataFrame, patterns: Sequence[str], column: str) -> DataFrame:
    """Rows by pattern: smart-case substring search of every pattern (a literal list) in one scan, in which every row is
    folded once. Rows without a hit go before anything is made of them."""
    found = [(p, F.contains(column, F.lit(p)) if X.is_upper(p) else F.contains("_low", F.lit(p.translate(X.FOLD)))) for p in dict.fromkeys(patterns)]
    folded = rows.withColumn("_low", X.ascii_lower(F.col(column)))
    some = F.lit(False)
    for _, hit in found:
        some = some | hit
    hits = F.array_compact(F.array(*[F.when(hit, F.lit(p)) for p, hit in found]))
    return folded.filter(some).select("*", F.explode(hits).alias("pattern")).drop("_low")


def capped(rows: DataFrame, group: str, order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` rows of every group; Spark keeps no more than that of a group in each task before it shuffles."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rn") <= most).drop("rn")


def find(lines: DataFrame, patterns: Sequence[str], most: int = PATTERN_CAP, path: str = "path", prefixes: Sequence[str] = (), extensions: Sequence[str] = ()) -> DataFrame:
    """Matching lines in path and line order, `most` of a pattern (256 at most). Path filters come before the search."""
    if not 1 <= most <= 256:
        raise ValueError("most must be in 1..256")
    rows = lines
    if prefixes:
        rows = rows.filter(X.under_any(F.col(path), prefixes))
    if extensions:
        rows = rows.filter(X.has_extension(F.col(path), extensions))
    return capped(matches(rows, patterns, "text"), "pattern", [F.col(path), F.col("line")], most)


def find_summary(lines: DataFrame, patterns: Sequence[str], most: int = PATTERN_CAP, path: str = "path") -> DataFrame:
    """pattern, matches, files, truncated (more matches than most; exact, whatever the order of files)."""
    found = matches(lines, patterns, "text").groupBy("pattern").agg(F.count(F.lit(1)).alias("matches"), F.countDistinct(path).alias("files"))
    return found.withColumn("truncated", F.col("matches") > most)


def find_paths(files: DataFrame, patterns: Sequence[str], most: int = PATTERN_CAP, path: str = "path") -> DataFrame:
    return capped(matches(files, patterns, path), "pattern", [F.col(path)], most)


def read_lines(lines: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """Lines start..end, clamped to each file."""
    return lines.filter(F.col("line").between(max(1, start), end if end is not None else 2**31 - 1))


def read_ranges(lines: DataFrame, ranges: DataFrame, path: str = "path") -> DataFrame:
    """Lines in any of ranges(path, start, end), with the first range that holds each, and a gap marker before each range's first line but the first."""
    inside = lines.join(ranges.select(path, F.col("start").alias("rs"), F.col("end").alias("re")), path).filter("line between rs and re")
    rows = inside.groupBy(path, "line", "text").agg(F.min("rs").alias("range_start"))
    before = F.lag("line").over(Window.partitionBy(path).orderBy("line"))
    return rows.withColumn("gap", F.coalesce(F.col("line") - before > 1, F.lit(False)))


def outline(lines: DataFrame, spans: DataFrame, path: str = "path") -> DataFrame:
    """Lines with the bodies of long functions folded: spans(path, start, end, name) of FOLD_LINES lines or more keep
    their first line, and one marker row at start + 1 stands for the rest; the outer function wins."""
    long = spans.filter(F.col("end") - F.col("start") + 1 >= FOLD_LINES).select(path, "start", "end", "name")
    w = Window.partitionBy(path).orderBy("start", F.desc("end"), "name").rowsBetween(Window.unboundedPreceding, -1)
    outer = long.withColumn("reach", F.max("end").over(w)).filter(F.col("reach").isNull() | (F.col("end") > F.col("reach")) & (F.col("start") > F.col("reach"))).drop("reach")
    hidden = outer.select(path, (F.col("start") + 1).alias("lo"), F.col("end").alias("hi"))
    kept = lines.join(hidden, (lines[path] == hidden[path]) & F.col("line").between(F.col("lo"), F.col("hi")), "left_anti").select(path, "line", "text", F.lit(False).alias("folded"))
    marks = outer.select(path, (F.col("start") + 1).alias("line"), F.format_string("%d-%d: … (%s)", F.col("start") + 1, F.col("end"), F.col("name")).alias("text"), F.lit(True).alias("folded"))
    return kept.unionByName(marks)


def _is_heading(text: Column) -> Column:
    return text.rlike("^\\s*#{1,6} ")


def _level(text: Column) -> Column:
    return F.length(F.regexp_extract(text, "^\\s*(#{1,6}) ", 1))


def _title(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "^\\s*#{1,6} ", ""))


def headings(lines: DataFrame, path: str = "path") -> DataFrame:
    """Markdown headings: path, line, level, title, qualified path#title. Fences are not looked at."""
    rows = lines.filter(_is_heading(F.col("text"))).select(path, "line", _level(F.col("text")).alias("level"), _title(F.col("text")).alias("title"))
    return rows.withColumn("qualified", F.concat_ws("#", F.col(path).cast("string"), "title"))


def sections(lines: DataFrame, path: str = "path") -> DataFrame:
    """A heading's span runs to the line before the next heading of its level or less, without blank lines at its end."""
    # One shuffle by path, without the texts: every line that is not blank with the one before it, then, from the end of the
    # file up, for every level the line before the next heading of that level or less.
    full = lines.filter(F.trim("text") != "").select(path, "line", "text")
    title, level = _title(F.col("text")), _level(F.col("text"))
    full = full.select(path, "line", F.when(_is_heading(F.col("text")), F.struct(level.alias("level"), title.alias("title"))).alias("h"))
    rows = full.withColumn("before", F.lag("line").over(Window.partitionBy(path).orderBy("line")))
    later = Window.partitionBy(path).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    until = F
    for k in range(1, 7):
        until = until.when(F.col("h.level") == k, F.min(F.when(F.col("h.level") <= k, F.struct("line", "before"))).over(later))
    last = F.max("line").over(Window.partitionBy(path).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("until", until).withColumn("last", last).filter("h is not null")
    return rows.select(path, "line", "h.level", "h.title", F.when(F.col("until").isNull(), F.col("last")).otherwise(F.col("until.before")).alias("end"))


def symbols_matching(symbols: DataFrame, term: str, most: int, name: str = "name", qualified: str = "qualified", file: str = "file", start: str = "start_line") -> DataFrame:
    """Exact names by (file, start); then names or qualified names that contain the term, in any ASCII case, by (bytes of the name, file, start).
    What is left equal goes by id, if there is one, so that the cut is the same in every run."""
    low = term.translate(str.maketrans(X.UPPER, X.UPPER.lower()))
    exact = F.col(name) == term
    part = F.contains(X.ascii_lower(F.col(name)), F.lit(low)) | F.contains(X.ascii_lower(F.col(qualified)), F.lit(low))
    rows = symbols.filter(exact | part).withColumn("bucket", F.when(exact, 0).otherwise(1))
    size = F.when(F.col("bucket") == 0, 0).otherwise(F.octet_length(name))
    return rows.orderBy("bucket", size, file, start, *[c for c in ("id",) if c in symbols.columns]).limit(most)


def ranked(symbols: DataFrame, terms: DataFrame, most: int = TERM_CAP) -> DataFrame:
    """symbols_matching for a table of terms(ord, term) at once: `most` hits of each term, rank from 1. terms is a query's (eight rows at most) and is broadcast."""
    t = F.broadcast(terms.select("ord", "term", X.ascii_lower(F.col("term")).alias("low")).orderBy("ord").limit(TERM_CAP))
    exact = F.col("name") == F.col("term")
    rows = symbols.join(t, exact | F.contains(X.ascii_lower(F.col("name")), F.col("low")) | F.contains(X.ascii_lower(F.col("qualified")), F.col("low")))
    rows = rows.withColumn("bucket", F.when(exact, 0).otherwise(1)).withColumn("size", F.when(exact, 0).otherwise(F.octet_length("name")))
    w = Window.partitionBy("ord").orderBy("bucket", "size", "file", "start_line", "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def explore(symbols: DataFrame, terms: DataFrame, most: int = SHOWN, prefixes: Sequence[str] = (), extensions: Sequence[str] = ()) -> DataFrame:
    """The selection of an exploration: TERM_CAP hits of each term, then path and language filters (a filtered hit has
    used up its place), one row a symbol in the order first met, twice `most` and then `most` of them."""
    if not 1 <= most <= 128:
        raise ValueError("most must be in 1..128")
    hits = ranked(symbols, terms).filter(X.under_any(F.col("file"), prefixes) & X.has_extension(F.col("file"), extensions))
    first = Window.partitionBy("id").orderBy("ord", "rank")
    return hits.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k").orderBy("ord", "rank").limit(most)


def chunks(lines: DataFrame, tags: DataFrame, size: int = 100, path: str = "path") -> DataFrame:
    """A read as a stream of JSON rows: chunks of `size` lines and a row that ends each file; (path, seq, json)."""
    seq = F.floor((F.col("line") - 1) / size).cast("int")
    body = lines.withColumn("seq", seq).groupBy(path, "seq").agg(
        F.min("line").alias("start"), F.max("line").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    last = body.groupBy(path).agg((F.max("seq") + 1).alias("seq"))
    frames = body.select(path, "seq", "start", "end", "text", F.lit(False).alias("eof")).unionByName(last.select(path, "seq", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), F.lit("").alias("text"), F.lit(True).alias("eof")))
    out = frames.join(tags.select(path, "tag"), path)
    return out.select(path, "seq", F.to_json(F.struct(F.col(path).cast("string").alias("path"), "tag", "start", "end", "seq", "text", "eof")).alias("json"))
