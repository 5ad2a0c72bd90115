"""Queries on differences, edit requests and patches over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import diffs, replay, requests
from .queries import query, table
from .sources import shared

# Every document against a copy: a line put first, the first line replaced, the last line dropped, or first and last replaced.


def _copies(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("old"))
    l, k, name = F.split("old", "\n", -1), F.col("path") % 5, F.col("path").cast("string")
    n = F.size(l)
    mark = lambda word: F.array(F.concat(F.lit(word + " "), name, F.lit(" \x01")))
    new = (
        F.when(k == 0, F.concat(mark("top"), l)).when(k == 1, F.concat(mark("head"), F.slice(l, F.lit(2), n))).when((k == 2) & (n > 1), F.slice(l, F.lit(1), n - 1))
        .when((k == 3) & (n > 2), F.concat(mark("head"), F.slice(l, F.lit(2), n - 2), mark("tail"))).otherwise(l)
    )
    return d.withColumn("new", F.array_join(new, "\n"))


COPIES = """l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents), c as (select doc_id as path, l, len(l) as n, doc_id % 5 as k, ' ' || doc_id || ' ' || chr(1) as m from l),
    copies as (select path, n, k, case when k = 0 then list_prepend('top' || m, l) when k = 1 then list_prepend('head' || m, l[2:]) when k = 2 and n > 1 then l[:n - 1]
        when k = 3 and n > 2 then list_append(list_prepend('head' || m, l[2:n - 1]), 'tail' || m) else l end as new,
        case when k = 1 then 1 when k = 2 and n > 1 then 1 when k = 3 and n > 2 then 2 else 0 end as removed, case when k in (0, 1) then 1 when k = 3 and n > 2 then 2 else 0 end as added from c)"""


@query(f"""with {COPIES} select path, removed, added, case when removed + added = 0 then 0 when k = 3 and n > 8 then 2 else 1 end as hunks, sha256(array_to_string(new, chr(10))) as patched from copies""")
def unified_diff(spark, sf_dir):
    """What the unified text of each document and its copy removes and adds, and the document after the patch."""
    d = _copies(spark, sf_dir)
    hunks = shared.written(diffs.file_hunks(d, "path", "old", "new"), "hunks")
    text = diffs.unified(hunks, "path").select("path", F.slice(F.split("text", "\n", -1), 3, 1 << 30).alias("lines"))
    with_sign = lambda sign: F.size(F.filter("lines", lambda x: x.startswith(sign))).cast("int")
    counts = text.select("path", with_sign("-").alias("removed"), with_sign("+").alias("added"), with_sign("@").alias("hunks"))
    after = diffs.applied(d, hunks, "path", "old").select("path", F.sha2("text", 256).alias("patched"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return after.join(counts, "path", "left").select("path", zero("removed"), zero("added"), zero("hunks"), "patched")


# Edit requests on files of parts: a function of one name on lines 2 to 2 + size, and two of another name.

FAULTS = ["no path", "no tag", "no edits", "another op", "unknown action", "no text", "bad lines", "bad block", "no block", "unknown symbol", "ambiguous symbol", "symbol in a new file", "bad place", "no destination", "two moves or removals", "removal with edits", "no sections"]


def _requests(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("req"), F.col("p_partkey").cast("string").alias("n"), (F.col("p_partkey") % 24).cast("int").alias("k"))
    head, lines = '{"path": "src/@", "tag": "abcd", "edits": [%s]}', '{"replace": {"lines": [2, 3]}, "with": "one @\\ntwo"}'
    bodies = [
        head % lines, head % (lines + ', {"insert": {"before": "^"}, "body": "top"}, {"insert": {"after": "$"}, "body": ""}'), head % '{"delete": {"block": 2}}', head % '{"replace": {"symbol": "one"}, "with": ""}',
        head % (lines + ', {"move": {"to": "dst/@"}}'), head % '{"remove": true}', "[" + head % lines + ", " + head % '{"insert": {"before": 1}, "body": "x"}, {"insert": {"after": 9}, "body": "y"}' + "]",
        '{"tag": "abcd", "edits": [%s]}' % lines, '{"path": "src/@", "tag": 5, "edits": [%s]}' % lines, head % "", '{"op": "other", ' + (head % lines)[1:], head % (lines + ', {"swap": 1}'), head % '{"replace": {"lines": [1, 2]}}',
        head % '{"delete": {"lines": [3, 2]}}', head % '{"delete": {"block": 0}}', head % '{"delete": {"block": 5}}', head % '{"delete": {"symbol": "none"}}', head % '{"delete": {"symbol": "two"}}',
        (head % '{"delete": {"symbol": "one"}}').replace("abcd", "new"), head % '{"insert": {"before": "$"}, "body": "x"}', head % '{"move": {"from": "a"}}', head % '{"remove": true}, {"move": {"to": "b"}}',
        head % (lines + ', {"remove": true}'), "[]",
    ]
    made = F.element_at(F.array(*[F.lit(b) for b in bodies]), F.col("k") + 1)
    return p.select("req", F.replace(made, F.lit("@"), F.col("n")).alias("body"))


def _compiled(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), "p_partkey").alias("file"), (F.col("p_size") + 2).cast("int").alias("end"))
    at = lambda name, line: p.select("file", F.lit(name).alias("name"), F.concat(F.lit("m::"), F.lit(name)).alias("qualified"), F.lit("fn").alias("kind"), F.lit(line).alias("start_line"))
    symbols = at("one", 2).unionByName(at("two", 90)).unionByName(at("two", 95))
    spans = p.select("file", F.lit(2).alias("start"), "end").unionByName(p.select("file", F.lit(2).alias("start"), F.lit(2).alias("end")))
    return requests.compiled(_requests(spark, sf_dir), symbols, spans)


@query("""with p as (select p_partkey as req, p_partkey % 24 as k, p_size, 'src/' || p_partkey as path from part), h as (
    select *, unnest(case when k in (0, 4) then [{section: 0, seq: 0, action: 'replace', s: 2, e: 3, body: 'one ' || req || '|two'}]
        when k = 1 then [{section: 0, seq: 0, action: 'replace', s: 2, e: 3, body: 'one ' || req || '|two'}, {section: 0, seq: 1, action: 'bof', s: 0, e: 0, body: 'top'}, {section: 0, seq: 2, action: 'eof', s: 0, e: 0, body: ''}]
        when k = 2 then [{section: 0, seq: 0, action: 'cut', s: 2, e: p_size + 2, body: ''}] when k = 3 then [{section: 0, seq: 0, action: 'replace', s: 2, e: p_size + 2, body: ''}]
        when k = 6 then [{section: 0, seq: 0, action: 'replace', s: 2, e: 3, body: 'one ' || req || '|two'}, {section: 1, seq: 0, action: 'insert_before', s: 1, e: 1, body: 'x'}, {section: 1, seq: 1, action: 'insert_after', s: 9, e: 9, body: 'y'}]
        else [] end) as h from p)
    select req, h.section as section, path, h.seq as seq, h.action as action, h.s as "start", cast(h.e as int) as "end", h.body as body from h""")
def compiled_edits(spark, sf_dir):
    return _compiled(spark, sf_dir)[1].withColumn("body", F.array_join("body", "|"))


@query("""with p as (select p_partkey as req, p_partkey % 24 as k, 'src/' || p_partkey as path from part)
    select req, unnest(case when k = 6 then [0, 1] when k < 6 then [0] else [] end) as section, path, 'abcd' as tag, case k when 4 then 'move' when 5 then 'remove' end as file_op, case when k = 4 then 'dst/' || req end as dest from p""")
def compiled_sections(spark, sf_dir):
    return _compiled(spark, sf_dir)[0]


@query("""with p as (select p_partkey as req, cast(p_partkey % 24 as int) as k from part)
    select req, case when k = 23 then -1 else 0 end as section, case when k in (7, 8, 9, 10, 22, 23) then -1 when k in (11, 21) then 1 else 0 end as seq,
        ['no path', 'no tag', 'no edits', 'another op', 'unknown action', 'no text', 'bad lines', 'bad block', 'no block', 'unknown symbol', 'ambiguous symbol', 'symbol in a new file', 'bad place', 'no destination', 'two moves or removals', 'removal with edits', 'no sections'][k - 6] as fault
    from p where k >= 7""")
def edit_faults(spark, sf_dir):
    return _compiled(spark, sf_dir)[2]


# Patches on documents with a first and a last line of their own; what they cite is the text of now or an older one.


def _replayed(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("ws"), (F.col("doc_id") % 12).cast("int").alias("k"), X.normalize_lf(F.coalesce("text", F.lit(""))).alias("t"))
    k = F.col("k")
    whole = lambda first, last: F.concat_ws("\n", first, F.concat(F.lit("m1 "), "ws"), F.concat(F.lit("m2 "), "ws"), F.col("t"), last, F.lit(""))
    head, tail = F.concat(F.lit("head "), "ws"), F.concat(F.lit("tail "), "ws")
    was = whole(head, tail)
    live = F.when(k.isin(1, 4, 5), whole(head, F.concat(F.lit("live "), "ws"))).when(k == 2, whole(F.lit("other"), tail)).otherwise(was)
    whole_texts = d.select("ws", "k", was.alias("was"), live.alias("text"))
    d = shared.written(whole_texts.select("ws", "k", X.tag(F.col("was")).alias("tag")), "replayed")
    files = whole_texts.select("ws", F.lit("a").alias("path"), "text").unionByName(d.filter("k in (7, 8)").select("ws", F.lit("b").alias("path"), F.lit("b\n").alias("text")))
    objects = whole_texts.filter("k <> 3").select(X.tag(F.col("was")).alias("tag"), F.col("was").alias("text"))
    cite = F.substr("tag", F.lit(1), F.lit(40))
    none = F.lit(None).cast("string")

    def section(kinds: list[int], number: int, path: str, cited: Column, op: Column = none, dest: Column = none) -> DataFrame:
        return d.filter(F.col("k").isin(kinds)).select("ws", F.lit(number).alias("section"), F.lit(path).alias("path"), cited.alias("cited"), op.alias("file_op"), dest.alias("dest"))

    def hunk(kinds: list[int], number: int, action: str, at: int, body: str) -> DataFrame:
        return d.filter(F.col("k").isin(kinds)).select("ws", F.lit(number).alias("section"), F.lit(0).alias("seq"), F.lit(action).alias("action"), F.lit(at).alias("start"), F.lit(at).alias("end"), F.array(F.lit(body)).alias("body"))

    gone = F.lit("0123456789abcdef")
    parts = [
        section([0, 1, 2, 4, 6, 7, 9], 0, "a", cite), section([3], 0, "a", gone), section([5], 0, "a", cite), section([4, 9], 1, "a", cite),
        section([6], 1, "a", cite, F.lit("move"), F.lit("c")), section([7], 1, "a", cite, F.lit("move"), F.lit("b")), section([6], 2, "c", cite),
        section([8], 0, "b", X.tag(F.lit("b\n")), F.lit("remove")), section([8], 1, "a", cite, F.lit("move"), F.lit("b")), section([10], 0, "n", F.lit("new")), section([10], 1, "a", F.lit("new")),
    ]
    hunks = [hunk([0, 1, 2, 3, 4, 6, 7, 9], 0, "replace", 1, "NEW"), hunk([5], 0, "replace", 10**6, "x"), hunk([4], 1, "insert_after", 2, "second"), hunk([9], 1, "replace", 1, "AGAIN"), hunk([6], 2, "eof", 0, "end"), hunk([10], 0, "bof", 0, "n")]
    every = lambda rows: functools.reduce(DataFrame.unionByName, rows)
    return replay.replayed(files, every(parts), every(hunks), objects)


@query("""with d as (select cast(doc_id as varchar) as ws, cast(doc_id % 12 as int) as k, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') as t from documents),
    p as (select ws, k, 'm1 ' || ws || chr(10) || 'm2 ' || ws || chr(10) || t as t, 'm1 ' || ws || chr(10) || 'second' || chr(10) || 'm2 ' || ws || chr(10) || t as t2, chr(10) as n, 'head ' || ws as head, 'tail ' || ws as tail, 'live ' || ws as live from d),
    f as (
        select ws, 'a' as path, case when k = 0 then 'applied' when k in (1, 4) then 'merged' when k = 2 then 'conflict' when k = 3 then 'missing tag' when k = 5 then 'out of bounds' when k = 6 then 'moved' when k = 7 then 'destination exists' when k = 8 then 'moved' when k = 9 then 'conflict'
            when k = 10 then 'file exists' else 'kept' end as state,
            case when k in (6, 8) then null when k = 0 then 'NEW' || n || t || n || tail || n when k = 1 then 'NEW' || n || t || n || live || n when k = 4 then 'NEW' || n || t2 || n || live || n
            when k = 2 then 'other' || n || t || n || tail || n when k = 5 then head || n || t || n || live || n else head || n || t || n || tail || n end as text from p
        union all select ws, 'b', case when k = 7 then 'destination exists' else 'applied' end, case when k = 7 then 'b' || n else head || n || t || n || tail || n end from p where k in (7, 8)
        union all select ws, 'c', 'merged', 'NEW' || n || t || n || tail || n || 'end' || n from p where k = 6)
    select ws, path, state, sha256(text) as text from f""")
def replayed_edits(spark, sf_dir):
    return _replayed(spark, sf_dir).withColumn("text", F.sha2("text", 256))
