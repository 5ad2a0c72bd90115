"""The reference operators on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import edits, graph, history, intervals, policy, resolve, search, sessions, vectors
from .sources import shared

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lines(shared.spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")))


#: Shared pieces of the SQL.
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TAG = r"sha256(array_to_string(list_transform(string_split({0}, chr(10)), lambda x: rtrim(x, ' ' || chr(9) || chr(13))), chr(10)))"
LINES = r"""lines as (
    select path, cast(i as int) as line, l[i] as text
    from (select doc_id as path, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) as l from documents where text is not null) d, unnest(range(1, len(l) + 1)) as u(i)
    where not (i = len(l) and l[i] = '')
)"""
PATTERNS = ["tion", "É", "The", "$$$"]
PATTERN_ROWS = "pats as (select unnest(['tion', 'É', 'The', '$$$']) as pattern)"


def smart(x: str) -> str:
    return f"case when regexp_matches(pattern, '\\p{{Lu}}') then contains({x}, pattern) else contains({FOLD.format(x)}, {FOLD.format('pattern')}) end"


# Text and search


@query(f"select doc_id, {TAG.format('text')} as tag, {TAG.format('text')}[1:7] as display from documents")
def doc_tag(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    tag = X.tag(F.col("text"))
    return d.select("doc_id", tag.alias("tag"), X.display_tag(tag).alias("display"))


@query(f"""with {LINES}, {PATTERN_ROWS}
    select pattern, path, line, text from lines, pats where {smart('text')}
    qualify row_number() over (partition by pattern order by path, line) <= 200""")
def find_lines(spark, sf_dir):
    return search.find(doc_lines(spark, sf_dir), PATTERNS).select("pattern", "path", "line", "text")


@query(f"""with {LINES}, {PATTERN_ROWS}
    select pattern, count(*) as matches, count(distinct path) as files, count(*) > 200 as truncated from lines, pats where {smart('text')} group by 1""")
def find_multi(spark, sf_dir):
    return search.find_summary(doc_lines(spark, sf_dir), PATTERNS)


@query(f"""with pats as (select unnest(['blog', '/en/', 'ORG']) as pattern)
    select pattern, page_id, url from pages, pats where {smart('url')} and (starts_with(url, 'https://') or starts_with(url, 'http://t'))
    qualify row_number() over (partition by pattern order by url, page_id) <= 50""")
def find_paths(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url").filter(X.under_any(F.col("url"), ["https://", "http://t"]))
    hits = search.matches(p, ["blog", "/en/", "ORG"], "url")
    return search.capped(hits, "pattern", [F.col("url"), F.col("page_id")], 50).select("pattern", "page_id", "url")


@query(f"with {LINES} select path, line, text from lines where line between 2 and 4")
def read_range(spark, sf_dir):
    return search.read_lines(doc_lines(spark, sf_dir), 2, 4)


@query(f"""with {LINES}, r as (select path, 1 as s, 2 as e from lines union select path, 4, 6 from lines),
    x as (select l.path, l.line, l.text, min(r.s) as range_start from lines l join r on l.path = r.path and l.line between r.s and r.e group by all)
    select path, line, text, range_start, coalesce(line - lag(line) over (partition by path order by line) > 1, false) as gap from x""")
def read_multi(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    ranges = lines.select("path").distinct().select("path", F.explode(F.array(F.struct(F.lit(1).alias("start"), F.lit(2).alias("end")), F.struct(F.lit(4).alias("start"), F.lit(6).alias("end")))).alias("x")).select("path", "x.*")
    return search.read_ranges(lines, ranges).select("path", "line", "text", "range_start", "gap")


@query(f"""with {LINES}, n as (select path, cast(max(line) as int) as n from lines group by 1),
    s as (select path, 2 as s, n as e from n where n - 2 + 1 >= 7)
    select l.path, l.line, l.text, false as folded from lines l where not exists (select 1 from s where s.path = l.path and l.line between s.s + 1 and s.e)
    union all select path, s + 1, (s + 1) || '-' || e || ': … (f' || path || ')', true from s""")
def outline(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    spans = lines.groupBy("path").agg(F.max("line").alias("end")).select("path", F.lit(2).alias("start"), "end", F.concat(F.lit("f"), F.col("path").cast("string")).alias("name"))
    inner = spans.select("path", (F.col("start") + 1).alias("start"), F.col("end"), F.lit("inner").alias("name"))
    return search.outline(lines, spans.unionByName(inner))


MD = """md as (select path, line, repeat('#', 1 + (line * 7 + path) % 3) || ' ' || text as text from lines where line % 3 = 1
    union all select path, line, text from lines where line % 3 <> 1)"""
HEADS = r"""heads as (select path, line, cast(length(regexp_extract(text, '^\s*(#{1,6}) ', 1)) as int) as level, trim(regexp_replace(text, '^\s*#{1,6} ', '')) as title
    from md where regexp_matches(text, '^\s*#{1,6} '))"""


def md_lines(spark, sf_dir):
    """Lines of documents with every third one made a heading, as the table has no Markdown."""
    marks = F.repeat(F.lit("#"), (1 + (F.col("line") * 7 + F.col("path")) % 3).cast("int"))
    return doc_lines(spark, sf_dir).withColumn("text", F.when(F.col("line") % 3 == 1, F.concat(marks, F.lit(" "), F.col("text"))).otherwise(F.col("text")))


@query(f"with {LINES}, {MD}, {HEADS} select path, line, level, title, path || '#' || title as qualified from heads")
def md_headings(spark, sf_dir):
    return search.headings(md_lines(spark, sf_dir))


@query(f"""with {LINES}, {MD}, {HEADS}, n as (select h.path, h.line, h.level, h.title, min(g.line) as nxt from heads h left join heads g on g.path = h.path and g.line > h.line and g.level <= h.level group by all)
    select n.path, n.line, n.level, n.title, max(m.line) as "end" from n join md m on m.path = n.path and m.line >= n.line and m.line < coalesce(n.nxt, 2147483647) and trim(m.text) <> '' group by 1, 2, 3, 4""")
def md_sections(spark, sf_dir):
    return search.sections(md_lines(spark, sf_dir))


def part_symbols(spark, sf_dir):
    """Parts as symbols: p_name as name, brand.name as qualified name, type as file, size as line."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.concat_ws("::", "p_brand", "p_name").alias("qualified"), F.lit("fn").alias("kind"),
        F.col("p_type").alias("file"), F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"), (F.col("p_partkey") % 4 - 1).alias("arity"),
    )


PARTS = """syms as (select cast(p_partkey as varchar) as id, p_name as name, p_brand || '::' || p_name as qualified, 'fn' as kind, p_type as file, p_size as start_line, p_size + 5 as end_line, p_partkey % 4 - 1 as arity from part)"""


@query(f"""with {PARTS}, q as (select ord, term from (values (0, 'small ring'), (1, 'ring'), (2, 'Brand#2'), (3, 'zzz')) t(ord, term)),
    h as (select ord, id, name, case when name = term then 0 else 1 end as bucket, case when name = term then 0 else strlen(name) end as size, file, start_line from syms, q
          where name = term or contains({FOLD.format('name')}, {FOLD.format('term')}) or contains({FOLD.format('qualified')}, {FOLD.format('term')}))
    select ord, id, name, cast(row_number() over (partition by ord order by bucket, size, file, start_line, id) as int) as rank from h
    qualify row_number() over (partition by ord order by bucket, size, file, start_line, id) <= 8""")
def symbols_topk(spark, sf_dir):
    terms = spark.createDataFrame([(0, "small ring"), (1, "ring"), (2, "Brand#2"), (3, "zzz")], "ord int, term string")
    return search.ranked(part_symbols(spark, sf_dir), terms).select("ord", "id", "name", "rank")


@query(f"""with {PARTS}, q as (select ord, term from (values (0, 'small ring'), (1, 'ring')) t(ord, term)),
    h as (select ord, id, name, file, row_number() over (partition by ord order by case when name = term then 0 else 1 end, case when name = term then 0 else strlen(name) end, file, start_line, id) as rank from syms, q
          where name = term or contains({FOLD.format('name')}, {FOLD.format('term')}) or contains({FOLD.format('qualified')}, {FOLD.format('term')})
          qualify rank <= 8),
    f as (select * from h where file <> '' and (starts_with(file, 'E') or starts_with(file, 'S') or starts_with(file, 'M')) qualify row_number() over (partition by id order by ord, rank) = 1)
    select cast(ord as int) as ord, cast(rank as int) as rank, id, name from f order by ord, rank limit 12""")
def explore_selection(spark, sf_dir):
    terms = spark.createDataFrame([(0, "small ring"), (1, "ring")], "ord int, term string")
    return search.explore(part_symbols(spark, sf_dir), terms, prefixes=["E", "S", "M"]).select("ord", "rank", "id", "name")


@query(r"""select item_id, array_to_string(list_distinct_keep, '|') as terms from (
    select item_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:8] as list_distinct_keep from (
        select item_id, list_filter(list_transform(regexp_split_to_array(text, '[^\p{L}\p{N}_:.]+'), lambda x: trim(x, ':.')), lambda x: strlen(x) >= 3) as w from benchmark))""")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.query_terms(F.col("text")), "|").alias("terms"))


def _score(lang: str) -> str:
    return " + ".join(f"cast(contains(h, '{n}') as int)" for n in X.NEEDLES[lang])


@query(f"""with s as (select doc_id, {_score('rust')} as r, {_score('python')} as p, {_score('cpp')} as c from (
        select doc_id, coalesce(try(decode(b[1:4096])), try(decode(b[1:4095])), try(decode(b[1:4094])), decode(b[1:4093])) as h from (
            select doc_id, encode(case doc_id % 3 when 0 then 'use x::y; pub fn f() -> u {{ let ' when 1 then repeat('é', 2045) || 'def f(self): import None ' else '' end || text) as b from documents)))
    select doc_id, case when greatest(r, p, c) < 3 then null when r = greatest(r, p, c) then 'rust' when p = greatest(r, p, c) then 'python' else 'cpp' end as language from s""")
def lang_sniff(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    head = F.when(F.col("doc_id") % 3 == 0, "use x::y; pub fn f() -> u { let ").when(F.col("doc_id") % 3 == 1, "é" * 2045 + "def f(self): import None ").otherwise("")  # the last needles are beyond the first 4096 bytes
    return d.select("doc_id", X.language_of_content(F.concat(head, F.col("text"))).alias("language"))


@query("""select page_id, length(replace(html, '}', '')) - length(replace(html, '{', '')) as braces, length(replace(html, ')', '')) - length(replace(html, '(', '')) as parens,
    length(replace(html, ']', '')) - length(replace(html, '[', '')) as brackets from pages""")
def delimiter_balance(spark, sf_dir):
    return edits.balance(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))).drop("text")


@query(f"""with {LINES}, t as (select doc_id as path, {TAG.format('text')} as tag from documents),
    b as (select path, cast((line - 1) // 10 as int) as seq, min(line) as s, max(line) as e, string_agg(text, chr(10) order by line) as text from lines group by 1, 2),
    f as (select path, seq, '"start":' || s || ',"end":' || e || ',"seq":' || seq || ',"text":' || cast(to_json(text) as varchar) || ',"eof":false' as body from b
          union all select path, max(seq) + 1, '"seq":' || (max(seq) + 1) || ',"text":"","eof":true' from b group by path)
    select f.path, f.seq, '{{"path":"' || f.path || '","tag":"' || t.tag || '",' || body || '}}' as json from f join t using (path)""")
def chunk_stream(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return search.chunks(X.lines(d), d.select("path", X.tag(F.col("text")).alias("tag")), 10)


# Resolution: parts are functions, brands types, regions traits; line items are calls.

def call_tables(spark, sf_dir):
    """symbols, calls and impls built from part, supplier, nation and lineitem."""
    p = table(spark, sf_dir, "part")
    brand = F.regexp_replace("p_brand", "#", "")
    name = F.regexp_replace("p_name", " ", "_")
    # Some are in a package, some are methods in the dotted form.
    qualified = F.when(F.col("p_partkey") % 7 == 0, F.concat_ws("::", F.lit("pkg"), brand, name)).when(F.col("p_partkey") % 11 == 0, F.concat_ws(".", brand, name)).otherwise(F.concat_ws("::", brand, name))
    fns = p.select(
        F.concat(F.lit("f"), "p_partkey").alias("id"), name.alias("name"), qualified.alias("qualified"),
        F.lit("fn").alias("kind"), F.col("p_type").alias("file"), F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"), (F.col("p_partkey") % 4 - 1).alias("arity"),
    )
    types = p.select(brand.alias("name")).distinct().select(F.concat(F.lit("t"), "name").alias("id"), "name", F.when(F.col("name").endswith("1"), F.concat(F.lit("m::"), "name")).otherwise(F.col("name")).alias("qualified"), F.lit("type").alias("kind"), F.lit("types").alias("file"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit(-1).cast("long").alias("arity"))
    r = table(spark, sf_dir, "region")
    traits = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.col("r_name").alias("qualified"), F.lit("trait").alias("kind"), F.lit("traits").alias("file"), F.col("r_regionkey").alias("start_line"), F.col("r_regionkey").alias("end_line"), F.lit(-1).cast("long").alias("arity"))
    symbols = fns.unionByName(types).unionByName(traits)
    impls = p.select(brand.alias("type_name")).distinct().withColumn("k", (F.regexp_extract("type_name", r"(\d+)", 1).cast("int") % 5)).join(r, F.col("k") == F.col("r_regionkey")).select("type_name", F.col("r_name").alias("trait_name"))
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber").distinct()
    named = p.select(F.col("p_partkey").alias("l_partkey"), F.regexp_replace("p_name", " ", "_").alias("pname"), brand.alias("pbrand"))
    rows = li.withColumn("kind", F.col("l_suppkey") % 5).join(named, "l_partkey")
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("free", "path", "typed", "dyn", "unknown")]), (F.col("kind") + 1).cast("int"))
    region = F.element_at(F.array(*[F.lit(x) for x in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]), (F.regexp_extract("pbrand", r"(\d+)", 1).cast("int") % 5 + 1))
    calls = rows.select(
        F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("caller"),
        F.when(F.col("kind") == 0, F.concat_ws("::", "pbrand", "pname")).otherwise(F.col("pname")).alias("callee_name"), (F.col("l_linenumber") % 4).alias("arity"), kinds.alias("recv_kind"),
        F.when(F.col("kind").isin(1, 2), F.col("pbrand")).when(F.col("kind") == 3, region).otherwise("").alias("recv_arg"),
    ).distinct()
    return symbols, calls, impls


GRAPH = """fns as (select 'f' || p_partkey as id, replace(p_name, ' ', '_') as name, replace(p_brand, '#', '') as brand, p_type as file, p_size as start_line, p_partkey % 4 - 1 as arity, p_partkey,
        case when p_partkey % 7 = 0 then 'pkg::' || replace(p_brand, '#', '') || '::' || replace(p_name, ' ', '_') when p_partkey % 11 = 0 then replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_')
             else replace(p_brand, '#', '') || '::' || replace(p_name, ' ', '_') end as qualified from part),
    types as (select distinct 't' || brand as id, brand as name, case when ends_with(brand, '1') then 'm::' || brand else brand end as qualified, 'types' as file from fns),
    traits as (select 'r' || r_regionkey as id, r_name as name, 'traits' as file from region),
    known as (select qualified from fns union select qualified from types union select name from traits),
    trait_of as (select distinct brand as type_name, ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][cast(regexp_extract(brand, '([0-9]+)', 1) as int) % 5 + 1] as trait_name from fns),
    impls as (select t.* from trait_of t where trait_name in (select r_name from region)),
    calls as (select distinct 'f' || l_suppkey as caller, case when l_suppkey % 5 = 0 then brand || '::' || name else name end as callee_name, l_linenumber % 4 as arity,
            ['free', 'path', 'typed', 'dyn', 'unknown'][l_suppkey % 5 + 1] as recv_kind,
            case when l_suppkey % 5 in (1, 2) then brand when l_suppkey % 5 = 3 then trait_name else '' end as recv_arg
        from lineitem join fns on l_partkey = p_partkey join trait_of on brand = type_name),
    owners as (select distinct recv_arg, recv_arg as owner from calls where recv_kind = 'dyn' union select trait_name, type_name from impls),
    hits as (
        select c.*, id, 'direct' as confidence, '' as detail from calls c join fns on callee_name = qualified where recv_kind = 'free'
        union all select c.*, id, 'direct', '' from calls c join fns on recv_arg || '::' || callee_name = qualified where recv_kind = 'path'
        union all select c.*, id, 'direct', '' from calls c join fns on recv_arg || '::' || callee_name = regexp_extract(qualified, '[^:]+::[^:]+$') where recv_kind = 'path' and recv_arg || '::' || callee_name not in (select qualified from known)
        union all select c.*, id, 'typed', recv_arg from calls c join fns on recv_arg || '::' || callee_name = qualified where recv_kind = 'typed'
        union all select c.*, id, 'typed', recv_arg from calls c join fns on recv_arg || '.' || callee_name = qualified where recv_kind = 'typed'
        union all select c.*, id, 'dyn', recv_arg from calls c join owners using (recv_arg) join fns on owner || '::' || callee_name = qualified where recv_kind = 'dyn'),
    u as (select distinct caller, callee_name, arity as given from calls c where recv_kind <> 'path' and not contains(callee_name, '::') and not exists
        (select 1 from hits h where h.caller = c.caller and h.callee_name = c.callee_name and h.arity = c.arity and h.recv_kind = c.recv_kind and h.recv_arg = c.recv_arg)),
    cand as (select callee_name, given, id, row_number() over (partition by callee_name, given order by file, start_line, id) as rn
        from (select distinct callee_name, given from u) a join fns on name = callee_name and (fns.arity < 0 or fns.arity = given)),
    named as (select u.caller, cand.id from u join cand using (callee_name, given) where rn <= 8 and cand.id <> u.caller)"""


def tier_sql(kind: str) -> str:
    return f"with {GRAPH} select caller as src, id as dst, 'call' as kind, confidence, detail from hits where recv_kind = '{kind}'"


@query(tier_sql("free"))
def resolve_free(spark, sf_dir):
    symbols, calls, _ = call_tables(spark, sf_dir)
    return resolve.resolve_free(calls, symbols)


@query(tier_sql("path"))
def resolve_path(spark, sf_dir):
    symbols, calls, _ = call_tables(spark, sf_dir)
    return resolve.resolve_path(calls, symbols)


@query(tier_sql("typed"))
def resolve_typed(spark, sf_dir):
    symbols, calls, _ = call_tables(spark, sf_dir)
    return resolve.resolve_typed(calls, symbols)


@query(tier_sql("dyn"))
def resolve_dyn(spark, sf_dir):
    symbols, calls, impls = call_tables(spark, sf_dir)
    return resolve.resolve_dyn(calls, symbols, impls)


@query(f"with {GRAPH} select caller as src, id as dst, 'call' as kind, 'name' as confidence, '' as detail from named")
def resolve_name(spark, sf_dir):
    symbols, calls, impls = call_tables(spark, sf_dir)
    calls = shared.written(calls, "calls")  # it is read by every tier
    return resolve.resolve_name(calls, symbols, resolve.resolved(calls, symbols, impls))


def graph_facts(spark, sf_dir):
    """What the edges of call_tables are made of: symbols, calls, impls, methods and refs. See graph_edges()."""
    symbols, calls, impls = call_tables(spark, sf_dir)
    calls = shared.written(calls, "calls")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_partkey").alias("id"), "p_partkey", F.regexp_replace("p_brand", "#", "").alias("type_name"))
    some = p.join(impls, "type_name", "left")
    refs = some.select(F.col("id").alias("referrer"), "type_name").unionByName(some.filter("trait_name is not null").select(F.col("id").alias("referrer"), F.col("trait_name").alias("type_name")))
    return symbols, calls, impls, p.select(F.col("id").alias("method_id"), F.col("type_name").alias("type_qualified")), refs


def graph_edges(spark, sf_dir):
    """All edges of call_tables, with a reference of every function to its type and trait, and every function a method of its type."""
    symbols, calls, impls, methods, refs = graph_facts(spark, sf_dir)
    return symbols, resolve.resolve_edges(calls, symbols, impls, methods, refs)


ALL_EDGES = f"""{GRAPH}, refs as (select id as referrer, brand as type_name from fns union select id, trait_name from fns join impls on brand = type_name),
    syms as (select id, file from fns union all select id, file from types union all select id, file from traits),
    every as (select caller as src, id as dst, 'call' as kind, confidence, detail from hits union select caller, id, 'call', 'name', '' from named
        union select referrer, id, 'reference', 'direct', '' from refs join (select id, name from types union all select id, name from traits) on name = type_name
        union select fns.id, types.id, 'method_of', 'direct', '' from fns join types on brand = types.qualified
        union select types.id, traits.id, 'impl_of', 'direct', trait_name from impls join types on type_name = types.name join traits on trait_name = traits.name),
    edges as (select every.*, file from every join syms on src = syms.id)"""


@query(f"with {ALL_EDGES} select * from edges")
def resolve_edges(spark, sf_dir):
    return graph_edges(spark, sf_dir)[1]


@query("""select 'm' || s_suppkey as src, 'n' || n_nationkey as dst, 'method_of' as kind, 'direct' as confidence, '' as detail from supplier join nation on s_nationkey = n_nationkey""")
def method_of(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("qualified"), F.lit("type").alias("kind"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("type_qualified"))
    m = table(spark, sf_dir, "supplier").join(names, "s_nationkey").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("method_id"), "type_qualified")
    return resolve.method_of(m, n)


@query("""select 'n' || n_nationkey as src, 'r' || r_regionkey as dst, 'impl_of' as kind, 'direct' as confidence, r_name as detail from nation join region on n_regionkey = r_regionkey""")
def impl_of(spark, sf_dir):
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    traits = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.col("r_name").alias("qualified"), F.lit("trait").alias("kind"), F.lit("b").alias("file"), F.col("r_regionkey").alias("start_line"))
    # An earlier trait of the same name, which the later one hides.
    hidden = traits.withColumn("id", F.concat(F.lit("old"), "id")).withColumn("file", F.lit("a"))
    types = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("n_name").alias("qualified"), F.lit("type").alias("kind"), F.lit("c").alias("file"), F.col("n_nationkey").alias("start_line"))
    impls = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("type_name"), F.col("r_name").alias("trait_name"))
    return resolve.impl_of(impls, traits.unionByName(hidden).unionByName(types))


@query("""select 'c' || c_custkey as src, 'n' || n_nationkey as dst, 'reference' as kind, 'direct' as confidence, '' as detail from customer join nation on c_nationkey = n_nationkey""")
def type_refs(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    types = n.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("m::"), "n_name").alias("qualified"),
        F.when(F.col("n_nationkey") % 2 == 0, "type").otherwise("trait").alias("kind"), F.lit("b").alias("file"), F.lit(1).alias("start_line"),
    )
    hidden = types.filter("kind = 'trait'").withColumn("id", F.concat(F.lit("old"), "id")).withColumn("file", F.lit("a"))  # an earlier trait of the name
    types = types.unionByName(hidden)
    refs = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("referrer"), F.col("n_name").alias("type_name"))
    return resolve.type_references(refs, types)


# Graph: users in the order of events call one another.

EDGES = """edges as (select distinct 'u' || user_id as src, 'u' || nxt as dst, case when nxt % 7 = 0 then 'method_of' else 'call' end as kind,
        case et when 'view' then 'direct' when 'click' then 'typed' when 'purchase' then 'dyn' else 'name' end as confidence, case when et = 'purchase' then 't' || nxt % 3 else '' end as detail
    from (select user_id, event_type as et, lead(user_id) over (order by event_id) as nxt from events) where nxt is not null)"""


def user_edges(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("nxt"))  # ids are dense
    tier = F.when(F.col("event_type") == "view", "direct").when(F.col("event_type") == "click", "typed").when(F.col("event_type") == "purchase", "dyn").otherwise("name")
    u = lambda c: F.concat(F.lit("u"), F.col(c).cast("string"))
    return e.join(after, "event_id").select(u("user_id").alias("src"), u("nxt").alias("dst"), F.when(F.col("nxt") % 7 == 0, "method_of").otherwise("call").alias("kind"), tier.alias("confidence"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("t"), (F.col("nxt") % 3).cast("string"))).otherwise("").alias("detail")).distinct()


@query(f"""with {EDGES} select distinct dst, case when confidence in ('direct', 'typed') then 'confirmed' when confidence = 'dyn' then 'dynamic' else 'named' end as tier, src, detail from edges where kind = 'call'""")
def callers_tiers(spark, sf_dir):
    return graph.caller_rows(user_edges(spark, sf_dir))


@query(f"""with recursive {EDGES}, b as (select dst as node, src as id, confidence = 'dyn' as dyn from edges where kind in ('call', 'method_of') and confidence in ('direct', 'typed', 'dyn')),
    x as (select 'u3' as start, id, dyn, 1 as hops from b where node = 'u3' union select x.start, b.id, b.dyn, x.hops + 1 from x join b on b.node = x.id where not x.dyn and x.hops < 3)
    select start, id, cast(min(hops) as int) as hops, bool_and(dyn) as dyn from x group by 1, 2""")
def blast_radius(spark, sf_dir):
    return graph.blast_radius(user_edges(spark, sf_dir), spark.createDataFrame([("u3",)], "start string"))


PATH = f"""{EDGES}, hops as (select src, dst, min(confidence) as confidence from edges where kind = 'call' group by 1, 2),
    x as (select 'u1' as id, 0 as hops union select h.dst, x.hops + 1 from x join hops h on h.src = x.id where x.hops < 30),
    level as (select id, min(hops) as hops from x group by 1),
    parent as (select h.dst as id, arg_min(h.src, (h.src, h.confidence)) as parent, arg_min(h.confidence, (h.src, h.confidence)) as confidence from hops h join level a on a.id = h.src join level b on b.id = h.dst and b.hops = a.hops + 1 group by 1)"""


@query(f"""with recursive {PATH}, walk as (select l.id as target, l.id, l.hops, p.parent, p.confidence from level l left join parent p using (id) where l.id in ('u6', 'u50')
        union all select w.target, l.id, l.hops, p.parent, p.confidence from walk w join level l on l.id = w.parent left join parent p on p.id = l.id)
    select target, cast(hops as int) as hop, id, case when hops = 0 then '' else confidence end as confidence from walk""")
def call_path(spark, sf_dir):
    pairs = spark.createDataFrame([("u1", "u6"), ("u1", "u50")], "a string, b string")
    return graph.call_paths(user_edges(spark, sf_dir), pairs).select(F.col("b").alias("target"), "hop", "id", "confidence")


SPANS = """spans as (select user_id as file, event_id as id, cast(floor(value) as int) as s, cast(floor(value) as int) + cast(event_id % 40 as int) as e from events where event_type = 'view'),
    points as (select distinct user_id as file, cast(floor(value) as int) as line from events where event_type = 'error')"""


@query(f"""with {SPANS}, i as (select p.file, p.line, arg_min(id, (e - s, s, id)) as inner_id from points p join spans x on p.file = x.file and p.line between s and e group by 1, 2),
    l as (select p.file, p.line, arg_max(id, (s, id)) as last_id from points p join spans x on p.file = x.file and s <= p.line group by 1, 2)
    select p.file, p.line, coalesce(inner_id, last_id) as enclosing_id, inner_id is not null as exact from points p left join i using (file, line) left join l using (file, line)""")
def enclosing(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.floor("value").cast("int")
    spans = e.filter("event_type = 'view'").select(F.col("user_id").alias("file"), F.col("event_id").alias("id"), at.alias("start"), (at + (F.col("event_id") % 40).cast("int")).alias("end"))
    points = e.filter("event_type = 'error'").select(F.col("user_id").alias("file"), at.alias("line")).distinct()
    return graph.enclosing(points, spans)


# Differences, histories, intervals


@query("""with o as (select event_id as key, event_type as h from events where event_id % 3 <> 0), n as (select event_id as key, case when event_id % 10 = 0 then 'x' else event_type end as h from events where event_id % 5 <> 0)
    select key, case when o.key is null then 'added' when n.key is null then 'removed' else 'modified' end as change from o full join n using (key) where o.h is distinct from n.h""")
def struct_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = e.filter("event_id % 3 <> 0").select(F.col("event_id").alias("key"), F.col("event_type").alias("h"))
    new = e.filter("event_id % 5 <> 0").select(F.col("event_id").alias("key"), F.when(F.col("event_id") % 10 == 0, "x").otherwise(F.col("event_type")).alias("h"))
    return intervals.struct_diff(old, new, "key", "h")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 40)")
def stale_files(spark, sf_dir):
    return history.stale(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("select c_custkey, o.n is null as miss from customer left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by 1) o on c_custkey = o_custkey")
def cache_miss(spark, sf_dir):
    cache = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    hits, misses = vectors.split_cache(table(spark, sf_dir, "customer").select("c_custkey"), cache, "c_custkey")
    return hits.select("c_custkey", F.lit(False).alias("miss")).unionByName(misses.select("c_custkey", F.lit(True).alias("miss")))


@query(f"""with i as (select {TAG.format('text')} as tag, doc_id, source from documents)
    select tag, min(doc_id) as ord, (select string_agg(source, ',' order by d) from (select j.source, min(j.doc_id) as d from i j where j.tag = i.tag group by 1)) as workspaces from i group by tag""")
def fanout_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("doc_id").alias("ord"), F.col("source").alias("workspace"), X.tag(F.col("text")).alias("tag"), F.col("doc_id").alias("item"))
    return history.fan_out(rows).select("tag", "ord", F.array_join("workspaces", ",").alias("workspaces"))


@query(f"""with i as (select {TAG.format('text')} as digest, doc_id, source from documents)
    select doc_id, source as root, first_value(source) over (partition by digest order by doc_id) as first_root from i""")
def fanout_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("root"), X.tag(F.col("text")).alias("digest"))
    return history.first_equal(d).select(F.col("ord").alias("doc_id"), "root", "first_root")


@query("""with s as (select distinct l_suppkey, cast(l_partkey as int) as s, cast(l_partkey + floor(l_quantity) as int) as e from lineitem),
    g as (select *, max(e) over (partition by l_suppkey order by s, e rows between unbounded preceding and 1 preceding) as m from s),
    k as (select *, sum(case when m is null or s > m + 1 then 1 else 0 end) over (partition by l_suppkey order by s, e rows unbounded preceding) as k from g)
    select l_suppkey, min(s) as "start", max(e) as "end" from k group by l_suppkey, k""")
def interval_coalesce(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return intervals.coalesce(li.select("l_suppkey", F.col("l_partkey").cast("int").alias("start"), (F.col("l_partkey") + F.floor("l_quantity")).cast("int").alias("end")), ["l_suppkey"])


@query("""with p as (select distinct l_suppkey, cast(l_partkey as int) as line from lineitem), k as (select *, line - row_number() over (partition by l_suppkey order by line) as k from p)
    select l_suppkey, min(line) as "start", max(line) as "end" from k group by l_suppkey, k""")
def line_runs(spark, sf_dir):
    return intervals.runs(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").cast("int").alias("line")), ["l_suppkey"])


@query("""select user_id, event_id, event_type, cast(row_number() over (partition by user_id order by event_id) - 1 as int) as revision from (
    select *, lag(event_type) over (partition by user_id order by event_id) as was from events) where was is null or was <> event_type""")
def journal_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return history.journal(e, ["user_id"], [F.col("event_id")], "event_type")


@query("""with l as (select user_id, arg_max(event_type, event_id) as live from events group by 1)
    select e.user_id as path, max(e.event_id) as revision, arg_max(e.event_type, e.event_id) as tag from events e join l using (user_id) where e.event_type <> l.live group by 1""")
def undo_target(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("revision"), F.col("event_type").alias("tag"))
    live = e.groupBy("path").agg(F.max_by("tag", "revision").alias("tag"))
    return history.undo_target(e, live)


HISTORY = """h as (select 'u' || user_id as path, sha256(event_type || event_id) as tag, event_id as revision, case when event_type = 'signup' then null else cast(floor(epoch(ts)) as bigint) end as saved_at from events)"""


@query(f"with {HISTORY} select path, tag, revision, saved_at from h where saved_at >= 1704100000 order by saved_at desc nulls last, path, revision desc limit 50 offset 100")
def history_page(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = F.when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.unix_seconds(F.col("ts").cast("timestamp_ltz")))
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.sha2(F.concat("event_type", F.col("event_id").cast("string")), 256).alias("tag"), F.col("event_id").alias("revision"), at.alias("saved_at"))
    return history.history(rows, since=1704100000, most=50, offset=100)[0]


@query("""select path, tags, modified from (select 'u' || user_id as path, array_to_string(list(event_type order by event_id desc)[1:3], ',') as tags, max(event_id) as modified from events group by 1) order by modified desc, path limit 20""")
def changelog(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("revision"), F.col("event_type").alias("tag"), F.col("event_id").alias("modified"))
    return history.changelog(e).select("path", F.array_join("tags", ",").alias("tags"), "modified")


@query("""with j as (select source as workspace, doc_id, sha256(text) as tag from documents) select doc_id, tag from j where workspace = 'src0' and tag not in (select tag from j where workspace <> 'src0')""")
def archive_objects(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("workspace"), F.sha2("text", 256).alias("tag"))
    return history.archive(d.select("workspace", "tag"), d.filter("workspace = 'src0'").select("doc_id", "tag"), "src0")[1].select("doc_id", "tag")


@query("""select tag, doc_id from (select sha256(text)[1:6] as tag, doc_id from documents) where starts_with(tag, (select min(sha256(text))[1:4] from documents))""")
def object_prefix(spark, sf_dir):
    objects = table(spark, sf_dir, "documents").select(F.substr(F.sha2("text", 256), F.lit(1), F.lit(6)).alias("tag"), "doc_id", F.sha2("text", 256).alias("full"))
    cited = objects.agg(F.min("full")).first()[0][:4].upper()
    return history.resolve(objects, cited)[1].select("tag", "doc_id")


@query("""select l_orderkey, l_linenumber, cast(sum(d) over (partition by l_orderkey order by l_linenumber rows unbounded preceding) as bigint) as shift from (
    select l_orderkey, l_linenumber, cast(floor(l_quantity) as bigint) - 25 as d from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity from lineitem group by 1, 2)) qualify d <> 0""")
def line_shift(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.floor(F.max("l_quantity")) - 25).alias("delta"))
    return intervals.line_shift(e, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "shift")


@query("""with s as (select distinct l_suppkey, l_partkey as s, l_partkey + l_linenumber as e from lineitem),
    g as (select *, max(e) over (partition by l_suppkey order by s, e rows between unbounded preceding and 1 preceding) as m from s)
    select l_suppkey, s, e, cast(sum(case when m is null or s - m > 6 then 1 else 0 end) over (partition by l_suppkey order by s, e rows unbounded preceding) as bigint) as hunk from g""")
def hunk_groups(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("s"), (F.col("l_partkey") + F.col("l_linenumber")).alias("e")).distinct()
    return intervals.hunk_groups(li, ["l_suppkey"], "s", "e")


HUNKS = """n as (select path, cast(max(line) as int) as n from lines group by 1), hk as (
    select path, 0 as seq, 'replace' as action, 1 as s, least(2, n) as e, ['new ' || path, 'two'] as body from n where path % 4 = 0
    union all select path, 1, 'insert_after', n, n, ['after'] from n where path % 4 = 0 union all select path, 2, 'eof', 0, 0, ['end'] from n where path % 2 = 0
    union all select path, 0, 'cut', n, n, [] from n where path % 4 = 1 union all select path, 1, 'bof', 0, 0, ['top', 'top2'] from n where path % 4 = 1)"""


@query(f"""with {LINES}, {HUNKS}, k as (
        select l.path, l.line as k1, 2 as k2, 0 as k3, 0 as k4, text from lines l where not exists (select 1 from hk where hk.path = l.path and action in ('replace', 'cut') and l.line between s and e)
        union all select path, case action when 'bof' then 0 when 'eof' then 2147483647 else s end, case action when 'bof' then 0 when 'insert_before' then 1 when 'replace' then 2 when 'insert_after' then 3 else 4 end, seq + 1, i - 1, body[i]
        from hk, unnest(range(1, len(body) + 1)) as u(i))
    select path, cast(row_number() over (partition by path order by k1, k2, k3, k4) as int) as line, text from k""")
def apply_hunks(spark, sf_dir):
    lines = doc_lines(spark, sf_dir)
    n = lines.groupBy("path").agg(F.max("line").alias("n"))

    def hunk(mod: int, rest: int, seq: int, action: str, start, end, body: list) -> DataFrame:
        made = F.array(*body) if body else F.array().cast("array<string>")
        return n.filter(F.col("path") % mod == rest).select("path", F.lit(seq).alias("seq"), F.lit(action).alias("action"), start.alias("start"), end.alias("end"), made.alias("body"))

    last, none = F.col("n"), F.lit(0)
    rows = hunk(4, 0, 0, "replace", F.lit(1), F.least(F.lit(2), last), [F.concat(F.lit("new "), F.col("path").cast("string")), F.lit("two")])
    rows = rows.unionByName(hunk(4, 0, 1, "insert_after", last, last, [F.lit("after")])).unionByName(hunk(2, 0, 2, "eof", none, none, [F.lit("end")]))
    rows = rows.unionByName(hunk(4, 1, 0, "cut", last, last, [])).unionByName(hunk(4, 1, 1, "bof", none, none, [F.lit("top"), F.lit("top2")]))
    return edits.apply_hunks(lines, rows)


@query("""with t as (select l_orderkey as path, cast(l_partkey % 60 as int) as line from lineitem), s as (select o_orderkey as path, cast(o_custkey % 50 as int) as s, cast(o_custkey % 50 + 20 as int) as e from orders)
    select distinct path, line from t where not exists (select 1 from s where s.path = t.path and t.line between s.s and s.e)""")
def unseen_lines(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_partkey") % 60).cast("int").alias("line")).distinct()
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 50).cast("int").alias("start"), (F.col("o_custkey") % 50 + 20).cast("int").alias("end"))
    return intervals.unseen(t, s, ["path"])


@query("""with e as (select l_orderkey as path, cast(l_partkey % 30 as int) as s, cast(l_partkey % 30 + l_linenumber as int) as e from lineitem)
    select path, cast(line as int) as line, count(*) as n from e, unnest(range(s, e + 1)) as u(line) group by 1, 2 having count(*) > 1""")
def edit_overlaps(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_partkey") % 30).cast("int").alias("start"), (F.col("l_partkey") % 30 + F.col("l_linenumber")).cast("int").alias("end"))
    return intervals.overlaps(e, ["path"])


# Vectors. The SQL uses doubles as Spark does.

def unit_sql(source: str) -> str:
    return f"""u as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double) / n) as unit from (select vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as n from {source})),
    sc as (select 127.0::double / max(list_max(list_transform(unit, lambda x: abs(x)))) as scale from u),
    ix as (select vec_id, label, unit, scale, list_transform(unit, lambda x: cast(greatest(-127, least(127, round(x * scale))) as bigint)) as code from u, sc),
    nb as (select c.vec_id, c.label, c.scale, cast(list_sum(list_transform(list_zip(c.code, q.code), lambda p: p[1] * p[2])) as bigint) as idot,
        cast(list_sum(list_transform(list_zip(c.unit, q.unit), lambda p: case when (p[1] >= 0) = (p[2] >= 0) then 0 else 1 end)) as int) as hamming from ix c, ix q where q.vec_id = 0 and c.vec_id <> 0)"""


UNIT = unit_sql("embeddings")


def vector_index(spark, sf_dir):
    rows = vectors.index(vectors.usable(table(spark, sf_dir, "embeddings")))
    return rows, rows.filter("vec_id = 0")


@query(f"with {UNIT} select vec_id, idot from nb order by idot desc, vec_id limit 10")
def vec_neighbors(spark, sf_dir):
    return vectors.neighbours(*vector_index(spark, sf_dir), 10).select("vec_id", "idot")


@query(f"with {UNIT} select vec_id, hamming from nb order by hamming, vec_id limit 128")
def vec_shortlist(spark, sf_dir):
    return vectors.shortlist(*vector_index(spark, sf_dir), 4).select("vec_id", "hamming")


@query(f"with {UNIT}, p as (select * from nb order by hamming, vec_id limit 320) select vec_id, idot from p where idot / (scale * scale) >= 0.2 order by idot desc, vec_id limit 10")
def vec_query(spark, sf_dir):
    return vectors.query(*vector_index(spark, sf_dir), 10).select("vec_id", "idot")


@query("select label, count(*) as c from embeddings group by 1 having count(*) >= greatest((select count(*) // 40 from embeddings), 5)")
def common_names(spark, sf_dir):
    return vectors.common_names(table(spark, sf_dir, "embeddings"), "label")


#: Vectors and, of each, further ones at growing distances, and rows that no index may hold.
COPIES = """vecs as (select vec_id, label, embedding from embeddings
    union all select vec_id + 1000000 * k, label, list_transform(embedding, lambda x, i: cast(cast(x as double) * (1 + k / 8.0::double * ((i - 1) % 5 - 2)) as float)) from embeddings, range(1, 7) r(k))"""


def vector_copies(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    k = e.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6))))
    moved = F.transform("embedding", lambda x, i: (x.cast("double") * (1 + F.col("k") / F.lit(8.0) * (i % 5 - 2))).cast("float"))
    copies = k.select((F.col("vec_id") + 1000000 * F.col("k")).alias("vec_id"), "label", moved.alias("embedding"))
    bad = e.limit(1).select((F.col("vec_id") - 1).alias("vec_id"), "label", F.array(F.lit(1.0).cast("float"), F.lit("NaN").cast("float")).alias("embedding"))
    return vectors.usable(e.unionByName(copies).unionByName(bad))


@query(f"""with {COPIES}, {unit_sql("vecs")}, k as (select *, vec_id % 3 as lang, vec_id // 2 as name from nb order by idot desc, vec_id limit 16)
    select vec_id, idot from k where idot / (scale * scale) >= 0.65 and lang <> 0 and name not in (select vec_id // 2 from vecs group by 1 having count(*) >= greatest((select count(*) // 40 from vecs), 5)) order by idot desc, vec_id limit 5""")
def kin(spark, sf_dir):
    rows = vectors.index(vector_copies(spark, sf_dir)).withColumn("lang", F.col("vec_id") % 3).withColumn("name", F.floor(F.col("vec_id") / 2))
    return vectors.kin(rows, rows.filter("vec_id = 0"), "lang", "name").select("vec_id", "idot")


@query(f"""with {COPIES}, {unit_sql("vecs")} select a.vec_id as a, b.vec_id as b, cast(list_sum(list_transform(list_zip(a.code, b.code), lambda p: p[1] * p[2])) as bigint) / (a.scale * a.scale) as score
    from (select vec_id as va, vec_id + 1000000 as vb from embeddings) p join ix a on a.vec_id = va join ix b on b.vec_id = vb
    union all select vec_id, vec_id + 9000000, null from embeddings""")
def relatedness(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"))
    pairs = e.withColumn("b", F.col("a") + 1000000).unionByName(e.withColumn("b", F.col("a") + 9000000))  # there is nothing at the latter
    return vectors.relatedness(pairs, vectors.index(vector_copies(spark, sf_dir)))


@query(r"""with w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{L}\p{N}_]+') as w from documents),
    g as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as unit from w),
    h as (select doc_id, cast('0x' || md5(unit)[1:8] as bigint) as h from g),
    c as (select doc_id, h % 64 as i, sum(case when h >= 2147483648 then 1 else -1 end)::double as v from h group by 1, 2)
    select doc_id, cast(round(1000000 * v / sqrt(sum(v * v) over (partition by doc_id))) as bigint) as micros, cast(i as int) as i from c where v <> 0""")
def embed_documents(spark, sf_dir):
    rows = vectors.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cells = rows.select("doc_id", F.posexplode("embedding").alias("i", "v")).filter("v <> 0")
    return cells.select("doc_id", F.round(F.col("v") * 1000000).cast("long").alias("micros"), "i")


# Sessions


@query("""with g as (select user_id, ts, case when ts > lag(ts) over (partition by user_id order by ts) + interval 1 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as n from events),
    k as (select *, sum(n) over (partition by user_id order by ts range unbounded preceding) as k from g) select user_id, min(ts) as "start", max(ts) as "end", count(*) as n from k group by user_id, k""")
def debounce(spark, sf_dir):
    return sessions.debounce(table(spark, sf_dir, "events").select("user_id", "ts"), ["user_id"], "ts", "1 hour")


@query("""with r as (select user_id, row_number() over w as rn, sum(case when event_type in ('view', 'click') then 1 else 0 end) over (partition by user_id order by event_id rows 2 preceding) as k from events window w as (partition by user_id order by event_id))
    select user_id, cast(min(rn) as int) as hint_at from r where k = 3 group by 1""")
def hint_first(spark, sf_dir):
    return sessions.hint_first(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], [F.col("event_id")], F.col("event_type").isin("view", "click"))


@query("""with g as (select user_id, event_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over w < 36000 * 1000000::bigint then 0 else 1 end as n from events window w as (partition by user_id order by ts, event_id)),
    k as (select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
    select user_id, event_id, cast(row_number() over (partition by user_id, k order by ts, event_id) as int) as place from k qualify place >= 6""")
def crash_loop(spark, sf_dir):
    return sessions.chains(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", 36000).select("user_id", "event_id", "place")


@query("""with k as (select user_id, event_type, sum(case when event_type in ('purchase', 'click') then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as run from events)
    select user_id, cast(run as bigint) as run, count(*) as n from k where event_type not in ('purchase', 'click') group by user_id, run having count(*) >= 5""")
def miss_runs(spark, sf_dir):
    return sessions.miss_runs(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], [F.col("event_id")], ~F.col("event_type").isin("purchase", "click"))


@query("""with recursive s as (select user_id, event_id, case event_type when 'click' then 1 when 'purchase' then -1 else 0 end as d, row_number() over (partition by user_id order by event_id) as rn from events),
    f as (select user_id, event_id, rn, greatest(0, d) as open, false as refused from s where rn = 1
          union all select s.user_id, s.event_id, s.rn, greatest(0, least(8, f.open + s.d)), s.d = 1 and f.open >= 8 from f join s on s.user_id = f.user_id and s.rn = f.rn + 1)
    select user_id, event_id, cast(open as bigint) as open, refused from f""")
def in_flight(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return sessions.in_flight(e, ["user_id"], [F.col("event_id")], F.col("event_type") == "click", F.col("event_type") == "purchase").select("user_id", "event_id", "open", "refused")


@query("select user_id, max(ts) as touched from events group by 1 having max(ts) < timestamp '2024-02-02 00:00:00' - interval 3 day")
def ttl_expired(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("touched"))
    return sessions.expired(rows, "touched", F.lit("2024-02-02 00:00:00").cast("timestamp_ntz"), "3 days")


OPS = "case event_type when 'view' then 'context.read' when 'click' then 'mutate.edit' when 'purchase' then 'verify.build' when 'error' then 'context.prompt' else 'session.request' end"


@query(f"""select effect, count(*) as n from (select case when starts_with(op, 'context.') then 'context' when starts_with(op, 'mutate.') then 'mutate' when starts_with(op, 'verify.') then 'verify' else 'other' end as effect from (select {OPS} as op from events)) group by 1""")
def effect_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(sessions.effect(F.expr(OPS)).alias("effect")).groupBy("effect").agg(F.count(F.lit(1)).alias("n"))


@query(f"""select user_id, event_id, max(case when op = 'context.prompt' then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) = 1 as admitted from (select *, {OPS} as op from events)""")
def schema_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(OPS).alias("op"))
    return sessions.gate(e, ["user_id"], [F.col("event_id")]).select("user_id", "event_id", "admitted")


POLICIES = {
    "a": policy.Policy.of(["context.", "state.status"], ["context.log"]),
    "b": policy.Policy.of(["context.read"], ["context.log", "mutate"]),
    "c": policy.Policy.of([], ["mutate"]),
    "d": policy.Policy.of(["mutate.edit", "verify."], []),
}
PARTS = [("a", "allow", "below", "context"), ("a", "allow", "at", "state.status"), ("a", "deny", "at", "context.log"), ("a", "deny", "below", "context.log"), ("b", "allow", "at", "context.read")]
PARTS += [("b", "deny", k, x) for k in ("at", "below") for x in ("context.log", "mutate")] + [("c", "allow", "below", "")] + [("c", "deny", k, "mutate") for k in ("at", "below")]
PARTS += [("d", "allow", "at", "mutate.edit"), ("d", "allow", "below", "verify")]
POLICY_SQL = f"p as (select * from (values {', '.join(map(str, PARTS))}) t(policy, side, kind, place))"


def held_sql(place: str, kind: str, taken: str) -> str:
    """Whether a part of the tree lies in a row of parts: it is that, or the row takes all below a place above it."""
    pieces = f"string_split({place}, '.')"
    above = f"list_contains(list_prepend('', list_transform(range(1, len({pieces}) - case when {pieces}[-1] = '' then 1 else 0 end), lambda i: array_to_string({pieces}[:i], '.'))), {taken}.place)"
    return f"(({taken}.kind = {kind} and {taken}.place = {place}) or ({taken}.kind = 'below' and not ({kind} = 'below' and {place} = '') and {above}))"


@query(f"""with {POLICY_SQL}, o as (select distinct {OPS} as op from events) select policy, op, not bool_or(side = 'deny' and {held_sql('op', "'at'", 'p')}) and bool_or(side = 'allow' and {held_sql('op', "'at'", 'p')}) as permitted from o, p group by 1, 2""")
def policy_eval(spark, sf_dir):
    return policy.verdicts(table(spark, sf_dir, "events").select(F.expr(OPS).alias("op")), policy.rows(spark, POLICIES))


def narrows_sql(current: str, following: str) -> str:
    """Whether a policy narrows another, over the parts p(policy, side, kind, place)."""
    inside = lambda side, inner, outer: f"not exists (select 1 from p x where x.policy = {inner} and x.side = '{side}' and not exists (select 1 from p y where y.policy = {outer} and y.side = '{side}' and {held_sql('x.place', 'x.kind', 'y')}))"
    return f"{inside('allow', following, current)} and {inside('deny', current, following)}"


# A policy for each nation: what it may do, and what it must not.
NATION_PARTS = """raw as (select distinct n_name as policy, unnest(case n_nationkey % 4 when 0 then [{s: 'allow', k: 'below', p: ''}] when 1 then [{s: 'allow', k: 'below', p: 'context'}] when 2 then [{s: 'allow', k: 'at', p: 'context.read'}, {s: 'allow', k: 'at', p: 'mutate.edit'}]
        else [{s: 'allow', k: 'below', p: 'context'}, {s: 'allow', k: 'below', p: 'mutate'}, {s: 'allow', k: 'at', p: 'state'}] end
        || case n_regionkey when 0 then [{s: 'deny', k: 'at', p: 'context.log'}] when 1 then [{s: 'deny', k: 'at', p: 'mutate'}, {s: 'deny', k: 'below', p: 'mutate'}] when 2 then [{s: 'deny', k: 'below', p: 'context'}] else [] end) as x from nation),
    p as (select policy, x.s as side, x.k as kind, x.p as place from raw)"""


@query(f"""with {NATION_PARTS}, n as (select distinct policy from p)
    select a.policy as current, b.policy as next, {narrows_sql('a.policy', 'b.policy')} as narrows from n a, n b""")
def policy_narrow(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    part = lambda side, kind, place: F.struct(F.lit(side).alias("side"), F.lit(kind).alias("kind"), F.lit(place).alias("place"))
    allow = (
        F.when(F.col("n_nationkey") % 4 == 0, F.array(part("allow", "below", ""))).when(F.col("n_nationkey") % 4 == 1, F.array(part("allow", "below", "context")))
        .when(F.col("n_nationkey") % 4 == 2, F.array(part("allow", "at", "context.read"), part("allow", "at", "mutate.edit")))
        .otherwise(F.array(part("allow", "below", "context"), part("allow", "below", "mutate"), part("allow", "at", "state")))
    )
    deny = (
        F.when(F.col("n_regionkey") == 0, F.array(part("deny", "at", "context.log"))).when(F.col("n_regionkey") == 1, F.array(part("deny", "at", "mutate"), part("deny", "below", "mutate")))
        .when(F.col("n_regionkey") == 2, F.array(part("deny", "below", "context"))).otherwise(F.array().cast("array<struct<side:string,kind:string,place:string>>"))
    )
    return policy.narrowing(n.select(F.col("n_name").alias("policy"), F.explode(F.concat(allow, deny)).alias("x")).select("policy", "x.*"))


# Paths and distances


@query("select p_partkey, p_size % 4 <= 1 as inside, p_size % 4 = 0 as plain from part")
def path_safety(spark, sf_dir):
    path = F.concat(F.lit("a/"), F.repeat(F.lit("../"), (F.col("p_size") % 4).cast("int")), F.lit("b"))
    return table(spark, sf_dir, "part").select("p_partkey", X.stays_inside(path).alias("inside"), X.plain_path(path).alias("plain"))


@query("""with p as (select distinct user_id, cast(floor(value) as int) as line from events where event_type = 'error'),
    r as (select user_id, cast(floor(value) as int) as s, cast(floor(value) as int) + 3 as e from events where event_type = 'view')
    select user_id, line, min(greatest(0, s - line, line - e)) as distance from p join r using (user_id) group by 1, 2""")
def edit_distance(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor("value").cast("int").alias("line"))
    regions = e.filter("event_type = 'view'").select("user_id", F.col("line").alias("start"), (F.col("line") + 3).alias("end"))
    return intervals.distance(e.filter("event_type = 'error'").select("user_id", "line").distinct(), regions, ["user_id"])


@query(f"""with t as (select {TAG.format('text')} as tag, doc_id from documents), k as (select tag from t where doc_id % 2 = 0) select doc_id, tag in (select tag from k) as unchanged from t""")
def unchanged_files(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), X.tag(F.col("text")).alias("tag"))
    known = t.filter("path % 2 = 0").select("tag").distinct()
    hit = t.join(known, "tag", "left_semi").select(F.col("path").alias("doc_id"), F.lit(True).alias("unchanged"))
    return hit.unionByName(t.join(known, "tag", "left_anti").select(F.col("path").alias("doc_id"), F.lit(False).alias("unchanged")))
