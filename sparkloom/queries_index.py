"""Queries on edges kept up to date, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import batch_vectors, paths, resolve, vectors
from .plans import refresh
from .queries import ALL_EDGES, call_tables, query, table, unit_sql
from .sources import shared

# Parts are functions in files of ten. Of every 500 one is dropped, one gets another name, one another arity and one another line.


def index_facts(spark, sf_dir) -> refresh.Facts:
    """The facts of graph_edges with the file of each."""
    symbols, calls, impls = call_tables(spark, sf_dir)
    of = lambda n: F.concat(F.lit("src/"), F.floor(n / 10).cast("string"))
    number = lambda c: F.substring(c, 2, 20).try_cast("long")
    symbols = symbols.withColumn("file", F.when(F.col("kind") == "fn", of(number("id"))).otherwise(F.col("file")))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), "p_partkey").alias("id"), "p_partkey", of(F.col("p_partkey")).alias("file"), F.regexp_replace("p_brand", "#", "").alias("type_name"))
    some = p.join(impls, "type_name", "left")
    refs = some.select("file", F.col("id").alias("referrer"), "type_name").unionByName(some.filter("trait_name is not null").select("file", F.col("id").alias("referrer"), F.col("trait_name").alias("type_name")))
    methods = p.select("file", F.col("id").alias("method_id"), F.col("type_name").alias("type_qualified"))
    written = lambda df, name: shared.written(df, name)
    return refresh.Facts(written(symbols, "symbols"), written(calls.withColumn("file", of(number("caller"))), "calls"), written(impls.withColumn("file", F.lit("types")), "impls"), written(methods, "methods"), written(refs, "refs"))


def refreshed(spark, sf_dir) -> refresh.Refreshed:
    before = index_facts(spark, sf_dir)
    number = F.substring("id", 2, 20).try_cast("long") % 500
    fns = before.symbols.filter("kind = 'fn'").withColumn("e", number)
    changed = fns.filter("e in (7, 13, 21, 33)").select("file").distinct()
    fresh = before.of(changed)
    renamed = lambda c: F.when(number == 13, F.concat(F.col(c), F.lit("_v2"))).otherwise(F.col(c)).alias(c)
    arity, line = F.when(number == 21, 2 - F.col("arity")).otherwise(F.col("arity")).alias("arity"), F.when(number == 33, F.col("start_line") + 100).otherwise(F.col("start_line")).alias("start_line")
    symbols = fresh.symbols.filter(number != 7).select("id", renamed("name"), renamed("qualified"), "kind", "file", line, "end_line", arity)
    gone = lambda df, c: df.filter(F.substring(c, 2, 20).try_cast("long") % 500 != 7)
    fresh = refresh.Facts(symbols, fresh.calls, fresh.impls, gone(fresh.methods, "method_id"), gone(fresh.refs, "referrer"))
    return refresh.refresh(before, before.edges(), fresh, changed)


#: The edges of index_facts, made from nothing, over the table `part` or a changed form of it; calls and types are those of part.
_WAS = ALL_EDGES.replace("p_type as file", "'src/' || p_partkey // 10 as file")
EDGES_BEFORE = f"with {_WAS}"
EDGES_AFTER = (
    """with was as (select p_partkey, replace(p_name, ' ', '_') as name, replace(p_brand, '#', '') as brand from part),
    edited as (select p_partkey, p_brand, p_name || case when p_partkey % 500 = 13 then '_v2' else '' end as p_name, p_size + case when p_partkey % 500 = 33 then 100 else 0 end as p_size,
        case when p_partkey % 500 = 21 then 2 - (p_partkey % 4 - 1) else p_partkey % 4 - 1 end as arity from part where p_partkey % 500 <> 7), """
    + _WAS.replace("from part)", "from edited)", 1).replace("p_partkey % 4 - 1 as arity", "arity").replace("file from fns)", "file from was)", 1).replace("trait_name from fns)", "trait_name from was)", 1)
    .replace("lineitem join fns on l_partkey", "lineitem join was on l_partkey")
)


@query(f"{EDGES_AFTER} select * from edges")
def refresh_edges(spark, sf_dir):
    return refreshed(spark, sf_dir).edges


@query(f"""select 'removed' as change, * from (({EDGES_BEFORE} select src, dst, kind, confidence, detail, file from edges) except ({EDGES_AFTER} select src, dst, kind, confidence, detail, file from edges))
    union all select 'added', * from (({EDGES_AFTER} select src, dst, kind, confidence, detail, file from edges) except ({EDGES_BEFORE} select src, dst, kind, confidence, detail, file from edges))""")
def refresh_delta(spark, sf_dir) -> DataFrame:
    got = refreshed(spark, sf_dir)
    one = lambda df, change: df.select(F.lit(change).alias("change"), *resolve.EDGE, "file")
    return one(got.removed, "removed").unionByName(one(got.added, "added"))


# Every part is a module with a class, whose base is the class of the next part unless its number ends a run of five; makers' modules
# have the classes of their brands' modules, which name those of their parts. Suppliers use methods of the parts they deliver.


def name_facts(spark, sf_dir) -> paths.Facts:
    text = lambda c: F.col(c).cast("string")
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("m"), text("p_partkey")).alias("m"), F.lower(F.regexp_replace("p_brand", "#", "")).alias("brand"))
    p = p.withColumn("maker", F.concat(F.lit("maker"), F.substr("brand", F.lit(6), F.lit(1)))).withColumn("file", F.concat(F.lit("pkg/"), "m", F.lit(".py")))
    brands = p.select("brand", "maker").distinct()
    makers = p.select("maker").distinct()
    s = li.select(F.concat(F.lit("app/s"), text("l_suppkey"), F.lit(".py")).alias("file")).distinct()
    file = lambda folder, c: F.concat(F.lit(folder + "/"), c, F.lit(".py")).alias("file")
    none = F.lit(None).cast("string")
    modules = p.select("file", F.array(F.lit("pkg"), "m").alias("name")).unionByName(brands.select(file("lib", F.col("brand")), F.array(F.lit("lib"), "brand").alias("name"))).unionByName(makers.select(file("api", F.col("maker")), F.array(F.lit("api"), "maker").alias("name")))
    scopes = p.select("file", F.lit("C").alias("scope"), F.lit("").alias("parent")).unionByName(s.select("file", F.lit("main").alias("scope"), F.lit("").alias("parent")))
    of = lambda rows, scope, name, line, inner: rows.select("file", F.lit(scope).alias("scope"), F.lit(name).alias("name"), F.lit(line).alias("line"), inner.alias("inner"))
    defs = of(p, "", "C", 1, F.lit("C")).unionByName(of(p.filter("p_partkey % 2 = 0"), "C", "run", 2, none)).unionByName(of(p.filter("p_partkey % 3 = 0"), "C", "stop", 3, none))
    alias = lambda rows, name, target, absolute=True: rows.select("file", F.lit("").alias("scope"), name.alias("name"), target.alias("target"), F.lit(absolute).alias("absolute"))
    after = F.concat(F.lit("m"), (F.col("p_partkey") + 1).cast("string"))
    aliases = alias(p, F.lit("Base"), F.array(F.lit("pkg"), after, F.lit("C")))
    aliases = aliases.unionByName(alias(p.select(file("lib", F.col("brand")), "m"), F.upper("m"), F.array(F.lit("pkg"), "m", F.lit("C"))))
    aliases = aliases.unionByName(alias(s.crossJoin(F.broadcast(makers)), F.col("maker"), F.array(F.lit("api"), "maker")))  # a few makers
    aliases = aliases.unionByName(alias(s, F.lit("loop"), F.array(F.lit("loop"), F.lit("on")), False))
    stars = brands.select(file("api", F.col("maker")), F.lit("").alias("scope"), F.array(F.lit("lib"), "brand").alias("target"))
    bases = p.filter("p_partkey % 5 <> 0").select("file", F.lit("C").alias("scope"), F.array(F.lit("Base")).alias("target"))
    used = li.join(p.select(F.col("p_partkey").alias("l_partkey"), "maker", F.upper("m").alias("c")), "l_partkey")
    methods = F.explode(F.array(F.lit("run"), F.lit("stop"))).alias("method")
    uses = used.select(F.concat(F.lit("app/s"), text("l_suppkey"), F.lit(".py")).alias("file"), F.lit("main").alias("scope"), F.col("l_partkey").cast("int").alias("line"), "maker", "c", methods)
    uses = uses.select("file", "scope", "line", F.array("maker", "c", "method").alias("name")).unionByName(s.select("file", F.lit("main").alias("scope"), F.lit(0).alias("line"), F.array(F.lit("loop")).alias("name")))
    return paths.Facts(*[shared.written(df, "facts") for df in (modules, scopes, defs, aliases, stars, bases, uses)])


@query("""with u as (select distinct l_suppkey as s, l_partkey as p, unnest(['run', 'stop']) as m from lineitem),
    up as (select p_partkey as p, unnest(range(0, case when p_partkey % 5 = 0 then 1 else 6 - p_partkey % 5 end)) as i from part), q as (select p, p + i as q from up where p + i <= (select max(p_partkey) from part)),
    d as (select p, 'run' as m, min(q) as q from q where q % 2 = 0 group by 1 union all select p, 'stop', min(q) from q where q % 3 = 0 group by 1)
    select 'app/s' || s || '.py' as ref_file, cast(p as int) as ref_line, m as name, 'pkg/m' || q || '.py' as def_file, case m when 'run' then 2 else 3 end as def_line from u join d using (p, m)""")
def member_references(spark, sf_dir):
    return paths.resolved(name_facts(spark, sf_dir)).withColumn("name", F.element_at("name", -1))


# Every vector and a moved one beside it, searched for all of them at once.

PAIRED = """vecs as (select vec_id, label, embedding from embeddings
    union all select vec_id + 1000000, label, list_transform(embedding, lambda x, i: cast(cast(x as double) * (1 + 0.125::double * ((i - 1) % 5 - 2)) as float)) from embeddings)"""


def paired_index(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.transform("embedding", lambda x, i: (x.cast("double") * (1 + F.lit(0.125) * (i % 5 - 2))).cast("float"))
    return vectors.index(vectors.usable(e.unionByName(e.select((F.col("vec_id") + 1000000).alias("vec_id"), "label", moved.alias("embedding")))))


@query(f"""with {PAIRED}, {unit_sql("vecs")}, p as (select a.vec_id as query, b.vec_id as id, a.scale, cast(list_sum(list_transform(list_zip(a.code, b.code), lambda p: p[1] * p[2])) as bigint) as score from ix a, ix b where a.vec_id <> b.vec_id),
    k as (select * from p qualify row_number() over (partition by query order by score desc, id) <= 16)
    select query, id, score, cast(row_number() over (partition by query order by score desc, id) as int) as rank from k where score / (scale * scale) >= 0.65 and query % 3 <> id % 3
        and id // 2 not in (select vec_id // 2 from vecs group by 1 having count(*) >= greatest((select count(*) // 40 from vecs), 5)) qualify row_number() over (partition by query order by score desc, id) <= 5""")
def kin_of_all(spark, sf_dir):
    rows = paired_index(spark, sf_dir).withColumn("lang", F.col("vec_id") % 3).withColumn("name", F.floor(F.col("vec_id") / 2))
    return batch_vectors.kin(rows, "lang", "name")


@query(f"""with {PAIRED}, {unit_sql("vecs")}, p as (select a.vec_id as query, b.vec_id as id, cast(list_sum(list_transform(list_zip(a.unit, b.unit), lambda p: case when (p[1] >= 0) = (p[2] >= 0) then 0 else 1 end)) as bigint) as score
        from ix a, ix b where a.vec_id <> b.vec_id)
    select query, id, score, cast(row_number() over (partition by query order by score, id) as int) as rank from p qualify row_number() over (partition by query order by score, id) <= 128""")
def shortlists_of_all(spark, sf_dir):
    return batch_vectors.shortlists(paired_index(spark, sf_dir), 4)
