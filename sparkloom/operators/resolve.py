"""Call resolution: a cascade of equi-joins from calls to symbols, by confidence.

calls: file, caller, callee_name, arity, recv_kind (free, path, typed, dyn, unknown), recv_arg. symbols: id, name,
qualified, kind, file, start_line, end_line, arity (-1: not known). Every function returns edges (src, dst, kind,
confidence, detail). Dimension tables join by hash; none is broadcast by hand, as Spark and AQE know their sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import shared

#: Fixed value: candidates of a call in the name tier.
NAME_CANDIDATES = 8
EDGE = ("src", "dst", "kind", "confidence", "detail")
#: Calls and functions of a key that meet as one block. Runs of a call and repeats of a row of functions are this long in what is
#: written, within what a file's compression looks back on.
CALL_BLOCK, FUNCTION_BLOCK = 512, 256


def _edges(df: DataFrame, confidence: str, detail: Column | None = None, kind: str = "call", src: str = "caller") -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col("id").alias("dst"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), (F.lit("") if detail is None else detail).alias("detail"))


def functions(symbols: DataFrame) -> DataFrame:
    return symbols.filter("kind = 'fn'")


#: What tells one call from another: calls that agree in all of these resolve alike.
CALL = ("caller", "callee_name", "arity", "recv_kind", "recv_arg")


def _calls(calls: DataFrame, kind: str) -> DataFrame:
    return calls.filter(F.col("recv_kind") == kind).select(*CALL)


def _targets(symbols: DataFrame, tails: bool = False) -> DataFrame:
    """(id, key, tail): functions by their qualified name and, with tails, those with `::` by its last two segments too."""
    fns = functions(symbols)
    full = fns.select("id", F.col("qualified").alias("key"), F.lit(False).alias("tail"))
    ends = fns.filter(F.contains("qualified", F.lit("::"))).select("id", X.last_segments(F.col("qualified")).alias("key"), F.lit(True).alias("tail"))
    return full.unionByName(ends) if tails else full


# What calls look up: the columns of CALL, key and tail, a row for each key. A call has a few keys, however many functions have them.


def _asked(rows: DataFrame, key: Column, tail: Column | None = None) -> DataFrame:
    return rows.select(*CALL, key.alias("key"), (F.lit(False) if tail is None else tail).alias("tail"))


def asked_free(calls: DataFrame) -> DataFrame:
    return _asked(_calls(calls, "free"), F.col("callee_name"))


def asked_path(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    needle = X.last_segments(F.concat_ws("::", F.when(F.col("recv_arg") != "", F.col("recv_arg")), "callee_name"))
    known = symbols.select(F.col("qualified").alias("needle"), F.lit(True).alias("known")).distinct()
    return _asked(_calls(calls, "path").withColumn("needle", needle).join(known, "needle", "left"), F.col("needle"), F.col("known").isNull())


def asked_typed(calls: DataFrame) -> DataFrame:
    return _asked(_calls(calls, "typed"), F.explode(F.array(F.concat_ws("::", "recv_arg", "callee_name"), F.concat_ws(".", "recv_arg", "callee_name"))))


def asked_dyn(calls: DataFrame, impls: DataFrame) -> DataFrame:
    dyn = _calls(calls, "dyn")
    types = impls.filter("trait_name is not null").select(F.col("trait_name").alias("recv_arg"), F.col("type_name").alias("owner")).distinct()
    own = dyn.withColumn("owner", F.col("recv_arg"))
    both = own.unionByName(dyn.join(types, "recv_arg").select(own.columns))
    return _asked(both, F.concat_ws("::", "owner", "callee_name"))


def asked(calls: DataFrame, symbols: DataFrame, impls: DataFrame) -> DataFrame:
    return asked_free(calls).unionByName(asked_path(calls, symbols)).unionByName(asked_typed(calls)).unionByName(asked_dyn(calls, impls))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys in as many partitions as there are shuffle partitions: the rows are few, but what a join makes of them is not, so
    they are not to be put together by their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _blocks(rows: DataFrame, keys: list[str], name: str, size: int) -> DataFrame:
    """(keys, name): the rows by keys as arrays of their other columns, in blocks of no more than size."""
    held = [c for c in rows.columns if c not in keys]
    place = F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*held)) - 1) / size)
    return rows.withColumn("place", place).groupBy(*keys, "place").agg(F.collect_list(F.struct(*held)).alias(name)).drop("place")


def met(asks: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """asks.join(names, keys), by blocks of either side: what is shuffled and held are blocks, and pairs are made of two blocks at a time, so
    that the same row of names comes again and again and takes little where the pairs are written."""
    a, b = _blocks(_dealt(asks, *keys), keys, "ask", CALL_BLOCK), _blocks(names, keys, "name", FUNCTION_BLOCK)
    pairs = a.join(b, keys).select(*keys, F.explode("ask").alias("ask"), "name")
    return pairs.select(*keys, "ask", F.explode("name").alias("name")).select(*keys, "ask.*", "name.*")


def _found(asks: DataFrame, symbols: DataFrame, tails: bool, of: Sequence[str]) -> DataFrame:
    """Every call with every function that has a key of it: the columns of and id."""
    keys = ["key", "tail"] if tails else ["key"]
    return met(asks.select(*of, *keys), _targets(symbols, tails).select("id", *keys), keys).select(*of, "id")


# of: the columns of CALL that are wanted beside id.


def match_free(calls: DataFrame, symbols: DataFrame, of: Sequence[str] = CALL) -> DataFrame:
    """Free calls with every function of that qualified name, in any file."""
    return _found(asked_free(calls), symbols, False, of)


def match_path(calls: DataFrame, symbols: DataFrame, of: Sequence[str] = CALL) -> DataFrame:
    """Path calls by their last two segments: with functions of that qualified name if any symbol at all has it, else with functions that end in it."""
    return _found(asked_path(calls, symbols), symbols, True, of)


def match_typed(calls: DataFrame, symbols: DataFrame, of: Sequence[str] = CALL) -> DataFrame:
    """Calls on a receiver of known type with type::name and type.name."""
    return _found(asked_typed(calls), symbols, False, of)


def match_dyn(calls: DataFrame, symbols: DataFrame, impls: DataFrame, of: Sequence[str] = CALL) -> DataFrame:
    """Calls through a trait with the trait's own method and that of every type that implements it."""
    return _found(asked_dyn(calls, impls), symbols, False, of)


def resolve_free(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    return _edges(match_free(calls, symbols, ("caller",)), "direct")


def resolve_path(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    return _edges(match_path(calls, symbols, ("caller",)), "direct")


def resolve_typed(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    return _edges(match_typed(calls, symbols, ("caller", "recv_arg")), "typed", F.col("recv_arg"))


def resolve_dyn(calls: DataFrame, symbols: DataFrame, impls: DataFrame) -> DataFrame:
    return _edges(match_dyn(calls, symbols, impls, ("caller", "recv_arg")), "dyn", F.col("recv_arg"))


def resolve_name(calls: DataFrame, symbols: DataFrame, resolved: DataFrame) -> DataFrame:
    """Calls that no tier before resolved, without a path, with functions of that name and arity (-1 fits all): the first
    NAME_CANDIDATES by (file, start), of which the caller itself is dropped afterwards.

    resolved holds the calls that did resolve. Whether a call falls back is its own matter: another call of the same name
    in the same function does not decide it.
    """
    fns = functions(symbols)
    bare = calls.filter((F.col("recv_kind") != "path") & ~F.contains("callee_name", F.lit("::"))).select(*CALL)
    left = bare.join(resolved, list(CALL), "left_anti").select("caller", "callee_name", F.col("arity").alias("given")).distinct()
    # Candidates depend on name and arity alone, so they are ranked once for each such pair, not for each call; the pairs are
    # those of all bare calls, so that what is resolved need not be worked out for them too.
    asked = bare.select("callee_name", F.col("arity").alias("given")).distinct()
    fits = asked.join(fns.select("id", F.col("name").alias("callee_name"), "arity", "file", "start_line"), "callee_name").filter("arity < 0 or arity = given")
    w = Window.partitionBy("callee_name", "given").orderBy("file", "start_line", "id")
    top = fits.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= NAME_CANDIDATES).select("callee_name", "given", "id")
    return _edges(left.join(top, ["callee_name", "given"]).filter("id <> caller"), "name")


def _last_traits(symbols: DataFrame) -> DataFrame:
    """(id, trait_name): of traits that share a name the last one in file and line order."""
    w = Window.partitionBy("name").orderBy(F.desc("file"), F.desc("start_line"), F.desc("id"))
    return symbols.filter("kind = 'trait'").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("id", F.col("name").alias("trait_name"))


def type_references(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs(referrer, type_name) -> all types of that name, and the last trait of that name."""
    types = symbols.filter("kind = 'type'").select("id", F.col("name").alias("type_name"))
    named = types.unionByName(_last_traits(symbols).withColumnRenamed("trait_name", "type_name"))
    return _edges(refs.join(named, "type_name"), "direct", kind="reference", src="referrer")


def method_of(methods: DataFrame, symbols: DataFrame) -> DataFrame:
    """methods(method_id, type_qualified) -> their types. The bare name is compared, so a type inside a module is not found."""
    types = symbols.filter("kind = 'type'").select("id", F.col("qualified").alias("type_qualified"))
    return _edges(methods.join(types, "type_qualified"), "direct", kind="method_of", src="method_id")


def impl_of(impls: DataFrame, symbols: DataFrame) -> DataFrame:
    """All types of a name -> the last trait of the name they implement, which is the edge's detail."""
    types = symbols.filter("kind = 'type'").select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))
    pairs = impls.filter("trait_name is not null").select("type_name", "trait_name").distinct()
    return _edges(pairs.join(types, "type_name").join(_last_traits(symbols), "trait_name"), "direct", F.col("trait_name"), kind="impl_of", src="type_id")


def resolved(calls: DataFrame, symbols: DataFrame, impls: DataFrame) -> DataFrame:
    """The calls (the columns of CALL) that a tier before the name tier resolves: a row for each key that a function has, not for each function."""
    return asked(calls, symbols, impls).join(_targets(symbols, True), ["key", "tail"], "left_semi").select(*CALL)


def _pairs(asks: DataFrame, symbols: DataFrame, owner: DataFrame | None) -> DataFrame:
    """The edges of the tiers before the name tier as distinct pairs of a source and a function's qualified name, key in place of dst."""
    fns = functions(symbols).select(F.col("qualified").alias("key"))
    ends = fns.filter(F.contains("key", F.lit("::"))).select(X.last_segments(F.col("key")).alias("end"), "key").distinct()
    named = asks.filter("not tail").drop("tail").unionByName(asks.filter("tail").withColumnRenamed("key", "end").join(ends, "end").select(*CALL, "key"))
    tier = F.when(F.col("recv_kind") == "typed", "typed").when(F.col("recv_kind") == "dyn", "dyn").otherwise("direct")
    detail = F.when(F.col("recv_kind").isin("typed", "dyn"), F.col("recv_arg")).otherwise("")
    pairs = named.select(F.col("caller").alias("src"), F.lit("call").alias("kind"), tier.alias("confidence"), detail.alias("detail"), "key").distinct()
    return pairs if owner is None else pairs.join(owner, "src")


def _first_edges(asks: DataFrame, symbols: DataFrame, owner: DataFrame | None) -> DataFrame:
    """The edges of the tiers before the name tier, without repeats. Repeats go before calls meet functions, by the functions' qualified
    names, as there can be many functions of a name; what is left for afterwards are functions whose id has several such names."""
    fns = functions(symbols).select("id", F.col("qualified").alias("key"))
    pairs, extra = _pairs(asks, symbols, owner), [] if owner is None else ["file"]
    names = fns.groupBy("id").agg(F.min("key").alias("key"), F.max("key").alias("last"))
    several = fns.distinct().join(names.filter("key <> last").select("id"), "id", "left_semi")
    made = [met(pairs, x, ["key"]).select(*[F.col("id").alias(c) if c == "dst" else c for c in EDGE], *extra) for x in (names.filter("key = last").select("id", "key"), several)]
    return made[0].unionByName(made[1].dropDuplicates(list(EDGE)))


def _named_edges(calls: DataFrame, symbols: DataFrame, asks: DataFrame) -> DataFrame:
    done = asks.join(_targets(symbols, True), ["key", "tail"], "left_semi").select(*CALL)
    return resolve_name(calls, symbols, done).distinct()


def _whole(calls: DataFrame) -> DataFrame:
    return calls.select(*[F.coalesce(c, F.lit("")).alias(c) if c in ("recv_kind", "recv_arg") else F.col(c) for c in CALL])


def resolve_calls(calls: DataFrame, symbols: DataFrame, impls: DataFrame, owner: DataFrame | None = None) -> DataFrame:
    """The call edges of all tiers without repeats, with the file of owner(src, file) if it is given; a call reaches the name tier
    only if its own tier found nothing. What calls look up is written, as it is read twice: for edges, and to tell which
    calls are left."""
    calls = _whole(calls)
    asks = shared.written(asked(calls, symbols, impls), "asked")
    named = _named_edges(calls, symbols, asks)
    return _first_edges(asks, symbols, owner).unionByName(named if owner is None else named.join(owner, "src"))


def call_pairs(calls: DataFrame, symbols: DataFrame, impls: DataFrame, owner: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of resolve_calls() before calls meet functions: the distinct (src, kind, confidence, detail, file, key), with the file of
    owner(src, file), that stand for an edge to every function whose qualified name is key, and the edges of the name tier, without file."""
    calls = _whole(calls)
    asks = shared.written(asked(calls, symbols, impls), "asked")
    pairs = _pairs(asks, symbols, owner).select("src", "kind", "confidence", "detail", "file", "key")
    return pairs, _named_edges(calls, symbols, asks)


def resolve_edges(calls: DataFrame, symbols: DataFrame, impls: DataFrame, methods: DataFrame, refs: DataFrame) -> DataFrame:
    """All edges without repeats, with file, the file of src (edges of unknown sources are dropped)."""
    owner = symbols.groupBy(F.col("id").alias("src")).agg(F.min("file").alias("file"))
    rest = type_references(refs, symbols).unionByName(method_of(methods, symbols)).unionByName(impl_of(impls, symbols))
    return resolve_calls(calls, symbols, impls, owner).unionByName(rest.dropDuplicates(list(EDGE)).join(owner, "src")).select("src", *EDGE[1:], "file")


def keyed_edges(calls: DataFrame, symbols: DataFrame, impls: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The call and method_of edges of resolve_edges() as (src, dst, kind, confidence, detail), where dst may be a node that stands for
    all functions of a qualified name, and names(id, node) of these. There are as many as there are calls and functions,
    not as pairs of them; graph.blast_radius() and graph.caller_rows() take both."""
    calls = _whole(calls)
    asks = shared.written(asked(calls, symbols, impls), "asked")
    node = F.concat(F.lit("\x00"), "key")
    pairs = _pairs(asks, symbols, None).withColumn("dst", node).select(*EDGE)
    names = functions(symbols).select("id", F.col("qualified").alias("key")).select("id", node.alias("node")).filter("node is not null").distinct()
    edges = pairs.unionByName(_named_edges(calls, symbols, asks)).unionByName(method_of(methods, symbols).distinct())
    return edges.join(symbols.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(*EDGE), names


def edge_digest(edges: DataFrame) -> DataFrame:
    """(file, digest): equal for equal sets of edges."""
    return edges.groupBy("file").agg(F.hex(F.expr("bit_xor(xxhash64(src, dst, kind, confidence, detail))")).alias("digest"), F.count(F.lit(1)).alias("n"))


def dump(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols, then edges, as sorted text lines: equal for equal graphs."""
    a = symbols.select(F.lit(0).alias("part"), F.concat_ws("|", *[F.col(c).cast("string") for c in ("id", "name", "qualified", "kind", "file", "start_line", "end_line", "arity")]).alias("row"))
    b = edges.select(F.lit(1).alias("part"), F.concat_ws("|", *EDGE).alias("row"))
    return a.unionByName(b).orderBy("part", "row")
