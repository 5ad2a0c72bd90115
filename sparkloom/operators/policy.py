"""Operation policies: verdicts, narrowing and the enforcement that only narrows.

Ops form a tree by their dotted names. A policy names sets of ops by what it takes of that tree: the op at a place (AT), or
all ops below a place (BELOW; the root, '', has all ops below it). In an allow list `x` is AT x and `x.` is BELOW x; in a
deny list `x` is both. An op may run if the allow set has it and the deny set has not; no allow list at all is BELOW ''.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The operations of the built-in profiles.
READ_OPS = ("context.read", "context.find", "context.explore", "context.log", "context.prompt", "state.status")
CHECK_OPS = ("verify.check", "verify.diagnose", "verify.build")
MUTATE_OPS = ("mutate.edit", "mutate.create", "mutate.delete", "mutate.undo")
OBSERVE_OPS = ("session.request", "session.requests")

AT, BELOW = "at", "below"
Taken = frozenset[tuple[str, str]]
EVERYTHING: Taken = frozenset({(BELOW, "")})


def _above(place: str) -> list[str]:
    """The places that place is below, from the root down."""
    dots = [i for i, c in enumerate(place) if c == "." and i < len(place) - 1]
    return ["", *(place[:i] for i in dots)]


def _taken(texts: Iterable[str], bare: Sequence[str]) -> Taken:
    """What a list of patterns takes of the tree; bare is what one without a dot at its end takes."""
    out = set()
    for text in texts:
        place = text.removesuffix(".")
        if place == "" or place != "".join(place.split()):
            raise ValueError(f"bad pattern {text!r}")
        out |= {(kind, place) for kind in ((BELOW,) if text != place else bare)}
    return frozenset(out)


def _has(taken: Taken, part: tuple[str, str]) -> bool:
    """Whether a part of the tree lies in what is taken: it is taken itself, or is below a place whose ops all are."""
    return part in taken or any((BELOW, place) in taken for place in _above(part[1]) if part != (BELOW, ""))


@dataclass(frozen=True)
class Policy:
    """What is allowed and what is denied of the tree of ops."""

    allow: Taken
    deny: Taken = frozenset()

    @staticmethod
    def of(allow: Sequence[str], deny: Sequence[str] = ()) -> Policy:
        return Policy(_taken(allow, (AT,)) or EVERYTHING, _taken(deny, (AT, BELOW)))

    def permits(self, op: str) -> bool:
        return _has(self.allow, (AT, op)) and not _has(self.deny, (AT, op))

    def narrows(self, current: Policy) -> bool:
        """All that is allowed here is allowed in current, and all that current denies is denied here."""
        return all(_has(current.allow, part) for part in self.allow) and all(_has(self.deny, part) for part in current.deny)


PROFILES = {
    "readonly": Policy.of(READ_OPS),
    "review": Policy.of(READ_OPS + CHECK_OPS),
    "edit": Policy.of(READ_OPS + CHECK_OPS + MUTATE_OPS),
    "observe": Policy.of(READ_OPS + OBSERVE_OPS),
    "full": Policy.of(()),
}
LOCKDOWN = Policy.of(["state.status"])


def advance(active: Policy | None, request: Policy | None) -> tuple[Policy | None, bool]:
    """The enforcement after a request, and whether it is accepted: off -> active; then only narrower policies."""
    if request is None:
        return active, active is None
    if active is None or request.narrows(active):
        return request, True
    return active, False


def stored(text: str | None) -> Policy | None:
    """A stored policy, {"allow": [...], "deny": [...]}: absent is off, what cannot be read is lockdown."""
    if text is None:
        return None
    try:
        raw = json.loads(text)
        return Policy.of(raw["allow"], raw["deny"])
    except (ValueError, KeyError, TypeError, AttributeError):
        return LOCKDOWN


def rows(spark: SparkSession, policies: dict[str, Policy]) -> DataFrame:
    """(policy, side, kind, place): what each side of a policy takes, a row a part of the tree."""
    out = [(name, side, *part) for name, p in policies.items() for side, taken in (("allow", p.allow), ("deny", p.deny)) for part in sorted(taken)]
    return spark.createDataFrame(out, "policy string, side string, kind string, place string")


def _places_above(place: Column) -> Column:
    """_above() of a column."""
    steps = F.split(place, r"\.", -1)
    inner = F.size(steps) - 1 - (F.element_at(steps, -1) == "").cast("int")
    return F.concat(F.array(F.lit("")), F.when(inner > 0, F.transform(F.sequence(F.lit(1), inner), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "."))).otherwise(F.array().cast("array<string>")))


def _holders(parts: DataFrame) -> DataFrame:
    """parts(kind, place, ...) with in_kind and in_place: a row for each part of the tree that holds all of it, itself first."""
    root = (F.col("kind") == BELOW) & (F.col("place") == "")
    above = F.when(root, F.array().cast("array<string>")).otherwise(_places_above(F.col("place")))
    both = F.concat(F.array(F.struct(F.col("kind").alias("k"), F.col("place").alias("p"))), F.transform(above, lambda x: F.struct(F.lit(BELOW).alias("k"), x.alias("p"))))
    return parts.select("*", F.explode(F.array_distinct(both)).alias("_in")).select("*", F.col("_in.k").alias("in_kind"), F.col("_in.p").alias("in_place")).drop("_in")


def verdicts(ops: DataFrame, policies: DataFrame) -> DataFrame:
    """(policy, op, permitted) for every op under every policy: an op meets what holds it by an equi-join on the parts of the tree."""
    asked = ops.select("op").distinct()
    held = _holders(asked.select("op", F.lit(AT).alias("kind"), F.col("op").alias("place"))).select("op", F.col("in_kind").alias("kind"), F.col("in_place").alias("place"))
    hits = held.join(policies, ["kind", "place"]).groupBy("policy", "op").agg(F.bool_or(F.col("side") == "deny").alias("denied"), F.bool_or(F.col("side") == "allow").alias("allowed"))
    every = asked.crossJoin(policies.select("policy").distinct())  # the result has a row for each of these
    return every.join(hits, ["policy", "op"], "left").select("policy", "op", F.coalesce(F.col("allowed") & ~F.col("denied"), F.lit(False)).alias("permitted"))


def narrowing(policies: DataFrame) -> DataFrame:
    """(current, next, narrows) for every pair of policies: what next allows, current does, and what current denies, next does.

    A policy that takes a part of the tree is held by those that take a part around it; the parts of a policy that
    another one holds are counted, and all of them must be.
    """
    def held(side: str, inner: str, outer: str) -> DataFrame:
        """(inner, outer, n): how many parts of a policy's side lie in what the other one's takes."""
        parts = policies.filter(F.col("side") == side).select("policy", "kind", "place").distinct()
        around = _holders(parts.withColumnRenamed("policy", inner)).join(parts.select(F.col("policy").alias(outer), F.col("kind").alias("in_kind"), F.col("place").alias("in_place")), ["in_kind", "in_place"])
        return around.select(inner, outer, "kind", "place").distinct().groupBy(inner, outer).agg(F.count(F.lit(1)).alias(f"{side}_held"))

    def counted(side: str, name: str) -> DataFrame:
        return policies.filter(F.col("side") == side).select("policy", "kind", "place").distinct().groupBy(F.col("policy").alias(name)).agg(F.count(F.lit(1)).alias(f"{side}_parts"))

    names = policies.select("policy").distinct()
    pairs = names.select(F.col("policy").alias("current")).crossJoin(names.select(F.col("policy").alias("next")))  # the result has a row for each of these
    rows = pairs.join(counted("allow", "next"), "next", "left").join(counted("deny", "current"), "current", "left")
    rows = rows.join(held("allow", "next", "current"), ["current", "next"], "left").join(held("deny", "current", "next"), ["current", "next"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select("current", "next", ((zero("allow_parts") == zero("allow_held")) & (zero("deny_parts") == zero("deny_held"))).alias("narrows"))


def enforced(requests: DataFrame, policies: dict[str, Policy], by: str, order: list[Column], block: int = 512) -> DataFrame:
    """(by, active): the policy in force for each key after its requests(by, request) in order, null while there is none.

    A request is the name of a policy, or null, which asks for nothing. With a few policies every request is a map from the
    policy in force to the next one; maps compose, so a block of requests is one map, and a key's blocks are folded in order.
    """
    from pyspark.sql import Window

    names = sorted(policies)
    states = [None, *names]

    def after(active: str | None, request: str) -> int:
        now, _ = advance(policies[active] if active else None, policies[request])
        return states.index(request) if now is policies[request] else states.index(active)

    maps = F.create_map(*[x for r in names for x in (F.lit(r), F.array(*[F.lit(after(s, r)) for s in states]))])
    start = F.array(*[F.lit(i) for i in range(len(states))])
    rows = requests.filter(F.col("request").isNotNull()).withColumn("_at", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    rows = rows.withColumn("_map", maps[F.col("request")]).withColumn("_block", F.floor(F.col("_at") / block))
    chain = lambda xs: F.aggregate(xs, start, lambda f, x: F.transform(f, lambda i: x["_map"][i]))
    blocks = rows.groupBy(by, "_block").agg(F.array_sort(F.collect_list(F.struct("_at", "_map"))).alias("_rows")).select(by, "_block", chain(F.col("_rows")).alias("_map"))
    last = blocks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_block", "_map"))).alias("_maps")).select(by, chain(F.col("_maps"))[0].alias("_i"))
    named = F.array(*[F.lit(s) for s in states])
    return requests.select(by).distinct().join(last, by, "left").select(by, named[F.coalesce("_i", F.lit(0))].alias("active"))
