"""Runs and unions of ordered rows by one sort, with repeats, nulls and spans that end before they start."""

import random

import duckdb

from sparkloom.operators import intervals


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_runs_and_unions(spark):
    rng = random.Random(5)
    points = [(rng.choice("ab"), rng.choice([None, *range(60)])) for _ in range(70)]
    spans = [(by, s, s + rng.randrange(-6, 9)) for by, s in ((rng.choice("abc"), rng.randrange(200)) for _ in range(90))]
    db = duckdb.connect()
    db.execute("create table p (by_ varchar, line int)")
    db.executemany("insert into p values (?, ?)", points)
    db.execute("create table s (by_ varchar, s int, e int)")
    db.executemany("insert into s values (?, ?, ?)", spans)
    want = db.execute("select by_, min(line), max(line) from (select *, line - row_number() over (partition by by_ order by line nulls first) as k from (select distinct * from p)) group by by_, k").fetchall()
    got = intervals.runs(spark.createDataFrame(points, "by_ string, line int"), ["by_"])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    want = db.execute("""with g as (select *, max(e) over (partition by by_ order by s, e rows between unbounded preceding and 1 preceding) as m from (select distinct * from s)),
        k as (select *, sum(case when m is null or s > m + 1 then 1 else 0 end) over (partition by by_ order by s, e rows unbounded preceding) as k from g) select by_, min(s), max(e) from k group by by_, k""").fetchall()
    unions = intervals.coalesce(spark.createDataFrame(spans, "by_ string, start int, end int"), ["by_"])
    assert sorted(map(tuple, unions.collect())) == sorted(want)
    assert unions.schema["start"].dataType.simpleString() == "int"
    for df in (got, unions):  # no table of groups is held beside the sort
        assert "Aggregate" not in plan(df)
