"""What a search cuts among symbols that are equal in all else."""

from sparkloom.operators import graph


def test_named_functions_of_one_place_go_by_id(spark):
    rows = [(f"f{i:02}", "run", "A::run", "fn", "x", 1) for i in range(40)]
    for order in (rows, rows[::-1], rows[7:] + rows[:7]):
        symbols = spark.createDataFrame(order, "id string, name string, qualified string, kind string, file string, start_line int")
        assert sorted(r.id for r in graph.named(symbols, "run").collect()) == [f"f{i:02}" for i in range(16)]
