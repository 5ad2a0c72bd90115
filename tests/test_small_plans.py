"""Plans stay small however many steps a query takes: a plan is held by the driver, with its code."""

from sparkloom.operators import explore

EDGE = "src string, dst string, kind string, confidence string, detail string"


def test_a_report_reads_its_edges_once_a_part(spark):
    edges = spark.createDataFrame([(f"f{i}", f"f{i + 1}", "call", "direct", "") for i in range(6)], EDGE)
    symbols = spark.createDataFrame([(f"f{i}", f"file{i % 2}") for i in range(7)], "id string, file string")
    out = explore.report(spark.createDataFrame([(1, "f5"), (2, "f1")], "place int, id string"), symbols, edges)
    assert sorted((r.id, r.confirmed, r.blast, r.blast_files) for r in out.collect()) == [("f1", 1, 1, "file0 (1)"), ("f5", 1, 3, "file0 (2), file1 (1)")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 4 and plan.count("LogicalRDD") <= 3
