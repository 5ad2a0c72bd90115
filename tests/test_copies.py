"""Copies of files whose numbers are those of other files."""

import duckdb
import oracle

from sparkloom import queries, queries_more  # noqa: F401


def test_copies_whose_numbers_are_those_of_files(spark, tmp_path):
    ids = [1, 2, 3, 500001, 500003, 1000001]
    spark.createDataFrame([(i, f"text {i}\n" if i % 2 else f"text {i}") for i in ids], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.difference(spark, db, queries.QUERIES["create_delete"], queries.ORACLE_SQL["create_delete"], str(tmp_path)) is None
