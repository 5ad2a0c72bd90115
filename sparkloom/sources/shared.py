"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in a local session without it, as in tests, a new folder of this driver.

    On a cluster every machine would have a folder of its own, so there the setting is required.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sparkloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path of the shared folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors. options are the writer's. See dropped()."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables made by written() that no plan will read again."""
    for table in tables:
        path = getattr(table, "_shared_path", None)
        if path:
            delete(table.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores where it comes in fewer partitions than there are, as from a file of one row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out, by keys if given, in as many partitions as there are shuffle partitions, and no fewer than cores: for rows that are
    small but costly to work on, which Spark would put together by their size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)
