"""Append-only notes as JSON lines, and large results kept by reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bytes of a message, of an inline result, and the scopes and severities that notes have.
MAX_MESSAGE = 64 * 1024
MAX_INLINE = 16 * 1024
SCHEMA = "scope string, severity string, message string, rationale string, patch string"


def valid(notes: DataFrame, scopes: list[str]) -> DataFrame:
    """Notes whose scope is known and whose message is there and not too long."""
    return notes.filter(F.col("scope").isin(scopes) & (F.octet_length("message").between(1, MAX_MESSAGE)))


def append(notes: DataFrame, path: str, scopes: list[str]) -> None:
    valid(notes, scopes).write.mode("append").json(path)


def read(spark, path: str) -> DataFrame:
    """All notes; malformed lines are left out."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def by_reference(result: DataFrame) -> tuple[DataFrame, str | None]:
    """result itself if it is at most MAX_INLINE bytes as JSON, else the written table and its path."""
    size = result.select(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= MAX_INLINE:
        return result, None
    table = shared.written(result, "result")
    return table, table.inputFiles()[0].rpartition("/")[0]
