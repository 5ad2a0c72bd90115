"""What the operators of this subpackage share: the shared folder, checkpoints and Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import delete, dropped, folder, scratch, written  # noqa: F401


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """mapInArrow with a function of one record batch."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                made = fn(part)
                yield from [made] if isinstance(made, pa.RecordBatch) else made

    return df.mapInArrow(run, schema)


def shielded(df: DataFrame, *known: str) -> tuple[DataFrame, dict[str, str]]:
    """df with all columns but the known ones under names of their own, so that none can clash; and name -> name there."""
    names = {c: c if c in known else f"_c{i}_" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def unshielded(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of shielded()'s input, under their own names."""
    return df.select(*[F.col(n).alias(c) for c, n in names.items()])
