"""Named queries and ordered transactions over snapshots of a files table."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources import shared

#: Fixed value: steps of one transaction.
MAX_STEPS = 32


@dataclass
class Macros:
    """Stored sequences of steps, by a name of letters, digits, - and _."""

    stored: dict[str, str] = field(default_factory=dict)

    def save(self, name: str, steps: Sequence[dict]) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,64}", name):
            raise ValueError(f"bad name {name!r}")
        self.stored[name] = json.dumps(list(steps))

    def names(self) -> list[str]:
        return sorted(self.stored)

    def steps(self, name: str) -> list[dict]:
        return json.loads(self.stored[name])


class Snapshots:
    """Versions of a files table: immutable Parquet directories and a pointer that is swapped on commit."""

    def __init__(self, spark: SparkSession, first: DataFrame) -> None:
        self.spark, self.schema = spark, first.schema
        self.versions: list[str] = []
        self.commit(first)

    def commit(self, files: DataFrame) -> int:
        path = f"{shared.folder(self.spark)}/snapshot-{uuid.uuid4().hex}"
        files.write.parquet(path)
        self.versions.append(path)
        return len(self.versions) - 1

    def read(self, version: int = -1) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.versions[version])

    def restore(self, version: int) -> int:
        """Makes an earlier version the newest."""
        self.versions.append(self.versions[version])
        return len(self.versions) - 1


Step = Callable[[DataFrame], DataFrame]


def transaction(snapshots: Snapshots, steps: Sequence[Step], validate: Callable[[DataFrame], bool] | None = None) -> int:
    """Runs steps in order, each on what the one before it left; commits the last result once, or nothing at all if a step
    or the validation fails."""
    if not 1 <= len(steps) <= MAX_STEPS:
        raise ValueError(f"a transaction has 1 to {MAX_STEPS} steps")
    files = snapshots.read()
    for step in steps:
        files = shared.written(step(files), "step")
    if validate is not None and not validate(files):
        raise ValueError("validation failed; nothing was committed")
    return snapshots.commit(files)


def run(registry: Mapping[str, Callable[..., object]], steps: Sequence[dict]) -> list[object]:
    """Runs steps {"op": name, ...arguments} against a registry of operators."""
    return [registry[s["op"]](**{k: v for k, v in s.items() if k not in ("op", "label")}) for s in steps]


def commit_verified(snapshots: Snapshots, staged: DataFrame) -> int:
    """Commits staged(path, read_tag, text; a null text removes the file) if every file is still what was read, else nothing."""
    from ..operators import edits

    files, staged = snapshots.read(), shared.written(staged, "staged")
    changed = edits.verified(files, staged).orderBy("path").limit(1).collect()
    if changed:
        raise ValueError(f"{changed[0]['path']} has changed since it was read; nothing was committed")
    new = staged.filter("text is not null").select("path", "text")
    return snapshots.commit(files.join(staged.select("path"), "path", "left_anti").select("path", "text").unionByName(new))
