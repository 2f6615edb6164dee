"""Named-step pipelines whose step outputs are kept as Parquet tables.

The table of a step is known by a hash of its version, its settings and of everything before it,
so a changed step invalidates itself and the steps after it, and nothing else. A table is
written to a fresh place and published by a row of the manifest once it is whole: what an aborted
run leaves is in no row and is never read. Tables that the pipeline no longer names are dropped by the
manifest, too.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from types import CodeType

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from shelfline.lineage import remove

_MANIFEST = "step string, key string, path string, kept boolean, at timestamp"


@dataclass(frozen=True)
class Step:
    """A step. Without a ``version``, the code of ``apply`` stands for one; the code of functions it calls does not."""

    name: str
    apply: Callable[..., DataFrame]
    settings: dict = field(default_factory=dict)
    version: str | None = None

    def mark(self) -> str:
        if self.version is not None:
            return self.version
        code = getattr(self.apply, "__code__", None)
        return _code(code) if code else getattr(self.apply, "__qualname__", type(self.apply).__name__)


def _code(code: CodeType) -> str:
    """What a function does, as text: instructions, constants and names, nested functions included."""
    constants = [_code(c) if isinstance(c, CodeType) else repr(c) for c in code.co_consts]
    return f"{code.co_code.hex()} {constants} {code.co_names}"


class StepPipeline:
    def __init__(self, steps: Sequence[Step], folder: str, source: str):
        """``source`` names the input data; change it when the input changes."""
        self.steps, self.folder, self.source = list(steps), folder.rstrip("/"), source
        self.computed: list[str] = []

    def keys(self) -> list[str]:
        key, out = self.source, []
        for step in self.steps:
            text = json.dumps([key, step.name, step.mark(), step.settings], sort_keys=True, default=str)
            key = hashlib.md5(text.encode()).hexdigest()
            out.append(key)
        return out

    def manifest(self, spark: SparkSession) -> dict[str, str]:
        """key -> path of the tables that are published and not dropped; a few rows per step."""
        try:
            rows = spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        newest = Window.partitionBy("key").orderBy(F.desc("at"))
        rows = rows.withColumn("n", F.row_number().over(newest)).where("n = 1 AND kept")
        return {r.key: r.path for r in rows.collect()}

    def _note(self, spark: SparkSession, rows: list[tuple[str, str, str, bool]]) -> None:
        table = spark.createDataFrame(rows, "step string, key string, path string, kept boolean")
        table.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def run(self, df: DataFrame) -> DataFrame:
        """Start from the last kept step and write every later one."""
        spark, keys = df.sparkSession, self.keys()
        kept = self.manifest(spark)
        self.computed = []
        start = 0
        for i in reversed(range(len(keys))):
            if keys[i] in kept:
                start, df = i + 1, spark.read.parquet(kept[keys[i]])
                break
        for step, key in list(zip(self.steps, keys))[start:]:
            path = f"{self.folder}/{step.name}-{uuid.uuid4().hex}"
            step.apply(df, **step.settings).write.parquet(path)
            self._note(spark, [(step.name, key, path, True)])
            df = spark.read.parquet(path)
            self.computed.append(step.name)
        return df

    def clean(self, spark: SparkSession) -> list[str]:
        """Drop the published tables that these steps do not name; returns their paths.

        A table leaves the manifest before its files go, so no later run finds half a table.
        """
        named = set(self.keys())
        old = {k: p for k, p in self.manifest(spark).items() if k not in named}
        if old:
            self._note(spark, [("", key, path, False) for key, path in old.items()])
            for path in old.values():
                remove(path)
        return sorted(old.values())
