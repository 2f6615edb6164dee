"""Shared storage for intermediate results.

Everything that must survive the loss of an executor is written below the folder the
session names in ``spark.checkpoint.dir``. Only a local master may fall back to a
temporary folder of the machine, because there driver and executors share it.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None
#: Folders that this application has named and not removed.
_named: list[str] = []
_here = threading.local()
#: Spark's setting to delete the shuffle files of a query with its end; what it was, and an entry per writer at work.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_freeing: list[str | None] = []
_lock = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach."""
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="shelfline-")
    return _local_folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new sub-folder name; never reused, so nothing is overwritten."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _named.append(path)
    for open_ in getattr(_here, "scratch", ()):
        open_.append(path)
    return path


def remove(path: str) -> None:
    """Delete a folder, if it is there."""
    system, place = fs.FileSystem.from_uri(path)
    if system.get_file_info(place).type != fs.FileType.NotFound:
        system.delete_dir(place)


def clear(keep: Sequence[str] = ()) -> None:
    """Delete the folders that this application has named, but those of ``keep``.

    To be called once results are written elsewhere: a frame that still reads from one of them is lost.
    """
    drop([p for p in _named if p not in keep])


def drop(paths: Sequence[str]) -> None:
    """Delete folders that this application has named."""
    for path in paths:
        remove(path)
        with contextlib.suppress(ValueError):
            _named.remove(path)


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Delete at the end what this thread has named inside, but the folders put on the list."""
    if not hasattr(_here, "scratch"):
        _here.scratch = []
    named, keep = [], []
    _here.scratch.append(named)
    try:
        yield keep
    finally:
        # By identity: an outer list may be equal to this one.
        _here.scratch = [x for x in _here.scratch if x is not named]
        drop([p for p in named if p not in keep])


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``: fixes its rows and partitions and drops its lineage."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def _freed(spark: SparkSession) -> Iterator[None]:
    """Jobs that end inside delete their shuffle files; the setting is the session's, so the last thread to leave puts it back."""
    with _lock:
        if not _freeing:
            _freeing.append(spark.conf.get(_FREE, None))
            spark.conf.set(_FREE, "true")
        _freeing.append(None)
    try:
        yield
    finally:
        with _lock:
            _freeing.pop()
            if len(_freeing) == 1:
                before = _freeing.pop()
                if before is None:
                    spark.conf.unset(_FREE)
                else:
                    spark.conf.set(_FREE, before)


def stage(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    With ``by``, the table has a folder per value of these columns, so that a filter on them
    opens only its own folders.
    """
    return stage_at(fresh_path(df.sparkSession, label), df, by)


def stage_at(path: str, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``stage`` at a given place. What the job shuffled is deleted with its end, as only the table is read from then on."""
    with _freed(df.sparkSession):
        df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
