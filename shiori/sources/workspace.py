"""Tables written between stages, in the folder shared by the whole cluster."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
import weakref
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Removes the shuffle files of a query when it has ended.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_lock = threading.Lock()
_writing: dict[str, list] = {}
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a scratch folder only for local sessions without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shiori-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/shiori/{label}-{uuid.uuid4().hex}"


def together(*steps: Callable[[], Any]) -> list[Any]:
    """Run independent steps, each starting jobs of its own, side by side; their results in order."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [running.result() for running in [pool.submit(step) for step in steps]]


@contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """The setting is put back when the last of the writes that run side by side has ended."""
    key = str(spark.sparkContext.applicationId)
    with _lock:
        running = _writing.setdefault(key, [0, None])
        if not running[0]:
            running[1] = spark.conf.get(CLEAN_SHUFFLES)
            spark.conf.set(CLEAN_SHUFFLES, "true")
        running[0] += 1
    try:
        yield
    finally:
        with _lock:
            running[0] -= 1
            if not running[0]:
                spark.conf.set(CLEAN_SHUFFLES, running[1])


def materialise(df: DataFrame, label: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write once and read back: later uses do not recompute, and a lost executor costs no lineage.

    The planner then knows the real size, so it broadcasts the table only when it is small enough. Shuffle files of the
    write go when it has ended: nothing reads them again. ``discard`` removes the table itself.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with _clean_shuffles(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _folders[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the folders of materialised tables; call it when no query that still has to run reads them.

    Only the DataFrame that ``materialise`` returned has a folder: others are left alone, and a table can be discarded twice.
    """
    for table in tables:
        if path := _folders.pop(table, None):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
