"""Steps that several operators read: written once to the shared folder, so that plans start at the file.

A frame used a dozen times would otherwise be planned and computed a dozen times, and a lost executor would
cost all of it again.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_outside: list[str] = []
_written: ContextVar[list[str]] = ContextVar("written", default=_outside)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver runs from another folder."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session gets a temporary folder and a cluster an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="foldscale-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    context.setCheckpointDir(root)
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back; readers prune its columns."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _written.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input, never a broadcast: Spark estimates a side from compressed columns of
    its files, before rows are dealt out to cells, and would gather what has many times that size on the driver."""
    return left.join(right.hint("merge"), on, how)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    while paths:
        path = context._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Remove what ``stored`` wrote outside of ``scratch``; frames that still read it must be done by then."""
    _remove(spark, _outside)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What ``stored`` writes inside the block is removed at its end; results must be written by then."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        _remove(spark, paths)
