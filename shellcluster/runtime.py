"""Session plumbing shared by all operators: shipping code to workers and scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch where the session has Spark's default of 10,000: of long texts that many are too much for a worker.
BATCH_ROWS = 2000

#: What workers drop when a task ends: functions of modules that keep tables between batches.
at_release: list[Callable[[], None]] = []
_shipped: set[str] = set()
_own_dirs: dict[str, str] = {}
_scopes: dict[str, list[str]] = {}
_roots: set[str] = set()
_scope = contextvars.ContextVar("scope", default="")


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once per application, so no node needs it installed."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="shellcluster-"), "shellcluster_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("shellcluster", os.path.relpath(path, root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, on the cluster's file system where it names none.

    Where that is unset, a local session gets a temporary folder; on a cluster there would be none that
    executors share, so it raises.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if sc.applicationId not in _own_dirs:
            _own_dirs[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="shellcluster-shared-")
        return _own_dirs[sc.applicationId]
    path = sc._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it belongs to the current scope."""
    root = f"{shared_dir(spark).rstrip('/')}/shellcluster/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_delete_at_exit, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    _scopes.setdefault(_scope.get(), []).append(path)
    return path


def _delete_at_exit(jvm, conf, root: str) -> None:
    # results may be read until then; a driver that dies leaves its folder, as it leaves its checkpoints
    with contextlib.suppress(Exception):
        _delete(jvm, conf, root)


def delete(spark: SparkSession, path: str) -> None:
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def _delete(jvm, conf, path: str) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow; a worker gives memory back when its task ends, as it may next serve another operator."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


def release() -> None:
    """Drops what this worker could make anew at little cost, and returns freed memory to the system."""
    for drop in at_release:
        drop()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Scratch tables made inside belong to name. Entering a scope deletes what an earlier one of that name left."""
    for path in _scopes.pop(name, []):
        delete(spark, path)
    token = _scope.set(name)
    try:
        yield
    finally:
        _scope.reset(token)
