"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Tables of the workspaces that are open, the innermost last. A thread has workspaces of its own.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("workspaces", default=())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where none is set, a local master (tests) gets a new local folder; on a
    cluster that is an error, as machines would not find each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="spark-keelson-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str, owned: bool = True) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: what follows re-reads the files, so a lost executor costs no recomputation of ``df``. The
    innermost open ``workspace`` owns the table, unless ``owned`` is false; without one it stays until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keelson/{name}-{uuid.uuid4().hex}"
    if owned and (mine := _OPEN.get()):
        mine[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables that its thread materialised in it. What is still lazy then must have been written.
    Threads that are started in it own nothing of it."""
    mine: list[str] = []
    before = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        _OPEN.reset(before)
        for path in mine:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
