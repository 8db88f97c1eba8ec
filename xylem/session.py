"""Session helpers shared by the library."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where that is unset and all tasks run in this process, as in tests, a local one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_xylem_shared", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = spark._xylem_shared = "file://" + tempfile.mkdtemp(prefix="xylem-")
    return where.rstrip("/")


_OPEN: list[Workspace] = []


def release() -> None:
    """Remove the tables of all workspaces so far: for when no result over them is read any more."""
    while _OPEN:
        work = _OPEN.pop()
        work.released = True
        if work.spark.sparkContext._jsc is not None and work.owner == os.getpid():
            work.remove(work.root)


@atexit.register
def _at_end() -> None:
    try:
        release()
    except (Py4JError, OSError):  # the session has ended before
        _OPEN.clear()


class Workspace:
    """Intermediate tables written to the shared folder, so that lineage ends there and a lost executor costs one task, not the job.

    Results are lazy and read them, so they stay until ``release`` or the end of the process.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.owner = spark, os.getpid()
        self.root = f"{shared_dir(spark)}/xylem-{name}-{uuid.uuid4().hex}"
        self.released = False
        self._n = 0
        _OPEN.append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return it reread."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._xylem_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a saved table that nothing reads any more."""
        if path := getattr(df, "_xylem_path", None):
            self.remove(path)

    def remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
