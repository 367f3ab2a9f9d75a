"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "kinfold", cpus: int | str = "*", **conf) -> SparkSession:
    """A local session with the settings the engine expects (UTC, adaptive execution)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only in a local session where that is unset, as in
    tests, a temporary folder is made and set; on a cluster that would be another folder for each executor, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the executors of {master} share")
        named = "file://" + tempfile.mkdtemp(prefix="kinfold-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_settled: list[str] = []


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from files that
    outlive any executor, and lineage is cut there. ``sweep`` deletes what is left at the end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _settled.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete what ``settle`` wrote, once nothing reads it any more."""
    path = getattr(df, "_settled_at", None)
    if path is None:
        return
    _delete(df.sparkSession, path)
    if path in _settled:
        _settled.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is settled inside is deleted at the end, except the tables given to the function that this yields."""
    before, kept = set(_settled), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, "_settled_at", None))
        return df

    try:
        yield keep
    finally:
        for path in [p for p in _settled if p not in before and p not in kept]:
            _delete(spark, path)
            _settled.remove(path)


def sweep(spark: SparkSession) -> int:
    """Delete every settled table of this driver; call it when no result that reads them is needed any more."""
    paths = list(_settled)
    _settled.clear()
    for path in paths:
        _delete(spark, path)
    return len(paths)


class Versioned:
    """A table as numbered versions in a folder; the current one is named by the last complete version."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path(self.path)
        self._fs, self._Path = self._path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.Path

    def version(self) -> int:
        if not self._fs.exists(self._path):
            return -1
        done = [s.getPath().getName() for s in self._fs.listStatus(self._path) if self._fs.exists(self._Path(s.getPath(), "_SUCCESS"))]
        return max((int(n[1:]) for n in done if n.startswith("v")), default=-1)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], self.schema) if v < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v}")

    def replace(self, df: DataFrame, keep: int = 2) -> None:
        """Write the next version, then drop the oldest: readers of the current one aren't disturbed."""
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{v}")
        if v >= keep:
            self._fs.delete(self._Path(f"{self.path}/v{v - keep}"), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
