"""Session helpers: a local session for tests and benches, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "strandline", cpus: int | None = None, partitions: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("STRANDLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset on a local master (tests, local runs) a temporary folder of this machine is made and set; a
    cluster without it is refused, as its executors would write where no other can read.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandline-"))
    return sc.getCheckpointDir()


SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is run within are deleted as soon as it has ended, not when the driver collects its garbage."""
    before = spark.conf.get(SWEEP)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table into the shared folder and go on from that table.

    This cuts the lineage as ``checkpoint()`` does, at a fraction of its disk; the shuffles that made the table go at
    once. The table is deleted when the driver ends, or earlier by ``drop`` or ``release``.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    with swept(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that no result reads any more."""
    for table in tables:
        spark = table.sparkSession
        _paths[id(spark.sparkContext)][1].remove(table._cut)
        _delete(spark, table._cut)


_paths: dict[int, tuple[SparkSession, list[str]]] = {}


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the driver ends, or earlier by ``release``."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _paths.setdefault(id(spark.sparkContext), (spark, []))[1].append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what this application wrote into the shared folder; results that still read it must be used up."""
    _, paths = _paths.pop(id(spark.sparkContext), (None, []))
    for p in paths:
        _delete(spark, p)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _release_all() -> None:
    for spark, _ in list(_paths.values()):
        try:
            if spark.sparkContext._jsc is not None:
                release(spark)
        except Exception:  # noqa: BLE001 - the driver is ending, there may be no JVM any more
            pass
