"""Session set-up and the shared folder that materialised steps are written to."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def local_session(cores: int | str = 8, memory: str = "16g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rowassay")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local master may go without that setting: every "executor" then lives on this
    machine, so a fresh temporary folder is as good as a shared one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_dirs.setdefault(context.applicationId, tempfile.mkdtemp(prefix="rowassay-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet, inside the shared folder."""
    return os.path.join(shared_dir(spark), spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_METHODS = "spark.sql.codegen.hugeMethodLimit"


@contextlib.contextmanager
def _set(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def compiled(spark: SparkSession):
    """Where wide expressions are evaluated: generated methods stay within the 8,000 bytes that the JVM compiles.

    By Spark's own default a stage whose method is longer is still one method, which the JVM then interprets, row by row. With
    this limit Spark evaluates such a stage operator by operator, in methods that are short enough.
    """
    return _set(spark, _METHODS, "8000")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage, survives lost executors, and has an exact size, which is
    what lets Spark decide by itself whether a later join may broadcast it. The shuffles behind it
    are no longer needed then, so Spark is told to remove their files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(table: DataFrame) -> None:
    """Remove the files of a table from ``materialize`` once everything read from it has been written itself."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
