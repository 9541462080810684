"""Spark session and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "weftlake", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC, AQE and Arrow on; cluster settings already present win."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the cluster names none (local tests) a temporary one is set.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftlake-"))
        root = sc.getCheckpointDir()
    path = f"{root.rstrip('/')}/weftlake-{sc.applicationId}"
    jvm = sc._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows of a task whose rows are costly.
TASK_ROWS = 4000


def spread(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt to tasks of about ``rows`` rows: Spark makes tasks by bytes, and a few MB of short rows would all be one.

    For rows that are cheap to read and costly to work on; ``df`` is counted first.
    """
    return df.repartition(max(1, -(-df.count() // rows)))


def stash(df: DataFrame, name: str = "stash") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: lost executors re-read files rather than recompute, and
    columns that a later step does not need are not read again.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`stash` that no later step reads."""
    spark = df.sparkSession
    sc = spark.sparkContext
    root = shared_root(spark)
    for f in df.inputFiles()[:1]:
        folder = f.rsplit("/", 1)[0]
        if root.split(":", 1)[-1].lstrip("/") in folder:
            p = sc._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
