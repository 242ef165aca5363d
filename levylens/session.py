"""What a session needs for this package's Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What Python workers are started with: allocations of over 4 MB go back to the system when freed, so an idle worker holds little.
WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "MALLOC_ARENA_MAX": "2"}
#: Bytes of an Arrow batch, as rows of any length are sent in them.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def bind(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package wherever the driver was started, and bounds what they hold; settings that the session has stay."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if top not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([top, *filter(None, paths)])
    for name, value in WORKER.items():
        spark.sparkContext.environment.setdefault(name, value)
    if BATCH not in spark.conf.getAll:
        spark.conf.set(BATCH, BATCH_BYTES)
    return spark


def _shared(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode one of the driver's where that is unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_levylens_shared", None)
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="levylens-")
        sc._levylens_shared = root
    return root.rstrip("/")


def fresh(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    return f"{_shared(spark)}/kept-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept below the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt anew if it is read from fewer files than there are cores, so that work in Python has them all; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def kept(df: DataFrame) -> DataFrame:
    """df, written once below the shared folder by columns, so what reads it reads only the columns it needs."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
