"""A session with the settings that the operators assume."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """ANSI arithmetic, UTC, adaptive execution with skew handling, Arrow transfer.

    On a cluster, set ``shuffle_partitions`` so that one partition holds about
    100-200 MB of shuffled data; adaptive execution merges what is smaller.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName("lociq")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a cluster's tables go
    below its warehouse, which driver and executors share; only a session whose
    executors are threads of this process uses a temporary folder, removed at exit.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lociq-scratch"
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="lociq-")
            atexit.register(shutil.rmtree, _LOCAL[context.applicationId], ignore_errors=True)
        root = _LOCAL[context.applicationId]
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder now, for results that are small next to what they are made of and are read more than once."""
    path = f"{scratch_root(df.sparkSession)}/lociq/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
