"""Session set-up and the shared folder for tables that cut lineage."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Tables that cut lineage are written once and read a few times: what they weigh counts more than how fast they pack.
CODEC = "zstd"

_shared: dict[str, str] = {}
_local_dirs: list[tempfile.TemporaryDirectory] = []


def build_session(app: str = "duelframe", cores: str = "*", **conf: str) -> SparkSession:
    """Session for local runs and tests; on a cluster the submitter configures Spark."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        # small local tables still deserve one task per core
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own; on a cluster a
    machine-local folder would be lost with its machine.
    """
    app = spark.sparkContext.applicationId
    if app not in _shared:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            scratch = tempfile.TemporaryDirectory(prefix="duelframe-", ignore_cleanup_errors=True)
            _local_dirs.append(scratch)
            root = scratch.name
            spark.sparkContext.setCheckpointDir(root)
        _shared[app] = f"{root.rstrip('/')}/duelframe/{app}"
    return _shared[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def spool(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and scan it back.

    A written table survives the loss of executors, is read column by column,
    and fixes values (row positions, sampled ranges) that a recomputation
    could change.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path, compression=CODEC)
    return spark.read.schema(df.schema).parquet(path)


def ship(module: str) -> None:
    """Send a module's functions to Python workers by value, so that executors
    need no installed copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
