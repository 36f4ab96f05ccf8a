"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "fieldcast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC dates, AQE with skew handling).

    ``master`` is left to spark-submit on a cluster and given in tests and benches only.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        cores = master.partition("[")[2].rstrip("]") or "2"
        partitions = str(os.cpu_count() or 8) if cores == "*" else cores
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", partitions)
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared folder named by ``spark.checkpoint.dir``.

    Only an unset folder on a local master falls back to a temporary one; on a cluster a
    machine-local folder would lose the data with its machine, so that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldcast-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """Name of a fresh folder inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{prefix}-{uuid.uuid4()}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from the files.

    Lineage ends there, and the planner sees the table's true size: the small state of a
    late round is read as one partition and joined by broadcast, a large one is not.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a shuffle that one task should sort, join or aggregate.
ROWS = 1 << 21


def more_than_usual(spark: SparkSession, rows: int) -> bool:
    """Whether ``rows`` rows ask for more tasks than the session's number of shuffle partitions."""
    return -(-rows // ROWS) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_by_size(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` into as many partitions as ``rows`` rows ask for, so that a task's memory does not grow with them.

    Where the session's own number of partitions is enough it is left to that, and AQE may lower it.
    """
    return df.repartition(-(-rows // ROWS), *keys) if more_than_usual(df.sparkSession, rows) else df.repartition(*keys)
