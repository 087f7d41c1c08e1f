"""Session defaults, the shared folder, and the durable cut used between expensive stages."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "lexweave", **extra: str) -> SparkSession:
    """A session with the defaults the operators assume; `master` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: What a task reads of a table or takes of a shuffle at most, in bytes, where rows can be cut so.
TASK_BYTES = 16 << 20
#: Bytes of the tables for each partition that a shuffle begins with; adaptive execution puts small ones together.
SHUFFLE_SHARE = 4 << 20


def in_bytes(size: str) -> int:
    """A size setting such as 64MB, 16m or 1048576b."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def fit_tasks(spark: SparkSession, size: int) -> None:
    """Let the number of tasks grow with the `size` of the tables in bytes, not the rows of a task.

    A fixed number of shuffle partitions makes each as large as the input wants it. Smaller settings stay as they are.
    """
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
        if in_bytes(spark.conf.get(name)) > TASK_BYTES:
            spark.conf.set(name, f"{TASK_BYTES}b")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHUFFLE_SHARE)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: `spark.checkpoint.dir`. Without it there is nowhere to cut a plan: an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint `df` in the shared folder: computed once, and a lost executor costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: a checkpoint that is compressed and read by column, without its partitioning."""
    folder = fresh_folder(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
