"""Session helpers: settings, durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Most rows of one key that a single task is asked to order (setting below).
BLOCK_ROWS_KEY = "mediasift.block.rows"
BLOCK_ROWS_DEFAULT = 2_000_000


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own.

    Its checkpoint folder is ``MEDIASIFT_SHARED`` or a new one in the temporary folder: one
    machine, so driver and executor threads see the same files.
    """
    shared = os.environ.get("MEDIASIFT_SHARED") or tempfile.mkdtemp(prefix="mediasift-shared-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("mediasift")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", shared)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def block_rows(spark: SparkSession) -> int:
    """Row bound above which one key is split over several tasks."""
    return int(spark.conf.get(BLOCK_ROWS_KEY, str(BLOCK_ROWS_DEFAULT)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session (one machine) gets a new temporary folder; a cluster has to set it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="mediasift-shared-")
    sc.setCheckpointDir(shared)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: no lineage, no second run."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
