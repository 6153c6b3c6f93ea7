"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.session import ensure_checkpoint_dir

# White space and word classes (regular-expression text).
SPACE = r"[\x20\x09-\x0D]+"
LICENSE_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null text has none."""
    return non_empty(F.split(F.coalesce(text, F.lit("")), SPACE))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it; see ``ensure_checkpoint_dir`` where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        ensure_checkpoint_dir(spark)
        root = spark.sparkContext.getCheckpointDir()
    return root


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Write once to the shared folder and read back: later steps don't recompute, lost executors lose nothing."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame) -> DataFrame:
    """A small result in at most two partitions a core, whatever the number of shuffle partitions: Hadoop's local
    file system starts a process for each file that is written, and the driver keeps a record of each task."""
    return df.coalesce(2 * max(1, df.sparkSession.sparkContext.defaultParallelism))


def few_by_hash(rows: DataFrame, h: str, want: int, n: int) -> DataFrame:
    """About ``4 * want`` of ``n`` rows, chosen by their hash column: what is then sorted and
    sent to the driver doesn't grow with the number of partitions."""
    share = min(1.0, 4.0 * want / max(1, n))
    return rows.filter(F.pmod(F.col(h), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
