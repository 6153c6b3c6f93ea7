"""The append feeds as Structured Streaming.

Every function takes and returns a streaming DataFrame; event time must be a
``timestamp`` (cast NTZ columns first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mediasift.plans.results import job_status
from mediasift.session import written


def read_feed(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream with a fixed schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.load(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, partition: str | None = None) -> StreamingQuery:
    """Append what is new to Parquet, then stop; the checkpoint makes it exactly-once."""
    w = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (w.partitionBy(partition) if partition else w).start()


def tumbling_bitrate(stream: DataFrame, keys: Sequence[str], ts: str, size: str, window: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """R2: bits per window; rows older than the watermark are dropped."""
    g = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, window).alias("w"))
    return g.agg((F.sum(size) * 8).alias("bits"), F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "bits", "n")


def sliding_mean(stream: DataFrame, keys: Sequence[str], ts: str, value: str, window: str = "40 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Live form of the rolling mean."""
    g = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, window, slide).alias("w"))
    return g.agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "n")


def merge_alerts(stream: DataFrame, keys: Sequence[str], ts: str, kind: str, metric: str, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Alerts of one type merged while the gap stays below ``gap``.

    The session is per type, so an alert of another type in between does not
    split it (the batch merge in global start order does).
    """
    g = stream.withWatermark(ts, late).groupBy(*keys, kind, F.session_window(ts, gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n_merged"), F.avg(metric).alias("mean_metric"), F.min(ts).alias("start"), F.max(ts).alias("end")).drop("w")


def drop_repeats(stream: DataFrame, ts: str, content_hash: str, ttl: str = "24 hours") -> DataFrame:
    """First arrival per content hash inside the time to live."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([content_hash])


LEDGER_KEY = ["job_id", "state", "t", "seq"]


def upsert_jobs(stream: DataFrame, path: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """Job events merged by key into a ledger of ``parts`` key-hash partitions.

    A batch reads only the partitions that its jobs hash to, as the partition filter of the scan, and rewrites those
    (dynamic overwrite); one row per job, state, time and number stays, whoever wrote it. So a replayed batch changes
    nothing, and queries with own checkpoints add to one ledger, one after the other: two at once
    would each keep what the other has not yet written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(LEDGER_KEY).withColumn("part", F.pmod(F.xxhash64("job_id"), F.lit(parts)).cast("int"))
        new = written(new, "jobs")
        touched = sorted(r.part for r in new.select("part").distinct().collect())  # at most ``parts`` numbers
        if not touched:
            return
        try:
            old = ledger(spark, path).filter(F.col("part").isin(touched))
        except AnalysisException:  # no ledger yet
            old = None
        both = new if old is None else old.select(new.columns).unionByName(new).dropDuplicates(LEDGER_KEY)
        # what is overwritten is also read: the merged rows are written aside first
        merged = written(both.repartition(min(parts, len(touched)), "part"), "merged")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a ledger with their partition."""
    return spark.read.option("basePath", path).parquet(path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Current status of every job."""
    return job_status(ledger(spark, path), ["job_id"], "state", "t", "seq")
