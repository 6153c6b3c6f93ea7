"""Views of the driver tables in the shapes the operators expect, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # the tables hold zone-less times that mean UTC
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def series(spark, d) -> DataFrame:
    """k, t (hours), tie, x, kind, m (small integer feature from props)."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("k"),
        (micros("ts") / F.lit(3.6e9)).alias("t"),
        F.col("event_id").alias("tie"),
        F.col("value").alias("x"),
        F.col("event_type").alias("kind"),
        F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).cast("bigint").alias("m"),
    )


SERIES = """series AS (SELECT user_id AS k, CAST(epoch_us(ts) AS DOUBLE)/CAST(3600000000 AS DOUBLE) AS t, event_id AS tie,
 value AS x, event_type AS kind, CAST(regexp_extract(props,'"k": *(-?[0-9]+)',1) AS BIGINT) AS m FROM events)"""


def frames(spark, d) -> DataFrame:
    """Frame metrics per asset: similarity, distance, quality and motion columns."""
    s = series(spark, d)
    ang = F.col("m") * F.lit(0.0628)
    return s.select(
        "k", "t", "tie", "x", "m",
        F.greatest(F.lit(0.0), 1 - F.col("x") / 150).alias("ssim"),
        (F.col("m") / F.lit(100.0)).alias("hist_dist"),
        (1 + F.col("m") / F.lit(20.0)).alias("blockiness"),
        (1 + F.col("x") / F.lit(40.0)).alias("noise"),
        (F.col("x") / F.lit(25.0) * F.cos(ang)).alias("vx"),
        (F.col("x") / F.lit(25.0) * F.sin(ang)).alias("vy"),
    )


FRAMES = SERIES + """, frames AS (SELECT k, t, tie, x, m, greatest(0.0, 1 - x/150) AS ssim, m/CAST(100 AS DOUBLE) AS hist_dist,
 1 + m/CAST(20 AS DOUBLE) AS blockiness, 1 + x/40 AS noise, x/25*cos(m*CAST(0.0628 AS DOUBLE)) AS vx,
 x/25*sin(m*CAST(0.0628 AS DOUBLE)) AS vy FROM series)"""


def lines(spark, d) -> DataFrame:
    """Packets per supplier in shipping order; ``seq`` makes the order total."""
    l = table(spark, d, "lineitem")
    return l.select(
        F.col("l_suppkey").alias("k"),
        (micros("l_shipdate") / F.lit(8.64e10)).alias("t"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("tie"),
        F.col("l_extendedprice").alias("size"),
        F.col("l_quantity").alias("qty"),
    )
