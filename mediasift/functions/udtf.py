"""Table functions for SQL users, as SQL functions that run in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

FRAMES = """CREATE OR REPLACE TEMPORARY FUNCTION frames(signal ARRAY<DOUBLE>, width INT, hop INT)
RETURNS TABLE(win BIGINT, samples ARRAY<DOUBLE>)
RETURN SELECT CAST(i AS BIGINT), slice(signal, i * hop + 1, width)
FROM (SELECT explode(sequence(0, floor((size(signal) - width) / hop))) AS i WHERE size(signal) >= width)"""


def register(spark: SparkSession) -> None:
    """Make ``frames(signal, width, hop)``, overlapping windows of one array, available to ``spark.sql``."""
    spark.sql(FRAMES)
