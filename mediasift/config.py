"""Tunable thresholds, read from the environment and recorded with each run."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "MEDIASIFT_"

# Fixed values (P11): mains grids, fundamental and harmonic bands in Hz.
ENF_BANDS = {50: ((49.0, 51.0), (99.0, 101.0)), 60: ((59.0, 61.0), (119.0, 121.0))}


@dataclass(frozen=True)
class Settings:
    """Defaults of the published thresholds; any field can be set as MEDIASIFT_<NAME>."""

    audio_elevated: float = 0.35
    video_elevated: float = 0.30
    points_tampered: float = 80.0
    points_review: float = 30.0
    change_z: float = 4.0
    change_persist: int = 3
    bitrate_z: float = 2.5
    benford_mad: float = 0.15
    retention_hours: float = 24.0
    enf_grid: int = 50

    @classmethod
    def from_env(cls, env=os.environ) -> "Settings":
        out = {}
        for f in fields(cls):
            raw = env.get(PREFIX + f.name.upper())
            if raw is None:
                continue
            try:
                out[f.name] = type(f.default)(raw)
            except ValueError:
                pass  # an unreadable value keeps the default
        return cls(**out)

    def with_run(self, df: DataFrame, run_id: str) -> DataFrame:
        """Results tagged with the run and the settings they were made with."""
        pairs = [F.lit(x) for k, v in asdict(self).items() for x in (k, float(v))]
        return df.withColumn("run_id", F.lit(run_id)).withColumn("settings", F.create_map(*pairs))


def settings_table(spark: SparkSession, s: Settings) -> DataFrame:
    """One row per setting."""
    return spark.createDataFrame([(k, float(v)) for k, v in asdict(s).items()], "name string, value double")
