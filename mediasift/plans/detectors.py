"""Detectors as functions from tables to check rows, run together for all assets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.operators import series as W
from mediasift.operators import stats as A
from mediasift.operators.graph import union_findings
from mediasift.operators.stats import IDLE_CONFIDENCE, module_score, pick


@dataclass(frozen=True)
class Detector:
    """``checks(series, keys)`` returns finding rows; assets with fewer than ``min_rows`` rows are skipped."""

    name: str
    min_rows: int
    checks: Callable[[DataFrame, Sequence[str]], DataFrame]


REGISTRY: dict[str, Detector] = {}


def detector(name: str, min_rows: int = 8):
    def add(fn):
        REGISTRY[name] = Detector(name, min_rows, fn)
        return fn

    return add


def run_detectors(series: DataFrame, keys: Sequence[str], names: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, findings) of all assets. A bad or short asset becomes a skipped row, never an error."""
    k = list(keys)
    use = [REGISTRY[n] for n in names or REGISTRY]
    sizes = series.groupBy(*k).agg(F.count("x").alias("_n"))
    found = union_findings(*[d.checks(series, k).join(sizes.filter(F.col("_n") >= d.min_rows).select(*k), k, "left_semi") for d in use])
    scored = module_score(found, k, "module", "score", "weight", "severity")
    want = sizes.select(*k, "_n", F.explode(F.array(*[F.struct(F.lit(d.name).alias("module"), F.lit(d.min_rows).alias("_min")) for d in use])).alias("d")).select(*k, "_n", "d.*")
    j = want.join(scored, [*k, "module"], "left")
    out = j.select(
        *k, "module", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("confidence", pick(F.col("module"), IDLE_CONFIDENCE, 0.50)).alias("confidence"), (F.col("_n") < F.col("_min")).alias("skipped"),
        F.lit(None).cast("double").alias("snr_db"), F.lit(False).alias("enf_present"), F.coalesce("n_checks", F.lit(0)).alias("n_checks"),
    )
    return out, found


@detector("noise", 8)
def noise_checks(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spectral-balance series: variation and persistent change. Columns t, tie, x, lossy (optional), ref, warmup."""
    from mediasift.functions.exprs import explode_rules, finding

    ref, warm = 3.0, 0.5
    cp = W.change_point(series, keys, ["t", "tie"], "x", ref, warm)
    j = cp.join(A.variation(series, keys, "x"), list(keys))
    c = F.col
    return explode_rules(j, keys, [
        F.when(c("cv") >= 0.15, finding("noise", "tilt", "high", score=F.least(F.lit(0.85), 0.55 + (c("cv") - 0.15) * 0.5), weight=1.5))
        .when(c("cv") >= 0.04, finding("noise", "tilt", "medium", score=0.35 + (c("cv") - 0.04) * 1.5, weight=1.5)),
        F.when(c("change_t").isNotNull(), finding("noise", "change_point", "high", score=F.least(F.lit(0.8), 0.4 + F.least(c("max_z"), F.lit(20.0)) / 40), weight=2.0, start=c("change_t"))),
    ])


@detector("reverberation", 8)
def room_checks(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flatness series: change strength backed by the half difference."""
    from mediasift.functions.exprs import explode_rules, finding

    cp = W.change_point(series, keys, ["t", "tie"], "x", 3.0, 1.0)
    j = cp.join(A.half_compare(series, keys, ["t", "tie"], "x"), list(keys)).join(A.variation(series, keys, "x"), list(keys))
    c = F.col
    z = c("max_z")
    return explode_rules(j, keys, [
        F.when(c("change_t").isNotNull() & (z >= 8), finding("reverberation", "change", "high", F.when(c("half_diff") >= 0.30, 0.8).otherwise(0.6), F.least(F.lit(0.8), 0.55 + F.least(z - 8, F.lit(20.0)) / 60), 2.0))
        .when(c("change_t").isNotNull() & (z >= 4), finding("reverberation", "change", "medium", 0.5, 0.35 + (z - 4) / 20, 2.0)),
        F.when((c("cv") >= 0.015) & (z < 8), finding("reverberation", "flatness", "low", 0.4, 0.18, 0.5)),
    ])
