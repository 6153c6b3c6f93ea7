"""All detectors on the driver's event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.plans.bindings import series
from mediasift.plans.detector_set import SPECS, run_all
from mediasift.plans.registry import query, tidy

# measures read from the value column; the others from the small feature
FROM_VALUE = ("mains_snr", "rms", "edge_steepness", "sub_bass", "spectrum", "frame_size", "difference", "residual", "light", "centroid")


@query()
def q_run_detectors(spark, d):
    x, m = F.col("x"), F.col("m")
    scale = {"mains": m / 1000, "edge_hz": m * 90, "tag_risk": m / 100, "block_score": m / 100, "similarity": m / 100, "residual_corr": m / 100, "av_offset": m / 100}
    measures = {n: scale.get(n, x if n in FROM_VALUE else m) for s in SPECS.values() for n in s.needs}
    out = run_all(series(spark, d), ["k"], ["t", "tie"], measures, lossy=F.col("k") % 3 == 0, kbps=F.lit(128), nyquist=F.lit(8000))
    return tidy(out.select("k", "family", "module", "score", "confidence", "n_checks", "n_high", "skipped", "error"))
