"""Findings of the video modules from nested sub-results, one query per module, on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediasift.operators.subresults import subresult_findings
from mediasift.plans.bindings import SERIES, series
from mediasift.plans.registry import R, query, tidy

SUBS = f"""{SERIES}, ht AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY t, tie) AS r FROM series WHERE x > 120),
fst AS (SELECT k, list(t ORDER BY t) AS a FROM ht WHERE r <= 7 GROUP BY k),
g0 AS (SELECT k, count(*) AS n, least(1.0, stddev_pop(x)/avg(x)*0.6) AS s, least(1.0, avg(m)/97) AS q, count(CASE WHEN x > 120 THEN 1 END)/CAST(count(*) AS DOUBLE) AS fr, max(x)/4 AS mz,
 min(CASE WHEN x > 120 THEN t END) AS hs, max(CASE WHEN x > 120 THEN t END) AS he, min(CASE WHEN m > 80 THEN t END) AS ks, max(CASE WHEN m > 80 THEN t END) AS ke FROM series GROUP BY k),
z AS (SELECT g0.*, a FROM g0 LEFT JOIN fst ON g0.k=fst.k)"""


def subresults(spark, d) -> DataFrame:
    """One row per asset with a struct column per sub-result; hit lists are cut to seven before they are gathered."""
    c = F.col
    s = series(spark, d)
    first = s.filter("x > 120").withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("t", "tie"))).filter("r <= 7")
    first = first.groupBy("k").agg(F.array_sort(F.collect_list("t")).alias("a"))
    at = lambda f, cond: f(F.when(cond, c("t")))
    g = s.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.least(F.lit(1.0), F.stddev_pop("x") / F.avg("x") * 0.6).alias("s"), F.least(F.lit(1.0), F.avg("m") / 97).alias("q"),
        (F.count(F.when(c("x") > 120, 1)) / F.count(F.lit(1))).alias("fr"), (F.max("x") / 4).alias("mz"),
        at(F.min, c("x") > 120).alias("hs"), at(F.max, c("x") > 120).alias("he"), at(F.min, c("m") > 80).alias("ks"), at(F.max, c("m") > 80).alias("ke"),
    ).join(first, "k", "left")
    codes = lambda **on: F.array_compact(F.array(*[F.when(cond, name) for name, cond in on.items()])).alias("signals")
    times = lambda name, *cols: F.array_compact(F.array(*[c(x) for x in cols])).alias(name)
    k, n, s_, q, fr, mz = (c(x) for x in ("k", "n", "s", "q", "fr", "mz"))
    of = lambda r: k % r == 0
    segments = F.when(fr > 0, F.array(F.struct(c("hs").alias("start"), (c("hs") + 1).alias("end")), F.struct(c("he").alias("start"), (c("he") + 2).alias("end")))).alias("segments")
    parts = {
        "compression_bitrate": [codes(keyframes=of(2)), s_.alias("score"), c("a").alias("anomaly_t"), times("keyframe_t", "ks", "ke")],
        "compression_gop": [codes(irregular=F.lit(True)), q.alias("irregularity")],
        "compression_dct": [codes(grid=of(3), periodicity=of(3)), s_.alias("score")],
        "temporal_duplication": [codes(frozen=fr > 0, non_consecutive=of(4), other=of(5)), fr.alias("frozen_rate"), segments],
        "temporal_flow": [codes(spike=mz > 40, speed=k % 2 == 1, low_motion=of(7)), s_.alias("score")],
        "noise_prnu": [codes(strong=q > 0.5, temporal_drop=fr > 0, insufficient=n < 60), q.alias("score"), (n > 50).alias("reliable"), times("drop_t", "hs", "he")],
        "noise_pattern": [codes(periodic=q > 0.5, variance=s_ > 0.4, few_regions=of(5)), q.alias("frequency"), s_.alias("variance")],
        "lighting_illumination": [codes(shift=mz > 40, abrupt=s_ > 0.5, colour=k % 3 == 1), s_.alias("score"), times("spike_t", "hs", "he")],
        "lighting_shadow": [codes(direction=q > 0.4, ambient=of(2), highlight=of(3)), q.alias("direction"), s_.alias("ambient")],
        "audio_spectral": [codes(centroid=mz > 30, onset=of(2), profile=of(3), texture=of(5)), (mz * 1.5).alias("centroid_ratio"), s_.alias("score"), times("centroid_t", "hs"), times("rms_t", "he"), F.lit(None).cast("array<double>").alias("onset_t")],
        "audio_sync": [codes(mains=q > 0.5, duration=k % 2 == 1, start_offset=of(3), drift=of(7)), q.alias("mains"), s_.alias("duration"), fr.alias("start_offset")],
    }
    return g.select("k", *[F.struct(*cols).alias(name) for name, cols in parts.items()])


def _found(spark, d, module: str) -> DataFrame:
    rows = subresults(spark, d)
    rows = rows.select("k", *[c for c in rows.columns if c.startswith(module + "_")])
    return tidy(subresult_findings(rows, ["k"]).select("k", "type", "detail", "severity", "confidence", "uncertainty", "start_s", "end_s"))


def _sql(*rows: tuple) -> str:
    """One select per (type, detail, condition, severity, confidence, uncertainty, start, end)."""
    one = lambda ty, detail, cond, sev, conf, unc, start="NULL", end="NULL": (
        f"SELECT k, '{ty}' AS type, '{detail}' AS detail, {sev} AS severity, {R(conf)} AS confidence, {R(unc)} AS uncertainty, {R(start)} AS start_s, {R(end)} AS end_s FROM z WHERE {cond}"
    )
    return f"WITH {SUBS} " + " UNION ALL ".join(one(*r) for r in rows)


_HITS = "SELECT k, 'bitrate_anomaly' AS type, CAST(NULL AS VARCHAR) AS detail, CASE WHEN s > 0.6 THEN 'high' ELSE 'medium' END AS severity, " + f"{R('least(0.85, s+0.1)')} AS confidence, {R('0.15')} AS uncertainty, {R('u')} AS start_s, {R('NULL')} AS end_s FROM (SELECT k, s, unnest(list_slice(a, 1, 5)) AS u FROM z)"


@query(_sql(
    ("unexpected_keyframes", "keyframes", "k%2=0 AND ks IS NOT NULL", "'high'", "0.68", "0.12", "ks", "ke"),
    ("irregular_gop", "irregular", "q > 0.45", "'medium'", "q*0.85", "0.18"),
    *[("double_compression", s, "k%3=0", "CASE WHEN s > 0.7 THEN 'high' WHEN s > 0.45 THEN 'medium' ELSE 'low' END", "s", "0.18") for s in ("grid", "periodicity")],
) + " UNION ALL " + _HITS)
def q_subresult_compression(spark, d):
    return _found(spark, d, "compression")


@query(_sql(
    ("frame_duplication", "frozen", "fr > 0", "CASE WHEN fr > 0.05 THEN 'high' ELSE 'low' END", "CASE WHEN fr > 0.05 THEN least(0.9, 0.5+fr*2) ELSE 0.35 END", "0.08", "hs", "he+2"),
    ("frame_duplication", "non_consecutive", "k%4=0", "'medium'", "0.6", "0.08", "hs", "he+2"),
    ("frame_duplication", "other", "k%5=0", "'low'", "0.35", "0.08", "hs", "he+2"),
    ("flow_discontinuity", "spike", "mz > 40", "'high'", "greatest(0.15, least(0.8, s+0.1))", "0.15"),
    ("flow_discontinuity", "speed", "k%2=1", "'medium'", "greatest(0.15, s)", "0.15"),
    ("flow_discontinuity", "low_motion", "k%7=0", "'low'", "0.3", "0.15"),
))
def q_subresult_temporal(spark, d):
    return _found(spark, d, "temporal")


_REL = "CASE WHEN n > 50 THEN 0.18 ELSE 0.30 END"


@query(_sql(
    ("fingerprint_anomaly", "strong", "q > 0.5", "'high'", "greatest(0.1, least(0.85, q+0.1))", _REL),
    ("fingerprint_anomaly", "temporal_drop", "fr > 0", "'medium'", "greatest(0.1, q)", _REL, "hs", "he"),
    ("fingerprint_anomaly", "insufficient", "n < 60", "'low'", "0.25", _REL),
    ("noise_pattern", "periodic", "q > 0.5", "'high'", "greatest(0.15, q)", "0.2"),
    ("noise_pattern", "variance", "s > 0.4", "'medium'", "greatest(0.15, s)", "0.2"),
    ("noise_pattern", "few_regions", "k%5=0", "'low'", "0.3", "0.2"),
))
def q_subresult_noise(spark, d):
    return _found(spark, d, "noise")


@query(_sql(
    ("illumination_anomaly", "shift", "mz > 40", "'high'", "greatest(0.1, least(0.8, s+0.1))", "0.2", "hs", "he"),
    ("illumination_anomaly", "abrupt", "s > 0.5", "'medium'", "s", "0.2", "hs", "he"),
    ("illumination_anomaly", "colour", "k%3=1", "'low'", "0.3", "0.2", "hs", "he"),
    ("shadow_anomaly", "direction", "q > 0.4", "'medium'", "q", "0.22"),
    ("shadow_anomaly", "ambient", "k%2=0", "'medium'", "greatest(0.1, s)", "0.22"),
    ("shadow_anomaly", "highlight", "k%3=0", "'low'", "0.3", "0.22"),
))
def q_subresult_lighting(spark, d):
    return _found(spark, d, "lighting")


@query(_sql(
    ("spectral_anomaly", "centroid", "mz > 30", "CASE WHEN mz*1.5 >= 60 THEN 'high' ELSE 'medium' END", "CASE WHEN mz*1.5 >= 60 THEN least(0.85, 0.5+mz*1.5/200) ELSE greatest(0.1, s) END", "0.18", "hs", "he"),
    ("spectral_anomaly", "onset", "k%2=0", "'medium'", "least(0.7, s+0.1)", "0.18", "hs", "he"),
    ("spectral_anomaly", "profile", "k%3=0", "'medium'", "greatest(0.1, s)", "0.18", "hs", "he"),
    ("spectral_anomaly", "texture", "k%5=0", "'low'", "0.3", "0.18", "hs", "he"),
    ("sync_anomaly", "mains", "q > 0.5", "'high'", "q", "0.15"),
    ("sync_anomaly", "duration", "k%2=1", "'medium'", "greatest(0.1, s)", "0.15"),
    ("sync_anomaly", "start_offset", "k%3=0", "'medium'", "greatest(0.1, fr)", "0.15"),
    ("sync_anomaly", "drift", "k%7=0", "'low'", "0.25", "0.15"),
))
def q_subresult_audio(spark, d):
    return _found(spark, d, "audio")
