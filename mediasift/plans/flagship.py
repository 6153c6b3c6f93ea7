"""Flagship: series checks to detector scores to fused risk, one row per asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions.exprs import explode_rules, finding
from mediasift.operators import series as W
from mediasift.operators import stats as A
from mediasift.plans import results as RS
from mediasift.plans.bindings import SERIES, series
from mediasift.plans.fusion import fuse_audio
from mediasift.plans.q_series import REF_H, WARM_H
from mediasift.plans.q_stats import _conf
from mediasift.plans.registry import R, query, tidy


def score_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8 + W9 + A5 checks per asset, A20 module scores, F1 fusion, P9 band."""
    s, k, o = series(spark, sf_dir), ["k"], ["t", "tie"]
    cp = W.change_point(s, k, o, "x", REF_H, WARM_H, z_cut=3.0, persist=1).select("k", "max_z", "change_t")
    ab = W.abruptness(s, k, o, "x", points=((2, 0.0), (10, 1.0)), spike_multiple=4.0).select("k", "ratio", F.col("score").alias("ab_score"), "n_spikes")
    j = cp.join(ab, "k", "full").join(A.variation(s, k, "x"), "k", "full")
    c = F.col
    checks = explode_rules(j, k, [
        F.when(c("change_t").isNotNull(), finding("noise", "change_point", "high", score=F.least(F.lit(0.8), 0.4 + F.least(c("max_z"), F.lit(20.0)) / 40), weight=2.0, start=c("change_t"))),
        F.when(c("cv") > 0.9, finding("noise", "variation", "medium", score=F.least(F.lit(0.6), c("cv") * 0.4), weight=0.5)),
        finding("compression", "abruptness", F.when(c("ab_score") >= 0.5, "high").otherwise("low"), score=c("ab_score"), weight=1.0),
        F.when(c("n_spikes") > 0, finding("voice", "spikes", "medium", score=F.least(F.lit(0.9), 0.3 + 0.1 * c("n_spikes")), weight=1.0)),
        finding("enf", "level", "low", score=F.least(F.lit(1.0), c("std") / 120), weight=1.0),
    ])
    scores = A.module_score(checks, k, "module", "score", "weight", "severity", F.lit(False))
    scores = scores.withColumns({"skipped": F.lit(False), "snr_db": F.lit(None).cast("double"), "enf_present": F.lit(False)})
    fused = fuse_audio(scores, k)
    rs = RS.risk_score(c("fused"))
    return tidy(fused.select("k", "n_active", "base_score", "fused", "confidence", "verdict", "elevated_modules", rs.alias("risk_score"), RS.risk_band(rs).alias("risk_band")))


_W = "CASE module WHEN 'enf' THEN 0.30 WHEN 'noise' THEN 0.22 WHEN 'compression' THEN 0.18 ELSE 0.10 END"
_EL = "FILTER (WHERE s >= 0.35)"


@query(f"""WITH {SERIES}, i AS (SELECT *, row_number() OVER w - 1 AS i, sum(CASE WHEN t <= {REF_H} THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS nr, abs(x - lag(x) OVER w) AS d FROM series WINDOW w AS (PARTITION BY k ORDER BY t, tie)),
rs AS (SELECT k, avg(x) AS mu, stddev_pop(x) + 1e-6 AS sd FROM i WHERE t <= {REF_H} OR (nr < 3 AND i < 3) GROUP BY k),
cp AS (SELECT i.k, max(abs(x-mu)/sd) AS mz, min(CASE WHEN abs(x-mu)/sd > 3 AND t > {REF_H + WARM_H} THEN t END) AS ct, stddev_pop(x) AS sx, stddev_pop(x)/avg(x) AS cv, avg(d) AS md, max(d) AS mx FROM i JOIN rs ON i.k=rs.k GROUP BY i.k),
ab AS (SELECT cp.*, CASE WHEN mx/md <= 2 THEN 0.0 WHEN mx/md <= 10 THEN (mx/md-2)/8 ELSE 1.0 END AS sc, (SELECT count(*) FROM i WHERE i.k=cp.k AND i.d > cp.md*4) AS ns FROM cp),
ck AS (SELECT k, 'noise' AS module, least(0.8, 0.4+least(mz,20)/40) AS s, 2.0 AS w, 1 AS h FROM ab WHERE ct IS NOT NULL UNION ALL SELECT k,'noise',least(0.6,cv*0.4),0.5,0 FROM ab WHERE cv > 0.9
 UNION ALL SELECT k,'compression',sc,1.0,CASE WHEN sc >= 0.5 THEN 1 ELSE 0 END FROM ab UNION ALL SELECT k,'voice',least(0.9,0.3+0.1*ns),1.0,0 FROM ab WHERE ns > 0 UNION ALL SELECT k,'enf',least(1.0,sx/120),1.0,0 FROM ab),
ms0 AS (SELECT k, module, sum(s*w)/sum(w) AS s, count(*) AS n_checks, sum(h) AS nh FROM ck GROUP BY k, module),
ms AS (SELECT k, module, least(1.0, s + CASE WHEN nh >= 2 THEN {_conf(4)} WHEN nh = 1 THEN {_conf(3)} ELSE 0 END) AS s, least({_conf(2)}, {_conf(0)} + {_conf(1)}*n_checks)*CASE WHEN module='enf' THEN 0.35 ELSE 1.0 END AS c, CAST({_W} AS DOUBLE) AS w FROM ms0),
fl AS (SELECT k, bool_or(module='enf' AND s >= 0.3) AS ep, sum(w) AS tw FROM ms GROUP BY k),
ad AS (SELECT ms.k, module, s, c, CASE WHEN ep THEN w WHEN module='enf' THEN 0 ELSE w*(1+0.30/(tw-0.30)) END AS w FROM ms JOIN fl ON ms.k=fl.k),
b AS (SELECT k, count(*) AS na, sum(s*w)/sum(w) AS base, max(CASE WHEN s >= 0.65 AND w >= 0.08 THEN s*0.62 ELSE 0 END) AS esc, sum(c*w)/sum(w) AS cf, count(*) {_EL} AS ne, avg(s) {_EL} AS em, stddev_pop(s) {_EL} AS es, coalesce(string_agg(module, ',' ORDER BY module) {_EL},'') AS el FROM ad GROUP BY k),
f AS (SELECT *, least(1.0, greatest(base,esc)*CASE WHEN ne <= 1 THEN 1.0 WHEN ne=2 THEN 1.10 WHEN ne=3 THEN 1.17 ELSE 1.22 END) AS fu FROM b)
SELECT k, na AS n_active, {R('base')} AS base_score, {R('fu')} AS fused, {R('least(0.92, greatest(0.30, cf*CASE WHEN ne >= 2 THEN 1+0.15*greatest(0.0,1-es/(em+1e-6)) ELSE 1 END))')} AS confidence, CASE WHEN fu < 0.2 THEN 'likely_authentic' WHEN fu < 0.4 THEN 'inconclusive' WHEN fu < 0.65 THEN 'likely_tampered' ELSE 'tampered' END AS verdict,
 el AS elevated_modules, CAST(round_even(fu*100,0) AS INT) AS risk_score, CASE WHEN round_even(fu*100,0) < 40 THEN 'low' WHEN round_even(fu*100,0) < 75 THEN 'elevated' ELSE 'high' END AS risk_band FROM f""")
def q_score_assets(spark, d):
    return score_assets(spark, d)
