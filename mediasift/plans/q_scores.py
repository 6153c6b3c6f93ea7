"""Sub-score queries: detector formulas over summary columns of the event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.operators import scores as X
from mediasift.plans.bindings import SERIES, series
from mediasift.plans.registry import R, query, tidy

K = ["k"]
G = f"{SERIES}, g AS (SELECT k, count(*) AS n, avg(x) AS ax, stddev_pop(x) AS sx, max(x) AS mx, avg(m) AS am, stddev_pop(m) AS sm FROM series GROUP BY k)"


def grouped(spark, d):
    return series(spark, d).groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("ax"), F.stddev_pop("x").alias("sx"), F.max("x").alias("mx"), F.avg("m").alias("am"), F.stddev_pop("m").alias("sm")
    )


@query(f"""WITH {G}, a AS (SELECT k, n, mx/60 AS d, sx/600 AS s, k % 3 <> 0 AS ep, am/10-6 AS sf, am/20-4 AS sh FROM g)
SELECT k, 'phase' AS type, CASE WHEN d >= 4 THEN 'high' ELSE 'medium' END AS severity, {R('CASE WHEN d >= 4 AND ep THEN 0.82 WHEN d >= 4 THEN 0.52 WHEN ep THEN 0.65 ELSE 0.38 END')} AS confidence, {R('CASE WHEN d >= 4 THEN least(0.9,0.65+(d-4)*0.04) ELSE 0.45+(d-2.5)*0.05 END')} AS score, {R('2.0')} AS weight FROM a WHERE n >= 6 AND d >= 2.5
UNION ALL SELECT k,'drift',CASE WHEN s >= 0.1 THEN 'medium' ELSE 'low' END, {R('0.55')}, {R('CASE WHEN s >= 0.1 THEN least(0.6,0.4+(s-0.1)*2) ELSE 0.25 END')}, {R('0.6')} FROM a WHERE n >= 6 AND ep AND s >= 0.05
UNION ALL SELECT k,'harmonic_only','low',{R('0.45')},{R('0.2')},{R('0.3')} FROM a WHERE sh > -2 AND sf <= -2 UNION ALL SELECT k,'absent','low',{R('0.9')},NULL,{R('0.0')} FROM a WHERE NOT ep""")
def q_enf_checks(spark, d):
    g = grouped(spark, d).select("k", F.col("n").alias("n_frames"), (F.col("mx") / 60).alias("discontinuity"), (F.col("sx") / 600).alias("freq_std"), (F.col("k") % 3 != 0).alias("enf_present"), (F.col("am") / 10 - 6).alias("snr_fund"), (F.col("am") / 20 - 4).alias("snr_harm"))
    return tidy(X.enf_checks(g, K).select("k", "type", "severity", "confidence", "score", "weight"))


@query(f"""WITH {G}, a AS (SELECT k, n, mx/6 AS st, mx/8 AS td, am*90 AS cu, CASE k % 4 WHEN 0 THEN 9000.0 WHEN 3 THEN NULL ELSE 7000.0 END AS ce, sx/ax*0.15 AS cc, k % 2 = 0 AS un, k % 2 = 1 AS lo, 64+k % 5*32 AS kb FROM g)
SELECT k, 'lowpass' AS type, 'high' AS severity, {R('0.88')} AS confidence, {R('least(0.9, 0.1 + CASE WHEN st >= 40 THEN least(0.85,0.6+(st-40)/200) ELSE 0.4+(st-20)/100 END)')} AS score, {R('2.0')} AS weight FROM a WHERE un AND st >= 20 AND td >= 15
UNION ALL SELECT k,'expectation','medium',{R('0.65')},{R('least(0.6,0.3+(ce-cu)/ce*100/200)')},{R('1.0')} FROM (SELECT k, cu, least(ce, 0.98*8000) AS ce FROM a WHERE ce IS NOT NULL) WHERE (ce-cu)/ce*100 > 25
UNION ALL SELECT k,'moving_ceiling','medium',{R('0.65')},{R('0.4')},{R('0.8')} FROM a WHERE un AND n >= 5 AND cc > 0.12 UNION ALL SELECT k,'bandwidth_use','medium',{R('0.6')},{R('0.35')},{R('0.7')} FROM a WHERE lo AND kb > 0 AND st >= 20 AND cu < 0.65*least(kb*1000/16.0, 0.9*8000)""")
def q_lowpass_checks(spark, d):
    c = F.col
    g = grouped(spark, d).select(
        "k", (c("mx") / 6).alias("steepness"), (c("mx") / 8).alias("total_drop"), (c("am") * 90).alias("cutoff"), F.when(c("k") % 4 == 0, 9000.0).when(c("k") % 4 != 3, 7000.0).alias("ceiling_hz"), c("n").alias("n_segments"), (c("sx") / c("ax") * 0.15).alias("ceiling_cv"),
        (c("k") % 2 == 0).alias("uncompressed"), (c("k") % 2 == 1).alias("lossy"), (64 + c("k") % 5 * 32).alias("bitrate_kbps"), F.lit(8000.0).alias("nyquist"),
    )
    return tidy(X.lowpass_checks(g, K).select("k", "type", "severity", "confidence", "score", "weight"))


def _tier(x, cuts):
    return "CASE " + " ".join(f"WHEN {x} >= {a} THEN {e}" for a, e in cuts) + " ELSE 0 END"


@query(f"""WITH {G}, a AS (SELECT k, n, {_tier('mx/4', [(60, '1.0'), (30, '0.5+0.5*(mx/4-30)/30'), (10, '0.2+0.3*(mx/4-10)/20')])} AS c, {_tier('sx', [(80, '0.8'), (40, '0.4+0.4*(sx-40)/40'), (15, '0.15')])} AS r, {_tier('am/50', [(1.10, '0.7'), (0.85, '0.4+0.3*(am/50-0.85)/0.25'), (0.60, '0.2')])} AS p, mx > 250 AS o, sx/120 AS v, sm/60 AS f, am/100 AS q, mx, ax FROM g)
SELECT k, {R('least(1.0, greatest(c, r, p*0.8) + CASE WHEN (c > 0.3)::INT+(r > 0.2)::INT+(p > 0.25)::INT+o::INT >= 3 THEN 0.1 ELSE 0 END)')} AS spectral, {R('least(1.0, greatest(v*0.85, CASE WHEN n % 7 > 0 THEN 0.5+0.05*least(5, n % 7) ELSE 0 END, q*0.4, f*0.35))')} AS illumination,
 {R('least(1.0, 0.7*(CASE WHEN v > 0.3 AND f > 0.3 THEN 0.5*v+0.5*f WHEN f > 0.5 THEN f*0.5 WHEN v > 0.5 THEN v*0.25 ELSE 0 END)+0.2*q+0.1*least(1.0, (n % 7)/5.0))')} AS noise_pattern,
 {R('greatest(CASE WHEN q-0.5 < 0 THEN 0.65 WHEN q-0.5 < 0.02 THEN 0.5 WHEN q-0.5 < 0.05 THEN 0.3 ELSE 0 END, CASE WHEN v/3 > 0.2 THEN 0.7 WHEN v/3 > 0.1 THEN 0.55 WHEN v/3 > 0.05 THEN 0.4 ELSE 0 END, CASE WHEN f/2 > 0.3 THEN 0.65 WHEN f/2 > 0.15 THEN 0.45 ELSE 0 END, CASE WHEN v/5 > 0.08 AND n >= 20 THEN 0.45 ELSE 0 END, CASE WHEN k % 2 = 1 THEN 0 WHEN q < 0.3 THEN 0.75 WHEN q < 0.5 THEN 0.5 ELSE 0 END)')} AS fingerprint,
 {R("CASE k % 4 WHEN 0 THEN CASE WHEN n > 60 THEN 0.12 ELSE 0.25 END + CASE WHEN n < 55 THEN 0.08 ELSE 0 END WHEN 1 THEN round(0.1+0.1*(1-least(1.0, n/150.0)),3) WHEN 2 THEN CASE WHEN n > 60 THEN 0.15 ELSE 0.35 END ELSE 0.18 END")} AS uncertainty FROM a""")
def q_detector_scores(spark, d):
    c = F.col
    v, f, q, spikes = c("sx") / 120, c("sm") / 60, c("am") / 100, c("n") % 7
    mod = F.when(c("k") % 4 == 0, "noise").when(c("k") % 4 == 1, "temporal").when(c("k") % 4 == 2, "audio").otherwise("lighting")
    return tidy(grouped(spark, d).select(
        "k", X.spectral_score(c("mx") / 4, c("sx"), c("am") / 50, F.when(c("mx") > 250, 60).otherwise(0)).alias("spectral"), X.illumination_score(v, spikes, q, f).alias("illumination"),
        X.noise_pattern_score(v, q, f, spikes).alias("noise_pattern"), X.fingerprint_score(q - 0.5, v / 3, f / 2, v / 5, c("n"), F.when(c("k") % 2 == 0, q)).alias("fingerprint"),
        X.uncertainty(mod, c("n"), c("n") > 60, c("n") < 55, c("n") > 60).alias("uncertainty"),
    ))


@query(f"""WITH {G}, a AS (SELECT k, mx/ax/4 AS r, mx/10 AS z, sx/ax/8 AS cv, CASE WHEN k%3 <> 0 THEN n/10.0 END AS ct, CASE WHEN k%5 <> 0 THEN n/10.0 + 0.5 END AS dur FROM g)
SELECT k, 'pitch_change' AS type, CASE WHEN r >= 1.6 THEN 'high' ELSE 'medium' END AS severity, {R('CASE WHEN r >= 1.6 THEN 0.88 ELSE 0.7 END')} AS confidence, {R('CASE WHEN r >= 1.6 THEN least(0.85, 0.6+(r-1.6)*0.25) ELSE 0.4+least((z-6)/40, 0.25) END')} AS score, {R('2.0')} AS weight, {R('CASE WHEN ct IS NOT NULL THEN greatest(0, ct-1) END')} AS start_s, {R('CASE WHEN ct IS NOT NULL THEN CASE WHEN dur < ct+1 THEN dur ELSE ct+1 END END')} AS end_s FROM a WHERE r >= 1.6 OR z >= 6
UNION ALL SELECT k, 'pitch_unstable', 'low', {R('0.5')}, {R('0.18')}, {R('0.5')}, NULL, NULL FROM a WHERE cv >= 0.15 AND r < 1.6""")
def q_pitch_checks(spark, d):
    c = F.col
    g = grouped(spark, d).select("k", (c("mx") / c("ax") / 4).alias("f0_ratio"), (c("mx") / 10).alias("f0_max_z"), (c("sx") / c("ax") / 8).alias("f0_cv"), F.when(c("k") % 3 != 0, c("n") / 10).alias("change_t"), F.when(c("k") % 5 != 0, c("n") / 10 + 0.5).alias("duration"))
    return tidy(X.pitch_checks(g, K).select("k", "type", "severity", "confidence", "score", "weight", "start_s", "end_s"))
