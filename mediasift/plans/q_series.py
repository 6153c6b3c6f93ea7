"""W: ordered-series queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.operators import series as W
from mediasift.plans.bindings import FRAMES, SERIES, frames, series
from mediasift.plans.registry import R, query, tidy

K, O = ["k"], ["t", "tie"]
# Bounds for the driver tables: hours instead of media seconds.
REF_H, WARM_H, GAP_H = 473352.0 + 72.0, 10.0, 24.0
LAG = "lag({0}) OVER (PARTITION BY k ORDER BY t, tie)"


@query(f"WITH {SERIES} SELECT k, tie, {R('abs(x - lag(x) OVER (PARTITION BY k ORDER BY t, tie))')} AS d FROM series")
def q_abs_diff(spark, d):
    return tidy(W.abs_diff(series(spark, d), K, O, "x").select("k", "tie", "d"))


@query(f"""WITH {SERIES}, a AS (SELECT *, x < 40 AS hit, lead(t) OVER w AS nt, lag(x < 40) OVER w AS ph FROM series WINDOW w AS (PARTITION BY k ORDER BY t, tie)),
b AS (SELECT *, sum(CASE WHEN hit AND NOT coalesce(ph,false) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t, tie ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT k, count(*) AS n_rows, {R('min(t)')} AS start_t, {R('arg_max(coalesce(nt,t), tie)')} AS end_t FROM b WHERE hit GROUP BY k, run HAVING count(*) >= 3""")
def q_frozen_runs(spark, d):
    return tidy(W.frozen_runs(series(spark, d), K, O, "x", 40.0, 3))


@query(f"""WITH {SERIES}, a AS (SELECT *, x < 20 AS hit, lag(x < 20) OVER w AS ph FROM series WINDOW w AS (PARTITION BY k ORDER BY t, tie)), b AS (SELECT *, sum(CASE WHEN hit AND NOT coalesce(ph,false) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t, tie ROWS UNBOUNDED PRECEDING) AS run FROM a),
r AS (SELECT k, count(*) AS ns FROM (SELECT k FROM b WHERE hit GROUP BY k, run HAVING count(*) >= 2) GROUP BY k), g AS (SELECT k, count(*) AS n, count(CASE WHEN x < 20 THEN 1 END) AS nf, count(CASE WHEN x >= 20 AND x < 40 THEN 1 END) AS nn, count(CASE WHEN m < 4 THEN 1 END) AS nh FROM series GROUP BY k),
q AS (SELECT g.*, coalesce(ns,0) AS ns, nf/n AS fr, nn/n AS nr FROM g LEFT JOIN r ON g.k=r.k)
SELECT k, n AS n_steps, nf AS n_frozen, nn AS n_near, ns AS n_segments, nh AS n_hash_dup, {R('fr')} AS frozen_rate, {R('nr')} AS near_rate, {R('greatest(CASE WHEN fr > 0.3 THEN 0.8 WHEN fr > 0.1 THEN 0.6 WHEN fr > 0.03 THEN 0.4 WHEN nf > 0 THEN 0.2 ELSE 0 END, CASE WHEN ns > 1 THEN 0.55 ELSE 0 END, CASE WHEN nh > 5 THEN 0.65 WHEN nh > 2 THEN 0.45 ELSE 0 END)')} AS score FROM q""")
def q_duplication(spark, d):
    s = series(spark, d)
    dups = s.groupBy("k").agg(F.count(F.when(F.col("m") < 4, 1)).alias("n_hash_dup"))
    return tidy(W.duplication_summary(s, K, O, "x", 20.0, 40.0, 2, dups))


@query(f"""WITH {SERIES}, iv AS (SELECT k, t, tie, t - lag(t) OVER (PARTITION BY k ORDER BY t, tie) AS iv FROM series WHERE kind='error'),
st AS (SELECT k, count(*) AS n_key, count(CASE WHEN iv>0 THEN 1 END) AS n_interval, avg(CASE WHEN iv>0 THEN iv END) AS m, stddev_samp(CASE WHEN iv>0 THEN iv END) AS s FROM iv GROUP BY k)
SELECT st.k, n_key, n_interval, {R('max(m)')} AS mean_interval, {R('max(s)')} AS std_interval, count(CASE WHEN iv > m + 2*s THEN 1 END) AS n_long,
 {R('max(s/m)')} AS cv, coalesce(max(s/m) > 0.45, false) AS irregular FROM st JOIN iv ON st.k=iv.k GROUP BY st.k, n_key, n_interval""")
def q_gop_irregularity(spark, d):
    return tidy(W.gop_irregularity(series(spark, d), K, O, F.col("kind") == "error"))


@query(f"""WITH {SERIES}, iv0 AS (SELECT k, t, tie, t - lag(t) OVER (PARTITION BY k ORDER BY t, tie) AS iv, count(*) OVER (PARTITION BY k) AS n FROM series WHERE kind='error'),
iv AS (SELECT * FROM iv0 WHERE iv IS NOT NULL), md AS (SELECT k, quantile_cont(iv, 0.5) AS md FROM iv GROUP BY k),
bad AS (SELECT iv.k, t, tie, iv/md AS ratio, md FROM iv JOIN md ON iv.k=md.k WHERE n >= 4 AND md >= 0.05 AND (iv < md*0.8 OR iv > md*1.2)),
g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 24 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM bad WINDOW w AS (PARTITION BY k ORDER BY t, tie)),
h AS (SELECT *, sum(brk) OVER (PARTITION BY k ORDER BY t, tie ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT k, CAST(island AS BIGINT) AS island, count(*) AS n_irregular, {R('greatest(0.0, min(t)-0.5)')} AS start_t, {R('max(t)+0.5')} AS end_t, {R('avg(ratio)')} AS avg_ratio,
 {R('max(md)')} AS median_gop, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM h GROUP BY k, island""")
def q_gop_groups(spark, d):
    return tidy(W.gop_groups(series(spark, d), K, O, F.col("kind") == "error", near=GAP_H))


@query(f"""WITH {SERIES}, p AS (SELECT k, tie, t AS pts, t + m/CAST(500 AS DOUBLE) AS dts, lag(t) OVER (PARTITION BY k ORDER BY x, tie) AS pp FROM series)
SELECT k, count(*) AS n_rows, count(CASE WHEN pts-pp > 24 THEN 1 END) AS n_gap, count(CASE WHEN pp-pts > 48 THEN 1 END) AS n_reversal,
 count(CASE WHEN pp IS NOT NULL AND dts > pts + 0.1 THEN 1 END) AS n_inversion, {R('max(pts-pp)')} AS max_gap FROM p GROUP BY k""")
def q_pts_anomaly(spark, d):
    # file order stands in as value order, so presentation times go both ways
    s = series(spark, d).withColumn("dts", F.col("t") + F.col("m") / F.lit(500.0))
    return tidy(W.pts_anomalies(s, K, ["x", "tie"], "t", "dts", gap=24.0, reversal=48.0))


@query(f"""WITH {SERIES}, a AS (SELECT k, t, tie, avg(x) OVER (PARTITION BY k ORDER BY t, tie ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS lm,
 row_number() OVER (PARTITION BY k ORDER BY t, tie) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM series),
st AS (SELECT k, avg(CASE WHEN x>0 THEN x END) AS mu, stddev_samp(CASE WHEN x>0 THEN x END) AS s FROM series GROUP BY k)
SELECT a.k, tie, {R('lm')} AS local_mean, {R('abs(lm-mu)/(s+1)')} AS deviation FROM a JOIN st ON a.k=st.k WHERE i >= 10 AND i < n-10 AND n >= 10 AND abs(lm-mu)/(s+1) > 0.4""")
def q_rolling_deviation(spark, d):
    out = W.rolling_deviation(series(spark, d), K, O, "x", window=10, sigma=0.4)
    return tidy(out.select("k", "tie", "local_mean", "deviation"))


@query(f"""WITH RECURSIVE {SERIES}, hit AS (SELECT DISTINCT k, t FROM series WHERE x > 60),
kept(k, t) AS (SELECT k, min(t) FROM hit GROUP BY k UNION ALL SELECT q.k, q.nt FROM (SELECT kept.k, (SELECT min(h.t) FROM hit h WHERE h.k=kept.k AND h.t - kept.t >= 24) AS nt FROM kept) q WHERE q.nt IS NOT NULL)
SELECT k, {R('t')} AS t FROM kept""")
def q_suppress_nearby(spark, d):
    return tidy(W.suppress_nearby(series(spark, d).filter("x > 60"), K, "t", GAP_H))


@query(f"""WITH {SERIES}, a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, tie) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, sum(CASE WHEN t <= {REF_H} THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS nr FROM series),
b AS (SELECT *, (t <= {REF_H} OR (nr < 3 AND i < 3)) AS rf FROM a),
st AS (SELECT k, avg(x) AS mu, stddev_pop(x) + 1e-6 AS sd FROM b WHERE rf GROUP BY k),
z AS (SELECT b.*, abs(x-mu)/sd AS z FROM b JOIN st ON b.k=st.k),
h AS (SELECT *, min(z) OVER w AS lo, count(*) OVER w AS c FROM z WINDOW w AS (PARTITION BY k ORDER BY t, tie ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING))
SELECT k, count(*) AS n_rows, {R('max(z)',5)} AS max_z, {R(f"min(CASE WHEN lo > 1.5 AND c = 2 AND t > {REF_H + WARM_H} THEN t END)",5)} AS change_t, count(CASE WHEN z > 1.5 THEN 1 END) AS n_over FROM h GROUP BY k""")
def q_change_point(spark, d):
    return tidy(W.change_point(series(spark, d), K, O, "x", REF_H, WARM_H, z_cut=1.5, persist=2), 5)


@query(f"""WITH {SERIES}, a AS (SELECT k, t, abs(x - lag(x) OVER (PARTITION BY k ORDER BY t, tie)) AS d FROM series), b AS (SELECT * FROM a WHERE d IS NOT NULL),
st AS (SELECT k, count(*) AS n_steps, avg(d) AS md, max(d) AS mx FROM b GROUP BY k),
c AS (SELECT st.k, n_steps, md, mx, count(CASE WHEN md >= 1e-6 AND d > md*4 THEN 1 END) AS n_spikes FROM st JOIN b ON st.k=b.k GROUP BY st.k, n_steps, md, mx)
SELECT k, n_steps, {R('md')} AS mean_step, {R('mx')} AS max_step, n_spikes, {R('CASE WHEN md >= 1e-6 THEN mx/md ELSE 0 END')} AS ratio,
 {R('CASE WHEN md < 1e-6 OR mx/md <= 2 THEN 0.0 WHEN mx/md <= 10 THEN (mx/md-2)/8 ELSE 1.0 END')} AS score FROM c""")
def q_abruptness(spark, d):
    return tidy(W.abruptness(series(spark, d), K, O, "x", points=((2, 0.0), (10, 1.0)), spike_multiple=4.0))


@query(f"""WITH {SERIES}, st AS (SELECT k, avg(x) AS mu, stddev_pop(x) AS s FROM series GROUP BY k)
SELECT series.k, tie, {R('x')} AS x, CASE WHEN x > mu + 2.5*s THEN 'spike' ELSE 'drop' END AS anomaly FROM series JOIN st ON series.k=st.k
WHERE s >= 1e-6 AND (x > mu + 2.5*s OR (mu - 2.5*s > 0 AND x < mu - 2.5*s))""")
def q_sigma_spikes(spark, d):
    return tidy(W.sigma_spikes(series(spark, d), K, "x", 2.5).select("k", "tie", "x", "anomaly"))


@query(f"""WITH {FRAMES}, md AS (SELECT k, quantile_cont(x, 0.5) AS md, stddev_pop(x) AS s FROM frames GROUP BY k),
a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, tie) AS i, count(*) OVER (PARTITION BY k) AS n FROM frames)
SELECT a.k, tie, {R('x/greatest(md,0.01)')} AS ratio, CASE WHEN x/greatest(md,0.01) > 4 THEN 'high' ELSE 'medium' END AS severity
FROM a JOIN md ON a.k=md.k WHERE i > 1 AND i < n AND x > md + 1.5*s AND hist_dist > 0.5""")
def q_motion_spikes(spark, d):
    out = W.motion_spikes(frames(spark, d), K, O, "x", "hist_dist", gate=0.5, sigma=1.5)
    return tidy(out.select("k", "tie", "ratio", "severity"))


@query(f"""WITH {FRAMES}, a AS (SELECT k, tie, vx, vy, abs(atan2(vy,vx) - lag(atan2(vy,vx)) OVER (PARTITION BY k ORDER BY t, tie)) AS g FROM frames),
b AS (SELECT *, least(g, 2*pi()-g) AS turn FROM a)
SELECT k, tie, {R('turn')} AS turn, CASE WHEN turn > pi()*150/180 THEN 'high' ELSE 'medium' END AS severity FROM b WHERE turn > pi()/2 AND sqrt(vx*vx+vy*vy) > 0.5""")
def q_direction_reversal(spark, d):
    return tidy(W.direction_reversals(frames(spark, d), K, O, "vx", "vy").select("k", "tie", "turn", "severity"))


@query(f"""WITH {SERIES}, a AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, tie) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM series),
b AS (SELECT *, greatest(5, n // 10) AS w FROM a),
c AS (SELECT b.k, b.tie, avg(CASE WHEN y.i < b.i THEN y.x END) AS mb, avg(CASE WHEN y.i >= b.i THEN y.x END) AS ma FROM b JOIN b y ON b.k=y.k AND y.i >= b.i-b.w AND y.i < b.i+b.w WHERE b.n >= 20 AND b.i >= b.w AND b.i < b.n-b.w GROUP BY b.k, b.tie)
SELECT k, tie, {R('mb')} AS mean_before, {R('ma')} AS mean_after, {R('greatest(mb,ma)/(least(mb,ma)+0.01)')} AS ratio FROM c WHERE (mb >= 0.01 OR ma >= 0.01) AND greatest(mb,ma)/(least(mb,ma)+0.01) > 2""")
def q_before_after_ratio(spark, d):
    out = W.before_after(series(spark, d), K, O, "x", ratio_cut=2.0)
    return tidy(out.select("k", "tie", "mean_before", "mean_after", "ratio"))


@query(f"""WITH {SERIES}, st AS (SELECT k, avg(m/100.0) AS mu, stddev_pop(m/CAST(100 AS DOUBLE)) AS s, count(*) AS n FROM series GROUP BY k)
SELECT series.k, tie, {R('m/CAST(100 AS DOUBLE)')} AS coherence FROM series JOIN st ON series.k=st.k WHERE n >= 5 AND m/CAST(100 AS DOUBLE) < 0.3 AND m/CAST(100 AS DOUBLE) < mu - 1.5*s""")
def q_coherence_drops(spark, d):
    s = series(spark, d).withColumn("coherence", F.col("m") / F.lit(100.0))
    return tidy(W.coherence_drops(s, K, "coherence", sigma=1.5).select("k", "tie", "coherence"))


@query(f"""WITH {SERIES}, a AS (SELECT k, tie, row_number() OVER (PARTITION BY k ORDER BY t, tie) - 1 AS i,
 median(x) OVER (PARTITION BY k ORDER BY t, tie ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) AS sm FROM series) SELECT k, tie, {R('sm')} AS smooth FROM a WHERE i % 5 = 0""")
def q_rolling_median(spark, d):
    return tidy(W.rolling_median(series(spark, d), K, O, "x", 5, 5).select("k", "tie", "smooth"))


@query(f"""WITH {SERIES}, a AS (SELECT *, coalesce(t - lag(t) OVER w,0) AS dt, row_number() OVER w - 1 AS i FROM series WINDOW w AS (PARTITION BY k ORDER BY t, tie)),
b AS (SELECT *, 2*pi()*(x-50)*dt AS ph FROM a),
p AS (SELECT k, quantile_cont(abs(ph),0.75) AS p75 FROM b WHERE i > 0 GROUP BY k),
c AS (SELECT k, count(*) AS n_rows, stddev_pop(x) AS fs, max(CASE WHEN i>0 THEN abs(ph) END) AS ms, arg_max(t, CASE WHEN i>0 THEN abs(ph) END) AS st, sum(ph) AS ep FROM b GROUP BY k)
SELECT c.k, n_rows, {R('fs',4)} AS freq_std, {R('ms',4)} AS max_step, {R('st',4)} AS step_t, {R('ep',3)} AS end_phase, {R('ms/(p75+1e-6)',4)} AS discontinuity FROM c JOIN p ON c.k=p.k WHERE n_rows >= 6""")
def q_phase_discontinuity(spark, d):
    out = W.phase_discontinuity(series(spark, d), K, O, "x", 50.0)
    return tidy(out.withColumn("end_phase", F.round("end_phase", 3)), 4)


@query(f"""WITH {SERIES}, a AS (SELECT k, tie, x - lag(x) OVER (PARTITION BY k ORDER BY t, tie) AS d FROM series), st AS (SELECT k, avg(d) AS mu, stddev_pop(d) AS s FROM a GROUP BY k)
SELECT a.k, tie, {R('d')} AS d, {R('abs(d-mu)/s')} AS z FROM a JOIN st ON a.k=st.k WHERE d IS NOT NULL AND s > 0 AND abs(d-mu)/s >= 2.5""")
def q_diff_zscore(spark, d):
    return tidy(W.diff_zscore(series(spark, d), K, O, "x", 2.5).select("k", "tie", "d", "z"))


@query(f"""WITH {SERIES}, a AS (SELECT k, t AS s, t + x/20 AS e, tie, kind, m, least(2, m // 40) AS rk FROM series),
b AS (SELECT *, CASE WHEN lag(kind) OVER w = kind AND abs(s - lag(e) OVER w) < 24 THEN 0 ELSE 1 END AS nw FROM a WINDOW w AS (PARTITION BY k ORDER BY s, tie)),
c AS (SELECT *, sum(nw) OVER (PARTITION BY k ORDER BY s, tie ROWS UNBOUNDED PRECEDING) AS run FROM b),
e AS (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY s, tie) AS q FROM c)
SELECT k, arg_min(kind, tie) AS type, count(*) AS n_merged, {R('min(s)')} AS start_t, {R('arg_max(e, tie)')} AS end_t, {R('avg(m)')} AS mean_metric, max(rk) AS max_rank,
 string_agg(CASE WHEN q <= 6 THEN CAST(tie AS VARCHAR) END, ',' ORDER BY s, tie) AS evidence FROM e GROUP BY k, run""")
def q_merge_adjacent(spark, d):
    s = series(spark, d).withColumn("e", F.col("t") + F.col("x") / 20).withColumn("rk", F.least(F.lit(2), F.floor(F.col("m") / 40)))
    out = W.merge_adjacent(s.withColumn("m", F.col("m").cast("double")), K, "t", "e", "kind", "rk", "m", "tie", gap=GAP_H)
    ev = F.array_join(F.transform("evidence", lambda e: e.cast("string")), ",")
    return tidy(out.withColumn("evidence", ev).drop("_run"))


@query(f"""WITH {FRAMES}, st AS (SELECT k, avg(ssim) AS a, stddev_pop(ssim) AS b, avg(hist_dist) AS c, stddev_pop(hist_dist) AS e FROM frames GROUP BY k)
SELECT k, {R('least(greatest(a - 1.5*b, 0.3), 0.9)')} AS low_cut, {R('least(greatest(c + 1.5*e, 0.3), 0.95)')} AS high_cut FROM st""")
def q_adaptive_threshold(spark, d):
    return tidy(W.adaptive_thresholds(frames(spark, d), K, "ssim", "hist_dist"))


@query(f"""WITH {FRAMES}, st AS (SELECT k, avg(ssim) FILTER (WHERE k % 5 <> 0) AS a, stddev_pop(ssim) FILTER (WHERE k % 5 <> 0) AS b, avg(hist_dist) FILTER (WHERE k % 5 <> 0) AS c, stddev_pop(hist_dist) FILTER (WHERE k % 5 <> 0) AS e FROM frames GROUP BY k),
md(mode, f, lo, hi, du, z) AS (VALUES ('standard', 1.5::DOUBLE, 0.65, 0.75, 0.98, 2.5), ('high_sensitivity', 1.0, 0.75, 0.65, 0.96, 2.0), ('deep_scan', 0.8, 0.80, 0.60, 0.95, 1.5))
SELECT k, mode, {R('CASE WHEN a IS NULL THEN lo ELSE least(greatest(a - f*b, 0.3), 0.9) END')} AS low_cut, {R('CASE WHEN c IS NULL THEN hi ELSE least(greatest(c + f*e, 0.3), 0.95) END')} AS high_cut, {R('du')} AS duplicate_cut, {R('z')} AS z_cut FROM st, md""")
def q_threshold_modes(spark, d):
    # every fifth asset has no metrics, so it takes the fallbacks
    f = frames(spark, d).withColumns({c: F.when(F.col("k") % 5 != 0, F.col(c)) for c in ("ssim", "hist_dist")})
    return tidy(W.threshold_modes(f, K, "ssim", "hist_dist"))


@query(f"""WITH {FRAMES}, a AS (SELECT *, lead(t) OVER w AS nt, abs(lead(blockiness) OVER w - blockiness)/greatest(blockiness,1.0) AS dr, abs(lead(noise) OVER w - noise)/greatest(noise,1.0) AS nr FROM frames WINDOW w AS (PARTITION BY k ORDER BY t, tie)),
b AS (SELECT * FROM a WHERE nt IS NOT NULL)
SELECT k, tie, 'abrupt_transition' AS type, CASE WHEN ssim < 0.5 THEN 'high' ELSE 'medium' END AS severity, {R('1-ssim')} AS score FROM b WHERE ssim < 0.65 AND hist_dist > 0.75
UNION ALL SELECT k, tie, 'freeze_or_duplication', CASE WHEN nt - t > 1 THEN 'medium' ELSE 'low' END, {R('ssim')} FROM b WHERE ssim > 0.98
UNION ALL SELECT k, tie, 'quality_drift', CASE WHEN dr > 0.5 THEN 'high' ELSE 'medium' END, {R('least(1.0,dr)')} FROM b WHERE dr > 0.3 OR nr > 0.3""")
def q_pair_rules(spark, d):
    out = W.pair_rules(frames(spark, d), K, O, "ssim", "hist_dist", "blockiness", "noise", 0.65, 0.75, 0.98)
    return tidy(out.select("k", "tie", "type", "severity", "score"))


@query(f"""WITH {SERIES}, b AS (SELECT k, m AS f, avg(x) AS db FROM series GROUP BY k, m),
a AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY k) AS n, avg(db) OVER (PARTITION BY k ORDER BY f ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS be, avg(db) OVER (PARTITION BY k ORDER BY f ROWS BETWEEN 6 FOLLOWING AND 7 FOLLOWING) AS af, lead(f,2) OVER w AS cf FROM b WINDOW w AS (PARTITION BY k ORDER BY f)),
s AS (SELECT *, CASE WHEN f >= 40 AND i < n - 8 AND (CASE WHEN i > 2 THEN be ELSE db END - af) > 0 THEN (CASE WHEN i > 2 THEN be ELSE db END - af)/0.5 END AS st FROM a),
p AS (SELECT k, st, cf, row_number() OVER (PARTITION BY k ORDER BY st DESC, i) AS q FROM s WHERE st IS NOT NULL)
SELECT s.k, {R('coalesce(max(p.st),0)')} AS steepness, max(p.cf) AS cutoff, {R('CASE WHEN max(p.st) IS NULL THEN 0 ELSE coalesce(avg(db) FILTER (WHERE f < p.cf),0) - coalesce(avg(db) FILTER (WHERE f > 95), coalesce(avg(db) FILTER (WHERE f < p.cf),0)) END')} AS total_drop FROM s LEFT JOIN p ON s.k=p.k AND p.q=1 GROUP BY s.k""")
def q_steepest_drop(spark, d):
    b = series(spark, d).groupBy("k", F.col("m").alias("f")).agg(F.avg("x").alias("db"))
    return tidy(W.steepest_drop(b, K, "f", "db", 8, 100.0))


@query(f"""WITH {SERIES}, a AS (SELECT *, x < 40 AS hit, lead(t) OVER w AS nt, lag(x < 40) OVER w AS ph FROM series WINDOW w AS (PARTITION BY k ORDER BY t, tie)),
b AS (SELECT *, sum(CASE WHEN hit AND NOT coalesce(ph,false) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t, tie ROWS UNBOUNDED PRECEDING) AS run FROM a),
r AS (SELECT k, count(*) AS n_rows, min(t) AS s, arg_max(coalesce(nt,t), tie) AS e FROM b WHERE hit GROUP BY k, run), md AS (SELECT k, quantile_cont(e-s,0.5) AS md FROM r GROUP BY k)
SELECT r.k, n_rows, {R('s')} AS start_t, {R('e')} AS end_t, {R('e-s')} AS pause, {R('md')} AS median_pause FROM r JOIN md ON r.k=md.k WHERE e-s > greatest(24.0, 3*md)""")
def q_pause_anomaly(spark, d):
    return tidy(W.pause_anomalies(series(spark, d), K, O, "x", 40.0, floor=24.0, factor=3.0))


@query(f"""WITH {SERIES}, a AS (SELECT k, greatest(x - lag(x) OVER (PARTITION BY k ORDER BY t, tie), 0.0) AS fl, x - lag(x) OVER (PARTITION BY k ORDER BY t, tie) AS d FROM series), b AS (SELECT * FROM a WHERE d IS NOT NULL),
m AS (SELECT k, avg(fl) AS mu, stddev_pop(fl) AS s FROM b GROUP BY k),
sk AS (SELECT b.k, mu, s, avg(power((fl-mu)/s,3)) AS sk FROM b JOIN m ON b.k=m.k GROUP BY b.k, mu, s),
c AS (SELECT b.k, count(*) AS n_steps, count(CASE WHEN (fl-mu)/s > 1.5+0.5*greatest(sk,0) THEN 1 END) AS n_events, max(1.5+0.5*greatest(sk,0)) AS zc FROM b JOIN sk ON b.k=sk.k GROUP BY b.k)
SELECT k, n_steps, n_events, {R('zc')} AS z_cut, {R('n_events/n_steps')} AS event_rate, CASE WHEN n_events/n_steps > 0.05 THEN 'inconclusive' WHEN n_events >= 2 THEN 'flagged' ELSE 'clean' END AS status FROM c""")
def q_flux_events(spark, d):
    return tidy(W.flux_events(series(spark, d), K, O, "x", base_z=1.5, rate_cap=0.05))


@query(f"""WITH RECURSIVE {SERIES}, p AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY k) AS n, avg(x) OVER (PARTITION BY k) AS mu, stddev_pop(x) OVER (PARTITION BY k) AS sd, sum(x) OVER w AS cs FROM series WINDOW w AS (PARTITION BY k ORDER BY t, tie)),
q AS (SELECT *, least(30, n // 5) AS wd FROM p WHERE n >= 30),
o AS (SELECT q.k, q.t, row_number() OVER (PARTITION BY q.k ORDER BY q.t) AS r FROM q JOIN q AS h ON h.k=q.k AND h.i=q.i+q.wd-1 LEFT JOIN q AS l ON l.k=q.k AND l.i=q.i-q.wd-1 WHERE q.i >= q.wd AND q.i < q.n-q.wd AND abs((h.cs-coalesce(l.cs,0))/(2*q.wd) - q.mu) > 0.2*q.sd GROUP BY q.k, q.t),
kp(k, t, r) AS (SELECT k, t, r FROM o WHERE r = 1 UNION ALL SELECT z.k, z.t, z.r FROM (SELECT kp.k, min(o.r) AS r FROM kp JOIN o ON o.k=kp.k AND o.t >= kp.t + 24 AND o.r > kp.r GROUP BY kp.k) m JOIN o z ON z.k=m.k AND z.r=m.r),
u AS (SELECT DISTINCT k, t FROM kp), c AS (SELECT k, count(*) AS n FROM series GROUP BY k)
SELECT u.k, count(*) AS n_positions, {R('min(t)')} AS first_t, {R('max(t)')} AS last_t, max(n) AS n_rows, {R('least(1.0, count(*)/greatest(max(n)/100.0, 1.0))')} AS score FROM u JOIN c ON u.k=c.k GROUP BY u.k""")
def q_frame_deviation(spark, d):
    # events are far apart: a fifth of a deviation, and a day in place of a second
    return tidy(W.frame_deviation(series(spark, d), K, O, "x", sigma=0.2, spacing=24.0))
