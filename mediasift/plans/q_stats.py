"""A: grouped-statistics queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.functions.exprs import severity_name
from mediasift.operators import stats as A
from mediasift.operators.scores import shadow_score
from mediasift.plans.bindings import FRAMES, SERIES, frames, series, table
from mediasift.plans.registry import R, query, tidy

K, O = ["k"], ["t", "tie"]
# a centred, scaled signal from event values
SIG = f"{SERIES}, sig AS (SELECT k, t, tie, kind, m, (x-50)/500 AS s, x FROM series)"
PX = """px AS (SELECT label, vec_id, i-1 AS pos, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT label, vec_id, embedding, unnest(generate_series(1,64)) AS i FROM embeddings))"""


def sig(spark, d):
    return series(spark, d).withColumn("s", (F.col("x") - 50) / 500)


def pixels(spark, d):
    """One row per vector element: asset = label, frame = vec_id."""
    return table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


@query(f"WITH {SIG} SELECT k, {R('avg(s)')} AS dc, {R('max(abs(s))')} AS peak, {R('sqrt(avg(s*s))')} AS rms, {R('20*log10(max(abs(s))/(sqrt(avg(s*s))+1e-12))')} AS crest_db FROM sig GROUP BY k")
def q_signal_levels(spark, d):
    return tidy(A.signal_levels(sig(spark, d), K, "s"))


@query(f"""WITH {SIG}, a AS (SELECT k, abs(s) >= 0.08 AS h, lag(abs(s) >= 0.08) OVER (PARTITION BY k ORDER BY t, tie) AS p FROM sig)
SELECT k, {R('avg(CASE WHEN h THEN 1.0 ELSE 0.0 END)')} AS clip_ratio, count(CASE WHEN h AND NOT coalesce(p,false) THEN 1 END) AS clip_runs FROM a GROUP BY k""")
def q_clipping(spark, d):
    return tidy(A.clipping(sig(spark, d), K, O, "s", 0.08))


@query(f"""WITH {SIG} SELECT k, {R('avg(CASE WHEN abs(s) < 0.08 THEN 1.0 ELSE 0.0 END)')} AS silence_ratio, {R('coalesce(min(CASE WHEN abs(s) >= 0.08 THEN t END),max(t))-min(t)')} AS lead_silence,
 {R('max(t)-coalesce(max(CASE WHEN abs(s) >= 0.08 THEN t END),min(t))')} AS trail_silence FROM sig GROUP BY k""")
def q_silence(spark, d):
    return tidy(A.silence(sig(spark, d), K, "t", "s", 0.08))


@query(f"""WITH {SIG}, a AS (SELECT k, s, (row_number() OVER (PARTITION BY k ORDER BY t, tie) - 1) // 5 AS w FROM sig), b AS (SELECT k, w, sqrt(avg(s*s)) AS rms FROM a GROUP BY k, w HAVING count(*) = 5),
q AS (SELECT k, quantile_cont(rms, 0.05) AS p5, quantile_cont(rms, 0.9) FILTER (WHERE rms > 0.008) AS p90, quantile_cont(rms, 0.1) FILTER (WHERE rms > 0.008) AS p10 FROM b GROUP BY k),
r AS (SELECT k, sqrt(avg(s*s)) AS rms FROM sig GROUP BY k)
SELECT q.k, {R('coalesce(CASE WHEN p10 < 1e-9 THEN 60.0 ELSE 20*log10(p90/p10) END, 0.0)')} AS dynamic_range_db, {R('20*log10(greatest(p5,1e-12))')} AS noise_floor_db, {R('greatest(0.0, 20*log10(rms/greatest(p5,1e-12)))')} AS snr_db FROM q JOIN r ON q.k=r.k""")
def q_dynamic_range(spark, d):
    return tidy(A.dynamic_range(sig(spark, d), K, O, "s", 5))


@query(f"WITH {SERIES} SELECT k, count(x) AS n, {R('avg(x)')} AS mean, {R('stddev_pop(x)')} AS std, {R('CASE WHEN avg(x) > 1e-12 THEN stddev_pop(x)/avg(x) ELSE 0 END')} AS cv FROM series GROUP BY k")
def q_cv(spark, d):
    return tidy(A.variation(series(spark, d), K, "x"))


MOM = """mo AS (SELECT k, avg(x) AS mu, stddev_pop(x) AS sd FROM series GROUP BY k),
mom AS (SELECT series.k, count(*) AS n, max(mu) AS mu, max(sd) AS sd, avg(power((x-mu)/sd,3)) AS sk, avg(power((x-mu)/sd,4))-3 AS ku, avg(CASE WHEN abs(x-mu) > 3*sd THEN 1.0 ELSE 0.0 END) AS orate FROM series JOIN mo ON series.k=mo.k GROUP BY series.k)"""


@query(f"WITH {SERIES}, {MOM} SELECT k, n, {R('sk')} AS skew, {R('ku')} AS kurt FROM mom")
def q_moments(spark, d):
    return tidy(A.moments(series(spark, d), K, "x"))


@query(f"""WITH {SERIES}, {MOM}, b AS (SELECT *, least(1.0, greatest(0.0, ((sk*sk+1)/(abs(ku + 3.0*(n-1)*(n-1)/CAST((n-2)*(n-3) AS DOUBLE))+3)-0.2)/0.8)) AS bi, sd/(mu+1e-6) AS cv FROM mom)
SELECT k, n, {R('bi')} AS bimodality, {R('cv')} AS cv, {R('orate')} AS outlier_rate, {R('CASE WHEN n < 5 THEN 0.0 WHEN bi > 0.6 AND cv > 0.4 THEN 0.55 WHEN orate > 0.05 THEN 0.35 ELSE 0.0 END')} AS score FROM b""")
def q_bimodality(spark, d):
    return tidy(A.similarity_profile(series(spark, d), K, "x"))


@query(f"""WITH b AS (SELECT l_suppkey AS k, CAST(substr(CAST(CAST(floor(abs(l_extendedprice)) AS BIGINT) AS VARCHAR),1,1) AS INT) AS dg FROM lineitem WHERE abs(l_extendedprice) >= 1),
s AS (SELECT k, count(*) AS n, {'+'.join(f"abs(avg(CASE WHEN dg={i} THEN 1.0 ELSE 0.0 END)-log10(1+1.0/{i}))" for i in range(1, 10))} AS m FROM b GROUP BY k HAVING count(*) >= 100)
SELECT k, n, {R('m/9')} AS benford_mad, CASE WHEN m/9 >= 0.06 THEN 'high' WHEN m/9 >= 0.04 THEN 'medium' END AS severity FROM s""")
def q_benford(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("x"))
    return tidy(A.benford(l, K, "x", cut=0.04))


@query(f"""WITH l AS (SELECT l_suppkey AS k, CAST(floor(CAST(epoch_us(l_shipdate) AS DOUBLE)/2592000000000) AS BIGINT) AS bucket, l_extendedprice AS x FROM lineitem),
b AS (SELECT k, bucket, sum(x)*8 AS bits, count(*) AS n FROM l GROUP BY k, bucket), st AS (SELECT k, avg(bits) AS mu, stddev_pop(bits) AS s, count(*) AS nb, sum(n) AS nr FROM b GROUP BY k)
SELECT b.k, bucket, {R('bits',2)} AS bits, {R('(bits-mu)/s',4)} AS z, CASE WHEN abs((bits-mu)/s) >= 3.75 THEN 'high' ELSE 'medium' END AS severity FROM b JOIN st ON b.k=st.k WHERE s > 0 AND nb >= 4 AND nr >= 10 AND abs((bits-mu)/s) >= 2.5""")
def q_bitrate_zscore(spark, d):
    l = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("k"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(2.592e12)).alias("t"), F.col("l_extendedprice").alias("size")
    )
    out = A.bitrate_anomalies(l, K, "t", "size")
    return tidy(out.withColumn("bits", F.round("bits", 2)), 4)


HIST = """q AS (SELECT k, quantile_cont(x,0.05) AS lo, quantile_cont(x,0.95) AS hi, count(*) AS n FROM l GROUP BY k),
hb AS (SELECT l.k, least(CAST(floor((x-lo)/(hi-lo)*64) AS INT),63) AS b, count(*) AS c FROM l JOIN q ON l.k=q.k WHERE x BETWEEN lo AND hi AND hi > lo GROUP BY l.k, 2),
a0 AS (SELECT k, sum(c*c) AS s0, sum(c) AS used FROM hb GROUP BY k), al AS (SELECT x.k, sum(x.c*y.c) AS s FROM hb x JOIN hb y ON x.k=y.k AND y.b-x.b BETWEEN 2 AND 8 GROUP BY x.k),
per AS (SELECT q.k, q.n, CASE WHEN q.n >= 100 AND used >= 50 THEN coalesce(least(1.0, CAST(s AS DOUBLE)/CAST(s0 AS DOUBLE)/7),0) ELSE 0.0 END AS p FROM q LEFT JOIN a0 ON q.k=a0.k LEFT JOIN al ON q.k=al.k)"""
LX = "l AS (SELECT l_suppkey AS k, l_extendedprice AS x FROM lineitem)"


@query(f"WITH {LX}, {HIST} SELECT k, n, {R('p')} AS periodicity FROM per")
def q_hist_periodicity(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("x"))
    return tidy(A.histogram_periodicity(l, K, "x"))


@query(f"""WITH {LX}, {HIST}, mo AS (SELECT k, avg(x) AS mu, stddev_pop(x) AS sd FROM l GROUP BY k), ku AS (SELECT l.k, avg(power((x-mu)/sd,4))-3+4 AS ku, max(sd)/max(mu) AS cs FROM l JOIN mo ON l.k=mo.k GROUP BY l.k),
a AS (SELECT per.k, p, ku, cs, least(1.0,greatest(0.0,0.65*p+0.35*least(1.0,greatest(0.0,(ku-2)/8)))) AS dq, CASE WHEN ku < 2 THEN 0.0 WHEN ku < 5 THEN (ku-2)/6 WHEN ku < 10 THEN 0.5+(ku-5)/10 ELSE 1.0 END AS bl,
 CASE WHEN cs < 0.15 THEN 0.0 WHEN cs < 0.30 THEN (cs-0.15)/0.15*0.4 ELSE least(1.0,0.4+(cs-0.30)*2.0) END AS sp FROM per JOIN ku ON per.k=ku.k)
SELECT k, {R('dq')} AS double_quant, {R('bl')} AS blocking, {R('sp')} AS spatial, {R('least(1.0,0.5*dq+0.25*p+0.15*bl+0.1*sp)')} AS dct_score FROM a""")
def q_compression_score(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("x"))
    st = l.groupBy("k").agg((F.kurtosis("x") + 4).alias("ku"), (F.stddev_pop("x") / F.avg("x")).alias("cs"))
    j = A.histogram_periodicity(l, K, "x").join(st, "k")
    parts = A.compression_score(F.col("periodicity"), F.col("ku"), F.col("cs"))
    return tidy(j.select("k", *[c.alias(n) for n, c in parts.items()]))


@query(f"""WITH {SERIES}, c AS (SELECT k, kind, m // 10 AS cell, var_pop(x) AS v, avg(x) AS cm, stddev_pop(x) AS cs FROM series GROUP BY k, kind, m // 10),
fr AS (SELECT c.k, c.kind, c.cell, max(v) AS v, CASE WHEN max(cs)=0 THEN NULL ELSE avg(CASE WHEN cs > 0 THEN power((x-cm)/cs,3) END) END AS sk FROM c JOIN series ON c.k=series.k AND c.kind=series.kind AND series.m // 10 = c.cell GROUP BY c.k, c.kind, c.cell),
sk AS (SELECT k, cell, avg(v) AS v, avg(sk) AS sk FROM fr GROUP BY k, cell),
st AS (SELECT k, quantile_cont(v,0.5) AS md, avg(v) AS mu, stddev_pop(v) AS s FROM sk GROUP BY k),
o AS (SELECT sk.k, count(CASE WHEN v > 0.05*(md+1e-6) THEN 1 END) AS n_active, stddev_pop(CASE WHEN v > 0.05*(md+1e-6) THEN v END)/(avg(CASE WHEN v > 0.05*(md+1e-6) THEN v END)+1e-6) AS cvv,
 stddev_pop(sk)/(avg(abs(sk))+1e-6) AS cvs, count(CASE WHEN s > 0 AND abs(v-mu) > 2.5*s THEN 1 END) AS n_anomalous FROM sk JOIN st ON sk.k=st.k GROUP BY sk.k)
SELECT k, n_active, {R('cvv')} AS cv_variance, {R('cvs')} AS cv_skew, n_anomalous, {R('least(1.0,greatest(0.0,(cvv-0.3)/0.6))')} AS variance_score, {R('least(1.0,greatest(0.0,(cvs-0.4)/0.8))')} AS skew_score FROM o WHERE n_active >= 4""")
def q_grid_anomaly(spark, d):
    s = series(spark, d).withColumn("cell", F.floor(F.col("m") / 10))
    return tidy(A.grid_anomaly(s, K, "kind", ["cell"], "x"))


@query(f"""WITH {FRAMES}, g AS (SELECT k, avg(sin(atan2(vy,vx))) AS s, avg(cos(atan2(vy,vx))) AS c, count(*) AS n FROM frames GROUP BY k)
SELECT k, n, {R('atan2(s,c)')} AS mean_angle, {R('1-sqrt(s*s+c*c)')} AS circ_var, {R('least(1.0,greatest(0.0,(1-sqrt(s*s+c*c)-0.4)/0.5))')} AS score FROM g WHERE n >= 3""")
def q_circular(spark, d):
    return tidy(A.circular(frames(spark, d), K, F.atan2("vy", "vx")))


HALF = "hf AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY k ORDER BY t, tie) <= count(*) OVER (PARTITION BY k) // 2 THEN 1 ELSE 2 END AS half FROM series)"


@query(f"""WITH {SERIES}, {HALF}, g AS (SELECT k, avg(x) FILTER (WHERE half=1) AS a, avg(x) FILTER (WHERE half=2) AS b, sqrt(avg(x*x) FILTER (WHERE half=1)) AS r1, sqrt(avg(x*x) FILTER (WHERE half=2)) AS r2,
 quantile_cont(x,0.5) FILTER (WHERE half=1) AS m1, quantile_cont(x,0.5) FILTER (WHERE half=2) AS m2 FROM hf GROUP BY k)
SELECT k, {R('a')} AS mean_1, {R('b')} AS mean_2, {R('abs(a-b)')} AS half_diff, {R('greatest(r1,r2)/(least(r1,r2)+1e-6)')} AS rms_ratio, {R('greatest(m1,m2)/(least(m1,m2)+1e-6)')} AS median_ratio FROM g""")
def q_half_compare(spark, d):
    return tidy(A.half_compare(series(spark, d), K, O, "x"))


@query(f"""WITH {SERIES}, {HALF}, mm AS (SELECT k, m // 10 AS bin, coalesce(avg(x) FILTER (WHERE half=1),0) AS a, coalesce(avg(x) FILTER (WHERE half=2),0) AS b FROM hf GROUP BY k, m // 10),
tt AS (SELECT k, sum(a) AS ta, sum(b) AS tb FROM mm GROUP BY k)
SELECT mm.k, {R('sum(abs(a/ta-b/tb))')} AS l1, {R('sqrt(avg(power(10*(log10(a+1e-12)-log10(b+1e-12)),2)))')} AS lsd FROM mm JOIN tt ON mm.k=tt.k WHERE ta >= 1e-9 AND tb >= 1e-9 GROUP BY mm.k""")
def q_profile_shift(spark, d):
    h = A.with_half(series(spark, d), K, O).withColumn("bin", F.floor(F.col("m") / 10))
    return tidy(A.profile_shift(h, K, "half", "bin", "x"))


@query(f"""WITH {PX}, p AS (SELECT label, vec_id, v+1 AS v FROM px), q AS (SELECT label, vec_id, quantile_cont(v,0.25) AS lo, quantile_cont(v,0.75) AS hi FROM p GROUP BY label, vec_id),
f AS (SELECT p.label, p.vec_id, coalesce(avg(CASE WHEN v < lo THEN v END),0)/avg(CASE WHEN v > hi THEN v END) AS r FROM p JOIN q ON p.vec_id=q.vec_id GROUP BY p.label, p.vec_id)
SELECT label, count(*) AS n_frames, {R('avg(r)')} AS mean_ratio, {R('stddev_pop(r)/(avg(r)+1e-6)')} AS ratio_cv, {R('least(1.0,greatest(0.0,(stddev_pop(r)/(avg(r)+1e-6)-0.08)/0.25))')} AS score FROM f WHERE r IS NOT NULL GROUP BY label HAVING count(*) >= 3""")
def q_tail_ratio(spark, d):
    return tidy(A.tail_ratio(pixels(spark, d).withColumn("v", F.col("v") + 1), ["label"], "vec_id", "v"))


@query(f"""WITH {PX}, st AS (SELECT label, vec_id, avg(v) AS b, stddev_pop(v) AS s FROM px GROUP BY label, vec_id),
nb AS (SELECT label, vec_id, b, s, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM st),
dx AS (SELECT p.vec_id, sum(CASE WHEN q.pos = p.pos+1 AND p.pos % 8 <> 7 THEN abs(q.v-p.v) END)/56 + sum(CASE WHEN q.pos = p.pos+8 THEN abs(q.v-p.v) END)/56 AS bl FROM px p JOIN px q ON p.vec_id=q.vec_id AND q.pos IN (p.pos+1, p.pos+8) GROUP BY p.vec_id),
lp AS (SELECT p.vec_id, p.pos, sum(CASE WHEN q.pos=p.pos THEN -4*q.v ELSE q.v END) AS l FROM px p JOIN px q ON p.vec_id=q.vec_id AND q.pos IN (p.pos, p.pos-1, p.pos+1, p.pos-8, p.pos+8) WHERE p.pos % 8 BETWEEN 1 AND 6 AND p.pos // 8 BETWEEN 1 AND 6 GROUP BY p.vec_id, p.pos),
sh AS (SELECT vec_id, var_pop(l) AS sharp FROM lp GROUP BY vec_id),
ss AS (SELECT a.vec_id, covar_pop(a.v, c.v) AS cv, avg(a.v) AS ma, avg(c.v) AS mc, var_pop(a.v) AS va, var_pop(c.v) AS vc FROM px a JOIN nb ON a.vec_id=nb.vec_id JOIN px c ON c.vec_id=nb.nx AND c.pos=a.pos GROUP BY a.vec_id)
SELECT nb.label, nb.vec_id, {R('b')} AS brightness, {R('s')} AS contrast, {R('bl')} AS blockiness, {R('sharp')} AS sharpness, {R('((2*ma*mc+0.0001)*(2*cv+0.0009))/((ma*ma+mc*mc+0.0001)*(va+vc+0.0009))')} AS ssim
FROM nb JOIN dx ON nb.vec_id=dx.vec_id JOIN sh ON nb.vec_id=sh.vec_id LEFT JOIN ss ON nb.vec_id=ss.vec_id""")
def q_frame_metrics(spark, d):
    return tidy(A.frame_metrics(table(spark, d, "embeddings"), ["label"], ["vec_id"], "embedding").drop("embedding", "noise"))


@query(f"""WITH {PX}, e AS (SELECT label, vec_id, pos, r, c, v FROM (SELECT *, pos // 8 AS r, pos % 8 AS c FROM px)),
nb AS (SELECT label, vec_id, pos, v, unnest([-1,0,1]) AS a, r, c FROM e), n2 AS (SELECT *, unnest([-1,0,1]) AS b FROM nb),
n3 AS (SELECT *, (7-abs(7-abs(r+a)))*8 + 7-abs(7-abs(c+b)) AS q FROM n2),
h AS (SELECT n3.label, n3.vec_id, n3.pos, least(1.0, greatest(0.0, 9*max(n3.v) - sum(px.v))) AS h FROM n3 JOIN px ON n3.vec_id=px.vec_id AND n3.q=px.pos GROUP BY n3.label, n3.vec_id, n3.pos)
SELECT label, vec_id, {R('stddev_pop(h)')} AS noise FROM h GROUP BY label, vec_id""")
def q_noise_level(spark, d):
    return tidy(A.frame_metrics(table(spark, d, "embeddings"), ["label"], ["vec_id"], "embedding").select("label", "vec_id", "noise"))


@query(f"""WITH {PX}, b AS (SELECT label, vec_id, pos // 4 AS cell, 128+600*v AS b, pos*7 % 80 AS s FROM px),
f AS (SELECT label, vec_id, avg(CASE WHEN b > 220 AND s < 40 THEN 1.0 ELSE 0.0 END) AS r, avg(b) FILTER (WHERE b > 220 AND s < 40) AS i FROM b GROUP BY label, vec_id),
h AS (SELECT label, count(*) AS n_frames, avg(r) AS hr, stddev_pop(r)/(avg(r)+1e-6) AS ac, stddev_pop(i)/(avg(i)+1e-6) AS ic FROM f GROUP BY label),
q AS (SELECT label, vec_id, quantile_cont(b, 0.2) AS lo FROM b GROUP BY label, vec_id),
c AS (SELECT label, cell, avg(r) AS r FROM (SELECT b.label, b.vec_id, cell, avg(CASE WHEN b < lo THEN 1.0 ELSE 0.0 END) AS r FROM b JOIN q ON b.vec_id=q.vec_id AND b.label=q.label GROUP BY b.label, b.vec_id, cell) GROUP BY label, cell),
st AS (SELECT label, avg(r) AS m, stddev_pop(r) AS s FROM c GROUP BY label),
g AS (SELECT c.label, max(m) AS sr, max(s)/(max(m)+1e-6) AS sc, count(*) FILTER (WHERE s > 0 AND abs(r-m) > 2.5*s) AS n_regions FROM c JOIN st ON c.label=st.label GROUP BY c.label),
o AS (SELECT h.*, sr, sc, n_regions, least(1.0,greatest(0.0,ac-0.3)) AS ds, coalesce(least(1.0,greatest(0.0,(ic-0.05)/0.2)),0.0) AS iss FROM h JOIN g ON h.label=g.label)
SELECT label, n_frames, {R('hr')} AS highlight_ratio, {R('ac')} AS area_cv, {R('ic')} AS intensity_cv, {R('ds')} AS distribution_score, {R('iss')} AS intensity_score, {R('sr')} AS shadow_ratio, {R('sc')} AS shadow_cv, n_regions,
 {R('greatest(0.5*sc + 0.3*ds + 0.2*iss, CASE WHEN n_regions > 3 THEN 0.3 ELSE 0.0 END)')} AS score FROM o""")
def q_highlight_shadow(spark, d):
    b = pixels(spark, d).select("label", "vec_id", F.floor(F.col("pos") / 4).alias("cell"), (128 + 600 * F.col("v")).alias("b"), (F.col("pos") * 7 % 80).alias("s"))
    j = A.highlight_scores(b, ["label"], "vec_id", "b", "s").join(A.shadow_coverage(b, ["label"], "vec_id", "cell", "b"), "label")
    # the tables hold no shadow directions; the coverage CV stands for their score
    return tidy(j.withColumn("score", shadow_score(F.col("shadow_cv"), F.col("distribution_score"), F.col("intensity_score"), F.col("n_regions"))))


@query(f"""WITH {SERIES}, {HALF}, a AS (SELECT k, m // 10 AS b, count(*) FILTER (WHERE half=1) AS p, count(*) FILTER (WHERE half=2) AS q FROM hf GROUP BY k, m // 10)
SELECT k, {R('sqrt(greatest(0.0, 1-sum(sqrt(CAST(p AS DOUBLE)*q))/sqrt(CAST(sum(p) AS DOUBLE)*CAST(sum(q) AS DOUBLE))))')} AS distance FROM a GROUP BY k""")
def q_bhattacharyya(spark, d):
    h = A.with_half(series(spark, d), K, O).groupBy("k", "half", F.floor(F.col("m") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return tidy(A.bhattacharyya(h.filter("half = 1"), h.filter("half = 2"), K, "bin", "n"))


@query(f"""WITH {SERIES}, c AS (SELECT k, m, count(*) AS n FROM series GROUP BY k, m), t AS (SELECT k, sum(n) AS s FROM c GROUP BY k),
p AS (SELECT *, lag(m) OVER w AS pm, lag(n) OVER w AS pn, lead(m) OVER w AS nm, lead(n) OVER w AS nn FROM c WINDOW w AS (PARTITION BY k ORDER BY m)),
g AS (SELECT k, count(CASE WHEN n > (CASE WHEN pm = m-1 THEN pn ELSE 0 END) AND n > (CASE WHEN nm = m+1 THEN nn ELSE 0 END) THEN 1 END) AS n_peaks FROM p GROUP BY k)
SELECT c.k, {R('sum(-(n/CAST(s AS DOUBLE))*log2(n/CAST(s AS DOUBLE)))')} AS entropy, count(*) AS n_values, max(n_peaks) AS n_peaks FROM c JOIN t ON c.k=t.k JOIN g ON c.k=g.k GROUP BY c.k""")
def q_entropy(spark, d):
    return tidy(A.entropy(series(spark, d), K, "m"))


@query(f"""WITH {PX}, m AS (SELECT label, pos, avg(v) AS mv, count(*) AS n FROM px GROUP BY label, pos), b AS (SELECT label, pos // 8 AS b, greatest(var_pop(mv),1e-6) AS bv, count(*) AS w FROM m GROUP BY label, pos // 8),
g AS (SELECT label, sum(bv*w)/sum(w) AS gv FROM b GROUP BY label)
SELECT m.label, CAST(pos AS INT) AS pos, n AS n_frames, {R('mv/(bv+gv)')} AS value FROM m JOIN b ON m.label=b.label AND m.pos // 8 = b.b JOIN g ON m.label=g.label""")
def q_fingerprint(spark, d):
    fp = A.fingerprint(table(spark, d, "embeddings"), ["label"], "embedding")
    return tidy(fp.select("label", F.posexplode("fingerprint").alias("pos", "value"), "n_frames"))


@query(f"""WITH {PX}, r AS (SELECT label, CAST(floor(sqrt(power(pos % 8 - 4,2)+power(pos // 8 - 4,2))*4) AS INT) AS rd, avg(abs(v)) AS lv FROM px GROUP BY label, 2),
s AS (SELECT label, avg(lv) AS mu, stddev_pop(lv) AS sd, count(*) AS n FROM r GROUP BY label), z AS (SELECT r.label, rd, lv, mu, sd, n, CASE WHEN sd > 1e-8 THEN (lv-mu)/sd ELSE 0 END AS z FROM r JOIN s ON r.label=s.label),
c AS (SELECT a.label, b.rd-a.rd AS lg, sum(a.z*b.z) AS c FROM z a JOIN z b ON a.label=b.label AND b.rd-a.rd BETWEEN 2 AND 6 GROUP BY a.label, b.rd-a.rd), p AS (SELECT label, sum(abs(c))/count(*) AS p FROM c GROUP BY label),
o AS (SELECT label, max(n) AS n_radii, count(CASE WHEN lv > mu+3.5*sd THEN 1 END) AS n_peaks, sum(z*z) AS c0 FROM z GROUP BY label)
SELECT o.label, n_radii, n_peaks, {R('coalesce(least(1.0,4*p/(c0+1e-8)),0)')} AS periodicity FROM o LEFT JOIN p ON o.label=p.label""")
def q_radial(spark, d):
    p = pixels(spark, d).withColumn("v", F.abs("v"))
    dx, dy = (F.col("pos") % 8 - 4) * 4, (F.floor(F.col("pos") / 8) - 4) * 4
    prof = A.radial_profile(p, ["label"], dx.cast("double"), dy.cast("double"), "v")
    return tidy(A.radial_periodicity(prof, ["label"], "radius", "level", (2, 6)))


# five event kinds stand in for five audio detectors, each row is one fired check
KIND_MODULE = {"click": "enf", "error": "noise", "purchase": "compression", "signup": "voice", "view": "metadata"}
CHECKS = f"""{SERIES}, checks AS (SELECT k, t, tie, CASE kind WHEN 'click' THEN 'enf' WHEN 'error' THEN 'noise' WHEN 'purchase' THEN 'compression' WHEN 'signup' THEN 'voice' ELSE 'metadata' END AS module,
 least(1.0, x/200) AS score, 0.5+m/CAST(50 AS DOUBLE) AS weight, CASE WHEN x >= 120 THEN 'high' WHEN x >= 60 THEN 'medium' WHEN x >= 20 THEN 'low' ELSE 'info' END AS severity, m, x FROM series)"""


def checks(spark, d):
    s = series(spark, d)
    mod = F.element_at(F.create_map(*[F.lit(v) for kv in KIND_MODULE.items() for v in kv]), F.col("kind"))
    sev = F.when(F.col("x") >= 120, "high").when(F.col("x") >= 60, "medium").when(F.col("x") >= 20, "low").otherwise("info")
    return s.select("k", "t", "tie", mod.alias("module"), F.least(F.lit(1.0), F.col("x") / 200).alias("score"), (0.5 + F.col("m") / F.lit(50.0)).alias("weight"), sev.alias("severity"), "m", "x")


# written out here, apart from the operator's own table
_CONF = {"enf": (0.50, 0.08, 0.92, 0, 0), "noise": (0.45, 0.08, 0.88, 0.10, 0.10), "compression": (0.45, 0.09, 0.90, 0, 0), "reverberation": (0.40, 0.09, 0.85, 0, 0), "voice": (0.42, 0.09, 0.88, 0, 0), "metadata": (0.40, 0.10, 0.85, 0.08, 0.15)}


def _conf(i):
    return "CASE module " + " ".join(f"WHEN '{m}' THEN {v[i]}" for m, v in _CONF.items()) + " END"


@query(f"""WITH {CHECKS}, g AS (SELECT k, module, count(*) AS n_checks, count(CASE WHEN severity='high' THEN 1 END) AS n_high, sum(score*weight)/sum(weight) AS s, bool_or(m >= 90) AS mp FROM checks GROUP BY k, module)
SELECT k, module, n_checks, n_high, {R(f"least(1.0, s + CASE WHEN n_high >= 2 THEN {_conf(4)} WHEN n_high = 1 THEN {_conf(3)} ELSE 0 END)")} AS score, {R(f"least({_conf(2)}, {_conf(0)} + {_conf(1)}*n_checks)*CASE WHEN module='enf' AND NOT mp THEN 0.35 ELSE 1.0 END")} AS confidence FROM g""")
def q_module_score(spark, d):
    return tidy(A.module_score(checks(spark, d), K, "module", "score", "weight", "severity", F.col("m") >= 90))


@query(f"""WITH {CHECKS}, p AS (SELECT k, module, avg(score) AS s FROM checks GROUP BY k, module)
SELECT k, {R("least(1.0, sum(s*CASE module WHEN 'enf' THEN 0.4 WHEN 'noise' THEN 0.35 WHEN 'compression' THEN 0.25 ELSE 0 END))")} AS score, count(CASE WHEN module IN ('enf','noise','compression') THEN 1 END) AS n_parts FROM p GROUP BY k""")
def q_subscore_mix(spark, d):
    p = checks(spark, d).groupBy("k", "module").agg(F.avg("score").alias("s"))
    return tidy(A.subscore_mix(p, K, "module", "s", {"enf": 0.40, "noise": 0.35, "compression": 0.25}))


PT = "CASE severity WHEN 'high' THEN 25.0 WHEN 'medium' THEN 12.0 WHEN 'low' THEN 4.0 ELSE 0.0 END"


@query(f"""WITH {CHECKS}, f AS (SELECT *, CASE WHEN module IN ('enf','noise') THEN 'temporal' ELSE 'spatial' END AS dom FROM checks),
g AS (SELECT k, count(*) AS n, least(100.0,sum(CASE WHEN dom='temporal' THEN {PT} ELSE 0 END)) AS ts, least(100.0,sum(CASE WHEN dom='spatial' THEN {PT} ELSE 0 END)) AS ss, count(*) FILTER (WHERE dom='temporal') AS nt, count(*) FILTER (WHERE dom='spatial') AS ns,
 count(*) FILTER (WHERE dom='temporal' AND severity='high') AS ht, count(*) FILTER (WHERE dom='spatial' AND severity='high') AS hs, string_agg(DISTINCT module, ',' ORDER BY module) AS types FROM f GROUP BY k),
h AS (SELECT *, round(ts*0.4+ss*0.6,1) AS c FROM g)
SELECT k, n AS n_findings, {R('CAST(ts AS DOUBLE)')} AS temporal_score, {R('CAST(ss AS DOUBLE)')} AS spatial_score, {R('CAST(c AS DOUBLE)')} AS confidence, CASE WHEN c >= 80 AND (ht+hs >= 2 OR (ht>0 AND hs>0)) THEN 'LIKELY_TAMPERED' WHEN c >= 30 THEN 'REVIEW_RECOMMENDED' ELSE 'LIKELY_AUTHENTIC' END AS verdict,
 CASE WHEN nt>0 AND ns>0 THEN 'BOTH' WHEN nt>0 THEN 'TEMPORAL_EDIT' WHEN ns>0 THEN 'CONTENT_MANIPULATION' ELSE 'NONE' END AS edit_type, types FROM h""")
def q_points_verdict(spark, d):
    f = checks(spark, d).withColumn("domain", F.when(F.col("module").isin("enf", "noise"), "temporal").otherwise("spatial"))
    # severities arrive in mixed case; the points must not depend on it
    f = f.withColumn("severity", F.when(F.col("tie") % 2 == 0, F.upper("severity")).otherwise(F.col("severity")))
    return tidy(A.points_verdict(f, K, "domain", "severity", "module"))


@query(f"WITH {SERIES} SELECT k, {R('round(least(100.0, avg(x)*0.7+max(x)*0.3),1)')} AS score, count(CASE WHEN x > 30 THEN 1 END) AS n_flagged, count(x) AS n_frames FROM series GROUP BY k")
def q_mean_max_blend(spark, d):
    return tidy(A.mean_max_blend(series(spark, d), K, "x"))


BW = "CASE module WHEN 'integrity' THEN 0.30 WHEN 'speaker_match' THEN 0.25 WHEN 'enf' THEN 0.20 WHEN 'events' THEN 0.15 WHEN 'duplicates' THEN 0.10 END"


@query(f"""WITH {SERIES}, a AS (SELECT k, CASE kind WHEN 'click' THEN 'integrity' WHEN 'error' THEN 'speaker_match' WHEN 'purchase' THEN 'enf' WHEN 'signup' THEN 'events' ELSE 'duplicates' END AS module, avg(least(1.0, x/60)) AS c, count(CASE WHEN x > 150 THEN 1 END) AS iss, count(*) AS n FROM series GROUP BY k, kind),
b AS (SELECT k, module, CASE WHEN n < 8 THEN NULL ELSE c END AS c, iss FROM a),
g AS (SELECT k, sum(CASE WHEN c IS NOT NULL THEN c*{BW} END)/sum(CASE WHEN c IS NOT NULL THEN {BW} END) AS av, min(c) AS mn, count(CASE WHEN c IS NOT NULL AND iss > 0 THEN 1 END) AS n_flagged FROM b GROUP BY k)
SELECT k, n_flagged, {R('coalesce(round(least(1.0,greatest(0.0,0.5*av+0.5*mn-0.2*n_flagged)),3),0.5)')} AS score FROM g""")
def q_confidence_blend(spark, d):
    names = {"click": "integrity", "error": "speaker_match", "purchase": "enf", "signup": "events", "view": "duplicates"}
    mod = F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("kind"))
    p = series(spark, d).groupBy("k", mod.alias("module")).agg(
        F.avg(F.least(F.lit(1.0), F.col("x") / 60)).alias("c"), F.count(F.when(F.col("x") > 150, 1)).alias("issues"), F.count(F.lit(1)).alias("n")
    )
    p = p.withColumn("c", F.when(F.col("n") >= 8, F.col("c")))
    return tidy(A.confidence_blend(p, K, "module", "c", "issues"))


@query(f"""WITH {PX}, a AS (SELECT label, vec_id, abs(v) AS v FROM px), s AS (SELECT vec_id, avg(v) AS mu FROM a GROUP BY vec_id HAVING avg(v) >= 0.05), f AS (SELECT label, a.vec_id, avg(CASE WHEN v > 2*mu THEN 1.0 ELSE 0.0 END) AS f FROM a JOIN s ON a.vec_id=s.vec_id GROUP BY label, a.vec_id)
SELECT label, {R('avg(f)')} AS divergent_fraction, count(*) AS n_frames FROM f GROUP BY label""")
def q_divergent_fraction(spark, d):
    return tidy(A.divergent_fraction(pixels(spark, d).withColumn("v", F.abs("v")), ["label"], "vec_id", "v", 2.0, 0.05))


@query(f"""WITH {PX}, a AS (SELECT label, vec_id, abs(v) AS v FROM px), s AS (SELECT vec_id, avg(v) AS mu FROM a GROUP BY vec_id HAVING avg(v) >= 0.05), f AS (SELECT label, a.vec_id, avg(CASE WHEN v > 2*mu THEN 1.0 ELSE 0.0 END) AS f FROM a JOIN s ON a.vec_id=s.vec_id GROUP BY label, a.vec_id)
SELECT label, {R('avg(f)')} AS divergent_fraction, count(*) AS n_frames, CASE WHEN avg(f) >= 0.25 THEN 'high' WHEN avg(f) >= 0.1 THEN 'medium' END AS severity FROM f GROUP BY label""")
def q_divergent_severity(spark, d):
    f = A.divergent_fraction(pixels(spark, d).withColumn("v", F.abs("v")), ["label"], "vec_id", "v", 2.0, 0.05)
    return tidy(f.withColumn("severity", A.rate_severity(F.col("divergent_fraction"), 0.25, 0.10)))


@query(f"""WITH {FRAMES}, g AS (SELECT k, count(*) AS n_pairs, avg(CASE WHEN ssim < 0.4 THEN 1.0 ELSE 0.0 END) AS r FROM frames GROUP BY k)
SELECT k, n_pairs, {R('r')} AS residual_rate, CASE WHEN r >= 0.5 THEN 'high' WHEN r >= 0.25 THEN 'medium' END AS severity FROM g""")
def q_residual_rate(spark, d):
    return tidy(A.residual_rate(frames(spark, d), K, "ssim"))


@query(f"""WITH {SERIES}, g AS (SELECT k, avg(m/CAST(400 AS DOUBLE)) AS z, stddev_pop(x)/avg(x) AS lc, avg((k % 10)/CAST(25 AS DOUBLE)) AS hf, avg(CASE WHEN x > 250 THEN 1.0 ELSE 0.0 END) AS cl, avg(m)/1000 AS dc, count(CASE WHEN x < 0.5 THEN 1 END) AS gp FROM series GROUP BY k)
SELECT k, {R('z')} AS zcr, {R('lc')} AS level_cv, {R('hf')} AS hf_share, CAST(z > 0.1 AS INT)+CAST(lc > 0.8 AS INT)+CAST(hf > 0.25 AS INT) AS music_votes, CASE WHEN z > 0.1 AND lc > 0.8 AND hf > 0.25 THEN 'music' WHEN hf < 0.02 AND z < 0.08 THEN 'phone_speech' ELSE 'speech' END AS kind,
 {R('greatest(0.0, least(1.0, 1 - CASE WHEN cl > 0.001 THEN least(0.5, cl*10) ELSE 0 END - CASE WHEN abs(dc) > 0.05 THEN 0.15 ELSE 0 END - least(0.4, gp*0.15)))')} AS integrity FROM g""")
def q_signal_type(spark, d):
    s = series(spark, d)
    frames_ = s.select("k", (F.col("m") / F.lit(400.0)).alias("z"), "x", (F.col("k") % 10 / F.lit(25.0)).alias("h"))
    kinds = A.signal_type(frames_, K, "z", "x", "h")
    health = s.groupBy("k").agg(A.integrity_confidence(F.avg((F.col("x") > 250).cast("double")), F.avg("m") / 1000, F.count(F.when(F.col("x") < 0.5, 1))).alias("integrity"))
    return tidy(kinds.join(health, "k"))


@query(f"""SELECT conv_id AS k, {R("avg((CASE WHEN role <> 'system' THEN 1.0 ELSE 0 END + CASE WHEN length(text) > 100 THEN 1.0 ELSE 0 END + CASE WHEN text LIKE '%,%' THEN 1.0 ELSE 0 END + 1.0)/4)")} AS completeness, count(*) AS n FROM conversations GROUP BY conv_id""")
def q_completeness(spark, d):
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("k"), F.col("turn").alias("a"), F.when(F.col("role") != "system", F.col("role")).alias("b"),
        F.when(F.length("text") > 100, 1).alias("c"), F.when(F.col("text").contains(","), 1).alias("e"),
    )
    return tidy(A.completeness(c, K, ["a", "b", "c", "e"]))


@query(f"WITH {CHECKS} SELECT coalesce(module,'TOTAL') AS module, coalesce(severity,'TOTAL') AS severity, count(*) AS n FROM checks GROUP BY ROLLUP(module, severity)")
def q_finding_rollup(spark, d):
    return A.finding_rollup(checks(spark, d), "module", "severity")


@query(f"WITH {CHECKS} SELECT coalesce(module,'TOTAL') AS module, coalesce(severity,'TOTAL') AS severity, count(*) AS n FROM checks GROUP BY CUBE(module, severity)")
def q_finding_cube(spark, d):
    return A.finding_rollup(checks(spark, d), "module", "severity", cube=True)


RANK = "CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


@query(f"""WITH {CHECKS} SELECT k, count(*) AS total_findings, count(DISTINCT module) AS modules_completed, CASE max({RANK}) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS highest_severity,
 string_agg(DISTINCT CASE WHEN severity='high' THEN module END, ',' ORDER BY CASE WHEN severity='high' THEN module END) AS high_modules FROM checks GROUP BY k""")
def q_case_summary(spark, d):
    return A.case_summary(checks(spark, d), K)


@query("SELECT source, count(DISTINCT lang) AS n_lang, count(DISTINCT md5(text)) AS n_text, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def q_distinct_tags(spark, d):
    # languages are a small closed set; texts are counted, never collected
    t = table(spark, d, "documents")
    return t.groupBy("source").agg(
        F.countDistinct("lang").alias("n_lang"), F.countDistinct(F.md5("text")).alias("n_text"), F.array_join(F.sort_array(F.collect_set("lang")), ",").alias("langs")
    )


@query(f"""WITH {SERIES}, h AS (SELECT k, count(*) AS n, count(CASE WHEN x > 120 THEN 1 END) AS hits, min(CASE WHEN x > 120 THEN t END) AS s, max(CASE WHEN x > 120 THEN t END) AS e, avg(x) AS mu, stddev_pop(x)/avg(x) AS cv FROM series GROUP BY k)
SELECT k, 'level' AS type, CASE WHEN hits*1.0/n > 0.12 THEN 'high' ELSE 'medium' END AS severity, {R('least(0.9, hits*1.0/n*5)')} AS score, {R('s')} AS start_s, {R('e')} AS end_s FROM h WHERE hits > 0
UNION ALL SELECT k, 'variation', 'medium', {R('least(1.0, cv*0.6)')}, NULL, NULL FROM h WHERE cv > 1""")
def q_subresult_findings(spark, d):
    # Summary row per asset to findings with severity, capped score and hit bounds
    from mediasift.functions.exprs import explode_rules, finding

    hit = F.col("x") > 120
    h = series(spark, d).groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(hit, 1)).alias("hits"), F.min(F.when(hit, F.col("t"))).alias("s"), F.max(F.when(hit, F.col("t"))).alias("e"),
        (F.stddev_pop("x") / F.avg("x")).alias("cv"),
    )
    rate = F.col("hits") / F.col("n")
    out = explode_rules(h, K, [
        F.when(F.col("hits") > 0, finding("compression", "level", F.when(rate > 0.12, "high").otherwise("medium"), score=F.least(F.lit(0.9), rate * 5), start=F.col("s"), end=F.col("e"))),
        F.when(F.col("cv") > 1, finding("compression", "variation", "medium", score=F.col("cv") * 0.6)),
    ])
    return tidy(out.select("k", "type", "severity", "score", "start_s", "end_s"))


@query(f"""WITH {SERIES}, {HALF}, g AS (SELECT k, stddev_pop(x)/avg(x)*0.15 AS tilt, stddev_pop(m)/avg(m)*0.3 AS hfe, stddev_pop(x)/avg(x) AS rc, max(x)/60 AS mz, stddev_pop(x)/avg(x)*0.02 AS sfm,
 sqrt(avg(x*x) FILTER (WHERE half=1)) AS r1, sqrt(avg(x*x) FILTER (WHERE half=2)) AS r2, k % 3 = 0 AS lossy, CASE WHEN k % 5 > 0 THEN arg_max(t-473352, [x, tie]) END AS ct, max(t-473352) AS du FROM hf GROUP BY k), q AS (SELECT *, greatest(r1,r2)/least(r1,r2) AS hr, mz*2 AS lsd, mz AS sr FROM g)
SELECT k, 'noise' AS module, 'tilt' AS type, CASE WHEN tilt >= 0.15 THEN 'high' ELSE 'medium' END AS severity, {R('CASE WHEN tilt >= 0.15 THEN least(0.85,0.55+(tilt-0.15)*0.5) ELSE least(1.0,0.35+(tilt-0.04)*1.5) END')} AS score, 1.5::DOUBLE AS weight, NULL::DOUBLE AS start_s, NULL::DOUBLE AS end_s FROM q WHERE NOT lossy AND tilt >= 0.04
UNION ALL SELECT k,'noise','high_band','low',0.2,0.5, NULL, NULL FROM q WHERE NOT lossy AND hfe >= 0.15
UNION ALL SELECT k,'noise','level','low',0.2,0.4, NULL, NULL FROM q WHERE rc >= 0.25 AND hr > 1.5
UNION ALL SELECT k,'noise','change_point',CASE WHEN lsd > 5 THEN 'high' ELSE 'medium' END, {R('least(0.8,0.4+least(lsd,20.0)/40)')}, 2.0, {R('greatest(0.0,ct-0.5)')}, {R('least(du,ct+0.5)')} FROM q WHERE NOT lossy AND ct IS NOT NULL AND lsd >= 4
UNION ALL SELECT k,'reverberation','change',CASE WHEN mz >= 8 THEN 'high' ELSE 'medium' END, {R('CASE WHEN mz >= 8 THEN least(0.8,0.55+least(mz-8,20)/60) ELSE 0.35+(mz-4)/20 END')}, 2.0, NULL, NULL FROM q WHERE mz >= 4
UNION ALL SELECT k,'reverberation','flatness','low',0.18,0.5, NULL, NULL FROM q WHERE sfm >= 0.015 AND mz < 8
UNION ALL SELECT k,'reverberation','sub_bass','low',0.2,0.4, NULL, NULL FROM q WHERE sr >= 3 AND mz >= 4
UNION ALL SELECT k,'voice','spectrum',CASE WHEN lsd >= 9 THEN 'high' ELSE 'medium' END, {R('CASE WHEN lsd >= 9 THEN least(0.75,0.55+(lsd-9)/30) ELSE 0.35+(lsd-6)/15 END')}, 1.5, NULL, NULL FROM q WHERE lsd >= 6""")
def q_audio_checks(spark, d):
    from mediasift.operators.series import audio_checks

    h = A.with_half(series(spark, d), K, O)
    r = lambda i: F.sqrt(F.avg(F.when(F.col("half") == i, F.col("x") * F.col("x"))))
    cvx = F.stddev_pop("x") / F.avg("x")
    g = h.groupBy("k").agg(
        (cvx * 0.15).alias("tilt_cv"), (F.stddev_pop("m") / F.avg("m") * 0.3).alias("hfe_cv"), cvx.alias("rms_cv"), (F.max("x") / 60).alias("max_z"),
        (cvx * 0.02).alias("sfm_cv"), r(1).alias("r1"), r(2).alias("r2"), F.max_by(F.col("t") - 473352, F.struct("x", "tie")).alias("_at"), F.max(F.col("t") - 473352).alias("duration"),
    )
    g = g.select("*", (F.greatest("r1", "r2") / F.least("r1", "r2")).alias("half_ratio"), (F.col("max_z") * 2).alias("lsd"), F.col("max_z").alias("sub_ratio"), (F.col("k") % 3 == 0).alias("lossy"))
    # the loudest moment stands for the change point
    g = g.withColumns({"change_z": F.col("lsd"), "change_t": F.when(F.col("k") % 5 > 0, F.col("_at"))})
    return tidy(audio_checks(g, K).select("k", "module", "type", "severity", "score", "weight", "start_s", "end_s"))


@query(f"""WITH {CHECKS}, f AS (SELECT k, CASE WHEN module IN ('enf','noise') THEN 'temporal' ELSE 'spatial' END AS dom, module, severity FROM checks),
t AS (SELECT k, dom, module, max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS r, count(*) AS n, count(*) FILTER (WHERE severity='high') AS h FROM f GROUP BY k, dom, module),
q AS (SELECT *, row_number() OVER (PARTITION BY k, dom ORDER BY r DESC, module) AS z FROM t)
SELECT k, dom AS domain, CAST(sum(n) AS BIGINT) AS n_findings, CAST(sum(h) AS BIGINT) AS n_high, string_agg(module, ',' ORDER BY z) FILTER (WHERE z <= 2) AS top_types FROM q GROUP BY k, dom""")
def q_top_types(spark, d):
    f = checks(spark, d).withColumn("domain", F.when(F.col("module").isin("enf", "noise"), "temporal").otherwise("spatial"))
    return A.top_types(f, K, "domain", "severity", "module", n=2)
