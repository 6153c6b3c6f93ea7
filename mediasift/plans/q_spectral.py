"""T: spectral and block queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.operators import blocks as B
from mediasift.operators import chunks as C
from mediasift.operators import spectral as T
from mediasift.plans.bindings import SERIES, series, table
from mediasift.plans.registry import R, query, tidy

# every vector is a 64-sample signal at 64 samples per second
SR, WIN, HOP = 64.0, 32, 16
VK = ["vec_id"]
FR = f"""sm AS (SELECT vec_id, i-1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(generate_series(1,64)) AS i FROM embeddings)),
fr AS (SELECT vec_id, w AS win, i-w*{HOP} AS n, x, x*(0.5-0.5*cos(2*pi()*(i-w*{HOP})/{WIN - 1})) AS xw FROM sm, generate_series(0,2) g(w) WHERE i >= w*{HOP} AND i < w*{HOP}+{WIN}),
sp AS (SELECT vec_id, win, b AS bin, power(sum(xw*cos(2*pi()*b*n/{WIN})),2)+power(sum(xw*sin(2*pi()*b*n/{WIN})),2) AS p FROM fr, generate_series(0,{WIN // 2}) h(b) GROUP BY vec_id, win, b)"""


def framed(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.lit(0).alias("start"), "embedding")
    return C.chunk_frames(e, VK, "start", "embedding", WIN, HOP)


def spectra(spark, d):
    return framed(spark, d).select("vec_id", "win", T.power_spectrum(F.col("samples")).alias("power"))


@query(f"WITH {FR} SELECT vec_id, win, CAST(bin AS INT) AS bin, {R('bin*2.0')} AS freq, {R('p')} AS power FROM sp")
def q_spectrum(spark, d):
    return tidy(T.spectrum(framed(spark, d), VK, SR, WIN))


FREQS = {"day": 1 / 24.0, "half_day": 1 / 12.0, "two_days": 1 / 48.0}


def _pw(f):
    return f"(power(sum(y*cos(s*{2 * T.PI * f!r})),2)+power(sum(y*sin(s*{2 * T.PI * f!r})),2))/count(*)"


@query(f"""WITH {SERIES}, z AS (SELECT k, t-473352 AS s, x-50 AS y FROM series), g AS (SELECT k, count(*) AS n, sum(y*y) AS e, {_pw(FREQS['day'])} AS d, {_pw(FREQS['half_day'])} AS h, {_pw(FREQS['two_days'])} AS w FROM z GROUP BY k)
SELECT k, n, {R('e',4)} AS energy, {R('d',4)} AS day, {R('h',4)} AS half_day, {R('w',4)} AS two_days, CASE WHEN d >= h AND d >= w THEN 'day' WHEN h >= w THEN 'half_day' ELSE 'two_days' END AS best, {R('10*log10((d+1e-12)/(greatest(e-d,0)+1e-12))',4)} AS snr_db FROM g""")
def q_band_power(spark, d):
    out = T.band_power(series(spark, d), ["k"], F.col("t") - 473352.0, F.col("x") - 50.0, FREQS)
    return tidy(out.withColumn("snr_db", T.band_snr(F.col("day"), F.col("energy"))), 4)


@query(f"""WITH {FR}, b AS (SELECT *, lag(p) OVER w AS a, lead(p) OVER w AS c, row_number() OVER (PARTITION BY vec_id, win ORDER BY CASE WHEN bin >= 1 THEN p END DESC NULLS LAST) AS q FROM sp WINDOW w AS (PARTITION BY vec_id, win ORDER BY bin))
SELECT vec_id, win, CAST(bin AS INT) AS peak_bin, {R('(bin + coalesce(CASE WHEN c IS NULL OR abs(a-2*p+c) < 1e-12 THEN 0 ELSE 0.5*(a-c)/(a-2*p+c) END,0))*2.0')} AS peak_freq, {R('p')} AS peak_power FROM b WHERE q = 1""")
def q_peak_track(spark, d):
    return tidy(T.peak_track(spectra(spark, d), ["vec_id", "win"], "power", SR / WIN))


@query(f"""WITH {FR}, m AS (SELECT vec_id, win, max(p) AS mx FROM sp GROUP BY vec_id, win), l AS (SELECT *, lag(p) OVER (PARTITION BY vec_id, bin ORDER BY win) AS pp FROM sp)
SELECT l.vec_id, l.win, {R('sum(p*bin*2)/(sum(p)+1e-12)')} AS centroid, {R('max(CASE WHEN p >= mx*1e-4 THEN bin*2.0 END)')} AS bandwidth, {R('exp(avg(ln(p+1e-12)))/(avg(p)+1e-12)')} AS flatness, {R('sum(CASE WHEN bin*2 < 8 THEN p ELSE 0 END)/(sum(CASE WHEN bin*2 >= 8 AND bin*2 < 20 THEN p ELSE 0 END)+1e-12)',4)} AS tilt,
 {R('sum(CASE WHEN bin*2 >= 24 THEN p ELSE 0 END)/(sum(CASE WHEN bin*2 >= 8 AND bin*2 < 20 THEN p ELSE 0 END)+1e-12)',4)} AS hfe, {R('sum(greatest(sqrt(p)-sqrt(pp),0) + CASE WHEN pp IS NULL THEN NULL ELSE 0 END)')} AS flux FROM l JOIN m ON l.vec_id=m.vec_id AND l.win=m.win GROUP BY l.vec_id, l.win""")
def q_spectral_features(spark, d):
    f = T.features(spectra(spark, d), VK, ["win"], "power", SR / WIN, (8.0, 20.0), 24.0)
    return tidy(f.withColumn("tilt", F.round("tilt", 4)).withColumn("hfe", F.round("hfe", 4)))


@query(f"""WITH {FR}, ac AS (SELECT a.vec_id, a.win, b.n-a.n AS lag, sum(a.x*b.x) AS c FROM fr a JOIN fr b ON a.vec_id=b.vec_id AND a.win=b.win AND b.n-a.n BETWEEN 2 AND 12 GROUP BY a.vec_id, a.win, b.n-a.n), e AS (SELECT vec_id, win, sum(x*x)+1e-12 AS e FROM fr GROUP BY vec_id, win),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, win ORDER BY c DESC, lag) AS q FROM ac) SELECT r.vec_id, r.win, CAST(lag AS INT) AS lag, {R('c/e')} AS peak, {R('64.0/lag')} AS f0, c/e > 0.35 AS voiced FROM r JOIN e ON r.vec_id=e.vec_id AND r.win=e.win WHERE q=1""")
def q_autocorr_peak(spark, d):
    return tidy(T.autocorr_peak(framed(spark, d), ["vec_id", "win"], "samples", SR, (2, 12)))


@query(f"""WITH p AS (SELECT vec_id, (i-1)//8 AS y, (i-1)%8 AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1,64)) AS i FROM embeddings)), k AS (SELECT j//8 AS u, j%8 AS w, j FROM generate_series(0,63) g(j))
SELECT vec_id, CAST(j AS INT) AS coef, {R("sum(v*cos(pi()*(2*y+1)*u/16)*cos(pi()*(2*x+1)*w/16))*max(CASE WHEN u=0 THEN sqrt(0.125) ELSE 0.5 END)*max(CASE WHEN w=0 THEN sqrt(0.125) ELSE 0.5 END)")} AS value FROM p, k GROUP BY vec_id, j""")
def q_block_dct(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", T.block_dct(F.col("embedding")).alias("c"))
    return tidy(e.select("vec_id", F.posexplode("c").alias("coef", "value")))


@query(f"""WITH p AS (SELECT vec_id, (i-1)//8 AS y, (i-1)%8 AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1,64)) AS i FROM embeddings)),
r AS (SELECT a.vec_id, a.y, a.x, max(a.v)-avg(b.v) AS r FROM p a JOIN p b ON a.vec_id=b.vec_id AND b.y BETWEEN a.y-1 AND a.y+1 AND b.x BETWEEN a.x-1 AND a.x+1 GROUP BY a.vec_id, a.y, a.x)
SELECT vec_id, count(*) AS n, {R('var_pop(r)')} AS residual_var, {R('avg(abs(r))')} AS residual_mean FROM r GROUP BY vec_id""")
def q_residual_var(spark, d):
    # one block a frame
    e = table(spark, d, "embeddings").select("vec_id", F.lit(0).alias("by"), F.lit(0).alias("bx"), "embedding")
    b = B.with_border(e, VK, "by", "bx", "embedding", 8)
    s = b.select("vec_id", B.block_sums(F.col("padded"), F.col("by"), F.col("bx"), 8, 1.0).alias("s"))
    n = F.col("s.n")
    return tidy(s.select("vec_id", n.cast("bigint").alias("n"), (F.col("s.res2") / n - (F.col("s.res") / n) ** 2).alias("residual_var"), (F.col("s.ares") / n).alias("residual_mean")))


# eight recordings, their vectors one after the other as chunks of 64 samples
LONG = """ls AS (SELECT k, (c*64+i-1) AS p, x FROM (SELECT vec_id % 8 AS k, vec_id // 8 AS c, unnest(generate_series(1,64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings))"""


def recordings(spark, d):
    return table(spark, d, "embeddings").select((F.col("vec_id") % 8).alias("k"), (F.floor(F.col("vec_id") / 8) * 64).alias("start"), "embedding")


@query(f"""WITH {LONG}, n AS (SELECT k, max(p)+1 AS n FROM ls GROUP BY k), w AS (SELECT k, unnest(generate_series(0, (n-100)//40)) AS win FROM n WHERE n >= 100)
SELECT w.k, win, {R('sum(x*x)')} AS energy, {R('sum(x*(p-win*40))')} AS slope, count(*) AS n FROM w JOIN ls ON ls.k=w.k AND p >= win*40 AND p < win*40+100 GROUP BY w.k, win""")
def q_chunk_frames(spark, d):
    f = C.chunk_frames(recordings(spark, d), ["k"], "start", "embedding", 100, 40, tile=400)
    x = F.col("samples")
    tot = lambda a: F.aggregate(a, F.lit(0.0), lambda s, e: s + e)
    return tidy(f.select("k", "win", tot(F.transform(x, lambda v: v * v)).alias("energy"), tot(F.transform(x, lambda v, i: v * i)).alias("slope"), F.size(x).cast("bigint").alias("n")))


@query(f"""WITH {LONG}, f AS (SELECT k, p//16 AS win, sqrt(sum(x*x)/16) AS rms FROM ls GROUP BY k, p//16 HAVING count(*) = 16), g AS (SELECT *, max(rms) OVER (PARTITION BY k) AS pk FROM f),
h AS (SELECT *, greatest(0.001, pk*0.6) AS fl, rms < greatest(0.001, pk*0.6) AS q FROM g), r AS (SELECT *, win - row_number() OVER (PARTITION BY k, q ORDER BY win) AS g FROM h), p AS (SELECT k, g, count(*)*16/64.0 AS s, min(win)*16/64.0 AS t FROM r WHERE q GROUP BY k, g),
m AS (SELECT k, median(s) AS md FROM p GROUP BY k), a AS (SELECT p.k, count(*) AS n, max(md) AS md, max(greatest(0.5, 2*md)) AS lim, count(CASE WHEN s > greatest(0.5, 2*md) THEN 1 END) AS bad, max(s) AS lng, min(CASE WHEN s > greatest(0.5, 2*md) THEN t END) AS ft FROM p JOIN m ON p.k=m.k GROUP BY p.k)
SELECT h.k, count(*) AS n_frames, count(CASE WHEN q THEN 1 END) AS n_silent, {R('max(pk)')} AS peak, {R('max(fl)')} AS floor, coalesce(max(n),0) AS n_pauses, {R('max(md)')} AS median_pause, {R('max(lim)')} AS pause_limit, coalesce(max(bad),0) AS n_anomalous, {R('max(lng)')} AS longest_pause, {R('max(ft)')} AS first_anomaly
 FROM h LEFT JOIN a ON a.k=h.k GROUP BY h.k""")
def q_pause_model(spark, d):
    return tidy(C.pause_model(recordings(spark, d), ["k"], "start", "embedding", SR, 16, ratio=0.6, min_pause=0.5, factor=2.0))


_DB = lambda n, w: f"CASE WHEN {w}/n < 1e-20 THEN 0.0 ELSE 10*log10(greatest({n},1e-300)/{w}) END"
_E = lambda lo, hi: f"sum(CASE WHEN f BETWEEN {lo} AND {hi} THEN e ELSE 0 END)"


@query(f"""WITH {LONG}, n AS (SELECT k, count(*) AS n, count(DISTINCT p//200) AS sg FROM ls GROUP BY k), z AS (SELECT k, p//200 AS s, b, sum(x*cos(2*pi()*b*(p%200)/200)) AS c, sum(x*sin(2*pi()*b*(p%200)/200)) AS d FROM ls, generate_series(20,55) g(b) GROUP BY k, p//200, b),
e AS (SELECT k, b*2.0 AS f, (c*c+d*d)*2/200 AS e FROM z), g AS (SELECT k, {_E(49,51)} AS b1, {_E(49.8,50.2)} AS n1, {_E(40,60)} AS w1, {_E(99,101)} AS b2, {_E(99.8,100.2)} AS n2, {_E(90,110)} AS w2 FROM e GROUP BY k),
q AS (SELECT n.k, n, sg, b1, b2, {_DB('n1','w1')} AS d1, {_DB('n2','w2')} AS d2 FROM n JOIN g ON n.k=g.k)
SELECT k, n AS n_samples, sg AS n_segments, {R('b1/n')} AS fundamental_power, {R('b2/n')} AS harmonic_power, {R('d1')} AS fundamental_db, {R('d2')} AS harmonic_db, d1 > -11 AS present, d2 > -11 AND d1 <= -11 AS harmonic_only FROM q""")
def q_mains_band(spark, d):
    # 400 samples a second: a segment of half a second takes parts of four or five chunks
    return tidy(C.mains_band(recordings(spark, d), ["k"], "start", "embedding", 400.0, 50, seconds=0.5, present_db=-11.0))


# frames of 16 x 16 pixels in four blocks
PX16 = """px AS (SELECT a, f, ry*8+(i-1)//8 AS y, rx*8+(i-1)%8 AS x, v FROM (SELECT vec_id // 32 AS a, vec_id // 4 % 8 AS f, vec_id // 2 % 2 AS ry, vec_id % 2 AS rx, unnest(generate_series(1,64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"""
_UD = lambda c: f"coalesce(lag({c}) OVER v, lead({c}) OVER v)"
_DN = lambda c: f"coalesce(lead({c}) OVER v, lag({c}) OVER v)"
_NEAR = lambda c: f"coalesce(lag({c}) OVER v, 0) + {c} + coalesce(lead({c}) OVER v, 0)"


@query(f"""WITH {PX16}, h AS (SELECT *, coalesce(lag(v) OVER w, lead(v) OVER w) AS l, coalesce(lead(v) OVER w, lag(v) OVER w) AS r, lead(v) OVER w AS nx, coalesce(lag(v) OVER w, 0) + v + coalesce(lead(v) OVER w, 0) AS s0, count(*) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS c0 FROM px WINDOW w AS (PARTITION BY a, f, y ORDER BY x)),
t AS (SELECT *, r-l AS dx, l+2*v+r AS sm, l+v+r AS s3 FROM h),
u AS (SELECT a, f, y, x, v, nx, lead(v) OVER v AS ny, l+r+{_UD('v')}+{_DN('v')}-4*v AS lap, {_UD('dx')}+2*dx+{_DN('dx')} AS gx, {_DN('sm')}-{_UD('sm')} AS gy, least(1.0, greatest(0.0, 9*v-s3-{_UD('s3')}-{_DN('s3')})) AS hp, v-({_NEAR('s0')})/({_NEAR('c0')}) AS res FROM t WINDOW v AS (PARTITION BY a, f, x ORDER BY y)),
g AS (SELECT a, f, count(*)//64 AS nb, avg(v) AS br, stddev_pop(v) AS ct, var_pop(lap) AS sh, avg(abs(gx))+avg(abs(gy)) AS bl, (sum(CASE WHEN x=7 THEN coalesce(abs(nx-v),0) ELSE 0 END)+sum(CASE WHEN y=7 THEN coalesce(abs(ny-v),0) ELSE 0 END))/nullif(count(CASE WHEN x=7 THEN nx END)+count(CASE WHEN y=7 THEN ny END),0)
 /((sum(CASE WHEN x<>7 THEN coalesce(abs(nx-v),0) ELSE 0 END)+sum(CASE WHEN y<>7 THEN coalesce(abs(ny-v),0) ELSE 0 END))/(count(CASE WHEN x<>7 THEN nx END)+count(CASE WHEN y<>7 THEN ny END))) AS ratio, stddev_pop(hp) AS nz, var_pop(res) AS rv, avg(abs(res)) AS rm FROM u GROUP BY a, f),
m AS (SELECT p.a, p.f, avg(p.v) AS ma, avg(q.v) AS mb, var_pop(p.v) AS va, var_pop(q.v) AS vb, covar_pop(p.v, q.v) AS cv FROM px p JOIN px q ON p.a=q.a AND q.f=p.f+1 AND p.y=q.y AND p.x=q.x GROUP BY p.a, p.f)
SELECT g.a, g.f, nb AS n_blocks, {R('br')} AS brightness, {R('ct')} AS contrast, {R('sh')} AS sharpness, {R('bl')} AS blockiness, {R('ratio')} AS boundary_ratio, {R('nz')} AS noise, {R('rv')} AS residual_var, {R('rm')} AS residual_mean, {R('(2*ma*mb+0.0001)*(2*cv+0.0009)/((ma*ma+mb*mb+0.0001)*(va+vb+0.0009))')} AS ssim FROM g LEFT JOIN m ON g.a=m.a AND g.f=m.f""")
def q_frame_rollup(spark, d):
    v = F.col("vec_id")
    b = table(spark, d, "embeddings").select(F.floor(v / 32).alias("a"), (F.floor(v / 4) % 8).alias("f"), (F.floor(v / 2) % 2).alias("by"), (v % 2).alias("bx"), "embedding")
    return tidy(B.frame_rollup(b, ["a"], "f", "by", "bx", "embedding"))
