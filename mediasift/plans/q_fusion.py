"""F: fusion, interpretation and reporting queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.operators import stats as A
from mediasift.plans import fusion as FU
from mediasift.plans import results as RS
from mediasift.plans.bindings import SERIES, series, table
from mediasift.plans.q_stats import CHECKS, checks
from mediasift.plans.registry import R, query, tidy

K = ["k"]
# events to detector scores: five kinds, one score per (user, kind)
SCORES = f"""{SERIES}, g0 AS (SELECT k, kind, stddev_pop(x) AS sd, avg(m) AS am, count(*) AS n, max(x) AS mx FROM series GROUP BY k, kind),
scores AS (SELECT k, CASE kind WHEN 'click' THEN 'enf' WHEN 'error' THEN 'noise' WHEN 'purchase' THEN 'compression' WHEN 'signup' THEN 'voice' ELSE 'metadata' END AS module,
 least(1.0, sd/120) AS score, least(1.0, am/80) AS confidence, n < 7 AS skipped, n*CAST(0.6 AS DOUBLE) AS snr_db, mx > 150 AS enf_present, least(0.5, 2.0/n) AS uncertainty, n >= 9 AS reliable, n FROM g0)"""


def scores(spark, d):
    names = {"click": "enf", "error": "noise", "purchase": "compression", "signup": "voice", "view": "metadata"}
    mod = F.element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), F.col("kind"))
    g = series(spark, d).groupBy("k", "kind").agg(F.stddev_pop("x").alias("sd"), F.avg("m").alias("am"), F.count(F.lit(1)).alias("n"), F.max("x").alias("mx"))
    return g.select(
        "k", mod.alias("module"), F.least(F.lit(1.0), F.col("sd") / 120).alias("score"), F.least(F.lit(1.0), F.col("am") / 80).alias("confidence"), (F.col("n") < 7).alias("skipped"),
        (F.col("n") * 0.6).alias("snr_db"), (F.col("mx") > 150).alias("enf_present"), F.least(F.lit(0.5), 2.0 / F.col("n")).alias("uncertainty"), (F.col("n") >= 9).alias("reliable"), "n",
    )


def video_scores(spark, d):
    m = {"enf": "noise", "noise": "temporal", "compression": "compression", "voice": "lighting", "metadata": "metadata"}
    return scores(spark, d).withColumn("module", F.element_at(F.create_map(*[F.lit(v) for kv in m.items() for v in kv]), F.col("module")))


AW = "CASE module WHEN 'enf' THEN 0.30 WHEN 'noise' THEN 0.22 WHEN 'compression' THEN 0.18 WHEN 'voice' THEN 0.10 WHEN 'metadata' THEN 0.08 END"


AFUSE = f"""{SCORES}, act AS (SELECT *, CAST({AW} AS DOUBLE) AS w FROM scores WHERE NOT skipped), sk AS (SELECT k, string_agg(module, ',' ORDER BY module) FILTER (WHERE skipped) AS skipped_modules FROM scores GROUP BY k),
fl AS (SELECT k, bool_or(module='enf' AND (score >= 0.3 OR enf_present OR snr_db > 5)) AS ep, bool_or(module <> 'metadata' AND score >= 0.35) AS ael, coalesce(sum(w) FILTER (WHERE module='enf'),0) AS ew, sum(w) AS tw, count(*) AS na FROM act GROUP BY k),
adj AS (SELECT act.k, module, confidence, CASE WHEN module='metadata' THEN CASE WHEN ael THEN least(score,0.25) ELSE 0 END ELSE score END AS s,
 CASE WHEN ep OR ew = 0 THEN w WHEN module='enf' THEN 0 ELSE w*(1+ew/nullif(tw-ew,0)) END AS w, ep FROM act JOIN fl ON act.k=fl.k),
b AS (SELECT k, bool_or(ep) AS ep, sum(s*w)/nullif(sum(w),0) AS base, max(CASE WHEN s >= 0.65 AND w >= 0.08 THEN s*0.62 ELSE 0 END) AS esc, sum(confidence*w)/nullif(sum(w),0) AS cf, count(*) AS na,
 count(*) FILTER (WHERE module <> 'metadata' AND s >= 0.35) AS ne, avg(s) FILTER (WHERE module <> 'metadata' AND s >= 0.35) AS em, stddev_pop(s) FILTER (WHERE module <> 'metadata' AND s >= 0.35) AS es, avg(confidence) FILTER (WHERE module <> 'metadata' AND s >= 0.35) AS ec,
 max(s) FILTER (WHERE module <> 'metadata' AND s >= 0.35) AS ex, string_agg(module, ',' ORDER BY module) FILTER (WHERE module <> 'metadata' AND s >= 0.35) AS el FROM adj GROUP BY k),
f AS (SELECT sk.k, coalesce(na,0) AS na, coalesce(ep AND base IS NOT NULL,false) AS ep, base, CASE WHEN ne >= 2 THEN CASE ne WHEN 2 THEN 1.10 WHEN 3 THEN 1.17 WHEN 4 THEN 1.22 ELSE 1.26 END ELSE 1.0 END AS fac, greatest(base,esc) AS lif, cf, coalesce(ne,0) AS ne, em, es, ec, ex, coalesce(el,'') AS el, skipped_modules FROM sk LEFT JOIN b ON sk.k=b.k),
h AS (SELECT *, coalesce(least(1.0, lif*fac),0) AS fu FROM f)"""
ACONF = "coalesce(least(0.92, greatest(0.30, cf*CASE WHEN ne >= 2 THEN 1+0.15*greatest(0.0,1-es/(em+1e-6)) ELSE 1 END)),0.30)"


@query(f"""WITH {AFUSE}
SELECT k, na AS n_active, ep AS enf_present, {R('coalesce(base,0)')} AS base_score, {R('fu')} AS fused, {R('CASE WHEN base IS NULL THEN 1.0 ELSE fac END')} AS corroboration,
 {R(ACONF)} AS confidence,
 CASE WHEN base IS NULL THEN 'inconclusive' WHEN fu < 0.2 THEN 'likely_authentic' WHEN fu < 0.4 THEN 'inconclusive' WHEN fu < 0.65 THEN 'likely_tampered' ELSE 'tampered' END AS verdict, ne AS n_elevated, el AS elevated_modules,
 CASE WHEN fu < 0.4 OR ne = 0 THEN 'none' WHEN ne = 1 AND ex >= 0.55 AND ec < 0.65 THEN 'sole_supporter' WHEN ec < 0.5 THEN 'low_confidence' ELSE 'none' END AS conflict,
 CASE WHEN base IS NULL THEN 'no usable scores' ELSE concat_ws('; ', CASE WHEN NOT ep THEN 'mains signal absent, weight redistributed' END, CASE WHEN skipped_modules IS NOT NULL THEN 'skipped: ' || skipped_modules END, CASE WHEN na < 3 THEN 'only ' || na || ' usable scores' END) END AS note FROM h""")
def q_fuse_audio(spark, d):
    return tidy(FU.fuse_audio(scores(spark, d), K))


VS = f"""{SCORES}, vs AS (SELECT k, CASE module WHEN 'enf' THEN 'noise' WHEN 'noise' THEN 'temporal' WHEN 'compression' THEN 'compression' WHEN 'voice' THEN 'lighting' ELSE 'metadata' END AS module, score, uncertainty, reliable FROM scores)"""
VFUSE = f"""{VS}, va AS (SELECT *, CASE module WHEN 'noise' THEN 0.25 WHEN 'temporal' THEN 0.20 ELSE 0.15 END/(uncertainty+0.01)*CASE WHEN reliable THEN 1.0 ELSE 0.5 END AS w FROM vs),
vg AS (SELECT k, count(*) AS n, sum(score*w)/sum(w) AS base, count(*) FILTER (WHERE reliable AND score >= 0.3) AS ne, count(*) FILTER (WHERE reliable) AS nr, count(*) FILTER (WHERE NOT reliable) AS nu, avg(uncertainty) AS mu,
 count(*) FILTER (WHERE reliable AND score >= 0.55) > 0 AND count(*) FILTER (WHERE reliable AND score < 0.15) > 0 AS cf, coalesce(string_agg(module, ',' ORDER BY module) FILTER (WHERE reliable AND score >= 0.3),'') AS el,
 coalesce(string_agg(module, ',' ORDER BY module) FILTER (WHERE reliable AND score < 0.3),'') AS be, coalesce(string_agg(module, ',' ORDER BY module) FILTER (WHERE NOT reliable),'') AS un FROM va GROUP BY k),
vm AS (SELECT *, CASE WHEN ne <= 1 THEN 1.0 WHEN ne=2 THEN 1.25 WHEN ne=3 THEN 1.5 ELSE 1.75 END AS mult FROM vg), vf AS (SELECT *, least(1.0, base*mult) AS fu FROM vm),
vc AS (SELECT *, least(0.99, greatest(0.05, 0.30+ne*0.12-mu*0.40-CASE WHEN cf THEN 0.15 ELSE 0 END-nu*0.05+least(abs(fu-0.2),abs(fu-0.4),abs(fu-0.65))*0.3)) AS conf, CASE WHEN fu < 0.2 THEN 'likely_authentic' WHEN fu < 0.4 THEN 'inconclusive' WHEN fu < 0.65 THEN 'likely_tampered' ELSE 'tampered' END AS verdict FROM vf)"""


@query(f"""WITH {VFUSE} SELECT k, n AS n_modules, {R('base')} AS base_score, {R('mult')} AS multiplier, {R('fu')} AS fused, {R('conf')} AS confidence, verdict, ne AS n_elevated, {R('ne/CAST(greatest(nr,1) AS DOUBLE)')} AS agreement_ratio, {R('mu')} AS mean_uncertainty,
 cf AS has_conflict, el AS elevated_modules, be AS below_modules, un AS unreliable_modules FROM vc""")
def q_fuse_video(spark, d):
    return tidy(FU.fuse_video(video_scores(spark, d), K))


@query(f"""WITH {VFUSE} SELECT k, 'verdict' AS type, CASE verdict WHEN 'tampered' THEN 'critical' WHEN 'likely_tampered' THEN 'high' WHEN 'inconclusive' THEN 'medium' ELSE 'low' END AS severity, {R("CASE verdict WHEN 'likely_tampered' THEN conf*0.85 WHEN 'inconclusive' THEN 0.4 ELSE conf END")} AS confidence, verdict AS detail FROM vc
UNION ALL SELECT k, 'corroboration', 'high', {R('least(0.9, conf+0.1)')}, el FROM vc WHERE ne >= 2 UNION ALL SELECT k, 'partial_domain', 'medium', {R('0.5')}, be FROM vc WHERE cf""")
def q_fusion_findings(spark, d):
    out = FU.fusion_findings(FU.fuse_video(video_scores(spark, d), K), K)
    return tidy(out.select("k", "type", "severity", "confidence", "detail"))


MISSING = f"""{VS}, e AS (SELECT k, unnest(['noise','temporal','metadata','compression','lighting','audio']) AS module FROM (SELECT DISTINCT k FROM series)),
ac AS (SELECT k, module, score, uncertainty, reliable, CASE WHEN reliable OR uncertainty < 0.3 THEN 'completed' ELSE 'failed' END AS status FROM vs),
full_ AS (SELECT e.k, e.module, CASE WHEN status='completed' THEN score ELSE 0 END AS score, CASE WHEN status='completed' THEN uncertainty ELSE 0.5 END AS uncertainty, CASE WHEN status='completed' THEN reliable ELSE false END AS reliable, coalesce(status,'skipped') AS status FROM e LEFT JOIN ac ON e.k=ac.k AND e.module=ac.module)"""


@query(f"WITH {MISSING} SELECT k, module, {R('score')} AS score, {R('uncertainty')} AS uncertainty, reliable, status FROM full_")
def q_missing_modules(spark, d):
    return tidy(_complete(spark, d))


def _complete(spark, d):
    s = video_scores(spark, d).withColumn("status", F.when(F.col("reliable") | (F.col("uncertainty") < 0.3), "completed").otherwise("failed"))
    s = s.select("k", "module", "score", "uncertainty", "reliable", "status")
    return FU.complete_modules(s, series(spark, d), K, list(FU.VIDEO_WEIGHTS))


# -- images: one row per page, features from the page itself ----------------
IMG = """img AS (SELECT page_id AS k, length(html) % 400 / CAST(20 AS DOUBLE) AS ela, length(html) % 700 / CAST(10 AS DOUBLE) AS noise, length(html) % 90 / CAST(10 AS DOUBLE) AS clone,
 CASE page_id % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS jpeg, CAST(length(regexp_extract(url,'[a-z]+$')) AS INT) AS n_exif, length(url)*CAST(2 AS DOUBLE) AS crop, length(html) % 100 * CAST(1 AS DOUBLE) AS shot, length(html) % 101 * CAST(1 AS DOUBLE) AS likelihood FROM pages)"""
IMG_EL = """CASE WHEN ela > 10 THEN 'ela' END, CASE WHEN noise > 5 THEN 'noise' END, CASE WHEN clone > 0.1 THEN 'copy_move' END, CASE WHEN jpeg='High' THEN 'jpeg_compression' END, CASE WHEN n_exif < 3 THEN 'exif_metadata' END, CASE WHEN crop > 40 THEN 'crop_detection' END, CASE WHEN shot > 40 THEN 'screenshot_detection' END"""


def images(spark, d):
    n, u = F.length("html"), F.length("url")
    dbl = lambda c: c.cast("double")
    return table(spark, d, "pages").select(
        F.col("page_id").alias("k"), dbl(n % 400 / 20).alias("ela"), dbl(n % 700 / 10).alias("noise"), dbl(n % 90 / 10).alias("clone"),
        F.when(F.col("page_id") % 3 == 0, "High").when(F.col("page_id") % 3 == 1, "Medium").otherwise("Low").alias("jpeg"),
        F.length(F.regexp_extract("url", "[a-z]+$", 0)).alias("n_exif"), dbl(u * 2).alias("crop"), dbl(n % 100).alias("shot"), dbl(n % 101).alias("likelihood"),
    )


def elevated_col():
    c = F.col
    return RS.image_elevated(c("ela"), c("noise"), c("clone"), c("jpeg"), c("n_exif"), c("crop"), c("shot"))


BAND = "CASE WHEN {0} < 40 THEN 'low' WHEN {0} < 75 THEN 'elevated' ELSE 'high' END"


_AUDIO = AFUSE[len(SCORES) + 2:]


@query(f"""WITH {VFUSE}, {_AUDIO}, {IMG}, im AS (SELECT k, CAST(round_even(likelihood,0) AS INT) AS rs, CASE jpeg WHEN 'High' THEN 0.9 WHEN 'Medium' THEN 0.6 ELSE 0.3 END AS cf, concat_ws(',', {IMG_EL}) AS el FROM img),
fr AS (SELECT k, 'frames' AS mt, avg(CASE WHEN x > 60 THEN 1.0 ELSE 0.0 END) AS p, concat_ws(',', CASE WHEN max(CASE WHEN kind='error' THEN x END) > 120 THEN 'temporal' END, CASE WHEN max(CASE WHEN kind='view' THEN x END) > 120 THEN 'spatial' END) AS el FROM series GROUP BY k),
u AS (SELECT k, 'video' AS media_type, CAST(round_even(fu*100,0) AS INT) AS rs, conf AS cf, el, n AS nd FROM vc UNION ALL SELECT k, 'image', rs, cf, el, 7 FROM im UNION ALL SELECT k, mt, CAST(round_even(p*100,0) AS INT), p, el, 2 FROM fr UNION ALL SELECT k, 'audio', CAST(round_even(fu*100,0) AS INT), {ACONF}, el, na FROM h)
SELECT k, media_type, rs AS risk_score, {BAND.format('rs')} AS risk_band, {R('round(CAST(cf AS DOUBLE),4)')} AS measurement_confidence, 'pre_calibration' AS calibration_status, el AS elevated, CAST(nd AS BIGINT) AS n_detectors, CAST(NULL AS VARCHAR) AS verdict FROM u""")
def q_unified_results(spark, d):
    return tidy(unified(spark, d))


def unified(spark, d):
    c = F.col
    v = FU.fuse_video(video_scores(spark, d), K)
    a = FU.fuse_audio(scores(spark, d), K)
    split = F.filter(F.split("elevated_modules", ","), lambda e: e != "")
    hit = lambda kind: F.max(F.when(c("kind") == kind, c("x"))) > 120
    fr = series(spark, d).groupBy("k").agg(
        F.avg((c("x") > 60).cast("double")).alias("p"),
        F.array_compact(F.array(F.when(hit("error"), F.lit("temporal")), F.when(hit("view"), F.lit("spatial")))).alias("el"),
    )
    img = images(spark, d)
    return (
        RS.unify(v, K, "video", c("fused"), c("confidence"), split, c("n_modules"))
        .unionByName(RS.unify(a, K, "audio", c("fused"), c("confidence"), split, c("n_active")))
        .unionByName(RS.unify(img, K, "image", c("likelihood") / 100, RS.confidence_word(c("jpeg")), elevated_col(), F.lit(7)))
        .unionByName(RS.unify(fr, K, "frames", c("p"), c("p"), c("el"), F.lit(2)))
    )


@query(f"""WITH {IMG} SELECT k, 'ela' AS type, CASE WHEN ela > 15 THEN 'high' ELSE 'medium' END AS severity, {R('least(ela/20,1.0)')} AS confidence FROM img WHERE ela > 8 UNION ALL SELECT k,'noise', CASE WHEN noise > 50 THEN 'high' ELSE 'medium' END, {R('least(noise/60,1.0)')} FROM img WHERE noise > 25
UNION ALL SELECT k,'copy_move', CASE WHEN clone > 5 THEN 'high' ELSE 'medium' END, {R('least(clone/8,1.0)')} FROM img WHERE clone > 2 UNION ALL SELECT k,'jpeg_compression', CASE jpeg WHEN 'High' THEN 'medium' ELSE 'low' END, {R("CASE jpeg WHEN 'High' THEN 0.7 ELSE 0.4 END")} FROM img WHERE jpeg IN ('High','Medium')
UNION ALL SELECT k,'exif_metadata','low',{R('0.5')} FROM img WHERE n_exif < 3 UNION ALL SELECT k,'crop_detection',CASE WHEN crop > 70 THEN 'medium' ELSE 'low' END,{R('0.5')} FROM img WHERE crop > 40 UNION ALL SELECT k,'screenshot_detection',CASE WHEN shot > 70 THEN 'medium' ELSE 'low' END,{R('0.5')} FROM img WHERE shot > 40""")
def q_image_findings(spark, d):
    return tidy(RS.image_findings(images(spark, d), K).select("k", "type", "severity", "confidence"))


@query(f"""WITH {SCORES}, a AS (SELECT k, CASE k % 4 WHEN 0 THEN 'audio' WHEN 1 THEN 'video' WHEN 2 THEN 'image' ELSE 'frames' END AS mt, module, skipped, n FROM scores),
g AS (SELECT k, max(mt) AS mt, sum(n) AS n FROM a GROUP BY k)
SELECT k, module AS name, 'detector_skipped' AS reason FROM a WHERE skipped AND mt IN ('audio','video') UNION ALL SELECT k, 'audio_metadata','unreadable_header' FROM g WHERE mt='audio' AND n % 2 = 0
UNION ALL SELECT k,'embedded_audio','no_audio_stream' FROM g WHERE mt='video' AND n % 3 = 0 UNION ALL SELECT k,'exif_metadata','no_exif_block_in_file' FROM g WHERE mt='image' AND n % 5 = 0 UNION ALL SELECT k,'frame_sampling','short input' FROM g WHERE mt='frames' AND n < 65""")
def q_checks_unavailable(spark, d):
    c = F.col
    g = scores(spark, d).groupBy("k").agg(F.collect_list(F.when(c("skipped"), c("module"))).alias("skipped"), F.sum("n").alias("n"))
    mt = F.when(c("k") % 4 == 0, "audio").when(c("k") % 4 == 1, "video").when(c("k") % 4 == 2, "image").otherwise("frames")
    g = g.select("k", mt.alias("media_type"), "skipped", F.when(c("n") % 2 != 0, "aac").alias("codec"), F.lit(True).alias("has_video"), (c("n") % 3 != 0).alias("has_audio"),
                 (c("n") % 5).cast("int").alias("n_exif"), F.when(c("n") < 65, "short input").alias("sampling_error"))
    return RS.checks_unavailable(g, K)


NAMES = {"ela": "Error Level Analysis", "noise": "Noise Analysis", "copy_move": "Copy-Move Detection", "jpeg_compression": "JPEG Compression", "exif_metadata": "Metadata Analysis", "crop_detection": "Crop Detection", "screenshot_detection": "Screenshot Detection"}
_el = IMG_EL
for _k, _v in NAMES.items():
    _el = _el.replace(f"'{_k}' END", f"'{_v}' END")


@query(f"""WITH {IMG}, a AS (SELECT k, list_filter([{_el}], lambda x: x IS NOT NULL) AS el, length(jpeg) AS nf, {BAND.format('likelihood')} AS rb FROM img)
SELECT k, CASE WHEN len(el)=0 THEN 'All 7 checks stayed under their limits; findings: ' || nf || '.' ELSE 'Over the limit in ' || len(el) || '/7 checks (' || array_to_string(el, ', ') || '); findings: ' || nf || '.' END AS summary,
 concat_ws(' ', CASE rb WHEN 'high' THEN 'Strong signals from several checks.' WHEN 'elevated' THEN 'Some checks are above their normal range.' ELSE 'No strong signals.' END, CASE WHEN len(el) > 0 THEN 'See: ' || array_to_string(el[1:3], ', ') || '.' END, CASE WHEN len(el) > 3 THEN 'Also recorded: ' || array_to_string(el[4:], ', ') || '.' END) AS meaning FROM a""")
def q_summary_text(spark, d):
    i = images(spark, d).withColumn("el", elevated_col())
    return i.select("k", RS.summary_text(F.col("el"), F.lit(7), F.length("jpeg")).alias("summary"), RS.meaning_text(RS.risk_band(F.col("likelihood")), F.col("el")).alias("meaning"))


@query("SELECT page_id AS k, w AS word FROM pages, (SELECT unnest(['manipulated','authentic','verified','inconclusive','tampered','fake','genuine','real','deepfake','the','of']) AS w) v WHERE w IN ('manipulated','authentic','verified','inconclusive','tampered','fake','genuine','real','deepfake') AND regexp_matches(lower(replace(html,'the ','real ')), '\\b' || w || '\\b')")
def q_banned_words(spark, d):
    # generated pages hold no banned words, so a frequent word stands in for one
    p = table(spark, d, "pages").select(F.col("page_id").alias("k"), F.replace("html", F.lit("the "), F.lit("real ")).alias("text"))
    return RS.banned_words(p, K, "text")


_SIG = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RS.STEPS_SIGNAL.items()) + " END"


@query(f"""WITH {IMG}, a AS (SELECT k, [{IMG_EL}] AS el FROM img), s AS (SELECT k, list_concat(list_concat(['verify_source','request_original','compare_versions'], list_filter(list_transform(el, lambda x: {_SIG.format('x')}), lambda x: x IS NOT NULL)),
 ['check_c2pa','check_metadata_authenticity','reverse_image_lookup','ai_detection_image','ocr_extract','caution_before_share']) AS st FROM a)
SELECT k, CAST(i-1 AS INT) AS step, st[i] AS action FROM (SELECT k, st, unnest(generate_series(1, len(st))) AS i FROM s)""")
def q_next_steps(spark, d):
    return RS.next_steps(images(spark, d), K, F.lit("image"), elevated_col())


@query(f"""WITH {CHECKS}, sc AS (SELECT k, module, max(score) AS score FROM checks GROUP BY k, module), c AS (SELECT k, module, count(*) FILTER (WHERE severity='high') AS n_high, count(*) FILTER (WHERE severity='medium') AS n_medium, count(*) FILTER (WHERE severity='low') AS n_low, count(*) AS n_findings FROM checks GROUP BY k, module),
w AS (SELECT sc.*, CASE sc.module WHEN 'enf' THEN 0.30 WHEN 'noise' THEN 0.22 WHEN 'compression' THEN 0.18 WHEN 'voice' THEN 0.10 ELSE 0.08 END AS w, CASE sc.module WHEN 'enf' THEN 0 WHEN 'noise' THEN 1 WHEN 'compression' THEN 2 WHEN 'voice' THEN 4 ELSE 5 END AS position FROM sc)
SELECT w.k, w.module, {R('score')} AS score, n_high, n_medium, n_low, n_findings, position, {R('w')} AS weight, {R('score*w')} AS weighted FROM w JOIN c ON w.k=c.k AND w.module=c.module""")
def q_report_tables(spark, d):
    ch = checks(spark, d)
    sc = ch.groupBy("k", "module").agg(F.max("score").alias("score"))
    return tidy(RS.report_modules(sc, ch, K, list(FU.AUDIO_WEIGHTS), FU.AUDIO_WEIGHTS))


@query(f"""WITH {CHECKS}, c AS (SELECT k, count(CASE WHEN severity='high' THEN 1 END) AS h, count(CASE WHEN severity='medium' THEN 1 END) AS m, count(CASE WHEN severity='low' THEN 1 END) AS l FROM checks WHERE module <> 'voice' GROUP BY k)
SELECT k, 0::INT AS position, 'HIGH' AS level, h AS n FROM c UNION ALL SELECT k, 1, 'MEDIUM', m FROM c UNION ALL SELECT k, 2, 'LOW', l FROM c UNION ALL SELECT k, 3, 'TOTAL', h+m+l FROM c""")
def q_report_severities(spark, d):
    return RS.report_severities(checks(spark, d), K, skip="voice")


@query(f"""WITH {CHECKS}, f AS (SELECT *, CASE module WHEN 'enf' THEN 0 WHEN 'noise' THEN 1 WHEN 'compression' THEN 2 WHEN 'voice' THEN 3 END AS s FROM checks WHERE module <> 'metadata')
SELECT k, row_number() OVER (PARTITION BY k ORDER BY s, t, tie) - 1 AS number, s AS section, module, upper(severity) AS level, module || ' ' || m AS title, {R('round(CAST(score AS DECIMAL(18,6)),2)')} AS confidence,
 CASE WHEN m % 2 = 0 THEN printf('%.2f', round(m/4.0,2)) || 's to ' || printf('%.2f', round(m/2.0,2)) || 's' END AS span FROM f""")
def q_report_findings(spark, d):
    m = F.col("m")
    even = lambda n: F.when(m % 2 == 0, m / F.lit(n))
    f = checks(spark, d).withColumns({"title": F.concat("module", F.lit(" "), m.cast("string")), "confidence": F.col("score"), "start_s": even(4.0), "end_s": even(2.0)})
    return tidy(RS.report_findings(f, K, ["enf", "noise", "compression", "voice"], ["t", "tie"]))


@query(f"""WITH {VFUSE} SELECT k, 0::INT AS position, 'base_score' AS name, {R('base')} AS value FROM vc UNION ALL SELECT k, 1, 'multiplier', {R('mult')} FROM vc UNION ALL SELECT k, 2, 'n_elevated', ne FROM vc UNION ALL SELECT k, 3, 'fused', {R('fu')} FROM vc""")
def q_report_appendix(spark, d):
    return tidy(RS.report_appendix(FU.fuse_video(video_scores(spark, d), K), K, ["base_score", "multiplier", "n_elevated", "fused"]))


@query(f"""WITH {AFUSE}, {CHECKS[len(SERIES) + 2:]}, cf AS (SELECT *, {ACONF} AS conf, CASE WHEN fu < 0.4 OR ne = 0 THEN 'none' WHEN ne = 1 AND ex >= 0.55 AND ec < 0.65 THEN 'sole_supporter' WHEN ec < 0.5 THEN 'low_confidence' ELSE 'none' END AS conflict FROM h),
sm AS (SELECT k, count(*) AS tf, count(DISTINCT module) AS mc, max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS hs FROM checks GROUP BY k),
j AS (SELECT c_custkey AS k, c_name AS submitted_by, fu, conf, conflict, tf, mc, hs, CASE WHEN fu IS NULL THEN 'no_result' WHEN conflict <> 'none' THEN conflict WHEN fu >= 0.4 AND conf < 0.5 THEN 'weak_confidence' END AS why FROM customer LEFT JOIN cf ON cf.k=c_custkey LEFT JOIN sm ON sm.k=c_custkey)
SELECT k, submitted_by, {R('round(coalesce(fu,0),4)')} AS probability, CASE WHEN conf >= 0.75 THEN 'high' WHEN conf >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_level, {R('round(1-coalesce(conf,0),4)')} AS uncertainty, why IS NOT NULL AS needs_review, why AS review_reason, coalesce(tf,0) AS total_findings, coalesce(mc,0) AS modules_completed,
 CASE hs WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'info' END AS highest_severity FROM j""")
def q_case_record(spark, d):
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("submitted_by"))
    return tidy(RS.case_record(cases, FU.fuse_audio(scores(spark, d), K), A.case_summary(checks(spark, d), K), K))


@query(f"""WITH j AS (SELECT d.lang, l.quality, (d.n_chars % 1000)/CAST(1000 AS DOUBLE) AS s FROM documents d JOIN labels l ON d.doc_id=l.doc_id), c AS (SELECT unnest([0.2,0.4,0.65,0.8]) AS cut),
g AS (SELECT lang, CAST(cut AS DOUBLE) AS cut, count(*) FILTER (WHERE s >= cut AND quality=1) AS tp, count(*) FILTER (WHERE s >= cut AND quality<>1) AS fp, count(*) FILTER (WHERE s < cut AND quality=1) AS fn, count(*) FILTER (WHERE s < cut AND quality<>1) AS tn FROM j, c GROUP BY lang, cut)
SELECT lang, cut, tp, fp, fn, tn, {R('tp/nullif(CAST(tp+fp AS DOUBLE),0)')} AS precision, {R('tp/nullif(CAST(tp+fn AS DOUBLE),0)')} AS recall, 'pre_calibration' AS status FROM g""")
def q_calibration(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") % 1000 / F.lit(1000.0)).alias("s")).join(table(spark, d, "labels"), "doc_id")
    return tidy(RS.calibration(j, ["lang"], "s", "quality", (0.2, 0.4, 0.65, 0.8)))


_ST = "CASE kind WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END"


@query(f"""WITH {SERIES}, a AS (SELECT k*100 + tie % 20 AS job, t, tie, {_ST} AS st FROM series)
SELECT job, count(*) AS n_events, CASE WHEN bool_or(st='completed') THEN 'completed' WHEN bool_or(st='failed') THEN 'failed' WHEN bool_or(st='running') THEN 'running' ELSE arg_max(st, tie) END AS status, {R('min(t)')} AS submitted_at, {R("min(t) FILTER (WHERE st='running')")} AS started_at,
 {R("coalesce(min(t) FILTER (WHERE st='completed'), min(t) FILTER (WHERE st='failed'))")} AS finished_at, {R("coalesce(min(t) FILTER (WHERE st='completed'), min(t) FILTER (WHERE st='failed')) - min(t)")} AS duration FROM a GROUP BY job""")
def q_job_status(spark, d):
    m = {"click": "PENDING", "view": "STARTED", "signup": "PROGRESS", "purchase": "SUCCESS", "error": "FAILURE"}
    st = F.element_at(F.create_map(*[F.lit(v) for kv in m.items() for v in kv]), F.col("kind"))
    e = series(spark, d).select((F.col("k") * 100 + F.col("tie") % 20).alias("job"), "t", "tie", st.alias("state"))
    return tidy(RS.job_status(e, ["job"], "state", "t", "tie"))


@query(f"""WITH {IMG} SELECT k, CASE WHEN likelihood > 60 THEN 'high' WHEN likelihood > 30 THEN 'medium' ELSE 'low' END AS status,
 coalesce(nullif(concat_ws(',', CASE WHEN ela > 15 THEN 'uneven_compression' WHEN ela > 8 THEN 'minor_compression' END, CASE WHEN noise > 50 THEN 'strong_noise' WHEN noise > 25 THEN 'some_noise' END, CASE WHEN clone > 5 THEN 'cloned_regions' WHEN clone > 2 THEN 'possible_clone' END, CASE WHEN jpeg='High' THEN 'resaved' END, CASE WHEN n_exif < 3 THEN 'missing_camera_info' END),''),'none_found') AS issues,
 coalesce(nullif(concat_ws(',', CASE WHEN ela <= 8 THEN 'consistent_compression' END, CASE WHEN noise <= 25 THEN 'uniform_noise' END, CASE WHEN clone <= 2 THEN 'no_clone' END, CASE WHEN jpeg IN ('Low','Medium') THEN 'single_save' END, CASE WHEN n_exif >= 3 THEN 'camera_info' END),''),'limited') AS positives FROM img""")
def q_issue_lists(spark, d):
    return RS.image_notes(images(spark, d), K)


@query(f"""WITH {SERIES}, s AS (SELECT k, avg(x)/100 AS p FROM series GROUP BY k) SELECT k, {R('p')} AS p, CASE WHEN p < 0.25 THEN 'info' WHEN p < 0.45 THEN 'low' WHEN p < 0.65 THEN 'medium' WHEN p < 0.8 THEN 'high' ELSE 'critical' END AS severity,
 CASE WHEN p < 0.2 THEN 'likely_authentic' WHEN p < 0.4 THEN 'inconclusive' WHEN p < 0.65 THEN 'likely_tampered' ELSE 'tampered' END AS verdict, {BAND.format('round_even(p*100,0)')} AS risk_band FROM s""")
def q_risk_band(spark, d):
    from mediasift.functions.exprs import band, severity_of

    p = F.col("p")
    s = series(spark, d).groupBy("k").agg((F.avg("x") / 100).alias("p"))
    return tidy(s.select("k", "p", severity_of(p).alias("severity"), band(p, FU.VERDICT_CUTS, FU.VERDICTS).alias("verdict"), RS.risk_band(RS.risk_score(p)).alias("risk_band")))


@query(f"""WITH {CHECKS}, g AS (SELECT k, module, least(1.0, avg(score)*2) AS s, count(*) AS n, count(*) FILTER (WHERE severity='high') AS h, arg_max(severity, score) AS top, k % 5 = 0 AND module = 'enf' AS sk FROM checks GROUP BY k, module),
d AS (SELECT *, CASE module {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RS.DISPLAY.items())} ELSE upper(module[1]) || module[2:] END AS nm FROM g)
SELECT k, module, CASE WHEN sk THEN nm || ': not run.' ELSE nm || ': ' || printf('%.2f', round(s,2)) || ', ' || CASE WHEN round(s,2) >= 0.65 THEN 'well above' WHEN round(s,2) >= 0.3 THEN 'above' ELSE 'within' END || ' its usual range. ' || n || CASE WHEN n = 1 THEN ' finding' ELSE ' findings' END || CASE WHEN h > 0 THEN ', ' || h || ' grave' ELSE '' END || '; strongest: ' || top || '.' END AS sentence FROM d""")
def q_detector_sentences(spark, d):
    g = checks(spark, d).groupBy("k", "module").agg(F.least(F.lit(1.0), F.avg("score") * 2).alias("s"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("severity") == "high", 1)).alias("h"), F.max_by("severity", "score").alias("top"))
    skipped = (F.col("k") % 5 == 0) & (F.col("module") == "enf")
    return g.select("k", "module", RS.detector_sentence(F.col("module"), F.round("s", 2), skipped, F.col("n"), F.col("h"), F.col("top")).alias("sentence"))
