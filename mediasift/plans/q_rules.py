"""P: projection and rule-pack queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.functions import constants as C
from mediasift.functions import exprs as E
from mediasift.operators import rules as P
from mediasift.plans.bindings import FRAMES, SERIES, frames, series, table
from mediasift.plans.registry import R, query, tidy

K = ["k"]
L = lambda xs: "[" + ",".join("'" + str(x).replace("'", "''") + "'" for x in xs) + "]"
arr = lambda xs: F.array(*[F.lit(x) for x in xs])
CODECS = ("pcm_s16le", "mp3", "aac", "opus", "vorbis", "flac", "amr_nb", "pcm_alaw", "alac", "mp3float", "pcm_s32le")
IN = lambda xs: "(" + ",".join(f"'{x}'" for x in xs) + ")"
case = lambda col, d: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in d.items()) + " END"


@query(f"""WITH a AS (SELECT p_partkey AS k, ({L(CODECS)})[p_size % 11 + 1] AS c0 FROM part), b AS (SELECT k, CASE c0 WHEN 'pcm_s32le' THEN 'pcm_s16le' WHEN 'pcm_s8' THEN 'pcm_s16le' WHEN 'mp3float' THEN 'mp3' ELSE c0 END AS codec FROM a)
SELECT k, codec, codec IN {IN(C.LOSSY_CODECS)} AS is_lossy, codec = 'alac' AS is_mobile_lossless, {R(case('codec', C.CODEC_MAX_HZ))} AS max_hz, {R(case('codec', C.CODEC_CEILING_HZ))} AS ceiling_hz FROM b""")
def q_codec_dim(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.upper(F.get(arr(CODECS), F.col("p_size") % 11)).alias("raw"))
    return tidy(p.select("k", *[v.alias(n) for n, v in P.codec_properties(F.col("raw")).items()]))


@query(f"""WITH a AS (SELECT p_partkey AS k, (p_partkey * 7) % 2400 AS h, p_retailprice/CAST(700 AS DOUBLE) AS dur, p_size AS n FROM part)
SELECT k, h > 0 AND h < 480 AS is_low_resolution, dur < 1.5 AS is_very_short, n >= 30 AS has_sufficient_frames, CASE WHEN h >= 2160 THEN '4K' WHEN h >= 1080 THEN '1080p' WHEN h >= 720 THEN '720p' WHEN h >= 480 THEN '480p' ELSE h || 'p (low)' END AS resolution, {R('dur/60')} AS minutes FROM a""")
def q_quality_flags(spark, d):
    p = table(spark, d, "part")
    f = P.quality_flags((F.col("p_partkey") * 7) % 2400, F.col("p_retailprice") / 700, F.col("p_size"), min_duration=1.5)
    return tidy(p.select(F.col("p_partkey").alias("k"), *[v.alias(n) for n, v in f.items()]))


@query(f"""SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE {R('p_size*1000/CAST(1001 AS DOUBLE)')} END AS rate FROM part WHERE p_partkey % 5 < 4 UNION ALL SELECT p_partkey, {R('p_size')} FROM part WHERE p_partkey % 5 = 4""")
def q_rational(spark, d):
    n, m = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    text = F.when(m == 0, F.concat(n, F.lit("/0"))).when(m == 1, F.lit("N/A")).when(m == 4, n).otherwise(F.concat(n, F.lit("000/1001")))
    return tidy(table(spark, d, "part").select(F.col("p_partkey").alias("k"), E.rational(text).alias("rate")))


@query(f"""WITH a AS (SELECT c_custkey AS k, (c_custkey % 200) - 100 AS la, (c_custkey % 400) - 200 AS lo, (c_custkey % 25) - 12 AS tz FROM customer)
SELECT k, {R('la + 0.25')} AS lat, {R('lo + 0.5')} AS lon, la+0.25 BETWEEN -90 AND 90 AND lo+0.5 BETWEEN -180 AND 180 AS valid, {R('tz')} AS tz, abs((lo+0.5)/15.0 - tz) > 2 AS zone_mismatch FROM a""")
def q_gps_checks(spark, d):
    la, lo, tz = (F.col("c_custkey") % 200 - 100 + 0.25), (F.col("c_custkey") % 400 - 200 + 0.5), (F.col("c_custkey") % 25 - 12).cast("int")
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), F.format_string("%+010.4f%+011.4f/", la, lo).alias("loc"), F.concat(F.lit("2024-03-01T10:00:00"), F.format_string("%s%02d:00", F.when(tz < 0, "-").otherwise("+"), F.abs(tz))).alias("ct"),
    )
    g = c.select("k", E.gps(F.col("loc")).alias("g"), E.tz_offset_hours(F.col("ct")).alias("tz"))
    lat, lon = F.col("g.lat"), F.col("g.lon")
    return tidy(g.select("k", lat.alias("lat"), lon.alias("lon"), E.gps_valid(lat, lon).alias("valid"), "tz", E.gps_zone_mismatch(lon, F.col("tz")).alias("zone_mismatch")))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE epoch_us(o_orderdate) - CASE WHEN o_orderkey % 6 = 1 THEN 7200000000 ELSE 0 END END AS us FROM orders")
def q_parse_ts(spark, d):
    ts, m = F.col("o_orderdate"), F.col("o_orderkey") % 6
    fm = lambda p: F.date_format(ts, p)
    text = (
        F.when(m == 0, fm("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(m == 1, F.concat(fm("yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+02:00"))).when(m == 2, fm("yyyy-MM-dd HH:mm:ss"))
        .when(m == 3, fm("yyyy:MM:dd HH:mm:ss")).when(m == 4, fm("yyyy-MM-dd")).otherwise("not a time")
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.unix_micros(E.parse_ts(text)).alias("us"))


@query("SELECT page_id AS k, coalesce(nullif(trim(regexp_extract(html,'<title>([^<]*)',1)),''), nullif(regexp_extract(html,'lang=\"([a-z]+)\"',1),'')) AS title, nullif(regexp_extract(html,'lang=\"([a-z]+)\"',1),'') AS lang, nullif(regexp_extract(url,'^([a-z]+):',1),'') AS scheme FROM pages")
def q_tag_lookup(spark, d):
    x = lambda c, p: F.regexp_extract(c, p, 1)
    m = F.create_map(F.lit("TITLE"), x("html", "<title>([^<]*)"), F.lit("Lang"), x("html", 'lang="([a-z]+)"'), F.lit("scheme"), x("url", "^([a-z]+):"), F.lit("LANG"), F.lit("later spelling"))
    p = table(spark, d, "pages").select(F.col("page_id").alias("k"), m.alias("tags"))
    t = F.col("tags")
    return p.select("k", E.tag(t, "title", "lang").alias("title"), E.tag(t, "language", "lang").alias("lang"), E.tag(t, "scheme").alias("scheme"))


@query(f"""WITH {SERIES} SELECT tie, {R('CASE WHEN x >= 150 THEN 1.0 WHEN x >= 60 THEN 0.5+0.5*(x-60)/90 WHEN x > 20 THEN 0.2*(x-20)/40 ELSE 0 END')} AS suspicion, {R('CASE WHEN x <= 5 THEN 0.0 WHEN x <= 40 THEN (x-5)/35 ELSE 1.0 END')} AS ramp,
 {R('CASE WHEN x >= 80 THEN 0.8 WHEN x >= 40 THEN 0.4+0.4*(x-40)/40 WHEN x >= 15 THEN 0.15 ELSE 0 END')} AS tiers FROM series""")
def q_ramp_score(spark, d):
    x = F.col("x")
    return tidy(series(spark, d).select("tie", E.suspicion(x, 20, 60, 150).alias("suspicion"), E.ramp(x, [(5, 0.0), (40, 1.0)]).alias("ramp"), E.tiers(x, [(15, 0.15, 0.15), (40, 0.4, 0.8)], (80, 0.8)).alias("tiers")))


_lv = " ".join(f"WHEN mo='{m}' THEN CASE WHEN p < {a} THEN 'authentic' WHEN p < {b} THEN 'likely_authentic' WHEN p < {c} THEN 'inconclusive' ELSE 'likely_tampered' END" for m, (a, b, c) in C.CONFIDENCE_CUTS.items())


@query(f"""WITH {SERIES}, a AS (SELECT tie, x/200 AS p, CASE kind WHEN 'click' THEN 'metadata' WHEN 'error' THEN 'noise' WHEN 'view' THEN 'lighting' WHEN 'signup' THEN 'audio' ELSE 'temporal' END AS mo, m FROM series)
SELECT tie, CASE WHEN p < 0.25 THEN 'info' WHEN p < 0.45 THEN 'low' WHEN p < 0.65 THEN 'medium' WHEN p < 0.8 THEN 'high' ELSE 'critical' END AS severity, CASE {_lv} END AS level, p >= 0.3 AND m % 10 <> 0 AS elevated FROM a""")
def q_severity(spark, d):
    k = F.col("kind")
    mod = F.when(k == "click", "metadata").when(k == "error", "noise").when(k == "view", "lighting").when(k == "signup", "audio").otherwise("temporal")
    s = series(spark, d).select("tie", (F.col("x") / 200).alias("p"), mod.alias("module"), (F.col("m") % 10 == 0).alias("skipped"))
    return s.select("tie", E.severity_of(F.col("p")).alias("severity"), P.confidence_level(F.col("module"), F.col("p")).alias("level"), E.elevated(F.col("p"), F.col("skipped"), 0.30).alias("elevated"))


@query(f"""WITH {SERIES}, a AS (SELECT tie, x*10 AS s, x*10 + m AS e, m/CAST(100 AS DOUBLE) AS r FROM series) SELECT tie, lpad(CAST(CAST(floor(s/60) AS INT) AS VARCHAR),2,'0') || ':' || printf('%06.3f', s-floor(s/60)*60) AS start, {R('e-s')} AS duration, {R('(s+e)/2')} AS midpoint,
 s < 600 AND e > 300 AS hits_window, CAST(trunc(r*1920) AS INT) AS px, CAST(trunc(r*0.5*1080) AS INT) AS ph FROM a""")
def q_timecode(spark, d):
    s, r = F.col("x") * 10, F.col("m") / F.lit(100.0)
    e = s + F.col("m")
    reg = F.struct(r.alias("x"), r.alias("y"), r.alias("w"), (r * 0.5).alias("h"))
    out = series(spark, d).select("tie", E.timecode(s).alias("start"), (e - s).alias("duration"), ((s + e) / 2).alias("midpoint"), E.overlaps(s, e, F.lit(300), F.lit(600)).alias("hits_window"), E.pixel_box(reg, F.lit(1920), F.lit(1080)).alias("b"))
    return tidy(out.select("tie", "start", "duration", "midpoint", "hits_window", F.col("b.x").alias("px"), F.col("b.h").alias("ph")))


# -- audio metadata: one asset per order ---------------------------------------
ENC = ("Audacity 3.2", "Lavf60.16.100", "LAME3.100", "", "Lavf58 apple", "REAPER/6.8", "iPhone 14")
CONT = ("wav", "mp3", "mov,mp4,m4a,3gp,3g2,mj2", "ogg", "flac", "unknown")
AUDIO = f"""au AS (SELECT o_orderkey AS k, ({L(CONT)})[o_custkey % 6 + 1] AS cont, ({L(CODECS)})[o_orderkey % 11 + 1] AS codec, lower(({L(ENC)})[o_orderkey % 7 + 1]) AS enc, o_orderkey % 13 = 0 AS notime,
 CAST(o_orderkey % 400 - 5 AS DOUBLE) AS gap, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_orderkey * 31) % 20000 END AS mf, CASE WHEN o_orderkey % 2 = 0 THEN 44100 ELSE 16000 END AS sr, 64007 + o_orderkey % 9 * 32003 AS br,
 o_totalprice*10 AS sz, 10.0 + o_orderkey % 50 AS dur, 160000 + (o_orderkey * 1000) % 900000 AS ns, o_orderkey % 3 = 0 AS tags FROM orders),
al AS (SELECT *, CASE cont WHEN 'wav' THEN codec IN ('pcm_s16le','pcm_s24le','pcm_f32le','pcm_s32le','pcm_alaw','pcm_mulaw','adpcm_ms','pcm_s8') WHEN 'mp3' THEN codec IN ('mp3','mp3float') WHEN 'mov,mp4,m4a,3gp,3g2,mj2' THEN codec IN ('aac','mp3','pcm_s16le','opus','alac','ac3')
 WHEN 'ogg' THEN codec IN ('vorbis','opus','flac') WHEN 'flac' THEN codec='flac' END AS ok, (codec IN {IN(C.LOSSY_CODECS)} OR codec='mp3float') AS lossy, regexp_matches(enc,'^(lavf[0-9]|lavc[0-9]|libav|ffmpeg)') AS gen, mf/(sr/2.0) AS bw,
 abs(floor(sz*8/dur)-br)/br*100 AS bd, floor(dur*16000) AS decl FROM au), am AS (SELECT *, abs(ns-decl)/decl*100 AS cut FROM al)"""


def audio_assets(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    t = F.col("o_orderdate").cast("timestamp")
    return o.select(
        k.alias("k"), F.get(arr(CONT), F.col("o_custkey") % 6).alias("container"), F.get(arr(CODECS), k % 11).alias("codec"), F.get(arr(ENC), k % 7).alias("encoder"),
        F.when(k % 13 != 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("creation_time"), F.timestamp_micros(F.unix_micros(t) + (k % 400 - 5) * 86400000000).alias("modified_at"),
        F.when(k % 17 != 0, (k * 31) % 20000).alias("max_freq"), F.when(k % 2 == 0, 44100).otherwise(16000).alias("sample_rate"), (64007 + k % 9 * 32003).alias("bitrate_bps"),
        (F.col("o_totalprice") * 10).alias("size_bytes"), (10.0 + k % 50).alias("duration_s"), (160000 + (k * 1000) % 900000).alias("n_samples"), F.lit(16000).alias("wav_rate"), (k % 3 == 0).alias("has_tags"),
    )


ED = " OR ".join(f"enc LIKE '%{w}%'" for w in C.EDITOR_WORDS)
DEV = " OR ".join(f"enc LIKE '%{w}%'" for w in C.DEVICE_WORDS)


@query(f"""WITH {AUDIO} SELECT k, 'container_codec' AS type, 'high' AS severity, {R('0.80')} AS confidence, {R('0.75')} AS score, {R('1.5')} AS weight FROM am WHERE NOT ok
UNION ALL SELECT k,'editor_encoder','medium',0.70,0.45,1.0 FROM am WHERE {ED} UNION ALL SELECT k,'generic_encoder','low',0.50,0.25,0.5 FROM am WHERE gen AND NOT ({ED}) AND NOT ({DEV})
UNION ALL SELECT k,'no_timestamp','low',0.45,0.2,0.5 FROM am WHERE notime AND cont LIKE '%mp4%'
UNION ALL SELECT k,'timestamp_gap',CASE WHEN gap > 180 OR gap < -1 THEN 'high' ELSE 'medium' END, 0.65, CASE WHEN gap > 180 THEN 0.6 WHEN gap > 7 THEN 0.35 ELSE 0.7 END, CASE WHEN gap > 180 THEN 1.2 WHEN gap > 7 THEN 1.0 ELSE 1.5 END FROM am WHERE NOT notime AND (gap > 7 OR gap < -1)
UNION ALL SELECT k,'bandwidth',CASE WHEN bw < 0.15 THEN 'high' ELSE 'medium' END, 0.72, CASE WHEN bw < 0.15 THEN 0.65 ELSE 0.4 END, CASE WHEN bw < 0.15 THEN 1.3 ELSE 1.0 END FROM am WHERE mf IS NOT NULL AND sr >= 32000 AND bw < 0.3
UNION ALL SELECT k,'bitrate',CASE WHEN bd < 50 THEN 'medium' ELSE 'high' END,0.55,{R('least(0.55,0.25+bd/200)')},0.8 FROM am WHERE lossy AND bd > 25
UNION ALL SELECT k,'length',CASE WHEN cut < 20 THEN 'medium' ELSE 'high' END, 0.70, CASE WHEN ns < decl THEN 0.5 ELSE 0.3 END, 1.0 FROM am WHERE decl > 0 AND cut > 5
UNION ALL SELECT k,'stripped_tags','medium',0.58,0.3,0.8 FROM am WHERE codec IN ('mp3','mp3float') AND ((NOT tags AND enc='') OR (gen AND notime))""")
def q_meta_rules_audio(spark, d):
    return tidy(P.audio_metadata(audio_assets(spark, d), K).select("k", "type", "severity", "confidence", "score", "weight"))


VENC = ("Lavf60.3", "Apple iPhone", "Adobe Premiere Pro 2023", "HandBrake 1.6", "mystery", "OBS Studio")
AS_OF = "2000-06-01 00:00:00"


@query(f"""WITH a AS (SELECT o_orderkey AS k, o_orderkey % 9 = 0 AS notime, o_orderdate AS ct, o_orderkey % 12 AS e1, o_orderkey % 7 AS e2, o_orderkey % 4 AS cc, CASE o_orderkey % 5 WHEN 0 THEN 0.72 ELSE 0 END AS conf, o_orderkey % 3 = 0 AS mk, o_orderkey % 6 = 0 AS md, o_orderkey % 5 = 0 AS sw,
 o_orderkey % 8 < 4 AS hasgps, (o_orderkey % 200)-100+0.5 AS lat, (o_orderkey % 370)-185+0.5 AS lon, o_orderkey % 10 = 1 AS differ FROM orders),
b AS (SELECT k, greatest(CASE WHEN notime THEN 0.45 WHEN ct > TIMESTAMP '{AS_OF}' THEN 0.85 WHEN year(ct) < 1990 THEN 0.6 ELSE 0 END, CASE WHEN differ THEN 0.55 ELSE 0 END) AS ts,
 CASE WHEN e1 >= 6 AND e2 >= 6 THEN 0.35 ELSE greatest(CASE e1 WHEN 0 THEN 0.6 WHEN 2 THEN 0.55 WHEN 3 THEN 0.55 WHEN 5 THEN 0.55 ELSE 0 END, CASE e2 WHEN 0 THEN 0.6 WHEN 2 THEN 0.55 WHEN 3 THEN 0.55 WHEN 5 THEN 0.55 ELSE 0 END) END AS en,
 greatest(conf, CASE cc WHEN 1 THEN 0.5 WHEN 3 THEN 0.5 ELSE 0 END) AS co, (CASE WHEN notime THEN 0 ELSE 1 END+CASE WHEN sw THEN 1 ELSE 0 END+CASE WHEN mk THEN 1 ELSE 0 END+CASE WHEN md THEN 1 ELSE 0 END)/CAST(4 AS DOUBLE) AS pr,
 CASE WHEN NOT hasgps THEN 0 WHEN NOT (lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) THEN 0.8 WHEN NOT notime AND abs(lon/15) > 2 THEN 0.65 ELSE 0 END AS gp FROM a),
c AS (SELECT *, CASE WHEN pr <= 0.25 THEN 0.5 WHEN pr <= 0.5 THEN 0.3 ELSE 0 END AS cm FROM b)
SELECT k, {R('ts')} AS "timestamp", {R('en')} AS encoder, {R('co')} AS container, {R('cm')} AS completeness, {R('gp')} AS gps, {R('0.3*ts+0.25*en+0.25*co+0.1*cm+0.1*gp')} AS probability,
 {R('0.05+0.03*((ts=0)::INT+(en=0)::INT+(co=0)::INT+(cm=0)::INT+(gp=0)::INT)')} AS uncertainty FROM c""")
def q_meta_rules_video(spark, d):
    k = F.col("o_orderkey")
    ct = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pick = lambda i: F.when(i < 6, F.get(arr(VENC), i))
    v = table(spark, d, "orders").select(
        k.alias("k"), F.when(k % 9 != 0, ct).alias("creation_time"), F.to_timestamp(F.lit(AS_OF)).alias("as_of"), ct.alias("video_time"), F.when(k % 10 == 1, "other").otherwise(ct).alias("audio_time"),
        F.array_compact(F.array(pick(k % 12), pick(k % 7))).alias("encoders"), F.get(arr(("mp4", "avi", "mov", "mkv")), k % 4).alias("container"), F.get(arr(("h264", "hevc", "h264", "mpeg2video")), k % 4).alias("codec"),
        F.when(k % 5 == 0, 0.72).alias("container_conf"), F.when(k % 3 == 0, "Canon").alias("device_make"), F.when(k % 6 == 0, "R5").alias("device_model"), F.when(k % 5 == 0, "fw").alias("encoder_software"),
        F.when(k % 8 < 4, k % 200 - 100 + 0.5).alias("lat"), F.when(k % 8 < 4, k % 370 - 185 + 0.5).alias("lon"),
    )
    return tidy(P.video_metadata(v, K))


@query(f"""WITH a AS (SELECT o_orderkey AS k, o_orderkey % 6 AS e, o_orderkey % 4 AS c, o_orderkey % 3 AS ns, o_orderkey % 5 AS f, (o_orderkey % 11)*CAST(0.7 AS DOUBLE) AS sp FROM orders),
b AS (SELECT *, (['apple ios','handbrake','x265','','ffmpeg h264','h264'])[e+1] AS enc, (['h264','hevc','vp9','mpeg4'])[c+1] AS codec FROM a)
SELECT k, 'codec_tag' AS type, 'low' AS severity FROM b WHERE ns = 0 AND enc <> '' AND NOT contains(enc,codec) AND NOT contains(codec,enc)
UNION ALL SELECT k,'stream_mismatch','high' FROM b WHERE ns = 2 UNION ALL SELECT k,'odd_container','low' FROM b WHERE f = 1
UNION ALL SELECT k,'timestamp_spread',CASE WHEN sp > 5 THEN 'high' ELSE 'medium' END FROM b WHERE sp > 1
UNION ALL SELECT k,'software_codec','medium' FROM b WHERE (e=0 AND codec NOT IN ('h264','hevc','aac')) OR (e=1 AND codec NOT IN ('h264','hevc','vp9')) OR (e=2 AND codec <> 'hevc') OR (e=4 AND codec NOT IN ('h264','hevc','vp8','vp9','av1'))""")
def q_meta_chain(spark, d):
    k = F.col("o_orderkey")
    codec = F.get(arr(("h264", "hevc", "vp9", "mpeg4")), k % 4)
    st = lambda prof, lev: F.struct(codec.alias("codec"), F.lit(prof).alias("profile"), F.lit(lev).alias("level"))
    t = F.col("o_orderdate").cast("timestamp")
    late = F.timestamp_micros(F.unix_micros(t) + F.round((k % 11) * 0.7 * 3.6e9).cast("bigint"))
    m = table(spark, d, "orders").select(
        k.alias("k"), F.get(arr(("apple ios", "handbrake", "x265", "", "ffmpeg h264", "h264")), k % 6).alias("encoder"), F.get(arr(("mov,mp4", "avi", "mov,mp4", "matroska", "mp4")), k % 5).alias("format_name"),
        F.when(k % 3 == 0, F.array(st("High", 40))).when(k % 3 == 1, F.array(st("High", 40), st("High", 40))).otherwise(F.array(st("High", 40), st("Main", 31))).alias("streams"), F.array(t, late, F.lit(None).cast("timestamp")).alias("times"),
    )
    return P.metadata_chain(m, K).select("k", "type", "severity")


SOFT = ("Snipping Tool 11", "Photoshop", "", "ShareX 15", "Camera")
SZ = ((1920, 1080), (4000, 3000), (1170, 2532), (800, 600))


@query(f"""WITH a AS (SELECT p_partkey AS k, p_partkey % 5 AS s, p_partkey % 2 AS png, p_partkey % 4 AS z, p_partkey % 7 AS dp, p_partkey % 3 AS tg, (p_partkey*37) % 4000 AS sh FROM part),
b AS (SELECT k, s IN (0,3) AS s1, tg <> 0 AS s2, dp = 1 AND tg = 2 AS s3, z IN (0,2) AS s4, tg = 1 AS s5, png = 1 AND tg <> 0 AS s6, sh > 2000 AS s7 FROM a)
SELECT k, {R('least(100, s1::INT*45+s2::INT*20+s3::INT*10+s4::INT*10+s5::INT*8+s6::INT*15+s7::INT*12)')} AS score, concat_ws(',', CASE WHEN s1 THEN 'software_tag' END, CASE WHEN s2 THEN 'missing_camera_exif' END, CASE WHEN s3 THEN 'screen_dpi' END, CASE WHEN s4 THEN 'screen_dimensions' END,
 CASE WHEN s5 THEN 'no_exif_thumbnail' END, CASE WHEN s6 THEN 'png_no_camera' END, CASE WHEN s7 THEN 'sharp_edges' END) AS signals FROM b""")
def q_weighted_signals(spark, d):
    k = F.col("p_partkey")
    ints = lambda *xs: F.array(*[F.lit(x) for x in xs])
    p = table(spark, d, "part").select(
        k.alias("k"), F.get(arr(SOFT), k % 5).alias("software"), F.when(k % 2 == 1, "png").otherwise("jpeg").alias("format"), F.get(ints(*[w for w, _ in SZ]), k % 4).alias("width"), F.get(ints(*[h for _, h in SZ]), k % 4).alias("height"),
        F.when(k % 7 == 1, 96).otherwise(300).alias("dpi_x"), F.when(k % 7 == 1, 96).otherwise(300).alias("dpi_y"),
        F.when(k % 3 == 0, ints(271, 272, 37386, 33434, 33437, 34855, 513)).when(k % 3 == 1, ints(271)).otherwise(ints(305)).alias("tags"), ((k * 37) % 4000).cast("double").alias("sharpness"),
    )
    return tidy(P.screenshot(p, K))


@query(f"""WITH a AS (SELECT p_partkey AS k, p_partkey % 3 = 1 AS mm, p_partkey % 4 = 0 AS g FROM part) SELECT k, {R('mm::INT*40+g::INT*60')} AS score, concat_ws(',', CASE WHEN mm THEN 'exif_dimension_mismatch' END, CASE WHEN g THEN 'grid_offset' END) AS signals FROM a""")
def q_crop_signals(spark, d):
    k = F.col("p_partkey")
    w = F.lit(4000)
    p = table(spark, d, "part").select(
        k.alias("k"), w.alias("width"), F.lit(3000).alias("height"), F.when(k % 3 != 2, w + F.when(k % 3 == 1, 40).otherwise(1)).alias("exif_w"), F.when(k % 3 != 2, F.lit(3000)).alias("exif_h"), (k % 4 == 0).alias("grid_offset"),
    )
    return tidy(P.crop(p, K))


@query(f"""WITH a AS (SELECT page_id AS k, length(html)/CAST(length(url)*100 AS DOUBLE) AS b, length(html) % 50 / CAST(64 AS DOUBLE)*100 AS art FROM pages)
SELECT k, {R('b')} AS bytes_per_pixel, CASE WHEN b > 2 THEN 'high' WHEN b > 1 THEN 'medium' ELSE 'low' END AS quality, {R('art')} AS artifact_score, CASE WHEN art > 30 THEN 'High' WHEN art > 15 THEN 'Medium' ELSE 'Low' END AS double_compression, art > 20 AS recompressed FROM a""")
def q_jpeg_profile(spark, d):
    n = F.length("html")
    j = P.jpeg_profile(n, F.length("url") * 100, n % 50, F.lit(64))
    return tidy(table(spark, d, "pages").select(F.col("page_id").alias("k"), *[v.alias(c) for c, v in j.items()]))


@query(None)
def q_image_score(spark, d):
    from mediasift.plans.q_fusion import images

    c = F.col
    i = images(spark, d)
    return tidy(i.select("k", P.image_score(c("ela"), c("noise"), c("clone"), c("jpeg"), c("n_exif"), F.col("k") % 4 == 0).alias("score")))


def _register_image_score():
    from mediasift.plans.q_fusion import IMG
    from mediasift.plans.registry import SQL

    SQL["q_image_score"] = f"""WITH {IMG} SELECT k, {R("least(100, CASE WHEN ela > 15 THEN 30 WHEN ela > 8 THEN 18 ELSE 0 END + CASE WHEN noise > 50 THEN 30 WHEN noise > 25 THEN 18 ELSE 0 END + CASE WHEN clone > 5 THEN 35 WHEN clone > 2 THEN 20 ELSE 0 END + CASE WHEN k % 4 <> 0 AND jpeg='High' THEN 25 ELSE 0 END + CASE WHEN k % 4 <> 0 AND n_exif < 3 THEN 17 ELSE 0 END)")} AS score FROM img"""


_register_image_score()


@query(f"""WITH {SERIES} SELECT k, tie, 'compression' AS type, CASE WHEN x/10 > 15 THEN 'high' ELSE 'medium' END AS severity FROM series WHERE x/10 > 8 UNION ALL SELECT k, tie, 'noise', CASE WHEN m > 50 THEN 'high' ELSE 'medium' END FROM series WHERE m > 25 UNION ALL SELECT k, tie, 'clone', CASE WHEN x/30 > 5 THEN 'high' ELSE 'medium' END FROM series WHERE x/30 > 2""")
def q_spatial_rules(spark, d):
    s = series(spark, d).select("k", "tie", "t", (F.col("x") / 10).alias("ela"), F.col("m").alias("noise"), (F.col("x") / 30).alias("clone"))
    return P.spatial_rules(s, ["k", "tie"], "t").select("k", "tie", "type", "severity")


@query(f"WITH {FRAMES} SELECT tie, {R('least(0.99, greatest(0.7, 0.7+least(0.29,(1-ssim)*0.15+hist_dist*0.15)))')} AS confidence FROM frames")
def q_boundary_confidence(spark, d):
    return tidy(frames(spark, d).select("tie", P.boundary_confidence(F.col("ssim"), F.col("hist_dist")).alias("confidence")))
