"""S, W20: source, sampling, record and chain queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.functions.exprs import stable_id
from mediasift.operators import chunks as C
from mediasift.operators import stats as A
from mediasift.plans.bindings import SERIES, series, table
from mediasift.plans.q_stats import CHECKS, checks
from mediasift.plans.registry import R, query, tidy
from mediasift.session import shared_path
from mediasift.sources import media as M
from mediasift.sources import records as S

K, O = ["k"], ["t", "tie"]


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, sha256(encode(text)[1:1048576]) AS sha256_head, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents")
def q_content_hash(spark, d):
    return M.hash_assets(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


@query(f"""WITH {SERIES} SELECT tie, 'mp4' AS container, CASE WHEN m % 3 = 0 THEN NULL ELSE 'h264' END AS video_codec, 'aac' AS audio_codec, {R('CASE WHEN m % 3 = 0 OR m % 5 = 0 THEN CASE WHEN m % 7 = 0 THEN m+1 ELSE m END ELSE x END')} AS duration,
 CAST(m*1000 AS BIGINT) AS bit_rate, CASE WHEN m % 2 = 0 THEN kind ELSE NULL END AS encoder, CAST(CASE WHEN m % 3 = 0 THEN 1 ELSE 2 END AS INT) AS n_streams FROM series""")
def q_probe_extract(spark, d):
    # probe documents built from event rows, then read back through the schema
    m = F.col("m")
    st = lambda typ, codec, dur: F.struct(F.lit(typ).alias("codec_type"), F.lit(codec).alias("codec_name"), dur.alias("duration"))
    video = F.when(m % 3 != 0, st("video", "h264", F.when(m % 5 == 0, "N/A").otherwise(F.col("x").cast("string"))))
    audio = st("audio", "aac", F.when(m % 7 == 0, (m + 1).cast("string")).otherwise("N/A"))
    fmt = F.struct(F.lit("mp4").alias("format_name"), m.cast("string").alias("duration"), (m * 1000).cast("string").alias("bit_rate"), F.create_map(F.when(m % 2 == 0, "Encoder").otherwise("comment"), F.col("kind")).alias("tags"))
    doc = F.to_json(F.struct(fmt.alias("format"), F.array_compact(F.array(video, audio)).alias("streams")))
    return tidy(M.probe_profile(M.parse_probe(series(spark, d).select("tie", doc.alias("doc")), "doc"), ["tie"]))


@query(f"""WITH {SERIES}, e AS (SELECT k, tie, 'format.encoder' AS place, kind AS v FROM series WHERE m % 2 = 0 UNION ALL SELECT k, tie, 'format.software', 'tool ' || (m % 7) FROM series WHERE m % 3 = 0 UNION ALL SELECT k, tie, 'stream.handler_name', 'handler' || (m % 11) FROM series WHERE m % 11 > 8
 UNION ALL SELECT k, tie, 'stream.encoder', kind FROM series WHERE m % 5 = 0), c AS (SELECT place, v, count(*) AS n FROM e GROUP BY place, v)
SELECT e.place, count(*) AS n_tags, count(DISTINCT e.v) AS n_values, count(DISTINCT e.tie) AS n_owners, max(t.v) AS top_value, max(t.n) AS n_top, true AS sketch_close FROM e JOIN (SELECT place, arg_max(v, [lpad(n::VARCHAR,12,'0'), v]) AS v, max(n) AS n FROM c GROUP BY place) t ON t.place=e.place GROUP BY e.place""")
def q_encoder_strings(spark, d):
    m, none = F.col("m"), F.lit(None).cast("string")
    tags = lambda **kv: F.map_filter(F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    fmt = F.struct(F.lit("mp4").alias("format_name"), tags(encoder=F.when(m % 2 == 0, F.col("kind")), Software=F.when(m % 3 == 0, F.concat(F.lit("tool "), (m % 7).cast("string")))).alias("tags"))
    # short stream tags don't count
    st = lambda kind, t: F.struct(F.lit(kind).alias("codec_type"), t.alias("tags"))
    video = st("video", tags(encoder=F.when(m % 5 == 0, F.col("kind")), handler_name=F.when(m % 11 > 8, F.concat(F.lit("handler"), (m % 11).cast("string"))).otherwise("abc")))
    audio = st("audio", tags(encoder=F.when(m % 5 == 0, F.col("kind")), handler_name=none))
    doc = F.to_json(F.struct(fmt.alias("format"), F.array(video, audio).alias("streams")))
    rows = M.encoder_strings(M.parse_probe(series(spark, d).select("k", "tie", doc.alias("doc")), "doc"), ["k", "tie"])
    g = A.distinct_tags(rows.filter("place IS NOT NULL"), ["place"], "value", "tie")
    near = F.abs(F.hll_sketch_estimate("sketch") - F.col("n_values")) <= 0.05 * F.col("n_values") + 1
    return g.withColumn("sketch_close", near).drop("sketch")


@query(f"""WITH {SERIES} SELECT k, count(*) AS n_packets, {R('max(t)')} AS last_pts, CAST(sum(CAST(floor(x) AS BIGINT)) AS BIGINT) AS total_size, count(CASE WHEN kind='error' THEN 1 END) AS n_key FROM series WHERE m % 17 <> 0 AND m % 19 <> 0 GROUP BY k""")
def q_packet_scan(spark, d):
    m = F.col("m")
    raw = series(spark, d).select(
        "k", F.when(m % 17 == 0, "N/A").otherwise(F.col("t").cast("string")).alias("pts"), F.col("t").cast("string").alias("dts"), F.when(m % 19 == 0, "").otherwise(F.floor("x").cast("string")).alias("size"), (F.col("kind") == "error").alias("is_key"),
    )
    p = M.clean_packets(raw)
    return tidy(p.groupBy("k").agg(F.count(F.lit(1)).alias("n_packets"), F.max("pts").alias("last_pts"), F.sum("size").alias("total_size"), F.count(F.when(F.col("is_key"), 1)).alias("n_key")))


@query(f"""WITH e AS (SELECT vec_id // 2 % 10 AS k, vec_id // 2 AS c, vec_id % 2 AS ch, CASE WHEN vec_id // 2 % 10 < 5 THEN 0 ELSE vec_id % 2 END AS s, embedding FROM embeddings),
b AS (SELECT k, c, pos, avg(v/32768) AS x, max(v/32768)-min(v/32768) AS sp FROM (SELECT e.k, e.c, i AS pos, CAST(z.embedding[i] AS DOUBLE)*1000 AS v FROM e JOIN embeddings z ON z.vec_id = e.c*2+e.s, generate_series(1,64) g(i)) GROUP BY k, c, pos)
SELECT k, count(*) AS n_samples, {R('avg(x)',9)} AS mean, bool_and(sp <= 1e-4) AS identical FROM b GROUP BY k""")
def q_normalise_signal(spark, d):
    e = table(spark, d, "embeddings")
    c = F.floor(F.col("vec_id") / 2)
    ch = e.select((c % 10).alias("k"), c.alias("chunk_no"), (F.col("vec_id") % 2).alias("ch"), "embedding")
    # assets below five carry the left channel twice
    left = ch.filter("ch = 0").select("chunk_no", F.col("embedding").alias("_l"))
    ch = ch.join(left, "chunk_no").withColumn("samples", F.transform(F.when(F.col("k") < 5, F.col("_l")).otherwise(F.col("embedding")), lambda v: v.cast("double") * 1000))
    return tidy(C.chunk_identity(C.mix_chunks(ch, K, "ch", "chunk_no", "samples", "int16"), K), 9)


I = "i AS (SELECT k, t, tie, row_number() OVER (PARTITION BY k ORDER BY t, tie) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM series)"


@query(f"WITH {SERIES}, {I} SELECT k, tie FROM i WHERE i % 7 = 0")
def q_sample_every_n(spark, d):
    return M.sample_every(series(spark, d), K, O, 7).select("k", "tie")


@query(f"WITH {SERIES}, {I}, w AS (SELECT *, CAST(floor(n*CAST(0.02 AS DOUBLE)) AS BIGINT) AS mg FROM i), p AS (SELECT DISTINCT k, mg + floor(j*(n-2*mg)/CAST(8 AS DOUBLE)) AS pos FROM w, generate_series(0,7) g(j)) SELECT w.k, w.tie FROM w JOIN p ON w.k=p.k AND w.i=p.pos")
def q_sample_even(spark, d):
    return M.sample_even(series(spark, d), K, O, 8, margin=0.02).select("k", "tie")


@query(f"WITH {SERIES}, {I} SELECT k, tie FROM i WHERE i % greatest(1, CAST(round((k % 5)*10/CAST(8 AS DOUBLE)) AS BIGINT)) = 0")
def q_sample_rate(spark, d):
    s = series(spark, d).withColumn("fps", (F.col("k") % 5) * 10)
    return M.sample_rate(s, K, O, "fps", 8.0).select("k", "tie")


@query("SELECT role AS event, count(*) AS n, count(DISTINCT conv_id) AS n_cases, min(turn) AS first_seq, max(turn) AS last_seq, CAST(sum(length(text)) AS BIGINT) AS detail_chars FROM conversations GROUP BY role")
def q_audit_scan(spark, d):
    # the table as an audit log: appended to the shared folder as JSON lines and read back
    c = table(spark, d, "conversations")
    log = c.select(
        stable_id("conv_id", "turn").alias("entry_id"), F.col("conv_id").cast("string").alias("case_id"), F.col("turn").cast("string").alias("timestamp"), F.col("role").alias("event"),
        F.col("text").alias("detail"), F.lit("reader").alias("actor"), F.lit(None).cast("string").alias("file_hash"), F.lit("").alias("signature"),
    )
    path = shared_path(spark, "audit")
    S.append_audit(log, path)
    seq = F.col("timestamp").cast("bigint")
    return S.read_audit(spark, path).groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("case_id").alias("n_cases"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.sum(F.length("detail")).alias("detail_chars"),
    )


# -- chain ---------------------------------------------------------------------
KEY = b"mediasift-test-key"


def _hmac_sql(msg: str) -> str:
    k = KEY.ljust(64, b"\0")
    i, o = bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()
    return f"sha256(unhex('{o}') || unhex(sha256(unhex('{i}') || encode({msg}))))"


def _body_sql() -> str:
    return "'{\"actor\": \"' || role || '\", \"detail\": \"' || md5(text) || '\", \"turn\": ' || '\"' || turn || '\"}'"


CHAIN_SQL = f"""a AS (SELECT conv_id, turn, role, {_body_sql()} AS body, text FROM conversations),
b AS (SELECT *, lag(body) OVER w AS b1, lag(body,2) OVER w AS b2 FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s0 AS (SELECT *, CASE turn % 3 WHEN 0 THEN sha256(body) WHEN 1 THEN {_hmac_sql("sha256(b1) || ':' || body")} ELSE {_hmac_sql(f"({_hmac_sql("sha256(b2) || ':' || b1")}) || ':' || body")} END AS sig0 FROM b),
s AS (SELECT *, CASE WHEN conv_id % 10 = 3 AND turn = 1 THEN reverse(sig0) ELSE sig0 END AS sig FROM s0),
v AS (SELECT *, coalesce(lag(sig) OVER (PARTITION BY conv_id ORDER BY turn), CAST(conv_id AS VARCHAR)) AS prev FROM s),
bad AS (SELECT conv_id, turn FROM v WHERE sig <> {_hmac_sql("prev || ':' || body")})"""


def chain_entries(spark, d):
    """Conversations as audit entries. Every third entry is an unsigned import (plain hash), the two
    after it are chained to it, and one entry of every tenth case is tampered with."""
    from pyspark.sql import Window

    c = table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("role").alias("actor"), F.md5("text").alias("detail"), F.col("turn").cast("string").alias("turn_text"),
    )
    body = F.concat(F.lit('{"actor": "'), F.col("actor"), F.lit('", "detail": "'), F.col("detail"), F.lit('", "turn": "'), F.col("turn_text"), F.lit('"}'))
    c = c.withColumn("body", body)
    from mediasift.operators.ordered import Ordered

    o = Ordered(c, ["conv_id"], ["turn"], before=2)
    c = o.add(_b1=o.prev("body"), _b2=o.prev("body", 2)).rows()
    h = lambda b: F.sha2(b, 256)
    first = S.sign(KEY, h(F.col("_b1")), F.col("body"))
    second = S.sign(KEY, S.sign(KEY, h(F.col("_b2")), F.col("_b1")), F.col("body"))
    sig = F.when(F.col("turn") % 3 == 0, h(F.col("body"))).when(F.col("turn") % 3 == 1, first).otherwise(second)
    sig = F.when((F.col("conv_id") % 10 == 3) & (F.col("turn") == 1), F.reverse(sig)).otherwise(sig)
    return c.withColumn("signature", sig).drop("_b1", "_b2")


@query(f"WITH {CHAIN_SQL} SELECT conv_id, turn FROM bad")
def q_chain_verify(spark, d):
    return S.verify_chain(chain_entries(spark, d), KEY, "conv_id", ["turn"], text=F.col("body")).select("conv_id", "turn")


@query(f"WITH {CHAIN_SQL}, n AS (SELECT conv_id, count(*) AS n FROM a GROUP BY conv_id), m AS (SELECT conv_id, count(*) AS m FROM bad GROUP BY conv_id) SELECT n.conv_id, n AS n_entries, coalesce(m,0) AS n_bad, coalesce(m,0)=0 AS intact FROM n LEFT JOIN m ON n.conv_id=m.conv_id")
def q_chain_summary(spark, d):
    e = chain_entries(spark, d)
    return S.chain_summary(e, S.verify_chain(e, KEY, "conv_id", ["turn"], text=F.col("body")), "conv_id")


# -- stores and records ----------------------------------------------------------
@query(f"""WITH {CHECKS} SELECT 'cases' AS "table", count(DISTINCT k) AS n_rows FROM checks UNION ALL SELECT 'module_results', count(DISTINCT (k, module)) FROM checks UNION ALL SELECT 'findings', count(DISTINCT (k, tie)) FROM checks
UNION ALL SELECT 'audit_entries', count(*) FROM conversations UNION ALL SELECT 'device_fingerprints', count(DISTINCT label) FROM embeddings""")
def q_case_tables(spark, d):
    # written twice, as after a retry: a key is stored once
    path = shared_path(spark, "cases")
    for _ in range(2):
        S.write_case_tables(case_tables(spark, d), path)
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows") for name, df in S.read_case_tables(spark, path).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def case_tables(spark, d):
    c = checks(spark, d)
    conv = table(spark, d, "conversations")
    return {
        "cases": c.select(F.col("k").alias("case_id"), F.to_date(F.lit("2024-01-01")).alias("ingest_date")),
        "module_results": c.groupBy(F.col("k").alias("case_id"), "module").agg(F.max("score").alias("score")),
        "findings": c.select(F.col("k").alias("case_id"), F.col("tie").alias("finding_id"), "module", "severity", "score"),
        "audit_entries": conv.select(F.col("conv_id").alias("case_id"), stable_id("conv_id", "turn").alias("entry_id"), F.col("role").alias("event")),
        "device_fingerprints": table(spark, d, "embeddings").groupBy(F.lit("cam").alias("device_make"), F.col("label").cast("string").alias("device_model")).agg(F.count(F.lit(1)).alias("frame_count")),
    }


@query(f"""WITH {SERIES}, a AS (SELECT k, '{{"k":' || k || ',"n":' || count(*) || ',"top":"' || arg_max(kind, tie) || '"}}' AS j FROM series GROUP BY k) SELECT k, sha256(j) AS digest, k % 7 <> 0 AS intact FROM a""")
def q_result_integrity(spark, d):
    r = series(spark, d).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max_by("kind", "tie").alias("top"))
    w = S.with_digest(r, F.struct("k", "n", "top"))
    # every seventh stored record is altered after signing
    stored = w.withColumn("json", F.when(F.col("k") % 7 == 0, F.replace("json", F.lit('"top"'), F.lit('"TOP"'))).otherwise(F.col("json")))
    return S.verify_digest(stored).select("k", "digest", "intact")


@query(f"""WITH {CHECKS}, f AS (SELECT k, module, severity, tie, row_number() OVER (PARTITION BY k ORDER BY tie) - 1 AS i FROM checks), p AS (SELECT k, i // 3 AS part, string_agg('{{"module":"' || module || '","severity":"' || severity || '","tie":' || tie || '}}', ',' ORDER BY i) AS j FROM f GROUP BY k, i // 3),
c AS (SELECT k, count(*) AS n FROM checks GROUP BY k) SELECT c.k, CAST(coalesce(part,0) AS BIGINT) AS part, '{{"k":' || c.k || ',"n":' || n || ',"findings":[' || coalesce(j,'') || ']}}' AS json FROM c LEFT JOIN p ON c.k=p.k""")
def q_export_json(spark, d):
    c = checks(spark, d)
    cases = c.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return S.export_records(cases, c.select("k", "module", "severity", "tie"), K, ["tie"], part_rows=3)


@query("WITH a AS (SELECT source, doc_id, n_chars % 100 > 24 AS old FROM documents) SELECT source, count(*) FILTER (WHERE old) AS n_expired, count(*) FILTER (WHERE NOT old) AS n_kept FROM a GROUP BY source")
def q_retention(spark, d):
    now = F.to_timestamp(F.lit("2024-06-01 00:00:00"))
    l = table(spark, d, "documents").select("source", "doc_id", F.timestamp_micros(F.unix_micros(now) - (F.col("n_chars") % 100) * 3600000000).alias("mtime"))
    return S.retention(l, ["source"], "mtime", now, 24.0)


@query("""WITH a AS (SELECT doc_id AS k, CASE doc_id % 4 WHEN 0 THEN 'exe' WHEN 1 THEN 'mp4' WHEN 2 THEN 'mov' ELSE 'mkv' END AS ext, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE n_chars END AS sz, lang <> 'de' AS hv, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE n_chars/CAST(2000 AS DOUBLE) END AS dur FROM documents),
b AS (SELECT k, concat_ws(',', CASE WHEN sz = 0 THEN 'empty' END, CASE WHEN sz > 10000 THEN 'too_large' END, CASE WHEN ext = 'exe' THEN 'unsupported' END, CASE WHEN NOT hv THEN 'no_video_stream' END) AS errors, concat_ws(',', CASE WHEN dur < 1 THEN 'very_short' END, CASE WHEN dur IS NULL THEN 'unknown_duration' END) AS warnings FROM a)
SELECT k, errors, warnings, errors = '' AS is_valid FROM b""")
def q_validate(spark, d):
    i = F.col("doc_id")
    ext = F.get(F.array(*[F.lit(x) for x in ("EXE", "mp4", "MOV", "mkv")]), i % 4)
    v = table(spark, d, "documents").select(
        i.alias("k"), F.concat(F.lit("in/a.b."), ext).alias("path"), F.when(i % 50 == 0, 0).otherwise(F.col("n_chars")).alias("size_bytes"), (F.col("lang") != "de").alias("has_video"), F.when(i % 9 != 0, F.col("n_chars") / 2000).alias("duration_s"),
    )
    return M.validate(v, K, (".mp4", ".mov", ".mkv"), 10000)


@query("""SELECT doc_id AS k, 'f' || doc_id || '.' || lang AS filename, CAST(strlen(text) AS BIGINT) AS size_bytes, upper(lang) AS format, n_chars || 'x' || doc_id % 100 AS dimensions, 'RGB' AS mode, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS INT) AS n_exif, CASE WHEN doc_id % 3 > 0 THEN source END AS gps, md5(text) AS md5, sha256(text) AS sha256 FROM documents""")
def q_image_metadata(spark, d):
    i = F.col("doc_id")
    files = table(spark, d, "documents").select(
        F.concat(F.lit("in/f"), i.cast("string"), F.lit("."), F.col("lang")).alias("path"), F.encode("text", "UTF-8").alias("content"), F.lit(None).cast("timestamp").alias("modificationTime"), F.col("n_chars").alias("width"), (i % 100).alias("height"), F.lit("RGB").alias("mode"),
        F.when(i % 3 > 0, F.create_map(F.lit("GPSInfo"), F.col("source"), F.lit("Make"), F.lit("x"))).alias("exif"),
    )
    m = M.image_metadata(files)
    return m.select(F.regexp_extract("filename", "[0-9]+", 0).cast("bigint").alias("k"), "filename", "size_bytes", "format", "dimensions", "mode", F.size("exif").alias("n_exif"), F.try_element_at("gps", F.lit("GPSInfo")).alias("gps"), "md5", "sha256")
