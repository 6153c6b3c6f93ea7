"""J, U, O: join, set, graph and ordering queries on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.functions.constants import CONTAINER_CODECS, ENCODER_SIGNATURES
from mediasift.functions.exprs import vsum
from mediasift.operators import graph as G
from mediasift.operators import joins as J
from mediasift.operators import pairs as PR
from mediasift.operators.stats import pick
from mediasift.plans.bindings import SERIES, series, table
from mediasift.plans.q_stats import CHECKS, checks
from mediasift.plans.registry import R, query, tidy

K, O = ["k"], ["t", "tie"]
CODECS = ("pcm_s16le", "mp3", "aac", "opus", "vorbis", "flac", "amr_nb", "amr_wb", "alac")
L = lambda xs: "[" + ",".join(f"'{x}'" for x in xs) + "]"
_exp = "CASE c " + " ".join(f"WHEN '{k}' THEN {L(v)}" for k, v in CONTAINER_CODECS.items()) + " END"


@query(f"""WITH a AS (SELECT p_partkey AS k, ({L(CONTAINER_CODECS)})[p_partkey % 8 + 1] AS c, ({L(CODECS)})[p_size % 9 + 1] AS codec FROM part)
SELECT k, c AS container, codec, array_to_string({_exp}, ',') AS expected, NOT list_contains({_exp}, codec) AS mismatch FROM a""")
def q_lookup_expected(spark, d):
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("k"), F.get(arr(CONTAINER_CODECS), F.col("p_partkey") % 8).alias("container"), F.get(arr(CODECS), F.col("p_size") % 9).alias("codec")
    )
    return J.lookup_expected(p, "container", "codec", CONTAINER_CODECS)


_sig = " ".join(f"WHEN regexp_matches(t, '{'|'.join(p)}') THEN '{n}|{c}|{str(s).lower()}'" for n, p, c, s in ENCODER_SIGNATURES)


@query(f"""WITH a AS (SELECT page_id AS k, lower(trim(html)) AS t FROM pages), b AS (SELECT k, string_split(CASE {_sig} END, '|') AS s FROM a)
SELECT k, s[1] AS name, s[2] AS category, s[3] = 'true' AS suspicious FROM b""".replace("SELECT k, s[1] AS name, s[2] AS category, s[3] = 'true' AS suspicious FROM b", "SELECT k, s[1] AS name, s[2] AS category, s[3] = 'true' AS suspicious FROM b"))
def q_signature_match(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("k"), J.first_signature(F.col("html"), ENCODER_SIGNATURES).alias("s"))
    return p.select("k", "s.name", "s.category", "s.suspicious")


def _susp(x, a, b, c):
    return f"CASE WHEN {x} >= {c} THEN 1.0 WHEN {x} >= {b} THEN 0.5+0.5*({x}-{b})/({c}-{b}) WHEN {x} >= {a} THEN 0.2*({x}-{a})/({b}-{a}) ELSE 0 END"


@query(f"""WITH {SERIES}, v AS (SELECT k, arg_min(x/100, tie) AS d, arg_min(m/CAST(300 AS DOUBLE), tie) AS s FROM series WHERE kind IN ('click','view') GROUP BY k), a AS (SELECT k, arg_min(x/100, tie) AS d, arg_min(m/CAST(300 AS DOUBLE), tie) AS s FROM series WHERE kind='error' GROUP BY k),
g AS (SELECT v.k, abs(v.d-a.d) AS dg, abs(v.s-a.s) AS og FROM v JOIN a ON v.k=a.k) SELECT k, {R('dg')} AS duration_gap, {R('og')} AS start_offset, {R(f"greatest(({_susp('dg', 0.10, 0.33, 1.0)})*0.7, ({_susp('og', 0.05, 0.20, 0.50)})*0.6)")} AS score FROM g""")
def q_av_sync(spark, d):
    s = series(spark, d).withColumn("codec_type", F.when(F.col("kind").isin("click", "view"), "video").when(F.col("kind") == "error", "audio"))
    s = s.withColumn("duration", F.col("x") / 100).withColumn("start_time", F.col("m") / F.lit(300.0))
    return tidy(J.av_sync(s, K, "codec_type", O, "duration", "start_time"))


@query(f"""WITH {SERIES}, l AS (SELECT k, t, tie FROM series WHERE kind='error'), r AS (SELECT k, t, x FROM series WHERE kind='view'),
b AS (SELECT l.k, l.tie, l.t, r.t AS rt, r.x, row_number() OVER (PARTITION BY l.k, l.tie ORDER BY abs(l.t-r.t), r.t) AS q FROM l JOIN r ON l.k=r.k AND abs(l.t-r.t) <= 24)
SELECT k, tie, {R('t')} AS t, {R('x')} AS x, {R('abs(t-rt)')} AS distance FROM b WHERE q=1""")
def q_asof_nearest(spark, d):
    s = series(spark, d)
    return tidy(J.nearest(s.filter("kind = 'error'"), s.filter("kind = 'view'"), K, "t", "t", "tie", "x", 24.0))


PAIRS = """i AS (SELECT k, tie, m, row_number() OVER (PARTITION BY k ORDER BY t, tie) AS r FROM series), pr AS (SELECT a.k, a.tie AS "left", b.tie AS "right", CAST(bit_count(xor(a.m,b.m)) AS BIGINT) AS distance FROM i a JOIN i b ON a.k=b.k AND b.r-a.r BETWEEN 5 AND 90 WHERE bit_count(xor(a.m,b.m)) <= 1)"""


@query(f'WITH {SERIES}, {PAIRS} SELECT k, "left", "right", distance FROM pr')
def q_band_hamming(spark, d):
    return J.band_hamming(series(spark, d), K, O, "m", "tie", max_dist=1)


@query(f"""WITH RECURSIVE {SERIES}, {PAIRS}, e AS (SELECT k, "left" AS a, "right" AS b FROM pr WHERE distance = 0 UNION SELECT k, "right", "left" FROM pr WHERE distance = 0),
c(k, node, lab) AS (SELECT DISTINCT k, a, a FROM e UNION SELECT c.k, e.b, c.lab FROM c JOIN e ON c.k=e.k AND c.node=e.a WHERE c.lab < e.b)
SELECT k, node, min(lab) AS component FROM c GROUP BY k, node""")
def q_components(spark, d):
    e = J.band_hamming(series(spark, d), K, O, "m", "tie", max_dist=0)
    return G.components(e, K, "left", "right")


@query("""WITH p AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT label, vec_id, list_transform(v, lambda e: e - list_avg(v)) AS v FROM p), n AS (SELECT label, vec_id, v, sqrt(list_dot_product(v,v)) + 1e-10 AS nn FROM c)
SELECT a.label, max(z.n) AS n, """ + R("avg(list_dot_product(a.v,b.v)/(a.nn*b.nn))") + """ AS mean_ncc FROM n a JOIN n b ON a.label=b.label AND a.vec_id < b.vec_id JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) z ON a.label=z.label GROUP BY a.label""")
def q_pair_ncc(spark, d):
    return tidy(J.mean_pair_ncc(table(spark, d, "embeddings"), ["label"], "embedding", 64))


_V = "sv AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def vectors(spark, d):
    # as stored: the operators compute in doubles, their shuffles carry the floats
    return table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").alias("v"))


@query(f"""WITH {_V}, c AS (SELECT a.label, a.vec_id, list_dot_product(a.v,b.v)/sqrt(list_dot_product(a.v,a.v)*list_dot_product(b.v,b.v)) AS c FROM sv a JOIN sv b ON a.label=b.label AND b.vec_id - a.vec_id > 5),
g AS (SELECT label, count(*) FILTER (WHERE c >= 0.3) AS np, max(c) FILTER (WHERE c >= 0.3) AS mx FROM c GROUP BY label), n AS (SELECT label, count(*) AS n FROM sv GROUP BY label)
SELECT n.label, n, coalesce(np,0) AS n_pairs, {R('mx')} AS max_cosine, coalesce(np,0) >= 3 AS flagged FROM n LEFT JOIN g ON n.label=g.label""")
def q_pair_cosine(spark, d):
    return tidy(J.repeat_summary(vectors(spark, d), ["label"], "vec_id", "v", cut=0.3))


@query(f"""WITH {_V}, c AS (SELECT a.label, list_dot_product(a.v,b.v)/sqrt(list_dot_product(a.v,a.v)*list_dot_product(b.v,b.v)) AS c FROM sv a JOIN sv b ON a.label=b.label AND b.vec_id - a.vec_id > 5),
m AS (SELECT label, count(*) AS np, median(c) AS md, max(c) AS mx FROM c GROUP BY label), d AS (SELECT m.label, median(abs(c-md)) AS mad FROM c JOIN m ON c.label=m.label GROUP BY m.label), n AS (SELECT label, count(*) AS n, max(vec_id)-min(vec_id) AS sp FROM sv GROUP BY label),
t AS (SELECT n.label, n, coalesce(np,0) AS np, md, mad, mx, CASE WHEN sp >= 60 AND np >= 20 THEN least(0.9, greatest(0.2, md+3.5*1.4826*mad)) ELSE 0.6 END AS cut FROM n LEFT JOIN m ON n.label=m.label LEFT JOIN d ON n.label=d.label), h AS (SELECT c.label, count(*) AS nh FROM c JOIN t ON c.label=t.label WHERE c >= cut GROUP BY c.label)
SELECT t.label, n, np AS n_pairs, {R('md')} AS median, {R('mad')} AS mad, {R('cut')} AS cut, coalesce(nh,0) AS n_hits, {R('mx')} AS max_similarity, coalesce(nh,0) >= 3 AS flagged FROM t LEFT JOIN h ON t.label=h.label""")
def q_pair_adaptive(spark, d):
    return tidy(PR.repeats_adaptive(vectors(spark, d), ["label"], "vec_id", "v", least=0.2, most=0.9, fixed=0.6))


@query(f"""WITH {_V}, p AS (SELECT a.label, a.vec_id AS q, b.vec_id AS b, sqrt(list_sum(list_transform(list_zip(a.v,b.v), lambda z: (z[1]-z[2])*(z[1]-z[2])))) AS d FROM sv a JOIN sv b ON a.label=b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY label, q ORDER BY d, b) AS n FROM p), g AS (SELECT label, q, max(CASE WHEN n=1 THEN b END) AS match, max(CASE WHEN n=1 THEN d END) AS d1, max(CASE WHEN n=2 THEN d END) AS d2 FROM r WHERE n <= 2 GROUP BY label, q)
SELECT label, q AS vec_id, match, {R('d1')} AS d1, {R('d2')} AS d2 FROM g WHERE d1 < 0.95*d2 AND abs(q-match) > 10""")
def q_knn_ratio(spark, d):
    return tidy(J.knn_ratio(vectors(spark, d), ["label"], "vec_id", "v", radius=1.2, ratio=0.95, min_gap=10))


@query("""WITH i AS (SELECT lang, doc_id, md5(text) AS h, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents), f AS (SELECT lang, h, min(pos) AS fp FROM i GROUP BY lang, h)
SELECT i.lang, doc_id, pos, fp AS first_pos FROM i JOIN f ON i.lang=f.lang AND i.h=f.h WHERE pos - fp > 2""")
def q_hash_dup(spark, d):
    t = table(spark, d, "documents").select("lang", "doc_id", F.md5("text").alias("h"))
    return J.hash_repeats(t, ["lang"], ["doc_id"], "h").select("lang", "doc_id", "pos", "first_pos")


@query(f"""WITH {SERIES}, n AS (SELECT k, greatest(1, CAST(floor(count(*)*0.05) AS BIGINT)) AS want FROM series GROUP BY k), fl AS (SELECT k, t, tie FROM series WHERE x > 150),
rs AS (SELECT s.k, s.t, s.tie, row_number() OVER (PARTITION BY s.k ORDER BY substr(md5(concat_ws(':', CAST(s.k AS VARCHAR), CAST(s.tie AS VARCHAR))),1,8), s.tie) AS q FROM series s WHERE x <= 150),
u AS (SELECT k, t, tie, 'flagged' AS origin FROM fl UNION ALL SELECT rs.k, t, tie, 'baseline' FROM rs JOIN n ON rs.k=n.k WHERE q <= want) SELECT k, {R('t')} AS t, tie, origin, CAST(0 AS BIGINT) AS n_left_out FROM u""")
def q_flagged_plus_baseline(spark, d):
    s = series(spark, d)
    return tidy(J.flagged_plus_baseline(s, s.filter("x > 150"), K, "t", "tie"))


@query("""WITH p AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), e AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS a FROM (SELECT label, embedding, unnest(generate_series(1,64)) AS i FROM embeddings) GROUP BY label, i),
r AS (SELECT label, list(a ORDER BY i) AS v FROM e GROUP BY label), rc AS (SELECT label, list_transform(v, lambda z: z - list_avg(v)) AS v FROM r), pc AS (SELECT vec_id, list_transform(v, lambda z: z - list_avg(v)) AS v FROM p),
s AS (SELECT vec_id, label AS device, list_dot_product(pc.v, rc.v)/(sqrt(list_dot_product(pc.v,pc.v))*sqrt(list_dot_product(rc.v,rc.v))+1e-10) AS ncc FROM pc, rc)
SELECT vec_id, arg_max(device, ncc) AS device, """ + R("max(ncc)") + " AS ncc FROM s GROUP BY vec_id")
def q_device_match(spark, d):
    e = table(spark, d, "embeddings")
    refs = e.groupBy("label").agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)]).alias("ref"))
    return tidy(J.device_match(e.select("vec_id", "embedding"), refs, "vec_id", "embedding", "label", "ref"))


@query(f"""WITH {SERIES}, g AS (SELECT k, count(*) AS n, avg(x) AS mu, stddev_pop(x) AS s, stddev_pop(m) AS b, max(x) AS hi, min(x) AS lo FROM series WHERE kind='error' GROUP BY k HAVING count(*) >= 4),
z AS (SELECT k, n, greatest(abs(hi-mu),abs(lo-mu))/s AS z, s/(b+1e-6) AS r FROM g) SELECT k, n, {R('z')} AS max_z, {R('r')} AS ratio, CASE WHEN z >= 2.5 AND r >= 2 THEN CASE WHEN z >= 3.75 THEN 'high' ELSE 'medium' END ELSE 'none' END AS severity FROM z""")
def q_roi_vs_background(spark, d):
    s = series(spark, d)
    roi = s.filter("kind = 'error'").select("k", "tie", F.col("x").alias("roi"))
    return tidy(J.roi_vs_background(roi, s.select("k", "tie", "m"), K, ["tie"], "roi", "m"))


_RG = """SELECT k, CASE WHEN avg(x) < 45 THEN 'low' ELSE 'high' END AS verdict, avg(x)/100 AS p, avg(m)/100 AS c, list_sort(list(DISTINCT kind) FILTER (WHERE x > 100)) AS el FROM series WHERE {0} GROUP BY k"""


@query(f"""WITH {SERIES}, g AS ({_RG.format('k % 10 <> 3')}), n AS ({_RG.replace('FROM series', 'FROM (SELECT k, x * CASE WHEN k % 10 = 5 THEN 1.25 ELSE 1 END AS x, m, kind FROM series)').format('k % 10 <> 4')}), j AS (SELECT coalesce(g.k,n.k) AS k, g.k AS gk, n.k AS nk, g.verdict AS gv, n.verdict AS nv, g.p AS gp, n.p AS np, g.c AS gc, n.c AS nc, coalesce(g.el,[]) AS ge, coalesce(n.el,[]) AS ne FROM g FULL JOIN n ON g.k=n.k),
f AS (SELECT *, concat_ws(',', CASE WHEN gv IS DISTINCT FROM nv THEN 'verdict' END, CASE WHEN abs(gp-np) > 0.02 THEN 'p' END, CASE WHEN abs(gc-nc) > 0.03 THEN 'c' END, CASE WHEN len(list_filter(ge, lambda z: NOT list_contains(ne,z))) > 0 THEN 'el:lost' END, CASE WHEN len(list_filter(ne, lambda z: NOT list_contains(ge,z))) > 0 THEN 'el:new' END) AS fl FROM j)
SELECT k, CASE WHEN gk IS NULL THEN 'added' WHEN nk IS NULL THEN 'missing' WHEN fl = '' THEN 'same' ELSE 'changed' END AS state, CASE WHEN gk IS NULL OR nk IS NULL THEN '' ELSE fl END AS fields FROM f""")
def q_regression_diff(spark, d):
    run = lambda s: s.groupBy("k").agg(
        F.when(F.avg("x") < 45, "low").otherwise("high").alias("verdict"), (F.avg("x") / 100).alias("p"), (F.avg("m") / 100).alias("c"), F.collect_set(F.when(F.col("x") > 100, F.col("kind"))).alias("el"),
    )
    s = series(spark, d)
    # declared fixture: the old run lacks the cases k % 10 = 3, the new one k % 10 = 4 and has raised values where k % 10 = 5
    new = s.withColumn("x", F.col("x") * F.when(F.col("k") % 10 == 5, 1.25).otherwise(1.0))
    return J.regression_diff(run(s.filter("k % 10 <> 3")), run(new.filter("k % 10 <> 4")), K, ["verdict"], {"p": 0.02, "c": 0.03}, ["el"])


@query(f"""WITH m AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS a, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey, {R('o_totalprice',2)} AS declared, {R('a',2)} AS actual, n AS n_rows, {R('abs(o_totalprice-a)/o_totalprice',4)} AS relative
FROM orders JOIN m ON o_orderkey=k WHERE o_totalprice > 0 AND abs(o_totalprice-a)/o_totalprice > 0.05""")
def q_declared_vs_actual(spark, d):
    out = J.declared_vs_actual(table(spark, d, "orders"), table(spark, d, "lineitem"), ("o_orderkey", "l_orderkey"), "o_totalprice", "l_extendedprice")
    return tidy(out.withColumn("declared", F.round("declared", 2)).withColumn("actual", F.round("actual", 2)), 4)


@query(f"""WITH e AS (SELECT vec_id // 2 AS i, vec_id % 2 AS s, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.i, unnest(a.v) AS x, unnest(b.v) AS y FROM e a JOIN e b ON a.i=b.i AND a.s=0 AND b.s=1)
SELECT i % 10 AS k, count(DISTINCT i) AS n_blocks, {R('avg(abs(x-y))')} AS mean_diff, {R('max(abs(x-y))')} AS max_diff FROM p GROUP BY i % 10""")
def q_raster_diff(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("i"), (F.floor(F.col("vec_id") / 2) % 10).alias("k"), (F.col("vec_id") % 2).alias("s"), "embedding")
    return tidy(J.raster_diff(e.filter("s = 0"), e.filter("s = 1"), ["k", "i"], K, "embedding"))


@query(f"""WITH {SERIES}, f AS (SELECT k, tie, t AS s, t + x/20 AS e, kind FROM series) SELECT a.k, a.tie, a.kind, count(b.tie) AS n_overlap, count(b.tie) > 0 AS corroborated
FROM f a LEFT JOIN f b ON a.k=b.k AND a.kind <> b.kind AND a.s < b.e AND a.e > b.s GROUP BY a.k, a.tie, a.kind""")
def q_interval_overlap(spark, d):
    s = series(spark, d).withColumn("e", F.col("t") + F.col("x") / 20)
    return J.overlap_counts(s, K, "tie", "t", "e", "kind")


@query("""WITH p AS (SELECT label, vec_id, i, embedding[i]::DOUBLE AS v FROM (SELECT label, vec_id, embedding, unnest(generate_series(1,64)) AS i FROM embeddings)), s AS (SELECT label, i, sum(v) AS sv, count(*) AS n FROM p GROUP BY label, i),
r AS (SELECT p.label, vec_id, v, (sv-v)/(n-1) AS r FROM p JOIN s ON p.label=s.label AND p.i=s.i WHERE n > 5), c AS (SELECT label, vec_id, covar_pop(v,r)*64/(stddev_pop(v)*8*stddev_pop(r)*8+1e-10) AS ncc FROM r GROUP BY label, vec_id),
t AS (SELECT label, greatest(avg(ncc)-1.5*(stddev_pop(ncc)+1e-6), 0.0*max(ncc)) AS cut FROM c GROUP BY label) SELECT c.label, vec_id, """ + R("ncc") + " AS ncc, " + R("cut") + " AS cut FROM c JOIN t ON c.label=t.label WHERE ncc < cut")
def q_loo_outlier(spark, d):
    return tidy(J.loo_outliers(table(spark, d, "embeddings"), ["label"], "vec_id", "embedding", 64, sigma=1.5, floor=0.0))


@query("""WITH p AS (SELECT label, i-1 AS pos, avg(embedding[i]::DOUBLE) AS v FROM (SELECT label, embedding, unnest(generate_series(1,64)) AS i FROM embeddings) GROUP BY label, i HAVING count(*) >= 10),
b AS (SELECT label, pos // 8 // 2 * 4 + pos % 8 // 2 AS block, pos // 8 % 2 * 2 + pos % 2 AS q, v FROM p), r AS (SELECT *, (sum(v) OVER (PARTITION BY label, q) - v)/15 AS r FROM b),
c AS (SELECT label, block, covar_pop(v,r)*4/(stddev_pop(v)*2*stddev_pop(r)*2+1e-10) AS ncc FROM r GROUP BY label, block), s AS (SELECT label, avg(ncc) AS m, stddev_pop(ncc) AS s FROM c GROUP BY label)
SELECT c.label, CAST(block AS INT) AS block, """ + R("ncc") + " AS ncc, " + R("m") + " AS consistency, ncc < m - 2*s AND s > 0.001 AS anomalous FROM c JOIN s ON c.label=s.label")
def q_block_consistency(spark, d):
    return tidy(J.block_consistency(table(spark, d, "embeddings"), ["label"], "embedding", 8, min_block=2))


# -- sets, order, limits ------------------------------------------------------
@query(f"WITH {CHECKS} SELECT k, tie, 'temporal' AS domain, {R('score')} AS score, severity FROM checks WHERE module IN ('enf','noise') UNION ALL SELECT k, tie, 'spatial', NULL, severity FROM checks WHERE module IN ('compression','metadata') UNION ALL SELECT k, tie, 'av', {R('score')}, NULL FROM checks WHERE module='voice'")
def q_union_findings(spark, d):
    c = checks(spark, d)
    part = lambda ms, dom, *cols: c.filter(F.col("module").isin(*ms)).select("k", "tie", F.lit(dom).alias("domain"), *cols)
    return tidy(G.union_findings(part(("enf", "noise"), "temporal", "score", "severity"), part(("compression", "metadata"), "spatial", "severity"), part(("voice",), "av", "score")))


@query(f"WITH {CHECKS} SELECT k, CAST(floor(t/48) AS BIGINT) AS slot, module, arg_min(severity, tie) AS severity, min(tie) AS tie FROM checks GROUP BY k, floor(t/48), module")
def q_dedupe(spark, d):
    c = checks(spark, d).select("k", F.floor(F.col("t") / 48).alias("slot"), "module", "severity", "tie")
    return G.dedupe(c, ["k", "slot", "module"], ["tie"])


@query(f"""WITH {CHECKS}, a AS (SELECT DISTINCT k, module FROM checks WHERE severity='high'), b AS (SELECT DISTINCT k, module FROM checks WHERE m < 20)
SELECT k, module, 'only_high' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT k, module, 'only_low_m' FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT k, module, 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def q_set_diff(spark, d):
    c = checks(spark, d)
    a, b = c.filter("severity = 'high'").select("k", "module").distinct(), c.filter("m < 20").select("k", "module").distinct()
    side = lambda df, n: df.withColumn("side", F.lit(n))
    return side(a.exceptAll(b), "only_high").union(side(b.exceptAll(a), "only_low_m")).union(side(a.intersect(b), "both"))


_W = "CASE module WHEN 'enf' THEN 0.30 WHEN 'noise' THEN 0.22 WHEN 'compression' THEN 0.18 WHEN 'voice' THEN 0.10 ELSE 0.08 END"


@query(f"WITH {CHECKS} SELECT k, tie, module, severity FROM checks ORDER BY CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, {_W} DESC, tie")
def q_rank_findings(spark, d):
    from mediasift.plans.fusion import AUDIO_WEIGHTS

    c = checks(spark, d).select("k", "tie", "module", "severity")
    return G.rank_findings(c, "severity", pick(F.col("module"), AUDIO_WEIGHTS, 0.05), "tie")


@query(f"WITH {CHECKS}, r AS (SELECT k, tie, module, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, tie) AS q FROM checks) SELECT k, tie, module, {R('score')} AS score FROM r WHERE q <= 5")
def q_topn_per_asset(spark, d):
    c = checks(spark, d).select("k", "tie", "module", "score")
    return tidy(J.top_n(c, K, [F.desc("score"), F.col("tie")], 5))


@query(f"WITH {CHECKS}, r AS (SELECT k, t, tie, row_number() OVER (PARTITION BY k ORDER BY t, tie) AS q FROM checks WHERE severity='high') SELECT k, string_agg(CAST(tie AS VARCHAR), ',' ORDER BY t, tie) AS first_hits, count(*) AS n FROM r WHERE q <= 3 GROUP BY k")
def q_first_n(spark, d):
    # limit rows first, so the list per asset is at most three long
    c = J.top_n(checks(spark, d).filter("severity = 'high'").select("k", "t", "tie"), K, [F.col("t"), F.col("tie")], 3)
    s = F.sort_array(F.collect_list(F.struct("t", "tie")))
    return c.groupBy("k").agg(F.array_join(F.transform(s, lambda e: e["tie"].cast("string")), ",").alias("first_hits"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SERIES}, fr AS (SELECT k, t, x FROM series WHERE kind <> 'click'), md AS (SELECT k, quantile_cont(x, 0.5) AS b FROM fr GROUP BY k HAVING quantile_cont(x, 0.5) >= 0.5),
o AS (SELECT k, t, tie FROM series WHERE kind = 'click' AND m >= 50), j AS (SELECT o.k, o.t, o.tie, fr.x, abs(o.t-fr.t) AS ds, row_number() OVER (PARTITION BY o.k, o.tie ORDER BY abs(o.t-fr.t), fr.t, fr.x DESC) AS q FROM o JOIN fr ON o.k=fr.k),
h AS (SELECT j.*, b, round_even(t, 1) AS bucket FROM j JOIN md ON j.k=md.k WHERE q = 1 AND ds <= 10 AND x < 0.3*b), z AS (SELECT *, row_number() OVER (PARTITION BY k, bucket ORDER BY t, tie) AS w FROM h)
SELECT k, {R('bucket')} AS bucket, tie, {R('t')} AS t, {R('x')} AS x, {R('ds')} AS distance, {R('b')} AS baseline, CASE WHEN ds*1000 > 200 THEN 'high' ELSE 'medium' END AS severity FROM z WHERE w = 1""")
def q_onset_low_motion(spark, d):
    s = series(spark, d)
    return tidy(J.onset_low_motion(s.filter("kind = 'click' AND m >= 50"), s.filter("kind <> 'click'"), K, "t", "tie", "x", tolerance=10.0))
