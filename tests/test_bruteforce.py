"""Operators against brute-force answers on small fixtures, including copies and stars."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.functions import exprs as E
from mediasift.functions import udtf
from mediasift.operators import graph as G
from mediasift.operators import joins as J
from mediasift.operators import spectral as T
from mediasift.sources import media as M
from mediasift.sources import records as S


def roots(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {a: find(a) for a in parent}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "pairs"])
def test_components(spark, kind):
    r = random.Random(7)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 120)] + [(500, 501)],
        "random": [(r.randrange(150), r.randrange(150)) for _ in range(110)],
        "pairs": [(2 * i + 1, 2 * i) for i in range(20)],
    }[kind]
    edges = [(a, b) for a, b in edges if a != b]
    df = spark.createDataFrame([(1, a, b) for a, b in edges] + [(2, b, a) for a, b in edges], "k int, a bigint, b bigint")
    got = {(x.k, x.node): x.component for x in G.components(df, ["k"], "a", "b").collect()}
    want = roots(edges)
    assert got == {(k, n): c for k in (1, 2) for n, c in want.items()}


def vectors(seed=3, n=90, dims=4):
    g = np.random.default_rng(seed)
    v = g.normal(size=(n, dims))
    v[10] = v[40]  # a pair of copies far apart
    v[20:24] = v[60]  # five copies
    v[61] = v[60]  # six, one of them next to another
    v[70] = v[71] * 1.0001  # close in time
    return v


def test_repeat_summary_with_copies(spark):
    v = vectors()
    df = spark.createDataFrame([(i % 2, i, [float(x) for x in row]) for i, row in enumerate(v)], "k int, id bigint, v array<double>")
    cut, gap = 0.97, 5
    want = {}
    for k in (0, 1):
        ids = [i for i in range(len(v)) if i % 2 == k]
        cos = lambda a, b: float(v[a] @ v[b] / (np.linalg.norm(v[a]) * np.linalg.norm(v[b])))
        far = [cos(a, b) for a, b in itertools.combinations(ids, 2) if b - a > gap]
        hits = [c for c in far if c >= cut - 1e-12]
        want[k] = (len(hits), round(max(hits), 6) if hits else None)
    got = {r.k: (r.n_pairs, round(r.max_cosine, 6)) for r in J.repeat_summary(df, ["k"], "id", "v", cut, gap).collect()}
    assert got == want


def test_knn_ratio_with_copies(spark):
    v = vectors(5)
    df = spark.createDataFrame([(1, i, [float(x) for x in row]) for i, row in enumerate(v)], "k int, id bigint, v array<double>")
    want = set()
    for i in range(len(v)):
        d = sorted((float(np.linalg.norm(v[i] - v[j])), j) for j in range(len(v)) if j != i)
        if d[0][0] < 0.7 * d[1][0]:
            want.add((i, d[0][1]))
    got = {(r.id, r.match) for r in J.knn_ratio(df, ["k"], "id", "v", radius=0.2).collect()}
    assert got == want and (10, 40) in got and not any(a in (20, 21, 22, 23, 60, 61) for a, _ in got)


def test_device_match_many_references(spark, monkeypatch):
    g = np.random.default_rng(1)
    ref, q = g.normal(size=(30, 8)), g.normal(size=(12, 8))
    vec = lambda m, n: spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], f"{n} bigint, {n}_v array<double>")
    corr = np.corrcoef(np.vstack([q, ref]))[:12, 12:]
    want = {i: int(corr[i].argmax()) for i in range(12)}
    for limit in (J.BROADCAST_BYTES, 0):
        monkeypatch.setattr(J, "BROADCAST_BYTES", limit)
        got = {r.q: (r.device, round(r.ncc, 6)) for r in J.device_match(vec(q, "q"), vec(ref, "d"), "q", "q_v", "d", "d_v", chunk=7).collect()}
        assert got == {i: (j, round(float(corr[i, j]), 6)) for i, j in want.items()}


def test_canonical_json_and_hmac(spark):
    import hashlib
    import hmac

    texts = ["plain", 'q"uote', "back\\slash", "tab\there\nline", "é ü ß", "日本", "emoji \U0001F600!", "\x01\x7f", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", "t", E.json_string(F.col("t")).alias("j"), E.hmac_sha256(b"key", F.coalesce("t", F.lit(""))).alias("h"), E.hmac_sha256(b"k" * 100, F.lit("x")).alias("long")).collect()
    for r in rows:
        assert r.j == json.dumps(r.t)
        assert r.h == hmac.new(b"key", (r.t or "").encode(), hashlib.sha256).hexdigest()
        assert r.long == hmac.new(b"k" * 100, b"x", hashlib.sha256).hexdigest()


def test_signed_text_equals_sorted_json(spark):
    e = {"entry_id": "1", "case_id": "c", "timestamp": "t", "event": "e", "detail": 'a "b"é', "actor": "me", "file_hash": None}
    df = spark.createDataFrame([tuple(e.values())], "entry_id string, case_id string, timestamp string, event string, detail string, actor string, file_hash string")
    assert df.select(S.signed_text().alias("t")).first().t == json.dumps(e, sort_keys=True)


def test_spectrum_equals_numpy(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=200)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, i bigint, x double")
    fr = T.frames(df, ["k"], "i", "x", 32, 8)
    got = {r.win: np.array(r.p) for r in fr.select("win", T.power_spectrum(F.col("samples")).alias("p")).collect()}
    wins = range((200 - 32) // 8 + 1)
    assert set(got) == set(wins)
    for w in wins:
        want = np.abs(np.fft.rfft(x[w * 8 : w * 8 + 32] * np.hanning(32))) ** 2
        assert np.allclose(got[w], want, atol=1e-9)


def test_dct_is_orthonormal(spark):
    g = np.random.default_rng(4)
    b = g.normal(size=(5, 64))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(b)], "i int, px array<double>")
    for r in df.select("i", T.block_dct(F.col("px")).alias("c")).collect():
        assert math.isclose(sum(v * v for v in r.c), float((b[r.i] ** 2).sum()), rel_tol=1e-9)
        assert math.isclose(r.c[0], b[r.i].sum() / 8, rel_tol=1e-9)


def test_table_function(spark):
    udtf.register(spark)
    rows = spark.sql("SELECT * FROM frames(array(1D, 2D, 3D, 4D, 5D), 3, 2)").collect()
    assert [(r.win, r.samples) for r in rows] == [(0, [1.0, 2.0, 3.0]), (1, [3.0, 4.0, 5.0])]


def test_parsers(spark):
    c = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.250+0200", "2024:01:02 03:04:05", "2024-01-02", "2024", "noise", "2024-13-40", "", None]
    df = spark.createDataFrame([(x,) for x in c], "c string")
    got = [r.u for r in df.select(F.unix_micros(E.parse_ts(F.col("c"))).alias("u")).collect()]
    base = 1704164645000000
    assert got == [base, base - 7200000000 + 250000, base, 1704153600000000, None, None, None, None, None]
    r = spark.createDataFrame([(x,) for x in ["30000/1001", "25", "1/0", "a/b", "", None]], "c string")
    vals = [x.v for x in r.select(E.rational(F.col("c")).alias("v")).collect()]
    assert [round(v, 3) if v is not None else None for v in vals] == [29.97, 25.0, None, None, None, None]


def test_edge_inputs(spark):
    """Empty tables, one row, equal values and nulls do not fail (no division by zero)."""
    from mediasift.operators import series as W
    from mediasift.operators import stats as A

    schema = "k int, t double, tie bigint, x double"
    one = [(1, 0.0, 0, 5.0)]
    flat = [(2, float(i), i, 0.0) for i in range(30)]
    nulls = [(3, float(i), i, None) for i in range(5)]
    for rows in ([], one, flat, nulls, one + flat + nulls):
        df = spark.createDataFrame(rows, schema)
        o = ["t", "tie"]
        for f in (
            lambda: W.abs_diff(df, ["k"], o, "x"), lambda: W.frozen_runs(df, ["k"], o, "x", 1.0), lambda: W.change_point(df, ["k"], o, "x", 3.0, 1.0), lambda: W.abruptness(df, ["k"], o, "x"),
            lambda: W.rolling_deviation(df, ["k"], o, "x"), lambda: W.before_after(df, ["k"], o, "x"), lambda: W.phase_discontinuity(df, ["k"], o, "x", 1.0), lambda: W.diff_zscore(df, ["k"], o, "x"),
            lambda: W.flux_events(df, ["k"], o, "x"), lambda: W.pause_anomalies(df, ["k"], o, "x", 1.0), lambda: A.signal_levels(df, ["k"], "x"), lambda: A.variation(df, ["k"], "x"),
            lambda: A.similarity_profile(df, ["k"], "x"), lambda: A.histogram_periodicity(df, ["k"], "x"), lambda: A.dynamic_range(df, ["k"], o, "x", 5), lambda: A.half_compare(df, ["k"], o, "x"),
            lambda: A.bitrate_anomalies(df, ["k"], "t", "x"), lambda: A.benford(df, ["k"], "x"), lambda: A.entropy(df.withColumn("v", F.col("tie")), ["k"], "v"),
        ):
            f().collect()


def test_open_tail_and_exact_run(spark):
    from mediasift.operators import series as W

    rows = [(1, float(t), t, v) for t, v in enumerate([9, 0, 0, 0, 9, 0, 0, 9, 0, 0, 0])]
    df = spark.createDataFrame(rows, "k int, t double, tie bigint, x double") if False else spark.createDataFrame([(a, b, c, float(d)) for a, b, c, d in rows], "k int, t double, tie bigint, x double")
    got = sorted((r.start_t, r.end_t, r.n_rows) for r in W.frozen_runs(df, ["k"], ["t", "tie"], "x", 1.0, 3).collect())
    assert got == [(1.0, 4.0, 3), (8.0, 10.0, 3)]


def test_change_point_rules(spark):
    """Runs inside the warm-up are skipped; the last persist - 1 rows cannot start one."""
    from mediasift.operators import series as W

    def cp(vals, **kw):
        df = spark.createDataFrame([(1, float(i), i, float(v)) for i, v in enumerate(vals)], "k int, t double, tie bigint, x double")
        return W.change_point(df, ["k"], ["t", "tie"], "x", 3.0, 2.0, 4.0, 3, **kw).first()

    noise = [0, 1, 0, 1]
    assert cp(noise + [50, 50, 50, 0, 0, 50, 50, 50]).change_t == 9.0
    r = cp(noise + [0, 0, 0, 0, 0, 50, 50])
    assert r.change_t is None and r.max_z > 4
    assert cp(noise + [0, 0, 50, 50, 50, 0]).change_t == 6.0


def test_rows_in_any_order(spark):
    from mediasift.operators import series as W

    rows = [(k, float(t), t * 10 + k, float((t * 37 + k * 11) % 50)) for k in range(3) for t in range(40)]
    out = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k int, t double, tie bigint, x double").repartition(5)
        out.append(sorted(map(str, W.merge_adjacent(df.withColumns({"e": F.col("t") + 1, "kind": F.lit("a"), "rk": F.lit(1)}), ["k"], "t", "e", "kind", "rk", "x", "tie").collect())))
    assert out[0] == out[1]


def test_scaled_pcm(spark):
    df = spark.createDataFrame([(-32768, 0), (32767, 255), (0, 128)], "a int, b int")
    got = [(round(r.a, 4), round(r.b, 4)) for r in df.select(M.scale_pcm(F.col("a"), "int16").alias("a"), M.scale_pcm(F.col("b"), "uint8").alias("b")).collect()]
    assert got == [(-1.0, -1.0), (1.0, 0.9922), (0.0, 0.0)]
