"""The cut taken from all pair similarities against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.operators import joins as J
from mediasift.operators import pairs as P

SCHEMA = "k string, i long, v array<double>, extra int"


def plain(rows, gap, least, most, fixed, min_span, min_pairs, min_hits):
    out = {}
    for k in {r[0] for r in rows}:
        w = sorted((r[1], np.array(r[2]) / np.linalg.norm(r[2])) for r in rows if r[0] == k and r[1] is not None and r[2] is not None and np.linalg.norm(r[2]) > 0)
        if not w:
            continue
        s = np.array([a @ b for x, (i, a) in enumerate(w) for j, b in w[x + 1 :] if j - i > gap])
        if not len(s):
            out[k] = (len(w), 0, None, None, fixed, 0, False)
            continue
        md = np.median(s)
        mad = np.median(abs(s - md))
        cut = min(most, max(least, md + 3.5 * 1.4826 * mad)) if w[-1][0] - w[0][0] >= min_span and len(s) >= min_pairs else fixed
        out[k] = (len(w), len(s), md, mad, cut, int((s >= cut).sum()), bool((s >= cut).sum() >= min_hits))
    return out


@pytest.mark.parametrize("rows_per_block", [7, 16, 1024])
def test_cut_from_the_assets_own_pairs(spark, rows_per_block):
    rng = np.random.default_rng(2)
    rows = []
    base = rng.normal(size=(120, 8))
    base[90:95] = base[10:15] + 0.01  # a copied passage
    rows += [("long", int(i), list(map(float, v)), 1) for i, v in enumerate(base)]
    rows += [("short", int(i), list(map(float, v)), 1) for i, v in enumerate(rng.normal(size=(30, 8)))]
    rows += [("same", int(i), [1.0, 2.0, 0.0, 0.0], 1) for i in range(80)]  # ties everywhere
    rows += [(None, int(3 * i), list(map(float, v)), 1) for i, v in enumerate(rng.normal(size=(41, 4)))]
    rows += [("one", 5, [1.0, 0.0], 1), ("none", 1, [0.0, 0.0], 1), ("long", None, [1.0] * 8, 1), ("long", 500, None, 1)]
    args = dict(gap=5, least=0.5, most=0.97, fixed=0.9, min_span=60, min_pairs=20, min_hits=3)
    got = {r.k: r for r in P.repeats_adaptive(spark.createDataFrame(rows, SCHEMA), ["k"], "i", "v", rows=rows_per_block, **args).collect()}
    want = plain(rows, **args)
    assert set(got) == set(want)
    for k, (n, pairs, md, mad, cut, hits, flag) in want.items():
        r = got[k]
        assert (r.n, r.n_pairs, r.n_hits, r.flagged) == (n, pairs, hits, flag), k
        assert r.cut == pytest.approx(cut, abs=1e-7) and (md is None) == (r.median is None)
        if md is not None:
            assert r.median == pytest.approx(md, abs=2e-9) and r.mad == pytest.approx(mad, abs=4e-9)
    assert got["long"].flagged and got["long"].n_hits < 200 and got["same"].n_pairs == 75 * 74 // 2


def test_empty(spark):
    assert P.repeats_adaptive(spark.createDataFrame([], SCHEMA), ["k"], "i", "v").count() == 0


def test_blocks_of_an_asset_are_bounded(spark):
    # positions far apart once gave each block of positions a copy of every other one
    rows = [("k", 1000 * i, [float(i % 7), 1.0, float(i % 5)], 1) for i in range(400)]
    b = P.dealt(spark.createDataFrame(rows, SCHEMA), ["k"], "v", F.col("i"), 10)
    assert {r._g for r in b.collect()} == {16} and P.pair_groups(b, ["k"]).count().count() == 16 * 17 // 2
    assert {r._g for r in P.dealt(spark.createDataFrame(rows, SCHEMA), ["k"], "v", F.col("i")).collect()} == {1}


def _vectors(seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(150, 6))
    v[41] = v[3]  # twins
    v[[60, 61, 90]] = v[7]  # four of a kind
    v[100] = v[11] + 1e-9  # all but equal
    return v, [(i % 2, 3 * i, [float(x) for x in r]) for i, r in enumerate(v)]


@pytest.mark.parametrize("block", [9, 40, 8192])
def test_nearest_two_in_blocks(spark, block):
    v, rows = _vectors(5)
    rows += [(2, 1, [0.0] * 6), (2, 2, [1.0] * 6), (0, 901, [1.0, None] * 3), (0, 902, [float("nan")] * 6), (0, 903, None), (2, 9, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "k int, id bigint, v array<double>")
    want = {}
    for i in range(150):
        d = sorted((float(np.linalg.norm(v[i] - v[j])), 3 * j) for j in range(150) if j != i and j % 2 == i % 2)
        if d[0][0] < 0.8 * d[1][0]:
            want[3 * i] = (d[0][1], pytest.approx(d[0][0], abs=1e-12), pytest.approx(d[1][0], abs=1e-12))
    got = {r.id: (r.match, r.d1, r.d2) for r in J.knn_ratio(df, ["k"], "id", "v", ratio=0.8, rows=block).collect()}
    assert got == want and (9, 123) in {(k, m) for k, (m, *_) in got.items()}


@pytest.mark.parametrize("block", [9, 40, 8192])
def test_alike_pairs_in_blocks(spark, block):
    v, rows = _vectors(6)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    got = {r.k: r for r in J.repeat_summary(spark.createDataFrame(rows, "k int, id bigint, v array<double>"), ["k"], "id", "v", cut=0.3, gap=14, rows=block).collect()}
    for k in (0, 1):
        c = [u[i] @ u[j] for i in range(k, 150, 2) for j in range(i + 2, 150, 2) if 3 * (j - i) > 14]
        hit = [x for x in c if x >= 0.3]
        assert (got[k].n, got[k].n_pairs, got[k].flagged) == (75, len(hit), True) and got[k].max_cosine == pytest.approx(max(hit), abs=1e-12)


@pytest.mark.parametrize("call", [lambda d: J.repeat_summary(d, ["k"], "id", "v"), lambda d: J.knn_ratio(d, ["k"], "id", "v")])
def test_vectors_are_not_joined_by_cells(spark, call):
    # every pair inside a neighbourhood was a join row
    plan = call(spark.createDataFrame([(1, i, [1.0, float(i), 0.5]) for i in range(20)], "k int, id bigint, v array<double>"))._jdf.queryExecution().optimizedPlan().toString()
    assert "_c0#" not in plan
