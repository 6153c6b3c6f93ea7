"""Outputs of survey rows A15, A16, A31, W16 and W18 against plain answers."""

import numpy as np
from pyspark.sql import functions as F

from mediasift.operators import joins as J
from mediasift.operators import series as W
from mediasift.operators import stats as A


def test_highlights_and_shadow(spark):
    # frame 1: two of four pixels are highlights, frame 2: none (one bright pixel is saturated)
    rows = [(1, 1, i, float(v), float(s)) for i, (v, s) in enumerate([(230, 0), (250, 10), (5, 0), (100, 0)])]
    rows += [(1, 2, i, float(v), float(s)) for i, (v, s) in enumerate([(230, 90), (50, 0), (7, 0), (100, 0)])]
    df = spark.createDataFrame(rows, "k int, f int, cell int, v double, s double")
    h = A.highlight_scores(df, ["k"], "f", "v", "s").first()
    assert h.highlight_ratio == 0.25 and abs(h.area_cv - 1) < 1e-4 and h.intensity_cv == 0 and abs(h.distribution_score - 0.7) < 1e-4 and h.intensity_score == 0
    s = A.shadow_coverage(df, ["k"], "f", "cell", "v").first()
    assert s.shadow_ratio == 0.25 and abs(s.shadow_cv - 3**0.5) < 1e-4 and s.n_regions == 0  # always cell 2


def test_noise_level(spark):
    x = np.random.default_rng(2).random((8, 8))
    e = np.pad(x, 1, mode="reflect")
    want = np.clip(9 * x - sum(e[a : a + 8, b : b + 8] for a in range(3) for b in range(3)), 0, 1).std()
    got = A.frame_metrics(spark.createDataFrame([(1, 1, x.ravel().tolist())], "k int, t int, px array<double>"), ["k"], ["t"], "px").first()
    assert abs(got.noise - want) < 1e-12


def test_residual_rate(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4), (1, None), (2, 0.9), (2, 0.1), (2, 0.9), (2, 0.9), (3, None), (4, 0.8)], "k int, r double")
    got = {r.k: (r.n_pairs, r.residual_rate, r.severity) for r in A.residual_rate(df, ["k"], "r").collect()}
    assert got == {1: (2, 0.5, "high"), 2: (4, 0.25, "medium"), 4: (1, 0.0, None)}


def test_threshold_modes(spark):
    df = spark.createDataFrame([(1, 0.8, 0.4), (1, 0.6, 0.6), (2, None, None)], "k int, s double, d double")
    got = {(r.k, r.mode): tuple(round(v, 6) for v in r[2:]) for r in W.threshold_modes(df, ["k"], "s", "d").collect()}
    assert got[1, "standard"] == (0.55, 0.65, 0.98, 2.5) and got[1, "deep_scan"] == (0.62, 0.58, 0.95, 1.5)
    assert got[2, "standard"] == (0.65, 0.75, 0.98, 2.5) and got[2, "high_sensitivity"] == (0.75, 0.65, 0.96, 2.0) and len(got) == 6


def test_block_consistency(spark):
    g = np.random.default_rng(1)
    part = g.normal(size=(2, 2))
    x = np.tile(part, (4, 4))
    x[2:4, 4:6] = -part  # block (1, 2) comes from elsewhere
    df = spark.createDataFrame([(1, (x + 0.01 * g.normal(size=x.shape)).ravel().tolist()) for _ in range(12)] + [(2, x.ravel().tolist())] * 9, "k int, v array<double>")
    got = J.block_consistency(df, ["k"], "v", 8, min_block=2).collect()
    assert [r.block for r in got if r.anomalous] == [6] and sorted(r.block for r in got) == list(range(16)) and {r.k for r in got} == {1}
    assert J.block_consistency(df, ["k"], "v", 8).collect() == []  # blocks of two rows are below the default
