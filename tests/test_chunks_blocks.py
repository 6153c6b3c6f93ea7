"""Signals in chunks and frames in blocks against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mediasift.operators import blocks as B
from mediasift.operators import chunks as C

SCHEMA = "k long, start long, samples array<double>"


def cut(k, x, sizes):
    rows, at = [], 0
    for n in sizes:
        rows.append((k, at, [float(v) for v in x[at : at + n]]))
        at += n
    return rows


@pytest.mark.parametrize("tile", [7, 40, 1000])
def test_windows_cross_chunks_and_stop_at_holes(spark, tile):
    x = np.arange(1, 101, dtype=float)
    rows = cut(1, x, [3, 1, 20, 40, 36]) + cut(2, x, [30]) + [(2, 37, [float(v) for v in x[37:90]])] + [(3, 0, []), (4, 0, None), (None, 0, list(map(float, x[:12])))]
    got = {(r.k, r.win): r.samples for r in C.chunk_frames(spark.createDataFrame(rows, SCHEMA), ["k"], "start", "samples", 10, 4, tile).collect()}
    want = {(1, w): list(x[4 * w : 4 * w + 10]) for w in range(23)}
    want |= {(2, w): list(x[4 * w : 4 * w + 10]) for w in range(23) if 4 * w + 10 <= 30 or (4 * w >= 37 and 4 * w + 10 <= 90)}
    want |= {(None, 0): list(x[:10])}
    assert got == want


def test_windows_with_gaps_between_hops(spark):
    x = np.arange(50, dtype=float)
    got = {r.win: r.samples for r in C.chunk_frames(spark.createDataFrame(cut(1, x, [11, 39]), SCHEMA), ["k"], "start", "samples", 3, 8, 16).collect()}
    assert got == {w: list(x[8 * w : 8 * w + 3]) for w in range(6)}


def test_null_samples_are_zero_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, [1.0, None]), (1, 2, [3.0, 4.0])], SCHEMA)
    assert [r.samples for r in C.chunk_frames(df, ["k"], "start", "samples", 4, 4).collect()] == [[1.0, 0.0, 3.0, 4.0]]
    none = df.limit(0)
    assert C.chunk_frames(none, ["k"], "start", "samples", 4, 4).count() == 0
    assert C.pause_model(none, ["k"], "start", "samples", 8.0, 4).count() == 0
    assert C.mains_band(none, ["k"], "start", "samples", 400.0, seconds=0.5).count() == 0


def test_mixed_channels(spark):
    df = spark.createDataFrame([(1, 0, 0, [1.0, 2.0, 3.0]), (1, 1, 0, [3.0, 2.0]), (1, 0, 1, [5.0]), (1, 1, 1, None)], "k long, ch int, chunk int, x array<double>")
    rows = {r.chunk: r for r in C.mix_chunks(df, ["k"], "ch", "chunk", "x").collect()}
    assert rows[0].mono == [2.0, 2.0, 3.0] and rows[0].spread == [2.0, 0.0, 0.0] and rows[1].mono == [5.0]
    r = C.chunk_identity(C.mix_chunks(df, ["k"], "ch", "chunk", "x"), ["k"]).first()
    assert (r.n_samples, r.mean, r.identical) == (4, 3.0, False)


def test_pause_against_the_assets_own_pauses(spark):
    # frames of 4 samples at 8 a second: half a second each; 1 = speech, 0 = silence
    def signal(level, plan):
        return [level if c == "1" else 0.0 for c in plan for _ in range(4)]
    short = "110110110" + "1" + "0" * 8 + "1"  # three pauses of 0.5 s, one of 4 s
    slow = "1000010000100001" + "0" * 8 + "1"  # pauses of 2 s, the last of 4 s stays under 4 x 2 s
    rows = cut(1, signal(1.0, short), [10] * 9) + cut(2, signal(0.2, slow), [13] * 9) + cut(3, signal(1.0, "111"), [12])
    got = {r.k: r for r in C.pause_model(spark.createDataFrame(rows, SCHEMA), ["k"], "start", "samples", 8.0, 4).collect()}
    assert (got[1].n_pauses, got[1].median_pause, got[1].pause_limit, got[1].n_anomalous, got[1].longest_pause) == (4, 0.5, 3.5, 1, 4.0)
    assert (got[2].n_pauses, got[2].median_pause, got[2].pause_limit, got[2].n_anomalous) == (4, 2.0, 8.0, 0)
    assert (got[3].n_pauses, got[3].median_pause, got[3].n_anomalous) == (0, None, 0)


def test_mains_band_doesnt_depend_on_the_chunks(spark):
    sr, n = 400.0, 4000
    t = np.arange(n) / sr
    noise = np.random.default_rng(5).normal(size=n) * 0.3
    hum, harm = 0.5 * np.sin(2 * math.pi * 50 * t), 0.5 * np.sin(2 * math.pi * 100 * t)
    rows = cut(1, hum + noise, [n]) + cut(2, hum + noise, [1, 700, 63, 1500, 1736]) + cut(3, harm + noise, [250] * 16) + cut(4, np.zeros(n), [n])
    got = {r.k: r for r in C.mains_band(spark.createDataFrame(rows, SCHEMA), ["k"], "start", "samples", sr, 50, seconds=2.0).collect()}
    a, b = got[1], got[2]
    assert a.n_samples == b.n_samples == n and a.n_segments == b.n_segments == 5
    assert abs(a.fundamental_power - b.fundamental_power) < 1e-12 and abs(a.fundamental_db - b.fundamental_db) < 1e-9
    # by the FFT of each segment of 800 samples
    p = sum(2 * abs(np.fft.rfft((hum + noise)[i : i + 800])[98:103]) ** 2 / 800 for i in range(0, n, 800)).sum() / n
    assert abs(a.fundamental_power - p) < 1e-9 and abs(p - 0.125) < 0.02
    assert a.present and not a.harmonic_only and got[3].harmonic_only and not got[3].present
    assert got[4].fundamental_db == 0.0 and got[4].fundamental_power == 0.0


def plain_frame(x, side, top=1.0):
    m = np.pad(x, 1, mode="reflect")
    h, w = x.shape
    sh = lambda dy, dx: m[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    lap = sh(-1, 0) + sh(1, 0) + sh(0, -1) + sh(0, 1) - 4 * x
    gx = sum(k * (sh(d, 1) - sh(d, -1)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    gy = sum(k * (sh(1, d) - sh(-1, d)) for d, k in ((-1, 1), (0, 2), (1, 1)))
    hp = np.clip(9 * x - sum(sh(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)), 0, top)
    res = np.array([[x[i, j] - x[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2].mean() for j in range(w)] for i in range(h)])
    on, off = [], []
    for i in range(h):
        for j in range(w):
            if j + 1 < w:
                (on if (j + 1) % 8 == 0 else off).append(abs(x[i, j + 1] - x[i, j]))
            if i + 1 < h:
                (on if (i + 1) % 8 == 0 else off).append(abs(x[i + 1, j] - x[i, j]))
    ratio = None if not on else np.mean(on) / np.mean(off)
    return dict(brightness=x.mean(), contrast=x.std(), sharpness=lap.var(), blockiness=np.abs(gx).mean() + np.abs(gy).mean(), noise=hp.std(), residual_var=res.var(), residual_mean=np.abs(res).mean(), boundary_ratio=ratio)


@pytest.mark.parametrize("side", [4, 8])
def test_frames_of_several_blocks(spark, side):
    rng = np.random.default_rng(1)
    frames = {(a, f): rng.random((3 * side, 2 * side)) for a in (1, None) for f in (0, 1, 3)}
    rows = [(a, f, y, x, p[y * side : y * side + side, x * side : x * side + side].ravel().tolist()) for (a, f), p in frames.items() for y in range(3) for x in range(2)]
    df = spark.createDataFrame(rows, "a long, f long, y long, x long, px array<double>")
    got = {(r.a, r.f): r for r in B.frame_rollup(df, ["a"], "f", "y", "x", "px", side).collect()}
    assert set(got) == set(frames)
    for k, p in frames.items():
        for name, want in plain_frame(p, side).items():
            assert got[k][name] == pytest.approx(want, abs=1e-9), (k, name)
        q = frames.get((k[0], k[1] + 1))
        if q is None:
            assert got[k].ssim is None
        else:
            ma, mb, cv = p.mean(), q.mean(), ((p - p.mean()) * (q - q.mean())).mean()
            assert got[k].ssim == pytest.approx((2 * ma * mb + 1e-4) * (2 * cv + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (p.var() + q.var() + 9e-4)), abs=1e-9)
    assert B.frame_rollup(df.limit(0), ["a"], "f", "y", "x", "px", side).count() == 0


@pytest.mark.parametrize("name", ["q_spectrum", "q_normalise_signal", "q_residual_var", "q_pause_model", "q_frame_rollup"])
def test_no_samples_or_pixels_in_shuffles(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # an explode by sample or pixel could only be a posexplode; that of the spectrum comes after the last shuffle
    lines = plan.splitlines()
    pos = [i for i, s in enumerate(lines) if "posexplode" in s]
    agg = [i for i, s in enumerate(lines) if s.lstrip(" :+-|").startswith("Aggregate")]
    assert not pos or (agg and pos[-1] < agg[0])


def test_windows_leave_the_tile_behind(spark):
    # no row that is made for a window carries the samples of its tile
    x = np.random.default_rng(4).normal(size=70_000)
    f = C.chunk_frames(spark.createDataFrame(cut(1, x, list(range(50, 70_000, 50))), SCHEMA), ["k"], "start", "samples", 16, 16)
    plan = f._jdf.queryExecution().executedPlan().toString()
    made = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(made) == 2 and "_x#" not in made[0].split("), [")[-1]
    got = {r.win: r.samples for r in f.collect()}
    assert len(got) == 4375 and all(got[w] == list(x[w * 16 : w * 16 + 16]) for w in (0, 1, 4095, 4096, 4374))
