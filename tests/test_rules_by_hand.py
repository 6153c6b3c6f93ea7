"""Rules worked out by hand on a few rows, apart from the operators' own constants."""

import pytest
from pyspark.sql import functions as F

from mediasift.operators import joins as J
from mediasift.operators import rules as P
from mediasift.operators import scores as X
from mediasift.operators import series as W
from mediasift.operators import stats as A
from mediasift.operators.graph import components
from mediasift.plans import results as RS
from mediasift.sources import records as S


def test_compression_has_no_bonus_for_high(spark):
    d = spark.createDataFrame([(1, "compression", 0.5, 2.0, "high"), (1, "noise", 0.5, 1.0, "high"), (1, "enf", 0.4, 1.0, "low")], "k int, m string, s double, w double, sev string")
    got = {r.m: (round(r.score, 6), round(r.confidence, 6)) for r in A.module_score(d, ["k"], "m", "s", "w", "sev", F.lit(False)).collect()}
    assert got == {"compression": (0.5, 0.54), "noise": (0.6, 0.53), "enf": (0.4, round(0.58 * 0.35, 6))}


def test_grid_variance_is_taken_per_frame(spark):
    # each cell's variance differs per frame only by level, so pooling frames would hide the cells' differences
    rows = [(1, f, c, 1000.0 * f + s * (1 + c)) for f in (0, 1) for c in range(4) for s in (-1.0, 1.0)]
    got = A.grid_anomaly(spark.createDataFrame(rows, "k int, f int, c int, x double"), ["k"], "f", ["c"], "x").first()
    v = [1.0, 4.0, 9.0, 16.0]
    mean = sum(v) / 4
    std = (sum((a - mean) ** 2 for a in v) / 4) ** 0.5
    assert got.cv_variance == pytest.approx(std / (mean + 1e-6)) and got.variance_score == pytest.approx(min(1, (std / mean - 0.3) / 0.6), abs=1e-5)


def test_success_overrides_failure(spark):
    ev = [(1, "PENDING", 0.0), (1, "STARTED", 1.0), (1, "FAILURE", 2.0), (1, "SUCCESS", 3.0), (2, "SUCCESS", 1.0), (2, "FAILURE", 2.0), (3, "STARTED", 1.0), (3, "PENDING", 2.0), (4, "FAILURE", 5.0)]
    got = {r.k: (r.status, r.finished_at) for r in RS.job_status(spark.createDataFrame(ev, "k int, s string, t double"), ["k"], "s", "t", "t").collect()}
    assert got == {1: ("completed", 3.0), 2: ("completed", 1.0), 3: ("running", None), 4: ("failed", 5.0)}


def test_screenshot_without_exif_keeps_dpi_signal(spark):
    sch = "k int, software string, format string, width int, height int, dpi_x int, dpi_y int, tags array<int>, sharpness double"
    got = {r.k: r for r in P.screenshot(spark.createDataFrame([(1, None, "JPEG", 10, 10, 96, 96, None, 1.0), (2, None, "JPEG", 10, 10, 96, 96, [], 1.0)], sch), ["k"]).collect()}
    assert got[1].score == got[2].score and "screen_dpi" in got[1].signals


def test_stripped_tags_of_both_mp3_names(spark):
    sch = "k int, container string, codec string, encoder string, creation_time string, modified_at timestamp, max_freq double, sample_rate int, bitrate_bps int, size_bytes double, duration_s double, n_samples bigint, wav_rate int, has_tags boolean"
    rows = [(i, "mp3", c, "", None, None, None, 44100, 0, 1.0, 10.0, 160000, 16000, False) for i, c in enumerate(("mp3", "mp3float", "aac"))]
    got = [(r.k, r.confidence) for r in P.audio_metadata(spark.createDataFrame(rows, sch), ["k"]).filter("type = 'stripped_tags'").collect()]
    assert sorted(got) == [(0, 0.58), (1, 0.58)]


LOW = "k int, steepness double, total_drop double, cutoff double, ceiling_hz double, n_segments int, ceiling_cv double, uncompressed boolean, lossy boolean, bitrate_kbps double, nyquist double"


def test_lowpass_rules(spark):
    rows = [(1, 25.0, 20.0, 6000.0, None, 9, 0.2, True, False, 0.0, 8000.0), (2, 5.0, 1.0, 5000.0, 20000.0, 9, 0.2, False, True, 128.0, 8000.0), (3, 25.0, 20.0, 7000.0, None, 9, 0.2, False, False, 0.0, 8000.0)]
    got = {(r.k, r.type): (r.severity, r.confidence, round(r.score, 6)) for r in X.lowpass_checks(spark.createDataFrame(rows, LOW), ["k"]).collect()}
    deficit = (7840 - 5000) / 7840 * 100
    assert got == {(1, "lowpass"): ("high", 0.88, 0.55), (1, "moving_ceiling"): ("medium", 0.65, 0.4), (2, "expectation"): ("medium", 0.65, round(min(0.6, 0.3 + deficit / 200), 6))}


def test_steepest_drop_by_quarter_means(spark):
    db = [0.0] * 60 + [-40.0] * 40
    d = spark.createDataFrame([(1, float(i), v) for i, v in enumerate(db)], "k int, f double, db double")
    r = W.steepest_drop(d, ["k"], "f", "db", 8, 100.0).first()
    # the first bin whose window ends wholly below the edge: i + 6 = 60, quarter span 2
    assert (r.steepness, r.cutoff, r.total_drop) == (80.0, 56.0, 40.0)


def test_mains_confidences(spark):
    sch = "k int, n_frames int, discontinuity double, freq_std double, enf_present boolean, snr_fund double, snr_harm double"
    got = {(r.k, r.type): (r.confidence, r.score) for r in X.enf_checks(spark.createDataFrame([(1, 9, 3.0, 0.0, True, 0.0, 0.0), (2, 9, 3.0, 0.0, False, -5.0, 0.0)], sch), ["k"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, "phase"): 0.65, (2, "phase"): 0.38, (2, "harmonic_only"): 0.45, (2, "absent"): 0.90} and got[(2, "absent")][1] is None


def test_signal_type_votes(spark):
    d = spark.createDataFrame([(1, 0.3, 0.1, 0.5), (1, 0.3, 3.0, 0.5), (2, 0.01, 1.0, 0.001), (2, 0.01, 1.0, 0.001), (3, 0.3, 1.0, 0.5)], "k int, z double, r double, h double")
    assert {r.k: r.kind for r in A.signal_type(d, ["k"], "z", "r", "h").collect()} == {1: "music", 2: "phone_speech", 3: "speech"}


def test_baseline_cap_never_drops_flagged(spark):
    d = spark.createDataFrame([(1, float(i), i) for i in range(100)], "k int, t double, tie int")
    out = J.flagged_plus_baseline(d, d.filter("tie < 40"), ["k"], "t", "tie", 0.10, baseline_cap=3).collect()
    assert sum(r.origin == "flagged" for r in out) == 40 and [r.n_left_out for r in out if r.origin == "baseline"] == [7] * 3


def test_components_of_a_long_chain_and_a_hub(spark):
    rows = [(0, i, i + 1) for i in range(60)] + [(1, 500, i) for i in range(1, 80)]
    got = {(r.g, r.node): r.component for r in components(spark.createDataFrame(rows, "g int, a int, b int"), ["g"], "a", "b").collect()}
    assert {got[0, i] for i in range(61)} == {0} and {got[1, i] for i in [*range(1, 80), 500]} == {1}


def test_case_store_is_safe_to_repeat(spark, tmp_path):
    t = {n: spark.createDataFrame([("c", "x", "2024-01-01")], f"{k[0]} string, {(k + ('other',))[1]} string, ingest_date string") for n, k in S.CASE_TABLES.items()}
    for _ in range(2):
        S.write_case_tables(t, str(tmp_path / "s"))
    assert {n: d.count() for n, d in S.read_case_tables(spark, str(tmp_path / "s")).items()} == dict.fromkeys(S.CASE_TABLES, 1)


def test_pitch_change_lies_inside_the_duration(spark):
    sch = "k int, f0_ratio double, f0_max_z double, f0_cv double, change_t double, duration double"
    rows = [(1, 1.7, None, None, None, 10.0), (2, 1.7, None, None, 0.4, 10.0), (3, 1.0, 7.0, 0.0, 9.5, 10.0), (4, 1.0, 7.0, 0.0, 9.5, None)]
    got = {r.k: (r.start_s, r.end_s) for r in X.pitch_checks(spark.createDataFrame(rows, sch), ["k"]).collect()}
    assert got == {1: (None, None), 2: (0.0, 1.4), 3: (8.5, 10.0), 4: (8.5, 10.5)}


def test_frame_deviation_needs_thirty_frames(spark):
    rows = [(n, float(i), i, 0.0 if i < n // 2 else 100.0) for n in (29, 30) for i in range(n)]
    got = W.frame_deviation(spark.createDataFrame(rows, "k int, t double, i int, x double"), ["k"], ["t", "i"], "x", sigma=0.5).collect()
    assert [r.k for r in got] == [30]
