"""Fusion against hand-computed cases."""

import pytest

from mediasift.config import Settings, settings_table
from mediasift.plans import fusion as FU
from mediasift.plans import results as RS
from mediasift.plans.detectors import run_detectors
from pyspark.sql import functions as F

A = "case_id string, module string, score double, confidence double, skipped boolean, snr_db double, enf_present boolean"


def audio(spark, rows):
    full = [("c", m, s, c, sk, snr, None) for m, s, c, sk, snr in rows]
    return FU.fuse_audio(spark.createDataFrame(full, A), ["case_id"]).first()


def test_all_skipped_is_null_result(spark):
    r = audio(spark, [("enf", 0.9, 0.9, True, None), ("noise", 0.9, 0.9, True, None)])
    assert (r.fused, r.confidence, r.verdict, r.n_elevated, r.note) == (0.0, 0.30, "inconclusive", 0, "no usable scores")


def test_only_unmeasurable_mains_is_null_result(spark):
    assert audio(spark, [("enf", 0.1, 0.9, False, -5.0)]).note == "no usable scores"


def test_mains_weight_moves_to_others(spark):
    r = audio(spark, [("enf", 0.1, 0.2, False, 0.0), ("noise", 0.3, 0.6, False, None), ("compression", 0.1, 0.6, False, None)])
    assert not r.enf_present and r.base_score == pytest.approx((0.3 * 0.22 + 0.1 * 0.18) / 0.40)
    assert r.confidence == pytest.approx(0.6)


def test_high_mains_score_counts_as_present(spark):
    r = audio(spark, [("enf", 0.70, 0.6, False, -5.0), ("noise", 0.0, 0.6, False, None)])
    base = 0.70 * 0.30 / 0.52
    assert r.enf_present and r.base_score == pytest.approx(base)
    assert r.fused == pytest.approx(max(base, 0.70 * 0.62)) and r.conflict == "sole_supporter"


def test_metadata_alone_has_no_say(spark):
    r = audio(spark, [("noise", 0.1, 0.6, False, None), ("metadata", 0.95, 0.6, False, None)])
    assert r.base_score == pytest.approx(0.1 * 0.22 / 0.30) and r.elevated_modules == "" and r.verdict == "likely_authentic"


def test_metadata_is_capped_when_corroborating(spark):
    r = audio(spark, [("noise", 0.5, 0.6, False, None), ("metadata", 0.95, 0.6, False, None)])
    assert r.base_score == pytest.approx((0.5 * 0.22 + 0.25 * 0.08) / 0.30) and r.n_elevated == 1


def test_corroboration_and_agreement(spark):
    r = audio(spark, [("enf", 0.5, 0.8, False, 10.0), ("noise", 0.5, 0.8, False, None), ("voice", 0.5, 0.8, False, None)])
    assert r.corroboration == pytest.approx(1.17) and r.fused == pytest.approx(0.585)
    assert r.confidence == pytest.approx(min(0.92, 0.8 * 1.15)) and r.elevated_modules == "enf,noise,voice"


def test_low_confidence_conflict(spark):
    r = audio(spark, [("noise", 0.6, 0.4, False, None), ("voice", 0.6, 0.4, False, None)])
    assert r.conflict == "low_confidence"


def test_unknown_module_can_escalate_after_redistribution(spark):
    # 0.05 * (1 + 0.30 / 0.27) passes the weight bar of 0.08
    r = audio(spark, [("enf", 0.0, 0.5, False, -5.0), ("noise", 0.0, 0.5, False, None), ("custom", 0.9, 0.5, False, None)])
    assert r.fused == pytest.approx(0.9 * 0.62)


V = "case_id string, module string, score double, uncertainty double, reliable boolean"


def test_video_fusion_by_hand(spark):
    rows = [("c", "noise", 0.6, 0.09, True), ("c", "temporal", 0.4, 0.19, True), ("c", "audio", 0.1, 0.09, False), ("c", "other", 1.0, 0.5, True)]
    r = FU.fuse_video(spark.createDataFrame(rows, V), ["case_id"]).first()
    w = [0.25 / 0.10, 0.20 / 0.20, 0.10 / 0.10 * 0.5]
    base = (0.6 * w[0] + 0.4 * w[1] + 0.1 * w[2]) / sum(w)
    assert r.base_score == pytest.approx(base) and r.multiplier == 1.5 and r.fused == pytest.approx(min(1.0, base * 1.5))
    assert r.n_elevated == 3 and not r.has_conflict and r.unreliable_modules == "audio"


def test_video_conflict(spark):
    rows = [("c", "noise", 0.7, 0.1, True), ("c", "temporal", 0.05, 0.1, True)]
    r = FU.fuse_video(spark.createDataFrame(rows, V), ["case_id"]).first()
    assert r.has_conflict
    kinds = {x.type for x in FU.fusion_findings(FU.fuse_video(spark.createDataFrame(rows, V), ["case_id"]), ["case_id"]).collect()}
    assert kinds == {"verdict", "partial_domain"}


def test_failed_modules_fold(spark):
    s = spark.createDataFrame([("c", "noise", 0.9, 0.1, True, "failed"), ("c", "audio", 0.4, 0.1, True, "completed")], V + ", status string")
    got = {r.module: (r.score, r.uncertainty, r.reliable, r.status) for r in FU.complete_modules(s, s, ["case_id"], list(FU.VIDEO_WEIGHTS)).collect()}
    assert len(got) == 6 and got["noise"] == (0.0, 0.5, False, "failed") and got["audio"] == (0.4, 0.1, True, "completed") and got["temporal"][3] == "skipped"


def test_published_image_example(spark):
    """Likelihood 17 and confidence "High": score 17, low band, confidence 0.9, missing EXIF elevated."""
    df = spark.createDataFrame([("x", 17.0, "High", 2.0, 1.0, 0.0, "Low", 0, None, None)], "id string, likelihood double, conf string, ela double, noise double, clone double, jpeg string, n_exif int, crop double, shot double")
    c = F.col
    el = RS.image_elevated(c("ela"), c("noise"), c("clone"), c("jpeg"), c("n_exif"), c("crop"), c("shot"))
    r = RS.unify(df, ["id"], "image", c("likelihood") / 100, RS.confidence_word(c("conf")), el, F.lit(7)).first()
    assert (r.risk_score, r.risk_band, r.measurement_confidence, r.elevated, r.verdict) == (17, "low", 0.9, "exif_metadata", None)


@pytest.mark.parametrize("score,band", [(0, "low"), (39, "low"), (40, "elevated"), (74, "elevated"), (75, "high"), (100, "high")])
def test_bands(spark, score, band):
    assert spark.range(1).select(RS.risk_band(F.lit(score)).alias("b")).first().b == band


def test_generated_text_has_no_banned_words(spark):
    arr = F.array(*[F.lit(d) for d in RS.DISPLAY])
    df = spark.range(1).select("id", F.concat_ws(" ", RS.summary_text(arr, F.lit(9), F.lit(2)), *[RS.meaning_text(F.lit(b), arr) for b in RS.RISK_BANDS]).alias("t"))
    assert RS.banned_words(df, ["id"], "t").count() == 0
    bad = spark.createDataFrame([(1, "This is Genuine."), (2, "really unrealistic")], "id int, t string")
    assert [(r.id, r.word) for r in RS.banned_words(bad, ["id"], "t").collect()] == [(1, "genuine")]


def test_detectors_find_a_known_change(spark):
    rows = [("steady", t * 0.25, t, 1.0 + 0.001 * (t % 3)) for t in range(40)] + [("jump", t * 0.25, t, (1.0 if t < 20 else 3.0) + 0.001 * (t % 3)) for t in range(40)] + [("short", 0.0, 0, 1.0)]
    s = spark.createDataFrame(rows, "k string, t double, tie bigint, x double")
    scores, found = run_detectors(s, ["k"])
    got = {(r.k, r.module): r for r in scores.collect()}
    assert got["jump", "noise"].score > 0.6 and got["steady", "noise"].score == 0.0
    assert got["short", "noise"].skipped and not got["jump", "noise"].skipped
    assert {r.k for r in found.collect()} == {"jump"}
    fused = {r.k: r for r in FU.fuse_audio(scores, ["k"]).collect()}
    assert fused["jump"].fused > fused["steady"].fused and fused["short"].note == "no usable scores"


def test_settings(spark):
    s = Settings.from_env({"MEDIASIFT_CHANGE_Z": "5.5", "MEDIASIFT_CHANGE_PERSIST": "x", "MEDIASIFT_ENF_GRID": "60"})
    assert (s.change_z, s.change_persist, s.enf_grid) == (5.5, 3, 60)
    assert settings_table(spark, s).filter("name = 'change_z'").first().value == 5.5
    assert s.with_run(spark.range(1), "r1").first().settings["change_z"] == 5.5
