"""All detectors in one pass: errors stay with their asset and detector, scores by hand, one exchange."""

import pytest
from pyspark.sql import functions as F

from mediasift.plans import detector_set as D


def test_errors_stay_where_they_are(spark):
    rows = [(1, float(i), str(10.0 + i % 2)) for i in range(10)] + [(2, float(i), "5") for i in range(3)] + [(3, float(i), "bad") for i in range(10)]
    d = spark.createDataFrame(rows, "k int, t double, x string")
    use = [D.SPECS[n] for n in ("audio_reverberation", "audio_voice", "video_compression")]
    out = D.run_all(d, ["k"], ["t"], {n: F.col("x") for n in ("flatness", "sub_bass", "frame_size", "block_score", "gop")}, use, split=False)
    got = {(r.k, r.module): r for r in out.collect()}
    assert len(got) == 9 and {got[k, "voice"].error for k in (1, 2, 3)} == {"not bound"}
    assert got[2, "reverberation"].error == "too few rows" and got[3, "compression"].error == "no value of frame_size"
    ok = got[1, "reverberation"]
    # 10 and 11 in turn: variation 0.5 / 10.5 is over 0.015, every step is the mean step
    assert ok.error is None and [f.type for f in ok.findings] == ["flatness"] and ok.score == pytest.approx(0.18) and ok.confidence == pytest.approx(0.49)
    assert got[3, "reverberation"].skipped and got[3, "reverberation"].score == 0 and got[3, "reverberation"].findings == []
    video = got[1, "compression"]
    # block scores are over 1 and clamp; step 1 gives no bitrate score; variation of gop is 0.5 / 10.5
    assert video.score == pytest.approx(0.40 + 0.25 * 0.5 / 10.5)


def test_twelve_detectors_take_one_exchange(spark):
    d = spark.createDataFrame([(1, float(i), float(i * i % 7)) for i in range(40)], "k int, t double, x double")
    measures = {n: F.col("x") for s in D.SPECS.values() for n in s.needs}
    out = D.run_all(d, ["k"], ["t"], measures, split=False)
    assert len(D.SPECS) == 12 and out.count() == 12
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert D.run_all(d.limit(0), ["k"], ["t"], measures, split=False).collect() == []
