"""Encoder strings, duplication, report tables and case record by hand."""

import json

from pyspark.sql import functions as F

from mediasift.operators import series as W
from mediasift.operators import stats as A
from mediasift.plans import results as RS
from mediasift.sources import media as M


def test_encoder_strings_of_all_places(spark):
    docs = [
        (1, {"format": {"tags": {"Encoder": "Lavf58", "software": ""}}, "streams": [{"tags": {"handler_name": "VideoHandler", "encoder": "x26"}}, {"tags": {"handler_name": "VideoHandler"}}, {}]}),
        (2, {"format": {"tags": {}}, "streams": []}),
        (3, {"format": {}}),
    ]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in docs], "a long, doc string")
    rows = {(r.a, r.place, r.value) for r in M.encoder_strings(M.parse_probe(df, "doc"), ["a"]).collect()}
    assert rows == {(1, "format.encoder", "Lavf58"), (1, "stream.handler_name", "VideoHandler"), (2, None, None), (3, None, None)}


def test_tag_sketches_merge_over_runs(spark):
    one = spark.range(3000).select(F.lit("p").alias("place"), F.concat(F.lit("v"), F.col("id") % 1000).alias("value"), "id")
    two = spark.range(3000).select(F.lit("p").alias("place"), F.concat(F.lit("v"), F.col("id") % 1500).alias("value"), "id")
    a, b = (A.distinct_tags(x, ["place"], "value", "id") for x in (one, two))
    r = a.first()
    assert (r.n_tags, r.n_values, r.n_owners, r.n_top) == (3000, 1000, 3000, 3)
    m = A.merge_tag_sketches(a.unionByName(b), ["place"]).first()
    assert m.n_tags == 6000 and abs(m.n_values_estimate - 1500) < 75


def test_duplication_rates(spark):
    d = [None, 0.1, 0.2, 5.0, 0.1, 0.1, 0.1, 2.0, 1.5, 9.0]
    df = spark.createDataFrame([(1, float(i), v) for i, v in enumerate(d)] + [(None, 0.0, None)], "k long, t double, d double")
    got = {r.k: r for r in W.duplication_summary(df, ["k"], ["t"], "d", 0.5, 3.0, 2, spark.createDataFrame([(1, 6)], "k long, n_hash_dup long")).collect()}
    r = got[1]
    assert (r.n_steps, r.n_frozen, r.n_near, r.n_segments, r.n_hash_dup, r.score) == (9, 5, 2, 2, 6, 0.80)
    assert r.frozen_rate == 5 / 9 and r.near_rate == 2 / 9
    assert (got[None].n_steps, got[None].score) == (0, 0.0)


def test_noise_change_point_is_located_inside_the_asset(spark):
    rows = [(1, 10.0, 6.0, 10.2, False), (2, 0.2, 4.0, 9.0, False), (3, None, 9.0, 9.0, False), (4, 5.0, 9.0, 9.0, True), (5, 5.0, 3.9, 9.0, False)]
    df = spark.createDataFrame(rows, "k long, change_t double, change_z double, duration double, lossy boolean")
    from mediasift.functions.exprs import explode_rules

    got = {r.k: (r.severity, r.score, r.start_s, r.end_s) for r in explode_rules(df, ["k"], W.noise_change_rules(F.col)).collect()}
    assert got == {1: ("high", 0.55, 9.5, 10.2), 2: ("medium", 0.5, 0.0, 0.7)}


def test_report_tables(spark):
    f = spark.createDataFrame(
        [(1, "noise", "high", 2.0, 0.333, 1.0, 2.5), (1, "enf", "LOW", 1.0, 0.5, None, None), (1, "fusion", "high", 0.0, 0.9, None, None), (1, "noise", "medium", 1.0, 0.2, None, None), (2, "other", "low", 1.0, 0.2, None, None)],
        "k long, module string, severity string, t double, confidence double, start_s double, end_s double",
    ).withColumn("title", F.col("module"))
    sev = {(r.k, r.level): r.n for r in RS.report_severities(f, ["k"]).collect()}
    assert sev == {(1, "HIGH"): 1, (1, "MEDIUM"): 1, (1, "LOW"): 1, (1, "TOTAL"): 3, (2, "HIGH"): 0, (2, "MEDIUM"): 0, (2, "LOW"): 1, (2, "TOTAL"): 1}
    rows = [(r.k, r.number, r.title, r.level, r.confidence, r.span) for r in RS.report_findings(f, ["k"], ["enf", "noise"], ["t"]).orderBy("k", "number").collect()]
    assert rows == [(1, 0, "enf", "LOW", 0.5, None), (1, 1, "noise", "MEDIUM", 0.2, None), (1, 2, "noise", "HIGH", 0.33, "1.00s to 2.50s")]
    assert [(r.name, r.value) for r in RS.report_appendix(spark.createDataFrame([(1, 2, 0.5)], "k long, a int, b double"), ["k"], ["b", "a"]).collect()] == [("b", 0.5), ("a", 2.0)]


def test_case_record(spark):
    cases = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n")], "k long, submitted_by string")
    fused = spark.createDataFrame([(1, 0.5, 0.4, "none"), (2, 0.123456, 0.8, "none"), (None, 0.9, 0.6, "sole_supporter")], "k long, fused double, confidence double, conflict string")
    summary = A.case_summary(spark.createDataFrame([(1, "enf", "HIGH"), (1, "enf", "low"), (None, "a", "medium")], "k long, module string, severity string"), ["k"])
    got = {r.k: r for r in RS.case_record(cases, fused, summary, ["k"]).collect()}
    assert (got[1].review_reason, got[1].total_findings, got[1].modules_completed, got[1].highest_severity, got[1].confidence_level) == ("weak_confidence", 2, 1, "high", "low")
    assert (got[2].probability, got[2].needs_review, got[2].total_findings) == (0.1235, False, 0)
    assert (got[3].review_reason, got[3].probability) == ("no_result", 0.0)
    assert (got[None].review_reason, got[None].highest_severity) == ("sole_supporter", "medium")
