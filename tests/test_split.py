"""One key with most of the rows: the split path gives the same rows as the plain one."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mediasift.operators import joins as J
from mediasift.operators import series as W
from mediasift.operators.ordered import Ordered, has_large_key, quantiles
from mediasift.session import BLOCK_ROWS_KEY
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
Q, SQL = entry.queries(), entry.oracle_sql()
ORDERED = [
    "q_abs_diff", "q_frozen_runs", "q_gop_groups", "q_pts_anomaly", "q_rolling_deviation", "q_suppress_nearby", "q_change_point", "q_motion_spikes", "q_direction_reversal", "q_before_after_ratio",
    "q_rolling_median", "q_phase_discontinuity", "q_merge_adjacent", "q_pair_rules", "q_steepest_drop", "q_clipping", "q_dynamic_range", "q_half_compare", "q_entropy", "q_frame_metrics", "q_asof_nearest",
    "q_band_hamming", "q_frame_deviation", "q_onset_low_motion", "q_interval_overlap", "q_hash_dup", "q_flagged_plus_baseline", "q_pair_cosine", "q_sample_every_n", "q_sample_even", "q_chain_verify", "q_export_json", "q_spectral_features", "q_signal_type", "q_hist_periodicity",
    "q_pause_model", "q_frame_rollup", "q_report_findings", "q_duplication",
]


@pytest.fixture
def small_blocks(spark):
    spark.conf.set(BLOCK_ROWS_KEY, "9")
    yield
    spark.conf.unset(BLOCK_ROWS_KEY)


@pytest.mark.parametrize("name", ORDERED)
def test_split_matches_sql(spark, small_blocks, name):
    ok, msg = compare(Q[name](spark, SF), connect(SF), SQL[name])
    assert ok, msg


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds nine tenths of 2,000 rows, with ties in t."""
    i = spark.range(2000)
    return i.select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7 + 1).otherwise(0).alias("k"), (F.floor(F.col("id") / 3) / 2.0).alias("t"), F.col("id").alias("tie"), ((F.col("id") * 7919) % 1000 / 10.0).alias("x"),
    )


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("op", [
    lambda d, s: W.abs_diff(d, ["k"], ["t", "tie"], "x", split=s),
    lambda d, s: W.frozen_runs(d, ["k"], ["t", "tie"], "x", 60.0, 2, split=s),
    lambda d, s: W.change_point(d, ["k"], ["t", "tie"], "x", 5.0, 1.0, 1.0, 3, split=s),
    lambda d, s: W.rolling_deviation(d, ["k"], ["t", "tie"], "x", window=4, sigma=0.3, split=s),
    lambda d, s: W.islands_by_gap(d, ["k"], ["t", "tie"], 0.4, split=s),
    lambda d, s: quantiles(d, ["k"], "x", split=s, a=0.05, b=0.5, c=0.93),
    lambda d, s: J.nearest(d.filter("x < 30"), d.filter("x > 80"), ["k"], "t", "t", "tie", "x", 3.0, split=s).drop("x"),
])
def test_operator_split_equals_plain(spark, skewed, op):
    spark.conf.set(BLOCK_ROWS_KEY, "64")
    try:
        assert has_large_key(skewed, ["k"], 64) and not has_large_key(skewed, ["k"], 5000)
        # values, not row text: sums may differ in the last digits
        r = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in df.collect())
        plain = r(op(skewed, False))
        assert r(op(skewed, True)) == plain
        # by size: only key 0 is split, the others stay plain
        assert r(op(skewed, None)) == plain
    finally:
        spark.conf.unset(BLOCK_ROWS_KEY)


def test_blocks_are_bounded(spark, skewed):
    spark.conf.set(BLOCK_ROWS_KEY, "64")
    try:
        o = Ordered(skewed, ["k"], ["t", "tie"], before=5, after=5)
        assert o.split
        sizes = [r["count"] for r in o.df.groupBy("k", "_blk").count().collect()]
        assert max(sizes) <= 64 + 10
        assert o.rows().count() == 2000
    finally:
        spark.conf.unset(BLOCK_ROWS_KEY)


def greedy(ts, d):
    kept = []
    for t in sorted(set(ts)):
        if not kept or t - kept[-1] >= d:
            kept.append(t)
    return kept


def test_suppression_all_paths(spark):
    ts = {1: [0, 0.6, 1.2, 1.7, 2.9], 2: [i * 0.3 for i in range(200)], 3: [5.0], 4: [0.0, 1.0, 2.0, 2.5, 3.0]}
    df = spark.createDataFrame([(k, float(t)) for k, v in ts.items() for t in v], "k bigint, t double")
    want = sorted((k, round(t, 9)) for k, v in ts.items() for t in greedy([float(x) for x in v], 1.0))
    assert (1, 1.2) in want and (1, 2.9) in want and (1, 0.6) not in want
    for split in (False, True):
        got = sorted((r.k, round(r.t, 9)) for r in W.suppress_nearby(df, ["k"], "t", 1.0, split=split).collect())
        assert got == want
