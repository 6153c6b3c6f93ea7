"""Benchmark: seconds per headline query, one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default all), ``BENCH_QUERIES``
(comma list, or ``all``). Each query is run to a sink that reads every row.
"""

from __future__ import annotations

import json
import os
import time

from mediasift.plans.catalog import QUERIES
from mediasift.session import local_session

HEADLINE = (
    "q_score_assets", "q_fuse_audio", "q_fuse_video", "q_unified_results", "q_change_point", "q_abruptness", "q_frozen_runs", "q_rolling_deviation", "q_suppress_nearby", "q_before_after_ratio",
    "q_merge_adjacent", "q_asof_nearest", "q_band_hamming", "q_components", "q_interval_overlap", "q_pair_cosine", "q_device_match", "q_declared_vs_actual", "q_hist_periodicity", "q_bitrate_zscore",
    "q_benford", "q_dynamic_range", "q_frame_metrics", "q_fingerprint", "q_spectrum", "q_spectral_features", "q_block_dct", "q_content_hash", "q_chain_verify", "q_meta_rules_audio", "q_finding_rollup", "q_calibration",
    "q_chunk_frames", "q_pause_model", "q_mains_band", "q_frame_rollup", "q_pair_adaptive", "q_duplication", "q_case_record", "q_encoder_strings", "q_run_detectors",
)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    pick = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if pick == "all" else [n for n in pick.split(",") if n] or list(HEADLINE)
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, memory=os.environ.get("BENCH_MEMORY", "12g"))
    # start the JVM, the Python workers and the code paths once
    run(QUERIES["q_abs_diff"](spark, sf))
    run(QUERIES["q_block_dct"](spark, sf))
    times = {}
    for n in names:
        t = time.perf_counter()
        run(QUERIES[n](spark, sf))
        times[n] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
