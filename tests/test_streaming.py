"""Stream results equal batch results."""

import hashlib
import hmac
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mediasift.operators import series as W
from mediasift.plans.bindings import series
from mediasift.sources import records as S
from mediasift.streaming import feeds, stateful

KEY = b"k1"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def write_parts(df, path, order, n):
    """Files in time order, so each trigger reads the next slice."""
    rows = df.orderBy(*order).toPandas()
    size = -(-len(rows) // n)
    import os

    os.makedirs(path, exist_ok=True)
    for i in range(n):
        f = f"{path}/p{i:03d}.parquet"
        rows.iloc[i * size : (i + 1) * size].to_parquet(f, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return path


def events(spark, sf):
    s = series(spark, sf)
    return s.withColumn("ts", F.timestamp_micros((F.col("t") * 3.6e9).cast("bigint")))


SCHEMA = "k bigint, t double, tie bigint, x double, kind string, m bigint, ts timestamp"


def test_ingest_is_exactly_once(spark, sf, tmp_path):
    src = write_parts(events(spark, sf), str(tmp_path / "in"), ["t", "tie"], 3)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):
        feeds.ingest(feeds.read_feed(spark, src, SCHEMA, "parquet", 1), out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == events(spark, sf).count()


def test_tumbling_matches_batch_on_closed_windows(spark, sf, tmp_path):
    src = write_parts(events(spark, sf), str(tmp_path / "in"), ["t", "tie"], 4)
    st = feeds.tumbling_bitrate(feeds.read_feed(spark, src, SCHEMA, "parquet", 1), ["kind"], "ts", "x", "12 hours", "1 hour")
    got = {(r.kind, r.start): round(r.bits, 6) for r in run(st, "r2").collect()}
    b = events(spark, sf).groupBy("kind", F.window("ts", "12 hours").alias("w")).agg((F.sum("x") * 8).alias("bits"))
    want = {(r.kind, r.w.start): round(r.bits, 6) for r in b.collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len(got) >= len(want) - 10


def test_late_rows_are_dropped(spark, tmp_path):
    day = lambda h: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)
    parts = [[("a", day(0), 1.0), ("a", day(50), 1.0)], [("a", day(51), 1.0)], [("a", day(1), 7.0), ("a", day(52), 1.0)], [("a", day(200), 1.0)]]
    import os

    src = str(tmp_path / "in")
    os.makedirs(src)
    for i, rows in enumerate(parts):
        f = f"{src}/p{i}.parquet"
        pd.DataFrame(rows, columns=["k", "ts", "x"]).to_parquet(f, coerce_timestamps="us")
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    st = feeds.tumbling_bitrate(feeds.read_feed(spark, src, "k string, ts timestamp, x double", "parquet", 1), ["k"], "ts", "x", "1 hour", "2 hours")
    bits = sorted(r.bits for r in run(st, "r2late").collect())
    assert 56.0 not in bits and 8.0 in bits


def test_sliding_mean(spark, sf, tmp_path):
    src = write_parts(events(spark, sf), str(tmp_path / "in"), ["t", "tie"], 3)
    st = feeds.sliding_mean(feeds.read_feed(spark, src, SCHEMA, "parquet", 1), ["kind"], "ts", "x", "48 hours", "24 hours", "1 hour")
    got = {(r.kind, r.start): round(r["mean"], 6) for r in run(st, "r3").collect()}
    b = events(spark, sf).groupBy("kind", F.window("ts", "48 hours", "24 hours").alias("w")).agg(F.avg("x").alias("m"))
    want = {(r.kind, r.w.start): round(r.m, 6) for r in b.collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_session_merge_matches_batch(spark, sf, tmp_path):
    one = events(spark, sf).filter("kind = 'error'")
    src = write_parts(one, str(tmp_path / "in"), ["t", "tie"], 3)
    st = feeds.merge_alerts(feeds.read_feed(spark, src, SCHEMA, "parquet", 1), ["k"], "ts", "kind", "x", "24 hours", "1 hour")
    got = {(r.k, r.start): (r.n_merged, round(r.mean_metric, 6)) for r in run(st, "r4").collect()}
    i = W.islands_by_gap(one, ["k"], ["t", "tie"], 24.0, strict=True)
    b = i.groupBy("k", "island").agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"))
    want = {(r.k, r.start): (r.n, round(r.m, 6)) for r in b.collect()}
    assert got and all(want[k] == v for k, v in got.items())


def chain(case, n):
    prev, out = case, []
    for i in range(n):
        e = {"entry_id": f"{case}-{i}", "case_id": case, "timestamp": f"2024-01-01T00:00:{i:02d}", "event": "step", "detail": f'é "{i}"\n', "actor": "system", "file_hash": None if i % 2 else "ab"}
        text = json.dumps(e, sort_keys=True)
        e["signature"] = prev = hmac.new(KEY, f"{prev}:{text}".encode(), hashlib.sha256).hexdigest()
        out.append(e)
    return out


@pytest.fixture
def broken():
    rows = chain("a", 6) + chain("b", 6) + chain("c", 6)
    rows[8]["detail"] = "changed"
    rows[14]["signature"] = rows[14]["signature"][::-1]
    return rows


def test_chain_batch(spark, broken):
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in S.AUDIT_SCHEMA.split(", ")) for r in broken], S.AUDIT_SCHEMA)
    bad = {r.entry_id for r in S.verify_chain(df, KEY, "case_id", ["timestamp", "entry_id"]).collect()}
    assert bad == {"b-2", "c-2", "c-3"}
    s = {r.case_id: (r.n_entries, r.n_bad, r.intact) for r in S.chain_summary(df, S.verify_chain(df, KEY, "case_id", ["timestamp", "entry_id"]), "case_id").collect()}
    assert s == {"a": (6, 0, True), "b": (6, 1, False), "c": (6, 2, False)}


def test_chain_stream_across_batches(spark, broken, tmp_path):
    import os

    stateful.use_rocksdb(spark)
    src = tmp_path / "in"
    src.mkdir()
    parts = [[r for r in broken if int(r["entry_id"][2:]) % 6 in g] for g in ((0, 1), (2,), (3, 4, 5))]
    for i, rows in enumerate(parts):
        f = src / f"p{i}.json"
        f.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    st = stateful.verify_stream(feeds.read_feed(spark, str(src), S.AUDIT_SCHEMA, "json", 1), KEY)
    assert {r.entry_id for r in run(st, "r5", "append").collect()} == {"b-2", "c-2", "c-3"}


def test_shuffled_entries_are_ordered_and_late_ones_told_apart(spark, tmp_path):
    import hashlib
    import hmac
    import json
    import os
    import random

    stateful.use_rocksdb(spark)
    names = ["case_id", "entry_id", "timestamp", "signature"]
    fields = [f for f in S.SIGNED_FIELDS]
    def chain(case, n):
        prev, out = case, []
        for i in range(n):
            e = {f: None for f in fields}
            e |= {"case_id": case, "entry_id": f"{case}-{i}", "timestamp": f"2024-01-01T00:{i:02d}:00"}
            body = json.dumps({f: e.get(f) for f in fields}, sort_keys=True)
            e["signature"] = prev = hmac.new(KEY, f"{prev}:{body}".encode(), hashlib.sha256).hexdigest()
            out.append(e)
        return out
    good, bad = chain("a", 40), chain("b", 40)
    bad[20]["signature"] = "0" * 64  # breaks itself and the next one
    src = tmp_path / "in"
    src.mkdir()
    rng = random.Random(3)
    late = good.pop(2)
    batches = []
    for i in range(0, 40, 8):
        part = good[i : i + 8] + bad[i : i + 8]
        batches.append(part)
    # neighbours change places over the border of two batches, rows inside a batch are shuffled
    for x, y in zip(batches, batches[1:]):
        x[-1], y[0] = y[0], x[-1]
    for b in batches:
        rng.shuffle(b)
    batches.append([late])
    for i, rows in enumerate(batches):
        f = src / f"p{i}.json"
        f.write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    st = stateful.verify_stream(feeds.read_feed(spark, str(src), S.AUDIT_SCHEMA, "json", 1), KEY, delay=900)
    got = {(r.entry_id, r.problem) for r in run(st, "r5late", "append").collect()}
    assert {e for e in got if e[0].startswith("b")} == {("b-20", "violation"), ("b-21", "violation")}
    # the entry left out is reported late, the one after it can't be proved
    assert {e for e in got if e[0].startswith("a")} == {("a-2", "late"), ("a-3", "violation")}


def test_change_stream_matches_batch(spark, sf, tmp_path):
    stateful.use_rocksdb(spark)
    ev = events(spark, sf)
    src = write_parts(ev, str(tmp_path / "in"), ["t", "tie"], 4)
    ref, warm = 473352.0 + 240.0, 10.0
    st = stateful.change_stream(feeds.read_feed(spark, src, SCHEMA, "parquet", 1), ref, warm, 1.2, 2)
    got = {r.k: round(r.change_t, 6) for r in run(st, "r6", "append").collect()}
    b = W.change_point(ev, ["k"], ["t", "tie"], "x", ref, warm, z_cut=1.2, persist=2)
    want = {r.k: round(r.change_t, 6) for r in b.collect() if r.change_t is not None}
    assert got and got == want


def test_repeats_and_ledger(spark, tmp_path):
    import os

    src = tmp_path / "in"
    src.mkdir()
    rows = [("h1", 0), ("h2", 1), ("h1", 2), ("h3", 3), ("h2", 4)]
    for i, (h, hour) in enumerate(rows):
        f = src / f"p{i}.parquet"
        pd.DataFrame([(h, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=hour))], columns=["h", "ts"]).to_parquet(f, coerce_timestamps="us")
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    st = feeds.drop_repeats(feeds.read_feed(spark, str(src), "h string, ts timestamp", "parquet", 1), "ts", "h")
    assert sorted(r.h for r in run(st, "r7").collect()) == ["h1", "h2", "h3"]

    jobs = tmp_path / "jobs"
    jobs.mkdir()
    ev = [("j1", "PENDING", 0.0, 1), ("j1", "STARTED", 1.0, 2), ("j2", "PENDING", 1.0, 3), ("j1", "SUCCESS", 5.0, 4), ("j2", "FAILURE", 6.0, 5), ("j1", "STARTED", 7.0, 6)]
    for i, e in enumerate(ev):
        (jobs / f"e{i}.json").write_text(json.dumps(dict(zip(("job_id", "state", "t", "seq"), e))))
    out = str(tmp_path / "ledger")
    schema = "job_id string, state string, t double, seq bigint"
    for ck in ("c1", "c2"):
        # the second run replays everything from a fresh checkpoint
        feeds.upsert_jobs(feeds.read_feed(spark, str(jobs), schema, "json", 2), out, str(tmp_path / ck)).awaitTermination()
        got = {r.job_id: (r.status, r.duration) for r in feeds.read_jobs(spark, out).collect()}
        assert got == {"j1": ("completed", 5.0), "j2": ("failed", 5.0)}


def test_ledger_keeps_the_jobs_of_two_queries(spark, tmp_path):
    schema = "job_id string, state string, t double, seq bigint"
    out = str(tmp_path / "ledger")

    def feed(name, events):
        src = tmp_path / name
        src.mkdir()
        for i, e in enumerate(events):
            (src / f"e{i}.json").write_text(json.dumps(dict(zip(("job_id", "state", "t", "seq"), e))))
        return lambda ck: feeds.upsert_jobs(feeds.read_feed(spark, str(src), schema, "json", 1), out, str(tmp_path / ck), parts=4).awaitTermination()

    a, b = feed("a", [("a", "PENDING", 0.0, 1), ("a", "SUCCESS", 3.0, 2)]), feed("b", [("b", "STARTED", 1.0, 3), ("a", "STARTED", 1.0, 4)])
    a("ca")
    b("cb")
    want = {"a": ("completed", 3.0), "b": ("running", None)}
    state = lambda: ({r.job_id: (r.status, r.duration) for r in feeds.read_jobs(spark, out).collect()}, sorted(tuple(r) for r in feeds.ledger(spark, out).select(*feeds.LEDGER_KEY).collect()))
    assert state()[0] == want and len(state()[1]) == 4
    before = state()
    a("replay")  # a fresh checkpoint sends everything again
    assert state() == before
    plan = feeds.ledger(spark, out).filter(F.col("part").isin([1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
