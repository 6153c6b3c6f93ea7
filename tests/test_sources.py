"""Readers and writers round-trip through files."""

import hashlib
import json

from pyspark.sql import functions as F

from mediasift.plans.q_sources import case_tables
from mediasift.sources import media as M
from mediasift.sources import records as S


def test_file_hashes(spark, tmp_path):
    big = b"a" * (M.MEGABYTE + 7)
    (tmp_path / "big.bin").write_bytes(big)
    (tmp_path / "small.bin").write_bytes(b"\x00\x01")
    rows = {r.path.rsplit("/", 1)[1]: r for r in M.hash_assets(M.read_assets(spark, str(tmp_path)), "content").drop("content").collect()}
    assert rows["big.bin"].sha256 == hashlib.sha256(big).hexdigest() and rows["big.bin"].sha256_head == hashlib.sha256(big[: M.MEGABYTE]).hexdigest()
    assert rows["small.bin"].md5 == hashlib.md5(b"\x00\x01").hexdigest() and rows["small.bin"].n_bytes == 2


def test_probe_file(spark, tmp_path):
    doc = {"asset_id": "a", "format": {"format_name": "mov,mp4", "duration": "12.5", "bit_rate": "800000", "tags": {"ENCODER": "Lavf60"}}, "streams": [{"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "h264", "duration": "N/A"}]}
    (tmp_path / "p.json").write_text(json.dumps(doc) + "\n{broken\n")
    r = M.probe_profile(M.read_probe(spark, str(tmp_path)).filter("asset_id is not null"), ["asset_id"]).first()
    assert (r.video_codec, r.audio_codec, r.duration, r.bit_rate, r.encoder, r.n_streams) == ("h264", "aac", 12.5, 800000, "Lavf60", 2)


def test_packets_drop_bad_rows(spark, tmp_path):
    rows = [{"asset_id": "a", "seq": i, "pts": str(i), "dts": str(i), "size": "10", "is_key": i == 0} for i in range(3)] + [{"asset_id": "a", "seq": 9, "pts": "N/A", "size": "5"}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    assert M.read_packets(spark, str(tmp_path)).count() == 3


def test_audit_append_and_read(spark, tmp_path):
    e = [("1", "c", "t1", "start", "d", "sys", None, "s1"), ("2", "c", "t2", "end", "d", "sys", "h", "s2")]
    for row in e:
        S.append_audit(spark.createDataFrame([row], S.AUDIT_SCHEMA), str(tmp_path / "a"))
    assert sorted(map(tuple, S.read_audit(spark, str(tmp_path / "a")).collect())) == e


def test_case_store(spark, sf, tmp_path):
    t = case_tables(spark, sf)
    S.write_case_tables(t, str(tmp_path / "store"))
    back = S.read_case_tables(spark, str(tmp_path / "store"))
    for name, keys in S.CASE_TABLES.items():
        assert back[name].count() == t[name].select(*keys).distinct().count()


def test_digest_survives_storage(spark, tmp_path):
    df = S.with_digest(spark.createDataFrame([(1, "é"), (2, None)], "k int, v string"), F.struct("k", "v"))
    df.write.parquet(str(tmp_path / "r"))
    back = S.verify_digest(spark.read.parquet(str(tmp_path / "r")))
    assert back.filter("intact").count() == 2
    assert S.verify_digest(back.withColumn("json", F.concat("json", F.lit(" ")))).filter("intact").count() == 0


def test_append_reads_the_partitions_it_touches(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda ids: {"cases": spark.createDataFrame([(i, f"c{i}", "2024-01-01") for i in ids], "case_id string, title string, ingest_date string")}
    ids = [str(i) for i in range(200)] + [None]
    S.write_case_tables(make(ids), path)
    S.write_case_tables(make(["7", "7", None, "new"]), path)
    S.write_case_tables(make(["7", "new"]), path)
    S.write_case_tables(make([]), path)
    back = spark.read.parquet(f"{path}/cases")
    assert back.count() == 202 and back.select("case_id").distinct().count() == 202
    one = back.filter("case_id = '7'").first()
    have = S.stored_keys(spark, f"{path}/cases", ["case_id"], [one.key_bucket])
    plan = have._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "key_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    n = have.count()
    assert 0 < n < 40 and have.filter("case_id = '7'").count() == 1


def test_append_to_a_store_without_the_partition_column(spark, tmp_path):
    path = str(tmp_path / "store")
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "case_id string, title string")
    old.write.parquet(f"{path}/cases")
    S.write_case_tables({"cases": spark.createDataFrame([("2", "x"), ("3", "c")], "case_id string, title string")}, path)
    assert sorted(map(tuple, spark.read.parquet(f"{path}/cases").collect())) == [("1", "a"), ("2", "b"), ("3", "c")]
