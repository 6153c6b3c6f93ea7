"""Audit chains, case tables, result records, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions.exprs import hmac_sha256, json_string
from mediasift.operators.ordered import Ordered

AUDIT_SCHEMA = "entry_id string, case_id string, timestamp string, event string, detail string, actor string, file_hash string, signature string"
# key order of the signed text
SIGNED_FIELDS = ("actor", "case_id", "detail", "entry_id", "event", "file_hash", "timestamp")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit JSON lines."""
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Append entries as JSON lines; empty fields are kept so that nulls sign the same."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def signed_text(fields: Sequence[str] = SIGNED_FIELDS) -> Column:
    """Canonical JSON of an entry: sorted keys, ", " and ": ", ASCII escapes."""
    parts = []
    for i, f in enumerate(sorted(fields)):
        parts += [F.lit(f'{"{" if i == 0 else ", "}"{f}": '), json_string(F.col(f))]
    return F.concat(*parts, F.lit("}"))


def sign(key: bytes, previous: Column, text: Column) -> Column:
    return hmac_sha256(key, F.concat(previous, F.lit(":"), text))


def verify_chain(df: DataFrame, key: bytes, case: str, order: Sequence[str], signature: str = "signature", text: Column | None = None, split=None) -> DataFrame:
    """Rows whose signature does not follow from the stored previous one.

    The first entry of a case chains to the case id. Every row is checked on its
    own against its neighbour, so a chain of any length is verified in parallel.
    """
    o = Ordered(df, [case], order, before=1, split=split)
    prev = F.coalesce(o.prev(signature), F.col(case).cast("string"))
    rows = o.add(_prev=prev).rows()
    want = sign(key, F.col("_prev"), signed_text() if text is None else text)
    return rows.withColumn("expected", want).filter(~F.col(signature).eqNullSafe(F.col("expected"))).drop("_prev")


def chain_summary(df: DataFrame, bad: DataFrame, case: str) -> DataFrame:
    """Entries and violations per case."""
    n = df.groupBy(case).agg(F.count(F.lit(1)).alias("n_entries"))
    b = bad.groupBy(case).agg(F.count(F.lit(1)).alias("n_bad"))
    return n.join(b, case, "left").withColumn("n_bad", F.coalesce("n_bad", F.lit(0))).withColumn("intact", F.col("n_bad") == 0)


CASE_TABLES = {
    "cases": ("case_id",), "module_results": ("case_id", "module"), "findings": ("case_id", "finding_id"), "audit_entries": ("case_id", "entry_id"), "device_fingerprints": ("device_make", "device_model"),
}


# partition column of the stores: part of the key's hash
BUCKET = "key_bucket"


def stored_keys(spark: SparkSession, path: str, key: Sequence[str], touched: Sequence[int]) -> DataFrame | None:
    """Keys that a store has in the ``touched`` partitions, all keys of a store without that column, None without a store."""
    try:
        store = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    keep = [*key, BUCKET] if BUCKET in store.columns else [*key]
    return store.filter(F.col(BUCKET).isin(list(touched))).select(*keep) if BUCKET in keep else store.select(*keep)


def write_case_tables(tables: dict[str, DataFrame], path: str, partition: str = "ingest_date", buckets: int = 16) -> None:
    """The five tables as Parquet, one row per key, partitioned by part of the key's hash and by ingest date.

    A key that the store already has is left as it is, null keys too, so a retried or repeated
    write adds nothing. An append reads only the keys of the partitions it
    touches. ``buckets`` stays the same for the life of a store, and one writer appends at a time.
    """
    for name, df in tables.items():
        key = list(CASE_TABLES[name])
        out = df.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(buckets)).cast("int"))
        # at most ``buckets`` numbers
        touched = sorted(r[0] for r in out.select(BUCKET).distinct().collect())
        have = stored_keys(df.sparkSession, f"{path}/{name}", key, touched)
        out = out.dropDuplicates(key)
        by = [BUCKET]
        if have is not None:
            by = [c for c in have.columns if c == BUCKET]
            old = have.select(*[F.col(k).alias(f"_o_{k}") for k in key])
            same = F.lit(True)
            for k in key:
                same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
            out = out.join(old, same, "left_anti")
        if not by:
            out = out.drop(BUCKET)
        by += [partition] if partition in out.columns else []
        if by:
            out.hint("rebalance", *by).write.mode("append").partitionBy(*by).parquet(f"{path}/{name}")
        else:
            out.write.mode("append").parquet(f"{path}/{name}")


def read_case_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}").drop(BUCKET) for n in CASE_TABLES}


def with_digest(df: DataFrame, record: Column) -> DataFrame:
    """JSON text of the record and its SHA-256."""
    return df.withColumn("json", F.to_json(record)).withColumn("digest", F.sha2("json", 256))


def verify_digest(df: DataFrame) -> DataFrame:
    """Recompute and compare."""
    return df.withColumn("intact", F.sha2("json", 256) == F.col("digest"))


def export_records(cases: DataFrame, findings: DataFrame, keys: Sequence[str], order: Sequence[str], part_rows: int = 1000, split=None) -> DataFrame:
    """Nested JSON per asset with its findings in order.

    A record holds at most ``part_rows`` findings; larger assets continue in
    further parts, so no asset has to fit one task.
    """
    o = Ordered(findings, keys, order, split=split).position()
    cols = [c for c in findings.columns if c not in keys]
    f = o.rows().withColumn("part", F.floor(F.col("_i") / part_rows)).groupBy(*keys, "part").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", F.struct(*cols).alias("f")))), lambda s: s["f"]).alias("findings")
    )
    j = cases.join(f, list(keys), "left")
    head = [c for c in cases.columns if c not in keys]
    none = F.from_json(F.lit("[]"), f.schema["findings"].dataType)
    return j.select(*keys, F.coalesce("part", F.lit(0)).alias("part"), F.to_json(F.struct(*keys, *head, F.coalesce("findings", none).alias("findings"))).alias("json"))


def _is_old(mtime: str, as_of: Column, max_age_hours: float) -> Column:
    # the bare column on one side: the comparison reaches the scan
    return F.col(mtime) < as_of - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max_age_hours * 3600.0))


def expired(listing: DataFrame, mtime: str, as_of: Column, max_age_hours: float) -> DataFrame:
    """Files older than the limit at ``as_of``."""
    return listing.filter(_is_old(mtime, as_of, max_age_hours))


def retention(listing: DataFrame, keys: Sequence[str], mtime: str, as_of: Column, max_age_hours: float) -> DataFrame:
    """Expired and kept counts per kind, in one aggregate. A file without a time is kept."""
    old = F.coalesce(_is_old(mtime, as_of, max_age_hours), F.lit(False))
    return listing.groupBy(*keys).agg(F.count(F.when(old, 1)).alias("n_expired"), F.count(F.when(~old, 1)).alias("n_kept"))
