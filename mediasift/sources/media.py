"""Readers and row-level source operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediasift.functions.exprs import tag
from mediasift.operators.ordered import Ordered

STREAM = (
    "struct<codec_type:string,codec_name:string,profile:string,level:int,width:int,height:int,r_frame_rate:string,avg_frame_rate:string,nb_frames:string,"
    "duration:string,start_time:string,bit_rate:string,sample_rate:string,channels:int,bits_per_sample:int,tags:map<string,string>>"
)
PROBE_SCHEMA = (
    "asset_id string, format struct<format_name:string,duration:string,size:string,bit_rate:string,nb_streams:int,tags:map<string,string>>, "
    f"streams array<{STREAM}>"
)
PACKET_SCHEMA = "asset_id string, seq bigint, pts string, dts string, size string, is_key boolean, frame_type string, pos string"
MEGABYTE = 1 << 20


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, content, length, modificationTime)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def image_metadata(df: DataFrame, path: str = "path", content: str = "content", modified: str = "modificationTime", width: str = "width", height: str = "height", exif: str = "exif") -> DataFrame:
    """One row per image file: name, size, format by extension, dimensions, mode, times, EXIF map, GPS part, hashes.

    Width, height, mode and the EXIF map (text to text) come from the decoder's table; a null map is empty.
    """
    c = F.col
    b = c(content).cast("binary")
    name = F.element_at(F.split(path, "/"), -1)
    tags = F.coalesce(c(exif), F.create_map().cast("map<string,string>"))
    return df.select(
        c(path).alias("path"), name.alias("filename"), F.octet_length(b).cast("bigint").alias("size_bytes"), F.round(F.octet_length(b) / MEGABYTE, 2).alias("size_mb"),
        F.upper(F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1))).alias("format"), F.concat_ws("x", c(width).cast("string"), c(height).cast("string")).alias("dimensions"), c("mode"), c(modified).alias("modified"),
        F.map_filter(tags, lambda k, v: ~k.startswith("GPS")).alias("exif"), F.map_filter(tags, lambda k, v: k.startswith("GPS")).alias("gps"), F.md5(b).alias("md5"), F.sha2(b, 256).alias("sha256"),
    )


def hash_assets(df: DataFrame, content: str) -> DataFrame:
    """md5, sha1, sha256 of the whole content and sha256 of its first megabyte."""
    b = F.col(content).cast("binary")
    return df.withColumns({
        "md5": F.md5(b), "sha1": F.sha1(b), "sha256": F.sha2(b, 256), "sha256_head": F.sha2(F.substring(b, 1, MEGABYTE), 256), "n_bytes": F.octet_length(b).cast("bigint"),
    })


def read_probe(spark: SparkSession, path: str) -> DataFrame:
    """Probe documents (JSON lines) with a fixed schema; numbers stay text until cast."""
    return spark.read.schema(PROBE_SCHEMA).option("mode", "PERMISSIVE").json(path)


def parse_probe(df: DataFrame, doc: str) -> DataFrame:
    """Probe documents held as JSON text in a column."""
    return df.withColumn("_p", F.from_json(doc, PROBE_SCHEMA)).select(*[c for c in df.columns if c != doc], "_p.format", "_p.streams")


def probe_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First video and audio stream with fall-backs from the container."""
    first = lambda kind: F.get(F.filter("streams", lambda s: s["codec_type"] == kind), F.lit(0))
    d = df.withColumn("_v", first("video")).withColumn("_a", first("audio"))
    num = lambda c: c.try_cast("double")
    tags = F.map_concat(*[F.coalesce(F.col(c), F.create_map().cast("map<string,string>")) for c in ("format.tags",)])
    return d.select(
        *keys, F.col("format.format_name").alias("container"), F.col("_v.codec_name").alias("video_codec"), F.col("_a.codec_name").alias("audio_codec"),
        F.coalesce(num(F.col("_v.duration")), num(F.col("_a.duration")), num(F.col("format.duration"))).alias("duration"),
        F.coalesce(F.col("format.bit_rate").try_cast("bigint"), F.col("_a.bit_rate").try_cast("bigint")).alias("bit_rate"),
        F.coalesce(tag(tags, "encoder", "software"), tag(F.col("_v.tags"), "encoder")).alias("encoder"), F.size("streams").alias("n_streams"),
    )


# Tag names that hold an encoder, for the container and for its streams.
FORMAT_ENCODER_TAGS = ("encoder", "software", "writing_application")
STREAM_ENCODER_TAGS = ("encoder", "handler_name")


def encoder_strings(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, place, value): every encoder string of a probe, once per place.

    Container tags may be capitalised; stream tags need more than three
    characters. Assets without any give one row with null place and value.
    """
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    empty = lambda v: F.nullif(v, F.lit(""))
    put = lambda place, v: F.struct(F.lit(place).alias("place"), v.alias("value"))
    fmt = [put(f"format.{k}", F.coalesce(empty(at(F.col("format.tags"), k)), empty(at(F.col("format.tags"), k.capitalize())))) for k in FORMAT_ENCODER_TAGS]
    per = lambda s: F.array(*[put(f"stream.{k}", F.when(F.length(at(s["tags"], k)) > 3, at(s["tags"], k))) for k in STREAM_ENCODER_TAGS])
    streams = F.flatten(F.transform(F.coalesce(F.col("streams"), F.array().cast(df.schema["streams"].dataType)), per))
    found = F.array_distinct(F.filter(F.concat(F.array(*fmt), streams), lambda e: e["value"].isNotNull()))
    return df.select(*keys, F.explode_outer(found).alias("_e")).select(*keys, "_e.place", "_e.value")


def _packets(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    r = spark.read.schema(PACKET_SCHEMA + ", _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
    return r.json(path) if fmt == "json" else r.option("header", "true").csv(path)


def read_packets(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """S3: packet records that parse and have a time and a size; ``broken_packets`` has the others."""
    return clean_packets(_packets(spark, path, fmt).filter("_broken IS NULL").drop("_broken"))


def broken_packets(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """S3: the lines that ``read_packets`` leaves out, as text where they didn't parse."""
    p = _packets(spark, path, fmt)
    ok = F.col("_broken").isNull() & F.col("pts").try_cast("double").isNotNull() & F.col("size").try_cast("bigint").isNotNull()
    return p.filter(~ok)


def clean_packets(df: DataFrame) -> DataFrame:
    """S3: cast text fields; a packet needs a time and a size."""
    num = lambda c, t: F.col(c).try_cast(t)
    return df.withColumns({"pts": num("pts", "double"), "dts": num("dts", "double"), "size": num("size", "bigint")}).filter(F.col("pts").isNotNull() & F.col("size").isNotNull())


def scale_pcm(x: Column, dtype: str) -> Column:
    """Integer samples to [-1, 1]."""
    scale = {"uint8": 128.0, "int16": 32768.0, "int32": 2147483648.0, "float": 1.0}[dtype]
    v = x.cast("double")
    return (v - 128.0) / scale if dtype == "uint8" else v / scale


def mono_mix(chunks: DataFrame, keys: Sequence[str], ch: str, chunk: str, samples: str, dtype: str = "float") -> DataFrame:
    """Chunk table to mono rows (keys, chunk, pos, x, spread between channels)."""
    e = chunks.select(*keys, ch, chunk, F.posexplode(samples).alias("pos", "_s")).withColumn("_x", scale_pcm(F.col("_s"), dtype))
    return e.groupBy(*keys, chunk, "pos").agg(F.avg("_x").alias("x"), (F.max("_x") - F.min("_x")).alias("spread"), F.count(F.lit(1)).alias("n_ch"))


def channel_identity(mono: DataFrame, keys: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """Whether all channels carry the same signal."""
    return mono.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), F.avg("x").alias("mean"), F.bool_and(F.col("spread") <= tolerance).alias("identical"))


def slice_time(df: DataFrame, t: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """Rows with start <= t <= end; pushed down to the scan when ``t`` is a column."""
    if start is not None:
        df = df.filter(F.col(t) >= start)
    return df if end is None else df.filter(F.col(t) <= end)


def sample_every(df: DataFrame, keys, order, step: int, offset: int = 0, split=None) -> DataFrame:
    """Every ``step``-th row of each key."""
    o = Ordered(df, keys, order, split=split).position()
    return o.rows().filter(F.pmod(F.col("_i") - offset, F.lit(step)) == 0).drop("_i")


def sample_even(df: DataFrame, keys, order, n: int, margin: float = 0.0, split=None) -> DataFrame:
    """``n`` evenly spaced rows per key (all when fewer), inside an edge margin."""
    o = Ordered(df, keys, order, split=split).position().stats(_n=F.count(F.lit(1)))
    o.add(_a=F.floor(F.col("_n") * margin), _b=F.col("_n") - F.floor(F.col("_n") * margin))
    i, m = F.col("_i") - F.col("_a"), F.col("_b") - F.col("_a")
    j = F.ceil(i * n / m)
    keep = (i >= 0) & (i < m) & ((m <= n) | ((j < n) & (F.floor(j * m / n) == i)))
    return o.rows().filter(keep).drop("_i", "_n", "_a", "_b")


def sample_rate(df: DataFrame, keys, order, source_fps: str, target_fps: float, split=None) -> DataFrame:
    """Thin a series from its own rate to ``target_fps``."""
    o = Ordered(df, keys, order, split=split).position()
    step = F.greatest(F.lit(1), F.round(F.col(source_fps) / target_fps)).cast("bigint")
    return o.rows().filter(F.pmod(F.col("_i"), step) == 0).drop("_i")


def validate(df: DataFrame, keys: Sequence[str], extensions: Sequence[str], max_bytes: int) -> DataFrame:
    """Errors, warnings and validity. Expects path, size_bytes, has_video, duration_s."""
    c = F.col
    ext = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    msg = lambda cond, text: F.when(cond, F.lit(text))
    errors = F.array_compact(F.array(
        msg(c("size_bytes") == 0, "empty"), msg(c("size_bytes") > max_bytes, "too_large"), msg(~ext.isin(*extensions), "unsupported"), msg(~c("has_video"), "no_video_stream"),
    ))
    warnings = F.array_compact(F.array(msg(c("duration_s") < 1.0, "very_short"), msg(c("duration_s").isNull(), "unknown_duration")))
    return df.select(*keys, F.array_join(errors, ",").alias("errors"), F.array_join(warnings, ",").alias("warnings"), (F.size(errors) == 0).alias("is_valid"))
