"""P: metadata and scoring rule packs. A rule is one ``when`` column; a pack explodes the fired ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.functions import constants as C
from mediasift.functions.exprs import clamp, explode_rules, finding, gps_valid, gps_zone_mismatch, let, parse_ts, tz_offset_hours
from mediasift.operators.joins import first_signature, matches


def has_word(text: Column, words: Sequence[str]) -> Column:
    return let(F.lower(text), lambda t: matches(t, words))


def first_word(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(F.lower(text), F.lit(w)), F.lit(w)) for w in words])


def codec_properties(codec: Column) -> dict[str, Column]:
    """Canonical codec and its properties as literal lookups."""
    c = F.lower(codec)
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    canon = F.coalesce(F.try_element_at(m(C.CODEC_ALIASES), c), c)
    return {
        "codec": canon, "is_lossy": canon.isin(*C.LOSSY_CODECS), "is_mobile_lossless": canon.isin(*C.MOBILE_LOSSLESS_CODECS),
        "max_hz": F.try_element_at(m(C.CODEC_MAX_HZ), canon), "ceiling_hz": F.try_element_at(m(C.CODEC_CEILING_HZ), canon),
    }


def quality_flags(height: Column, duration: Column, frames: Column, min_duration: float = 1.0, min_frames: int = 30) -> dict[str, Column]:
    """Reliability flags and labels of a video."""
    label = F.when(height >= 2160, "4K").when(height >= 1080, "1080p").when(height >= 720, "720p").when(height >= 480, "480p").otherwise(F.concat(height.cast("string"), F.lit("p (low)")))
    return {
        "is_low_resolution": (height > 0) & (height < 480), "is_very_short": duration < min_duration, "has_sufficient_frames": frames >= min_frames,
        "resolution": label, "minutes": duration / 60,
    }


def confidence_level(module: Column, p: Column) -> Column:
    """Probability to a named level with the module's own cut-offs."""
    out = None
    for name, (lo, mid, hi) in C.CONFIDENCE_CUTS.items():
        lv = C.CONFIDENCE_LEVELS
        v = F.when(p < lo, lv[0]).when(p < mid, lv[1]).when(p < hi, lv[2]).otherwise(lv[3])
        out = F.when(module == name, v) if out is None else out.when(module == name, v)
    return out


def container_allows(container: Column, codec: Column) -> Column:
    """true/false for the first container entry that matches either way, else null."""
    c = F.lower(container)
    out = None
    for k, v in C.CONTAINER_CODECS.items():
        hit = F.contains(F.lit(k), c) | F.contains(c, F.lit(k))
        ok = F.lower(codec).isin(*v)
        out = F.when(hit, ok) if out is None else out.when(hit, ok)
    return out


def audio_metadata(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seven checks. Expects container, codec, encoder, creation_time (text), modified_at,
    max_freq, sample_rate, bitrate_bps, size_bytes, duration_s, n_samples, wav_rate, has_tags."""
    c = F.col
    f = lambda ty, sev, conf, score, w: finding("metadata", ty, sev, conf, score, w)
    # computed once per row, the rules refer to it many times
    df = df.withColumn("_enc", F.lower(F.trim(F.coalesce(c("encoder"), F.lit("")))))
    enc = c("_enc")
    known = codec_properties(c("codec"))
    codec, lossy = known["codec"], known["is_lossy"]
    generic = enc.rlike(C.GENERIC_ENCODER_PATTERN)
    editor = has_word(enc, C.EDITOR_WORDS)
    df = df.withColumn("_gap", (F.unix_micros("modified_at") - F.unix_micros(parse_ts(c("creation_time")))) / 8.64e10)
    gap = c("_gap")
    no_time = F.coalesce(c("creation_time"), F.lit("")) == ""
    box = F.lower(c("container"))
    bw = F.try_divide(c("max_freq"), c("sample_rate") / 2.0)
    high_rate = c("max_freq").isNotNull() & (c("sample_rate") >= 32000)
    implied = F.floor(F.try_divide(c("size_bytes") * 8, c("duration_s")))
    br = F.try_divide(F.abs(implied - c("bitrate_bps")), c("bitrate_bps")) * 100
    declared = F.floor(c("duration_s") * c("wav_rate"))
    cut = F.try_divide(F.abs(c("n_samples") - declared), declared) * 100
    short = c("n_samples") < declared
    stripped = (codec == "mp3") & ((~c("has_tags") & (enc == "")) | (generic & no_time))
    return explode_rules(df, keys, [
        F.when(~container_allows(c("container"), c("codec")), f("container_codec", "high", 0.80, 0.75, 1.5)),
        F.when(editor, f("editor_encoder", "medium", 0.70, 0.45, 1.0)).when(generic & ~has_word(enc, C.DEVICE_WORDS), f("generic_encoder", "low", 0.50, 0.25, 0.5)),
        F.when(no_time & (box.contains("mp4") | box.contains("m4a") | box.contains("mov")), f("no_timestamp", "low", 0.45, 0.20, 0.5))
        .when(gap > 180, f("timestamp_gap", "high", 0.65, 0.60, 1.2)).when(gap > 7, f("timestamp_gap", "medium", 0.65, 0.35, 1.0)).when(gap < -1, f("timestamp_gap", "high", 0.65, 0.70, 1.5)),
        F.when(high_rate & (bw < 0.15), f("bandwidth", "high", 0.72, 0.65, 1.3)).when(high_rate & (bw < 0.30), f("bandwidth", "medium", 0.72, 0.40, 1.0)),
        F.when(lossy & (c("bitrate_bps") > 0) & (c("duration_s") > 0) & (br > 25), f("bitrate", F.when(br < 50, "medium").otherwise("high"), 0.55, F.least(F.lit(0.55), 0.25 + br / 200), 0.8)),
        F.when((declared > 0) & (cut > 5), f("length", F.when(cut < 20, "medium").otherwise("high"), 0.70, F.when(short, 0.50).otherwise(0.30), 1.0)),
        F.when(stripped, f("stripped_tags", "medium", 0.58, 0.30, 0.8)),
    ])


def video_metadata(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sub-scores, weighted probability and uncertainty, one row per asset.

    Expects creation_time, as_of, video_time, audio_time (text), encoders (array), container,
    codec, container_conf, device_make, device_model, encoder_software, lat, lon. ``as_of``
    replaces the wall clock.
    """
    c = F.col
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    df = df.withColumn("_ts", parse_ts(c("creation_time")))
    ts = c("_ts")
    when_score = F.when(empty(c("creation_time")), 0.45).when(ts > c("as_of"), 0.85).when(F.year(ts) < 1990, 0.60).otherwise(0.0)
    differ = F.when(~empty(c("video_time")) & ~empty(c("audio_time")) & (c("video_time") != c("audio_time")), 0.55).otherwise(0.0)
    one = lambda e: F.coalesce(first_signature(e, C.ENCODER_SIGNATURES, _encoder_score), F.lit(0.0))
    enc = F.when(F.size(F.coalesce(c("encoders"), F.array().cast("array<string>"))) == 0, 0.35).otherwise(F.array_max(F.transform("encoders", one)))
    box, codec = F.lower(c("container")), F.lower(c("codec"))
    rewrapped = (box.contains("avi") & codec.rlike("h265|hevc|vp9|av1")) | (box.rlike("mkv|webm") & codec.contains("mpeg2video"))
    cont = F.greatest(F.coalesce(c("container_conf"), F.lit(0.0)), F.when(rewrapped, 0.50).otherwise(0.0))
    present = sum((F.when(~empty(c(x)), 1.0).otherwise(0.0) for x in ("creation_time", "encoder_software", "device_make", "device_model")), F.lit(0.0)) / 4
    comp = F.when(present <= 0.25, 0.50).when(present <= 0.50, 0.30).otherwise(0.0)
    has_gps = c("lat").isNotNull() & c("lon").isNotNull()
    gps = F.when(has_gps & ~gps_valid(c("lat"), c("lon")), 0.80).when(has_gps & gps_zone_mismatch(c("lon"), tz_offset_hours(c("creation_time"))), 0.65).otherwise(0.0)
    sub = {"timestamp": F.greatest(when_score, differ), "encoder": enc, "container": cont, "completeness": comp, "gps": gps}
    out = df.select(*keys, *[v.cast("double").alias(k) for k, v in sub.items()])
    p = sum((c(k) * w for k, w in C.VIDEO_METADATA_WEIGHTS.items()), F.lit(0.0))
    zeros = sum((F.when(c(k) == 0.0, 1).otherwise(0) for k in sub), F.lit(0))
    return out.withColumn("probability", clamp(p)).withColumn("uncertainty", 0.05 + zeros * 0.03)


def _encoder_score(text: Column, name: str, category: str, suspicious: bool) -> Column:
    if category == "transcoder":
        return F.when(F.contains(text, F.lit("lavf")), 0.60).otherwise(0.55)
    return F.lit(0.55 if category in ("video_editor", "screen_recorder") else 0.0)


def metadata_chain(df: DataFrame, keys: Sequence[str], spread_hours: float = 1.0) -> DataFrame:
    """Encoder against codec, stream profiles, odd containers, timestamp spread.

    Expects encoder, format_name, streams array<struct<codec,profile,level>>, times array<timestamp>.
    """
    c = F.col
    df = df.withColumn("_us", F.transform(F.filter("times", lambda t: t.isNotNull()), lambda t: F.unix_micros(t)))
    n = F.size("streams")
    first = F.lower(F.get("streams", F.lit(0))["codec"])
    enc = F.lower(F.coalesce(c("encoder"), F.lit("")))
    distinct = lambda f: F.size(F.array_distinct(F.transform("streams", lambda s: s[f])))
    us = c("_us")
    spread = (F.array_max(us) - F.array_min(us)) / 3.6e9
    expected = None
    for k, v in C.SOFTWARE_CODECS:
        hit, bad = F.contains(enc, F.lit(k)), ~first.isin(*v)
        expected = F.when(hit, bad) if expected is None else expected.when(hit, bad)
    fmt = F.lower(c("format_name"))
    f = lambda ty, sev, v: finding("bitstream", ty, sev, score=v)
    return explode_rules(df, keys, [
        F.when((n == 1) & (enc != "") & ~F.contains(enc, first) & ~F.contains(first, enc), f("codec_tag", "low", None)),
        F.when((n > 1) & ((distinct("profile") > 1) | (distinct("level") > 1)), f("stream_mismatch", "high", None)),
        F.when(fmt.rlike("rawvideo|avi|asf") & ~fmt.contains("mp4"), f("odd_container", "low", None)),
        F.when((F.size(us) >= 2) & (spread > spread_hours), f("timestamp_spread", F.when(spread > spread_hours * 5, "high").otherwise("medium"), F.least(F.lit(1.0), spread / 100))),
        F.when(F.coalesce(expected, F.lit(False)), f("software_codec", "medium", None)),
    ])


def _weighted(signals: dict[str, Column], weights: dict[str, int]) -> tuple[Column, Column]:
    total = sum((F.when(F.coalesce(v, F.lit(False)), float(weights[k])).otherwise(0.0) for k, v in signals.items()), F.lit(0.0))
    names = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in signals.items()])), ",")
    return F.least(total, F.lit(100.0)), names


def screenshot(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Seven weighted signals. Expects software, format, width, height, dpi_x, dpi_y, tags (array<int>), sharpness."""
    c = F.col
    ids = F.array(*[F.lit(t) for t in C.CAMERA_TAGS])
    no_cam = F.size(F.array_except(ids, F.coalesce("tags", F.array().cast("array<int>")))) >= 4
    maker = F.arrays_overlap(F.coalesce("tags", F.array().cast("array<int>")), F.array(F.lit(271), F.lit(272)))
    sizes = F.concat_ws("x", c("width").cast("string"), c("height").cast("string")).isin(*[f"{w}x{h}" for w, h in C.SCREEN_SIZES])
    score, names = _weighted({
        "software_tag": has_word(F.coalesce(c("software"), F.lit("")), C.SCREENSHOT_WORDS), "missing_camera_exif": no_cam,
        "screen_dpi": c("dpi_x").isin(*C.SCREEN_DPIS) & (c("dpi_x") == c("dpi_y")) & ~maker, "screen_dimensions": sizes,
        "no_exif_thumbnail": maker & ~F.arrays_overlap(F.coalesce("tags", F.array().cast("array<int>")), F.array(F.lit(513), F.lit(514))), "png_no_camera": (F.upper("format") == "PNG") & no_cam, "sharp_edges": c("sharpness") > 2000,
    }, C.SCREENSHOT_WEIGHTS)
    return df.select(*keys, score.alias("score"), names.alias("signals"))


def crop(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored against actual size and supplied grid offset."""
    c = F.col
    size = c("exif_w").isNotNull() & c("exif_h").isNotNull() & ((F.abs(c("exif_w") - c("width")) > 1) | (F.abs(c("exif_h") - c("height")) > 1))
    score, names = _weighted({"exif_dimension_mismatch": size, "grid_offset": c("grid_offset")}, C.CROP_WEIGHTS)
    return df.select(*keys, score.alias("score"), names.alias("signals"))


def jpeg_profile(size: Column, pixels: Column, artifacts: Column, blocks: Column) -> dict[str, Column]:
    """Bytes per pixel and block-artefact bands."""
    bpp, art = F.try_divide(size, pixels), F.try_divide(artifacts, blocks) * 100
    return {
        "bytes_per_pixel": bpp, "quality": F.when(bpp > 2, "high").when(bpp > 1, "medium").otherwise("low"), "artifact_score": art,
        "double_compression": F.when(art > 30, "High").when(art > 15, "Medium").otherwise("Low"), "recompressed": art > 20,
    }


def image_score(ela: Column, noise: Column, clone: Column, jpeg: Column, n_exif: Column, is_frame: Column) -> Column:
    """Points for an image; saving history and EXIF count only for original files."""
    total = F.lit(0.0)
    for name, v in (("ela", ela), ("noise", noise), ("clone", clone)):
        hi, hp, lo, lp = C.IMAGE_POINTS[name]
        total = total + F.when(v > hi, hp).when(v > lo, lp).otherwise(0.0)
    total = total + F.when(~is_frame & (jpeg == "High"), C.IMAGE_RESAVED_POINTS).otherwise(0.0)
    total = total + F.when(~is_frame & (F.coalesce(n_exif, F.lit(0)) < 3), C.IMAGE_SPARSE_EXIF_POINTS).otherwise(0.0)
    return F.least(total, F.lit(100.0))


def spatial_rules(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Per-frame compression, noise and clone findings. Expects ela, noise, clone."""
    def rule(name, kind):
        hi, _, lo, _ = C.IMAGE_POINTS[name]
        return F.when(F.col(name) > lo, finding("spatial", kind, F.when(F.col(name) > hi, "high").otherwise("medium"), start=F.col(t), end=F.col(t)))
    return explode_rules(df, keys, [rule("ela", "compression"), rule("noise", "noise"), rule("clone", "clone")])


def boundary_confidence(ssim: Column, hist: Column) -> Column:
    """P20: confidence of a scene boundary."""
    return clamp(0.7 + F.least(F.lit(0.29), (1 - ssim) * 0.15 + hist * 0.15), 0.7, 0.99)
