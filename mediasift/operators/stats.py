"""A: grouped statistics. All are hash aggregates with map-side partials."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.functions.exprs import bimodality, clamp, col, cv, let, ramp, severity_name, severity_rank, steps, vsum
from mediasift.operators.ordered import Ordered, decide, quantiles

LN10_20 = 20.0


def db(x: Column) -> Column:
    return LN10_20 * F.log10(x)


def signal_levels(df, keys, x: str) -> DataFrame:
    """A1: DC, peak, RMS and crest factor."""
    c = F.col(x)
    out = df.groupBy(*keys).agg(F.avg(c).alias("dc"), F.max(F.abs(c)).alias("peak"), F.sqrt(F.avg(c * c)).alias("rms"))
    return out.withColumn("crest_db", db(F.col("peak") / (F.col("rms") + 1e-12)))


def clipping(df, keys, order, x: str, level: float = 0.9998, split=None) -> DataFrame:
    """A2: share of clipped samples and number of clipped runs (rising edges)."""
    o = Ordered(df, keys, order, before=1, split=split)
    hit = F.abs(F.col(x)) >= level
    rows = o.add(_hit=hit, _prev=F.coalesce(o.prev(hit), F.lit(False))).rows()
    return rows.groupBy(*keys).agg(
        F.avg(F.col("_hit").cast("double")).alias("clip_ratio"),
        F.count(F.when(F.col("_hit") & ~F.col("_prev"), 1)).alias("clip_runs"),
    )


def silence(df, keys, t: str, x: str, level: float = 0.008) -> DataFrame:
    """A3: silent share, leading and trailing silence in units of ``t``."""
    loud = F.when(F.abs(F.col(x)) >= level, F.col(t))
    return df.groupBy(*keys).agg(
        F.avg((F.abs(F.col(x)) < level).cast("double")).alias("silence_ratio"),
        (F.coalesce(F.min(loud), F.max(t)) - F.min(t)).alias("lead_silence"),
        (F.max(t) - F.coalesce(F.max(loud), F.min(t))).alias("trail_silence"),
    )


def window_rms(df, keys, order, x: str, size: int, split=None) -> DataFrame:
    """RMS of consecutive windows of ``size`` rows; a short last window is dropped."""
    o = Ordered(df, keys, order, split=split).position()
    rows = o.rows().withColumn("win", F.floor(F.col("_i") / size))
    g = rows.groupBy(*keys, "win").agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("rms"), F.count(F.lit(1)).alias("_n"))
    return g.filter(F.col("_n") == size).drop("_n")


def dynamic_range(df, keys, order, x: str, size: int, silent: float = 0.008, split=None) -> DataFrame:
    """A4: p90/p10 of active windows, p5 noise floor and signal-to-noise, in dB."""
    split = decide(df, keys, split)
    w = window_rms(df, keys, order, x, size, split=split)
    loud = quantiles(w.filter(F.col("rms") > silent), keys, "rms", split=split, _p90=0.9, _p10=0.1)
    floor = quantiles(w, keys, "rms", split=split, _p5=0.05)
    whole = df.groupBy(*keys).agg(F.sqrt(F.avg(F.col(x) * F.col(x))).alias("_rms"))
    j = floor.join(loud, list(keys), "left").join(whole, list(keys))
    fl = F.greatest(F.col("_p5"), F.lit(1e-12))
    rng = F.when(F.col("_p10") < 1e-9, 60.0).otherwise(db(F.try_divide("_p90", "_p10")))
    return j.select(
        *keys,
        F.coalesce(rng, F.lit(0.0)).alias("dynamic_range_db"),
        db(fl).alias("noise_floor_db"),
        F.greatest(F.lit(0.0), db(F.col("_rms") / fl)).alias("snr_db"),
    )


def variation(df, keys, x: str) -> DataFrame:
    """A5: mean, population std and CV."""
    out = df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    return out.withColumn("cv", cv(F.col("mean"), F.col("std")))


def moments(df, keys, x: str) -> DataFrame:
    """Skewness and excess kurtosis (population)."""
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))


def similarity_profile(df, keys, x: str) -> DataFrame:
    """Bimodality, CV and 3-sigma outlier rate with the resulting score."""
    st = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"), F.skewness(x).alias("_k3"), F.kurtosis(x).alias("_k4")
    )
    far = F.when(F.col("_s") > 0, (F.abs(F.col(x) - F.col("_m")) > 3 * F.col("_s")).cast("double")).otherwise(0.0)
    rate = df.join(st.select(*keys, "_m", "_s"), list(keys)).groupBy(*keys).agg(F.avg(far).alias("outlier_rate"))
    out = st.join(rate, list(keys)).select(
        *keys, "n", F.when(F.col("n") < 5, 0.0).otherwise(bimodality(F.col("_k3"), F.col("_k4"), F.col("n"))).alias("bimodality"),
        (F.col("_s") / (F.col("_m") + 1e-6)).alias("cv"), "outlier_rate",
    )
    score = F.when((F.col("bimodality") > 0.60) & (F.col("cv") > 0.40), 0.55).when(F.col("outlier_rate") > 0.05, 0.35).otherwise(0.0)
    return out.withColumn("score", F.when(F.col("n") < 5, 0.0).otherwise(score))


def benford(df, keys, x: str, cut: float = 0.15, min_rows: int = 100) -> DataFrame:
    """Mean absolute deviation of first digits from log10(1 + 1/d)."""
    v = F.abs(F.col(x))
    digit = F.substring(F.floor(v).cast("bigint").cast("string"), 1, 1).cast("int")
    share = [F.avg((F.col("_d") == i).cast("double")) for i in range(1, 10)]
    dev = sum((F.abs(s - F.log10(F.lit(1.0 + 1.0 / i))) for i, s in enumerate(share, 1)), F.lit(0.0)) / 9
    out = df.filter(v >= 1.0).withColumn("_d", digit).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), dev.alias("benford_mad"))
    out = out.filter(F.col("n") >= min_rows)
    return out.withColumn("severity", F.when(F.col("benford_mad") >= cut * 1.5, "high").when(F.col("benford_mad") >= cut, "medium"))


def bitrate_anomalies(df, keys, t: str, size: str, cut: float = 2.5, min_rows: int = 10, min_buckets: int = 4) -> DataFrame:
    """Bits per whole time unit; buckets whose z-score reaches ``cut``."""
    b = df.filter(F.col(t) >= 0).groupBy(*keys, F.floor(t).cast("bigint").alias("bucket")).agg(
        (F.sum(size) * 8).alias("bits"), F.count(F.lit(1)).alias("_n")
    )
    st = b.groupBy(*keys).agg(F.avg("bits").alias("_m"), F.stddev_pop("bits").alias("_s"), F.count(F.lit(1)).alias("_b"), F.sum("_n").alias("_r"))
    z = F.try_divide(F.col("bits") - F.col("_m"), F.col("_s"))
    j = b.join(st, list(keys)).filter((F.col("_s") > 0) & (F.col("_b") >= min_buckets) & (F.col("_r") >= min_rows)).withColumn("z", z)
    j = j.filter(F.abs("z") >= cut).withColumn("severity", F.when(F.abs("z") >= cut * 1.5, "high").otherwise("medium"))
    return j.select(*keys, "bucket", "bits", "z", "severity")


def histogram(df, keys, x: str, bins: int = 64, lo: float = 0.05, hi: float = 0.95, split=None) -> DataFrame:
    """Equal-width counts between two quantiles; the last bin is closed."""
    q = quantiles(df, keys, x, split=split, _lo=lo, _hi=hi)
    j = df.join(q, list(keys)).filter(F.col(x).between(F.col("_lo"), F.col("_hi")) & (F.col("_hi") > F.col("_lo")))
    b = F.floor(F.try_divide(F.col(x) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins)
    return j.groupBy(*keys, F.least(b, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_periodicity(df, keys, x: str, bins: int = 64, lags: tuple[int, int] = (2, 8), min_rows: int = 100, split=None) -> DataFrame:
    """Mean normalised autocorrelation of the histogram at short lags."""
    split = decide(df, keys, split)
    h = histogram(df, keys, x, bins, split=split)
    # the self-correlation needs at most ``bins`` numbers per key
    arr = h.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"), F.sum("n").alias("_used"))
    arr = arr.withColumn("_h", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0)).cast("double")))
    corr = lambda lag: F.aggregate(
        F.zip_with(F.slice("_h", 1, bins - lag), F.slice("_h", lag + 1, bins - lag), lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e
    )
    span = range(lags[0], lags[1] + 1)
    score = F.try_divide(sum((corr(k) for k in span), F.lit(0.0)), corr(0)) / len(span)
    total = df.groupBy(*keys).agg(F.count(x).alias("n"))
    out = total.join(arr.select(*keys, "_used", score.alias("_p")), list(keys), "left")
    ok = (F.col("n") >= min_rows) & (F.col("_used") >= min_rows / 2)
    return out.select(*keys, "n", F.coalesce(F.when(ok, clamp(F.col("_p"))), F.lit(0.0)).alias("periodicity"))


def blocking_score(k: Column) -> Column:
    return F.when(k < 2, 0.0).when(k < 5, (k - 2) / 6).when(k < 10, 0.5 + (k - 5) / 10).when(k.isNotNull(), 1.0)


def compression_score(periodicity: Column, kurt: Column, cv_of_std: Column) -> dict[str, Column]:
    """A10: sub-scores and total of the double-compression check."""
    quant = clamp(0.65 * periodicity + 0.35 * clamp((kurt - 2) / 8))
    spatial = F.when(cv_of_std < 0.15, 0.0).when(cv_of_std < 0.30, (cv_of_std - 0.15) / 0.15 * 0.4).otherwise(F.least(F.lit(1.0), 0.4 + (cv_of_std - 0.30) * 2.0))
    block = blocking_score(kurt)
    return {
        "double_quant": quant, "blocking": block, "spatial": spatial,
        "dct_score": clamp(0.50 * quant + 0.25 * periodicity + 0.15 * block + 0.10 * spatial),
    }


def bitrate_score(n_anomaly: Column, n: Column, gop: Column, unexpected: Column) -> Column:
    """A10: frame-size sub-score."""
    a = F.least(F.lit(1.0), n_anomaly / F.greatest(n / 100, F.lit(1.0)))
    return clamp(0.50 * a + 0.35 * gop + 0.15 * F.least(F.lit(1.0), unexpected / 3))


def grid_anomaly(df, keys, frame: str, cell: Sequence[str], x: str, active: float = 0.05, sigma: float = 2.5, split=None) -> DataFrame:
    """Variance and skew per frame and cell, averaged over frames; CV over active cells, skew CV, cells beyond ``sigma``."""
    f = df.groupBy(*keys, frame, *cell).agg(F.var_pop(x).alias("v"), F.skewness(x).alias("sk"))
    c = f.groupBy(*keys, *cell).agg(F.avg("v").alias("v"), F.avg("sk").alias("sk"))
    med = quantiles(c, keys, "v", split=split, _med=0.5)
    st = c.groupBy(*keys).agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    j = c.join(med, list(keys)).join(st, list(keys))
    on = F.when(F.col("v") > active * (F.col("_med") + 1e-6), F.col("v"))
    out = j.groupBy(*keys).agg(
        F.count(on).alias("n_active"),
        (F.stddev_pop(on) / (F.avg(on) + 1e-6)).alias("cv_variance"),
        (F.stddev_pop("sk") / (F.avg(F.abs("sk")) + 1e-6)).alias("cv_skew"),
        F.count(F.when((F.col("_s") > 0) & (F.abs(F.col("v") - F.col("_m")) > sigma * F.col("_s")), 1)).alias("n_anomalous"),
    )
    out = out.filter(F.col("n_active") >= 4)
    return out.withColumn("variance_score", clamp((F.col("cv_variance") - 0.30) / 0.60)).withColumn("skew_score", clamp((F.col("cv_skew") - 0.40) / 0.80))


def circular(df, keys, angle: Column, min_rows: int = 3) -> DataFrame:
    """Circular mean and variance of directions with the consistency ramp."""
    g = df.groupBy(*keys).agg(F.avg(F.sin(angle)).alias("_s"), F.avg(F.cos(angle)).alias("_c"), F.count(angle).alias("n"))
    var = 1.0 - F.sqrt(F.col("_s") * F.col("_s") + F.col("_c") * F.col("_c"))
    out = g.filter(F.col("n") >= min_rows).select(*keys, "n", F.atan2("_s", "_c").alias("mean_angle"), var.alias("circ_var"))
    return out.withColumn("score", clamp((F.col("circ_var") - 0.40) / 0.50))


def with_half(df, keys, order, name: str = "half", split=None) -> DataFrame:
    """Rows marked 1 for the first n div 2 rows of the key and 2 for the rest."""
    o = Ordered(df, keys, order, split=split).position().stats(_n=F.count(F.lit(1)))
    first = F.col("_i") < F.floor(F.col("_n") / 2)
    return o.add(**{name: F.when(first, 1).otherwise(2)}).drop("_i", "_n").rows()


def half_compare(df, keys, order, x: str, split=None) -> DataFrame:
    """Mean difference, RMS ratio and median ratio of the two halves."""
    split = decide(df, keys, split)
    h = with_half(df, keys, order, split=split)
    one, two = F.when(F.col("half") == 1, F.col(x)), F.when(F.col("half") == 2, F.col(x))
    agg = h.groupBy(*keys).agg(
        F.avg(one).alias("mean_1"), F.avg(two).alias("mean_2"), F.sqrt(F.avg(one * one)).alias("_r1"), F.sqrt(F.avg(two * two)).alias("_r2")
    )
    med = quantiles(h, [*keys, "half"], x, split=split, _m=0.5)
    med = med.groupBy(*keys).agg(F.max(F.when(F.col("half") == 1, F.col("_m"))).alias("_m1"), F.max(F.when(F.col("half") == 2, F.col("_m"))).alias("_m2"))
    ratio = lambda a, b: F.greatest(a, b) / (F.least(a, b) + 1e-6)
    return agg.join(med, list(keys)).select(
        *keys, "mean_1", "mean_2", F.abs(F.col("mean_1") - F.col("mean_2")).alias("half_diff"),
        ratio(F.col("_r1"), F.col("_r2")).alias("rms_ratio"), ratio(F.col("_m1"), F.col("_m2")).alias("median_ratio"),
    )


def profile_shift(df, keys, half: str, bin: str, power: str) -> DataFrame:
    """Distance of the mean spectra of two halves: L1 and log-spectral (dB)."""
    m = df.groupBy(*keys, bin).agg(
        F.avg(F.when(F.col(half) == 1, F.col(power))).alias("_a"), F.avg(F.when(F.col(half) == 2, F.col(power))).alias("_b")
    )
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    tot = m.groupBy(*keys).agg(F.sum(z("_a")).alias("_ta"), F.sum(z("_b")).alias("_tb"))
    j = m.join(tot, list(keys)).filter((F.col("_ta") >= 1e-9) & (F.col("_tb") >= 1e-9))
    d = 10 * (F.log10(z("_a") + 1e-12) - F.log10(z("_b") + 1e-12))
    return j.groupBy(*keys).agg(
        F.sum(F.abs(F.try_divide(z("_a"), F.col("_ta")) - F.try_divide(z("_b"), F.col("_tb")))).alias("l1"),
        F.sqrt(F.avg(d * d)).alias("lsd"),
    )


def tail_ratio(df, keys, frame: str, x: str, pct: float = 0.25, split=None) -> DataFrame:
    """Per frame mean below p / mean above 1 - p, then its CV over frames."""
    fk = [*keys, frame]
    q = quantiles(df, fk, x, split=split, _lo=pct, _hi=1 - pct)
    j = df.join(q, fk)
    lo, hi = F.when(F.col(x) < F.col("_lo"), F.col(x)), F.when(F.col(x) > F.col("_hi"), F.col(x))
    f = j.groupBy(*fk).agg(F.try_divide(F.coalesce(F.avg(lo), F.lit(0.0)), F.avg(hi)).alias("_r"))
    out = f.filter(F.col("_r").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), F.avg("_r").alias("mean_ratio"), (F.stddev_pop("_r") / (F.avg("_r") + 1e-6)).alias("ratio_cv")
    )
    return out.filter(F.col("n_frames") >= 3).withColumn("score", clamp((F.col("ratio_cv") - 0.08) / 0.25))


def highlight_scores(df, keys, frame: str, v: str, s: str, bright: float = 220.0, grey: float = 40.0) -> DataFrame:
    """Share of bright, unsaturated pixels per frame and their mean brightness; ramps over the CVs across frames.

    Frames without such a pixel have a share of 0 and no brightness.
    """
    on = F.coalesce((F.col(v) > bright) & (F.col(s) < grey), F.lit(False))
    f = df.groupBy(*keys, frame).agg(F.avg(on.cast("double")).alias("_r"), F.avg(F.when(on, F.col(v))).alias("_i"))
    spread = lambda c: F.stddev_pop(c) / (F.avg(c) + 1e-6)
    g = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"), F.avg("_r").alias("highlight_ratio"), spread("_r").alias("area_cv"), spread("_i").alias("intensity_cv"))
    return g.withColumns({"distribution_score": clamp((F.col("area_cv") - 0.30) / 1.0), "intensity_score": F.coalesce(clamp((F.col("intensity_cv") - 0.05) / 0.20), F.lit(0.0))})


def shadow_coverage(df, keys, frame: str, cell: str, x: str, pct: float = 0.20, sigma: float = 2.5, split=None) -> DataFrame:
    """Share of shadow (below the frame's own ``pct`` quantile) per cell, averaged over frames; CV over cells and cells beyond ``sigma``."""
    fk = [*keys, frame]
    j = df.join(quantiles(df, fk, x, split=split, _lo=pct), fk)
    c = j.groupBy(*fk, cell).agg(F.avg((F.col(x) < F.col("_lo")).cast("double")).alias("_r")).groupBy(*keys, cell).agg(F.avg("_r").alias("_r"))
    st = c.groupBy(*keys).agg(F.avg("_r").alias("_m"), F.stddev_pop("_r").alias("_s"))
    out = F.count(F.when((F.col("_s") > 0) & (F.abs(F.col("_r") - F.col("_m")) > sigma * F.col("_s")), 1))
    return c.join(st, list(keys)).groupBy(*keys).agg(F.max("_m").alias("shadow_ratio"), (F.max("_s") / (F.max("_m") + 1e-6)).alias("shadow_cv"), out.alias("n_regions"))


def noise_level(px, side: int, top: float = 1.0) -> Column:
    """Standard deviation of the 3x3 high-pass (8 x centre minus neighbours) of a row-major block.

    As for stored pixels the response is cut to 0..``top``; the block is mirrored at its edge.
    """
    at = lambda i: side - 1 - abs(side - 1 - abs(i))
    near = [[at(r + a) * side + at(c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)] for r in range(side) for c in range(side)]
    around = F.transform(F.lit(near), lambda n: 9 * F.get(px, F.get(n, F.lit(4))) - F.aggregate(n, F.lit(0.0), lambda s, i: s + F.get(px, i)))
    return let(F.transform(around, lambda e: clamp(e, 0.0, top)), lambda h: let(vsum(h) / side**2, lambda m: F.sqrt(F.aggregate(h, F.lit(0.0), lambda s, e: s + (e - m) * (e - m)) / side**2)))


def frame_metrics(blocks, keys, order, px: str, side: int = 8, split=None) -> DataFrame:
    """Brightness, contrast, blockiness, noise per block row and SSIM to the next.

    ``px`` is a row-major block; neighbour differences stay inside the array.
    """
    v = F.transform(px, lambda e: e.cast("double"))
    n = side * side
    b = blocks.withColumn("_v", v)
    mean = vsum(F.col("_v")) / n
    b = b.withColumn("brightness", mean).withColumn("_c", F.transform("_v", lambda e: e - F.col("brightness")))
    b = b.withColumn("_var", F.aggregate("_c", F.lit(0.0), lambda s, e: s + e * e) / n)
    pair = lambda step, keep: F.aggregate(
        F.filter(F.zip_with(F.slice("_v", 1, n - step), F.slice("_v", step + 1, n - step), lambda a, c: F.abs(c - a)), keep) if keep
        else F.zip_with(F.slice("_v", 1, n - step), F.slice("_v", step + 1, n - step), lambda a, c: F.abs(c - a)),
        F.lit(0.0), lambda s, e: s + e,
    )
    dx = pair(1, lambda e, i: F.pmod(i, F.lit(side)) != side - 1) / (side * (side - 1))
    dy = pair(side, None) / (side * (side - 1))
    lap = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.pmod(i, F.lit(side)).between(1, side - 2)) & (F.floor(i / side).between(1, side - 2))),
        lambda i: F.get("_v", i - 1) + F.get("_v", i + 1) + F.get("_v", i - side) + F.get("_v", i + side) - 4 * F.get("_v", i),
    )
    b = b.withColumn("contrast", F.sqrt("_var")).withColumn("blockiness", dx + dy).withColumn("_l", lap)
    lm = F.try_divide(vsum(F.col("_l")), F.size("_l"))
    b = b.withColumn("sharpness", F.try_divide(F.aggregate("_l", F.lit(0.0), lambda s, e: s + e * e), F.size("_l")) - lm * lm)
    b = b.withColumn("noise", noise_level(F.col("_v"), side))
    o = Ordered(b, keys, order, after=1, split=split)
    o.add(_nm=o.next("brightness"), _nvar=o.next("_var"), _nc=o.next("_c"))
    cov = F.aggregate(F.zip_with("_c", "_nc", lambda a, c: a * c), F.lit(0.0), lambda s, e: s + e) / n
    # structural similarity constants for a unit dynamic range
    c1, c2 = 0.01**2, 0.03**2
    ssim = ((2 * F.col("brightness") * F.col("_nm") + c1) * (2 * cov + c2)) / (
        (F.col("brightness") * F.col("brightness") + F.col("_nm") * F.col("_nm") + c1) * (F.col("_var") + F.col("_nvar") + c2)
    )
    out = o.rows().withColumn("ssim", F.when(F.col("_nm").isNotNull(), ssim))
    return out.drop("_v", "_c", "_l", "_var", "_nm", "_nvar", "_nc")


def bhattacharyya(left: DataFrame, right: DataFrame, keys, bin: str, n: str) -> DataFrame:
    """Histogram distance sqrt(1 - sum sqrt(p q)) between two count tables."""
    p = left.select(*keys, bin, F.col(n).alias("_a")).join(right.select(*keys, bin, F.col(n).alias("_b")), [*keys, bin], "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    s = p.groupBy(*keys).agg(F.sum(F.sqrt(z("_a") * z("_b"))).alias("_x"), F.sum(z("_a")).alias("_ta"), F.sum(z("_b")).alias("_tb"))
    return s.select(*keys, F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.col("_x"), F.sqrt(F.col("_ta") * F.col("_tb"))), F.lit(0.0)))).alias("distance"))


def entropy(df, keys, value: str, split=None) -> DataFrame:
    """Shannon entropy of values in bits and number of local count maxima."""
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    tot = c.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    p = F.col("_n") / F.col("_t")
    h = c.join(tot, list(keys)).groupBy(*keys).agg(F.sum(-p * F.log2(p)).alias("entropy"), F.count(F.lit(1)).alias("n_values"))
    o = Ordered(c, keys, [value], before=1, after=1, split=split)
    # neighbours must be adjacent values, an absent value counts zero
    pv, pn, nv, nn = o.prev(value), o.prev("_n"), o.next(value), o.next("_n")
    left = F.when(pv == F.col(value) - 1, pn).otherwise(0)
    right = F.when(nv == F.col(value) + 1, nn).otherwise(0)
    peaks = o.add(_pk=(F.col("_n") > left) & (F.col("_n") > right)).rows().groupBy(*keys).agg(F.count(F.when(F.col("_pk"), 1)).alias("n_peaks"))
    return h.join(peaks, list(keys))


def fingerprint(df, keys, vec: str, block: int = 8, min_frames: int = 50) -> DataFrame:
    """Element-wise mean, divided by (block variance + mean variance), with quality."""
    e = df.select(*keys, F.posexplode(vec).alias("pos", "_x"))
    m = e.groupBy(*keys, "pos").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    b = m.groupBy(*keys, F.floor(F.col("pos") / block).alias("_b")).agg(
        F.greatest(F.var_pop("_m"), F.lit(1e-6)).alias("_v"), F.count(F.lit(1)).alias("_w"),
        F.collect_list(F.struct("pos", "_m")).alias("_e"), F.max("_n").alias("_n"),
    )
    g = b.groupBy(*keys).agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("_mv"), F.max("_n").alias("n_frames"))
    x = b.drop("_n").join(g, list(keys)).select(*keys, "n_frames", F.explode(F.transform("_e", lambda s: F.struct(
        s["pos"].alias("pos"), (s["_m"] / (F.col("_v") + F.col("_mv"))).alias("f")))).alias("s"))
    out = x.groupBy(*keys, "n_frames").agg(F.sort_array(F.collect_list("s")).alias("_s"), F.stddev_pop("s.f").alias("fp_std"))
    q = 0.6 * F.least(F.lit(1.0), F.col("n_frames") / min_frames) + 0.4 * F.least(F.lit(1.0), F.col("fp_std") / 0.5)
    return out.select(*keys, "n_frames", F.transform("_s", lambda s: s["f"]).alias("fingerprint"), "fp_std", q.alias("quality"))


def radial_profile(df, keys, dx: Column, dy: Column, mag: str) -> DataFrame:
    """Mean magnitude per integer radius."""
    r = F.floor(F.sqrt(dx * dx + dy * dy)).cast("int")
    return df.groupBy(*keys, r.alias("radius")).agg(F.avg(mag).alias("level"))


def radial_periodicity(profile, keys, radius: str, level: str, lags: tuple[int, int], gain: float = 4.0) -> DataFrame:
    """Mean |autocorrelation| over a lag band, and radii above 3.5 sigma.

    The profile holds one number per radius; each row is sent to the lags it
    takes part in, so the lag join is an equi-join of a few copies per row.
    """
    st = profile.groupBy(*keys).agg(F.avg(level).alias("_m"), F.stddev_pop(level).alias("_s"), F.count(F.lit(1)).alias("n_radii"))
    j = profile.join(st, list(keys)).withColumn("_z", F.when(F.col("_s") > 1e-8, (F.col(level) - F.col("_m")) / F.col("_s")).otherwise(0.0))
    a = j.select(*keys, F.col(radius).alias("_r"), "_z")
    b = a.select(*keys, F.explode(F.sequence(F.lit(lags[0]), F.lit(lags[1]))).alias("_lag"), F.col("_r").alias("_r2"), F.col("_z").alias("_z2"))
    c = b.withColumn("_r", F.col("_r2") - F.col("_lag")).join(a, [*keys, "_r"]).groupBy(*keys, "_lag").agg(F.sum(F.col("_z") * F.col("_z2")).alias("_c"))
    c0 = j.groupBy(*keys).agg(F.sum(F.col("_z") * F.col("_z")).alias("_c0"), F.count(F.when(F.col(level) > F.col("_m") + 3.5 * F.col("_s"), 1)).alias("n_peaks"), F.max("n_radii").alias("n_radii"))
    p = c.groupBy(*keys).agg(F.sum(F.abs("_c")).alias("_sum"), F.count(F.lit(1)).alias("_k"))
    out = c0.join(p, list(keys), "left")
    per = F.least(F.lit(1.0), gain * F.col("_sum") / F.col("_k") / (F.col("_c0") + 1e-8))
    return out.select(*keys, "n_radii", "n_peaks", F.coalesce(per, F.lit(0.0)).alias("periodicity"))


# A20 fixed values: base and step of confidence, its cap, bonus per HIGH (one, two or more).
MODULE_CONFIDENCE = {
    "enf": (0.50, 0.08, 0.92, 0.0, 0.0),
    "noise": (0.45, 0.08, 0.88, 0.10, 0.10),
    "compression": (0.45, 0.09, 0.90, 0.0, 0.0),
    "reverberation": (0.40, 0.09, 0.85, 0.0, 0.0),
    "voice": (0.42, 0.09, 0.88, 0.0, 0.0),
    "metadata": (0.40, 0.10, 0.85, 0.08, 0.15),
}


def pick(module: Column, table: Mapping[str, float], default: float) -> Column:
    """Constant by module name as a literal expression (no join)."""
    out = None
    for k, v in table.items():
        out = F.when(module == k, F.lit(v)) if out is None else out.when(module == k, F.lit(v))
    return out.otherwise(F.lit(default))


# Confidence without any check, and the factor on mains analysis without a mains signal.
IDLE_CONFIDENCE = {"reverberation": 0.40, "voice": 0.40}
MAINS_ABSENT_FACTOR = 0.35


def module_score(checks, keys, module: str, score: str, weight: str, severity: str, mains_present: Column | None = None) -> DataFrame:
    """Weighted mean of fired checks, confidence by count, HIGH bonus.

    A check without a score only informs and doesn't count. ``mains_present``: a boolean of the
    checks' rows; where no row of a key has it, the mains module's confidence falls.
    """
    checks = checks.withColumn("_mains", F.lit(True) if mains_present is None else mains_present).filter(F.col(score).isNotNull())
    g = checks.groupBy(*keys, module).agg(
        F.count(F.lit(1)).alias("n_checks"), F.count(F.when(F.col(severity) == "high", 1)).alias("n_high"),
        F.try_divide(F.sum(F.col(score) * F.col(weight)), F.sum(weight)).alias("_s"), F.bool_or("_mains").alias("_mains"),
    )
    m = F.col(module)
    part = lambda i: {k: v[i] for k, v in MODULE_CONFIDENCE.items()}
    bonus = F.when(F.col("n_high") >= 2, pick(m, part(4), 0.0)).when(F.col("n_high") == 1, pick(m, part(3), 0.0)).otherwise(0.0)
    conf = F.least(pick(m, part(2), 0.9), pick(m, part(0), 0.45) + pick(m, part(1), 0.08) * F.col("n_checks"))
    conf = conf * F.when((m == "enf") & ~F.col("_mains"), MAINS_ABSENT_FACTOR).otherwise(1.0)
    return g.select(*keys, module, "n_checks", "n_high", F.least(F.lit(1.0), F.col("_s") + bonus).alias("score"), conf.alias("confidence"))


def subscore_mix(df, keys, name: str, score: str, weights: Mapping[str, float]) -> DataFrame:
    """Fixed-weight sum of named sub-scores, clamped; absent ones count 0."""
    return df.groupBy(*keys).agg(
        clamp(F.sum(F.coalesce(F.col(score), F.lit(0.0)) * pick(F.col(name), weights, 0.0))).alias("score"),
        F.count(F.when(F.col(name).isin(*weights), 1)).alias("n_parts"),
    )


# A22 fixed values: points per severity.
POINTS = {"high": 25.0, "medium": 12.0, "low": 4.0}


def points_verdict(findings, keys, domain: str, severity: str, kind: str, tampered: float = 80.0, review: float = 30.0) -> DataFrame:
    """Capped points per domain, 0.4/0.6 blend, multi-signal gate, edit type, top types.

    Severities compare without case.
    """
    sev = F.lower(severity)
    pts = pick(sev, POINTS, 0.0)
    is_t, is_s = F.col(domain) == "temporal", F.col(domain) == "spatial"
    hi = sev == "high"
    g = findings.groupBy(*keys).agg(
        F.least(F.lit(100.0), F.sum(F.when(is_t, pts).otherwise(0.0))).alias("temporal_score"),
        F.least(F.lit(100.0), F.sum(F.when(is_s, pts).otherwise(0.0))).alias("spatial_score"),
        F.count(F.when(is_t, 1)).alias("_nt"), F.count(F.when(is_s, 1)).alias("_ns"),
        F.count(F.when(hi & is_t, 1)).alias("_ht"), F.count(F.when(hi & is_s, 1)).alias("_hs"),
        F.count(F.lit(1)).alias("n_findings"), F.concat_ws(",", F.sort_array(F.collect_set(kind))).alias("types"),
    )
    conf = F.round(F.col("temporal_score") * 0.4 + F.col("spatial_score") * 0.6, 1)
    multi = (F.col("_ht") + F.col("_hs") >= 2) | ((F.col("_ht") > 0) & (F.col("_hs") > 0))
    return g.select(
        *keys, "n_findings", "temporal_score", "spatial_score", conf.alias("confidence"),
        F.when((conf >= tampered) & multi, "LIKELY_TAMPERED").when(conf >= review, "REVIEW_RECOMMENDED").otherwise("LIKELY_AUTHENTIC").alias("verdict"),
        F.when((F.col("_nt") > 0) & (F.col("_ns") > 0), "BOTH").when(F.col("_nt") > 0, "TEMPORAL_EDIT").when(F.col("_ns") > 0, "CONTENT_MANIPULATION").otherwise("NONE").alias("edit_type"),
        "types",
    )


def top_types(findings, keys, domain: str, severity: str, kind: str, n: int = 3) -> DataFrame:
    """Per domain the ``n`` types with the gravest finding (then by name), with counts."""
    by = [*keys, domain]
    t = findings.groupBy(*by, kind).agg(F.max(severity_rank(F.col(severity))).alias("_r"), F.count(F.lit(1)).alias("_n"), F.count(F.when(F.lower(severity) == "high", 1)).alias("_h"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_r"), kind))
    t = t.withColumn("_q", rank)
    listed = F.sort_array(F.collect_list(F.when(F.col("_q") <= n, F.struct("_q", kind))))
    return t.groupBy(*by).agg(F.sum("_n").alias("n_findings"), F.sum("_h").alias("n_high"), F.array_join(F.transform(listed, lambda e: e[kind]), ",").alias("top_types"))


def mean_max_blend(df, keys, x: str, mean_w: float = 0.7, max_w: float = 0.3, flag: float = 30.0) -> DataFrame:
    """Frame scores to an asset score."""
    return df.groupBy(*keys).agg(
        F.round(F.least(F.lit(100.0), F.avg(x) * mean_w + F.max(x) * max_w), 1).alias("score"),
        F.count(F.when(F.col(x) > flag, 1)).alias("n_flagged"), F.count(x).alias("n_frames"),
    )


# A24 fixed values: module weights of the confidence blend.
BLEND_WEIGHTS = {"integrity": 0.30, "speaker_match": 0.25, "enf": 0.20, "events": 0.15, "duplicates": 0.10}


def confidence_blend(df, keys, module: str, confidence: str, issues: str, weights: Mapping[str, float] = BLEND_WEIGHTS) -> DataFrame:
    """Half renormalised weighted mean, half worst module, minus 0.20 per flagged module."""
    w = pick(F.col(module), weights, 0.0)
    on = F.col(confidence).isNotNull() & F.col(module).isin(*weights)
    g = df.groupBy(*keys).agg(
        F.try_divide(F.sum(F.when(on, F.col(confidence) * w)), F.sum(F.when(on, w))).alias("_avg"),
        F.min(F.when(on, F.col(confidence))).alias("_min"), F.count(F.when(on & (F.col(issues) > 0), 1)).alias("n_flagged"),
    )
    score = F.round(clamp(0.5 * F.col("_avg") + 0.5 * F.col("_min") - 0.20 * F.col("n_flagged")), 3)
    return g.select(*keys, "n_flagged", F.coalesce(score, F.lit(0.5)).alias("score"))


def divergent_fraction(df, keys, frame: str, x: str, ratio: float = 3.0, min_mean: float = 0.1) -> DataFrame:
    """Share of blocks above ``ratio`` x frame mean, averaged over moving frames."""
    st = df.groupBy(*keys, frame).agg(F.avg(x).alias("_m")).filter(F.col("_m") >= min_mean)
    f = df.join(st, [*keys, frame]).groupBy(*keys, frame).agg(F.avg((F.col(x) > ratio * F.col("_m")).cast("double")).alias("_f"))
    return f.groupBy(*keys).agg(F.avg("_f").alias("divergent_fraction"), F.count(F.lit(1)).alias("n_frames"))


def rate_severity(rate, high: float, medium: float) -> Column:
    """High, medium or null (no finding) of a rate."""
    return F.when(rate >= high, "high").when(rate >= medium, "medium")


def residual_rate(df, keys, inliers: str, cut: float = 0.4, high: float = 0.5, medium: float = 0.25) -> DataFrame:
    """Share of the analysed frame pairs (one row each, null: not analysed) with an inlier ratio below ``cut``."""
    g = df.groupBy(*keys).agg(F.count(inliers).alias("n_pairs"), F.avg((F.col(inliers) < cut).cast("double")).alias("residual_rate"))
    return g.filter("n_pairs > 0").withColumn("severity", rate_severity(F.col("residual_rate"), high, medium))


def signal_type(df, keys, zcr: str, rms: str, hf: str, high: tuple[float, float, float] = (0.10, 0.80, 0.25), low: tuple[float, float] = (0.02, 0.08)) -> DataFrame:
    """Music, phone_speech or speech from frames with zero-crossing rate, level and HF energy share.

    Music needs all three votes (mean crossing rate, level CV and HF share above ``high``); phone
    speech a HF share and crossing rate below ``low``; all else is speech. The published text
    names the features and the votes; the cut-offs are parameters.
    """
    g = df.groupBy(*keys).agg(F.avg(zcr).alias("zcr"), F.try_divide(F.stddev_pop(rms), F.avg(rms)).alias("level_cv"), F.avg(hf).alias("hf_share"))
    votes = sum((F.coalesce(F.col(c) > v, F.lit(False)).cast("int") for c, v in zip(("zcr", "level_cv", "hf_share"), high)), F.lit(0))
    kind = F.when(votes >= 3, "music").when((F.col("hf_share") < low[0]) & (F.col("zcr") < low[1]), "phone_speech").otherwise("speech")
    return g.withColumn("music_votes", votes).withColumn("kind", kind)


def integrity_confidence(clip_ratio: Column, dc: Column, n_gaps: Column, clip_gain: float = 10.0) -> Column:
    """1 minus penalties: clipping above 0.1 % (``clip_gain`` x ratio, 0.5 at most), DC above 0.05 (0.15), 0.15 per long gap (0.4 at most)."""
    clip = F.when(clip_ratio > 0.001, F.least(F.lit(0.5), clip_ratio * clip_gain)).otherwise(0.0)
    return clamp(1.0 - clip - F.when(F.abs(dc) > 0.05, 0.15).otherwise(0.0) - F.least(F.lit(0.4), n_gaps * 0.15))


def completeness(df, keys, fields: Sequence[str]) -> DataFrame:
    """Share of non-null fields per key."""
    present = sum((F.col(c).isNotNull().cast("double") for c in fields), F.lit(0.0)) / len(fields)
    return df.groupBy(*keys).agg(F.avg(present).alias("completeness"), F.count(F.lit(1)).alias("n"))


def finding_rollup(findings, module: str, severity: str, cube: bool = False) -> DataFrame:
    """Counts by module and severity with TOTAL rows."""
    g = findings.cube(module, severity) if cube else findings.rollup(module, severity)
    out = g.agg(F.count(F.lit(1)).alias("n"), F.grouping(module).alias("_gm"), F.grouping(severity).alias("_gs"))
    name = lambda c, flag: F.when(F.col(flag) == 1, "TOTAL").otherwise(F.col(c)).alias(c)
    return out.select(name(module, "_gm"), name(severity, "_gs"), "n")


def case_summary(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Findings, modules with findings, highest severity and the modules with high ones, per case.

    Modules are a closed set, so the set gathered per case is small.
    """
    high = F.when(F.lower("severity") == "high", F.col("module"))
    out = findings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_findings"), F.countDistinct("module").alias("modules_completed"), severity_name(F.max(severity_rank(F.col("severity")))).alias("highest_severity"),
        F.array_join(F.sort_array(F.collect_set(high)), ",").alias("high_modules"),
    )
    return out.withColumn("high_modules", F.nullif("high_modules", F.lit("")))


def distinct_tags(tags: DataFrame, by: Sequence[str], value: str, owner: str, lg: int = 12) -> DataFrame:
    """Rows, owners and different values per group, exactly and as a sketch that can be merged over runs.

    Exact counts come from one row per (group, value) and (group, owner), never from a set in memory.
    """
    per_value = tags.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    v = per_value.groupBy(*by).agg(F.sum("_n").alias("n_tags"), F.count(F.lit(1)).alias("n_values"), F.max_by(value, F.struct("_n", value)).alias("top_value"), F.max("_n").alias("n_top"), F.hll_sketch_agg(value, lg).alias("sketch"))
    o = tags.filter(F.col(value).isNotNull()).select(*by, owner).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_owners"))
    r = o.withColumnsRenamed({k: f"_r_{k}" for k in by})
    cond = F.lit(True)
    for k in by:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return v.join(r, cond).drop(*[f"_r_{k}" for k in by])


def merge_tag_sketches(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Estimated number of different values over several runs of ``distinct_tags``."""
    return runs.groupBy(*by).agg(F.sum("n_tags").alias("n_tags"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_values_estimate"))
