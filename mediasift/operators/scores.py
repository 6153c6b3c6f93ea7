"""Sub-score formulas of the detectors over summary columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.functions.exprs import clamp, explode_rules, finding, steps, tiers

# Sub-score weights of each video detector.
SUB_WEIGHTS = {
    "compression": {"dct": 0.40, "bitrate": 0.35, "gop": 0.25},
    "noise": {"prnu_consistency": 0.40, "prnu_temporal": 0.25, "prnu_spatial": 0.20, "noise_pattern": 0.15},
    "temporal": {"duplication": 0.45, "flow": 0.40, "similarity": 0.15},
    "audio": {"spectral": 0.60, "sync": 0.40},
    "lighting": {"illumination": 0.40, "shadow": 0.35, "colour_temp": 0.25},
}


def enf_checks(df: DataFrame, keys: Sequence[str], min_frames: int = 6) -> DataFrame:
    """Mains-frequency checks. Expects n_frames, discontinuity, freq_std, enf_present, snr_fund, snr_harm."""
    return explode_rules(df, keys, enf_rules(F.col, min_frames))


def enf_rules(c, min_frames: int = 6) -> list[Column]:
    """Rule columns of ``enf_checks``; ``c`` gives the column of a name."""
    enough = c("n_frames") >= min_frames
    d, s = c("discontinuity"), c("freq_std")
    f = lambda ty, sev, conf, score, w: finding("enf", ty, sev, conf, score, w)
    return [
        F.when(enough & (d >= 4), f("phase", "high", F.when(c("enf_present"), 0.82).otherwise(0.52), F.least(F.lit(0.90), 0.65 + (d - 4) * 0.04), 2.0))
        .when(enough & (d >= 2.5), f("phase", "medium", F.when(c("enf_present"), 0.65).otherwise(0.38), 0.45 + (d - 2.5) * 0.05, 2.0)),
        F.when(enough & c("enf_present") & (s >= 0.10), f("drift", "medium", 0.55, F.least(F.lit(0.6), 0.4 + (s - 0.10) * 2), 0.6))
        .when(enough & c("enf_present") & (s >= 0.05), f("drift", "low", 0.55, 0.25, 0.6)),
        F.when((c("snr_harm") > -2) & (c("snr_fund") <= -2), f("harmonic_only", "low", 0.45, 0.20, 0.3)),
        # informs only: no score
        F.when(~c("enf_present"), f("absent", "low", 0.90, F.lit(None).cast("double"), 0.0)),
    ]


def pitch_checks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pitch change and stability. Expects f0_ratio (of the halves' medians, >= 1), f0_max_z, f0_cv, change_t, duration.

    A ratio of 1.6 or more, else a z of 6 or more, is a change; variation of 0.15 or more only
    counts where the ratio doesn't already explain it. The change lies one second around its time, inside
    the duration (null: unknown); a change without a time has no place.
    """
    return explode_rules(df, keys, pitch_rules(F.col))


def pitch_rules(c) -> list[Column]:
    """Rule columns of ``pitch_checks``; ``c`` gives the column of a name."""
    r, z, t = c("f0_ratio"), c("f0_max_z"), c("change_t")
    f = lambda ty, sev, conf, score, w, **at: finding("voice", ty, sev, conf, score, w, **at)
    # least and greatest pass nulls over: only a known time makes a place
    at = {"start": F.when(t.isNotNull(), F.greatest(F.lit(0.0), t - 1)), "end": F.when(t.isNotNull(), F.least(c("duration"), t + 1))}
    return [
        F.when(r >= 1.6, f("pitch_change", "high", 0.88, F.least(F.lit(0.85), 0.60 + (r - 1.6) * 0.25), 2.0, **at))
        .when(z >= 6, f("pitch_change", "medium", 0.70, 0.40 + F.least((z - 6) / 40, F.lit(0.25)), 2.0, **at)),
        F.when((c("f0_cv") >= 0.15) & ~F.coalesce(r >= 1.6, F.lit(False)), f("pitch_unstable", "low", 0.50, 0.18, 0.5)),
    ]


def lowpass_checks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Low-pass edge, expectation, moving ceiling, bandwidth use.

    Expects steepness, total_drop, cutoff, ceiling_hz, n_segments, ceiling_cv, uncompressed (PCM, FLAC or
    unknown codec), lossy, bitrate_kbps, nyquist.
    """
    return explode_rules(df, keys, lowpass_rules(F.col))


def lowpass_rules(c) -> list[Column]:
    """Rule columns of ``lowpass_checks``; ``c`` gives the column of a name."""
    st = c("steepness")
    edge = (st >= 20) & (c("total_drop") >= 15)
    base = F.when(st >= 40, F.least(F.lit(0.85), 0.60 + (st - 40) / 200)).otherwise(0.40 + (st - 20) / 100)
    expected = F.least(c("ceiling_hz"), 0.98 * c("nyquist"))
    deficit = F.try_divide(expected - c("cutoff"), expected) * 100
    want = 0.65 * F.least(c("bitrate_kbps") * 1000 / 16, 0.9 * c("nyquist"))
    f = lambda ty, sev, conf, score, w: finding("compression", ty, sev, conf, score, w)
    return [
        F.when(c("uncompressed") & edge, f("lowpass", "high", 0.88, F.least(F.lit(0.90), base + 0.10), 2.0)),
        F.when(c("ceiling_hz").isNotNull() & c("cutoff").isNotNull() & (deficit > 25), f("expectation", "medium", 0.65, F.least(F.lit(0.6), 0.3 + deficit / 200), 1.0)),
        F.when(c("uncompressed") & (c("n_segments") >= 5) & (c("ceiling_cv") > 0.12), f("moving_ceiling", "medium", 0.65, 0.40, 0.8)),
        F.when(c("lossy") & (c("bitrate_kbps") > 0) & (st >= 20) & (c("cutoff") < want), f("bandwidth_use", "medium", 0.60, 0.35, 0.7)),
    ]


def spectral_score(centroid: Column, rms: Column, profile: Column, onset: Column) -> Column:
    """Audio-track discontinuity of a video."""
    a = tiers(centroid, [(10, 0.20, 0.50), (30, 0.50, 1.0)], (60, 1.0))
    b = tiers(rms, [(15, 0.15, 0.15), (40, 0.40, 0.80)], (80, 0.80))
    p = tiers(profile, [(0.60, 0.20, 0.20), (0.85, 0.40, 0.70)], (1.10, 0.70))
    n = sum(((x).cast("int") for x in (a > 0.30, b > 0.20, p > 0.25, onset > 50)), F.lit(0))
    return F.least(F.lit(1.0), F.greatest(a, b, p * 0.80) + F.when(n >= 3, 0.10).otherwise(0.0))


def illumination_score(abrupt: Column, n_spikes: Column, direction: Column, colour: Column) -> Column:
    """Strongest of the lighting signals."""
    spikes = F.when(n_spikes > 0, 0.50 + 0.05 * F.least(n_spikes, F.lit(5))).otherwise(0.0)
    return clamp(F.greatest(abrupt * 0.85, spikes, direction * 0.40, colour * 0.35))


def shadow_score(direction: Column, distribution: Column, intensity: Column, n_regions: Column) -> Column:
    """Shadow direction, highlight area and highlight brightness; more than three odd regions count 0.30 at least."""
    score = 0.50 * direction + 0.30 * distribution + 0.20 * intensity
    return clamp(F.greatest(score, F.when(n_regions > 3, 0.30).otherwise(0.0)))


def fingerprint_score(consistency: Column, drop_rate: Column, region_rate: Column, std: Column, n: Column, device: Column) -> Column:
    """Sensor-noise sub-score, strongest signal wins; a null device reference is ignored."""
    own = F.when(consistency < 0, 0.65).when(consistency < 0.02, 0.50).when(consistency < 0.05, 0.30).otherwise(0.0)
    drops = steps(drop_rate, [(0.20, 0.70), (0.10, 0.55), (0.05, 0.40)])
    regions = steps(region_rate, [(0.30, 0.65), (0.15, 0.45)])
    dev = F.when(device < 0.30, 0.75).when(device < 0.50, 0.50).otherwise(0.0)
    return F.greatest(own, drops, regions, F.when((std > 0.08) & (n >= 20), 0.45).otherwise(0.0), dev)


def noise_pattern_score(variance: Column, skew: Column, freq: Column, n_regions: Column) -> Column:
    """Variance and frequency signals count fully only together."""
    both = F.when((variance > 0.30) & (freq > 0.30), 0.5 * variance + 0.5 * freq).when(freq > 0.50, freq * 0.50).when(variance > 0.50, variance * 0.25).otherwise(0.0)
    return clamp(0.70 * both + 0.20 * skew + 0.10 * F.least(F.lit(1.0), n_regions / 5.0))


def uncertainty(module: Column, n_frames: Column, reliable: Column, low_resolution: Column, has_audio: Column) -> Column:
    """Detector uncertainty by its own rule."""
    noise = F.when(reliable, 0.12).otherwise(0.25) + F.when(low_resolution, 0.08).otherwise(0.0)
    temporal = F.round(0.10 + 0.10 * (1 - F.least(F.lit(1.0), n_frames / 150)), 3)
    return F.when(module == "noise", noise).when(module == "temporal", temporal).when(module == "audio", F.when(has_audio, 0.15).otherwise(0.35)).when(module == "lighting", 0.18)
