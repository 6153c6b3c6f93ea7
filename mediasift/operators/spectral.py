"""T: framed spectra and block transforms.

Windows are formed by a shuffle on (asset, window), so one long asset is spread
over as many tasks as it has windows. Only the FFT and the matrix product run in
Arrow batches; everything around them is DataFrame code.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.functions.exprs import let, vsum
from mediasift.operators.ordered import Ordered

PI = 3.141592653589793


def frames(df: DataFrame, keys: Sequence[str], index: str, value: str, win: int, hop: int) -> DataFrame:
    """Overlapping windows as one row each: (keys, win, samples).

    A sample goes to every window that covers it (win / hop copies); short
    windows at the end are dropped.
    """
    i = F.col(index).cast("bigint")
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((i - win) / hop) + 1)
    e = df.select(*keys, i.alias("_i"), F.col(value).cast("double").alias("_x"), F.explode(F.sequence(first, F.floor(i / hop))).alias("win"))
    g = e.groupBy(*keys, "win").agg(F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_s"))
    return g.filter(F.size("_s") == win).select(*keys, "win", F.transform("_s", lambda s: s["_x"]).alias("samples"))


def power_spectrum(samples: Column, taper: str = "hann") -> Column:
    """|rFFT|^2 of each window, batched over Arrow."""

    @F.pandas_udf("array<double>")
    def fft(s: pd.Series) -> pd.Series:
        out = [None] * len(s)
        sizes = s.map(len).to_numpy()
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            x = np.stack(s.iloc[at].to_numpy())
            w = np.hanning(n) if taper == "hann" else 1 - ((np.arange(n) - (n - 1) / 2) / ((n - 1) / 2)) ** 2
            p = np.abs(np.fft.rfft(x * w, axis=1)) ** 2
            for j, row in zip(at, p):
                out[j] = row
        return pd.Series(out)

    return fft(samples)


def spectrum(framed: DataFrame, keys: Sequence[str], sr: float, win: int) -> DataFrame:
    """Long table (keys, win, bin, freq, power)."""
    s = framed.select(*keys, "win", power_spectrum(F.col("samples")).alias("_p"))
    return s.select(*keys, "win", F.posexplode("_p").alias("bin", "power")).withColumn("freq", F.col("bin") * (sr / win))


def band_power(df: DataFrame, keys: Sequence[str], t: Column, x: Column, freqs: dict[str, float]) -> DataFrame:
    """Exact DFT power at fixed frequencies, for even or uneven sampling.

    Two sums per frequency in one aggregate; no grid is joined.
    """
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(x * x).alias("energy")]
    for name, f in freqs.items():
        a = t * (2 * PI * f)
        aggs += [F.sum(x * F.cos(a)).alias(f"_c_{name}"), F.sum(x * F.sin(a)).alias(f"_s_{name}")]
    g = df.groupBy(*keys).agg(*aggs)
    power = {n: (F.col(f"_c_{n}") ** 2 + F.col(f"_s_{n}") ** 2) / F.col("n") for n in freqs}
    best = F.array_max(F.array(*[F.struct(p.alias("p"), F.lit(n).alias("n")) for n, p in power.items()]))
    return g.select(*keys, "n", "energy", *[p.alias(n) for n, p in power.items()], best["n"].alias("best"))


def band_snr(narrow: Column, energy: Column) -> Column:
    """Narrow band against everything else, in dB."""
    return 10 * F.log10((narrow + 1e-12) / (F.greatest(energy - narrow, F.lit(0.0)) + 1e-12))


def peak_track(spectra: DataFrame, keys: Sequence[str], power: str, step: float, lo: int = 1) -> DataFrame:
    """Strongest bin per window with parabolic refinement; ``power`` is an array."""
    body = F.slice(power, lo + 1, F.size(power))
    k = F.array_position(body, F.array_max(body)).cast("int") - 1 + lo
    at = lambda d: F.get(power, F.col("peak_bin") + d)
    s = spectra.withColumn("peak_bin", k)
    den = at(-1) - 2 * at(0) + at(1)
    shift = F.when(at(1).isNull() | (F.abs(den) < 1e-12), 0.0).otherwise(0.5 * (at(-1) - at(1)) / den)
    return s.select(*keys, "peak_bin", ((F.col("peak_bin") + F.coalesce(shift, F.lit(0.0))) * step).alias("peak_freq"), F.array_max(body).alias("peak_power"))


def features(spectra: DataFrame, keys: Sequence[str], order: Sequence[str], power: str, step: float, mid: tuple[float, float], high: float, split=None) -> DataFrame:
    """T4: centroid, -40 dB bandwidth, flatness, low/mid tilt, high share and positive flux per window."""
    tot = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, e: s + e)
    f = lambda i: i.cast("double") * step
    pick = lambda cond: F.aggregate(F.transform(power, lambda p, i: F.when(cond(f(i)), p).otherwise(0.0)), F.lit(0.0), lambda s, e: s + e)
    total = tot(F.col(power))
    cen = tot(F.transform(power, lambda p, i: p * f(i))) / (total + 1e-12)
    flat = F.exp(tot(F.transform(power, lambda p: F.log(p + 1e-12))) / F.size(power)) / (total / F.size(power) + 1e-12)
    floor = F.array_max(power) * 1e-4
    bw = let(floor, lambda m: F.array_max(F.transform(power, lambda p, i: F.when(p >= m, f(i)))))
    low, middle, hi = pick(lambda x: x < mid[0]), pick(lambda x: (x >= mid[0]) & (x < mid[1])), pick(lambda x: x >= high)
    o = Ordered(spectra.select(*keys, *order, power), keys, order, before=1, split=split)
    prev = o.prev(power)
    o.add(_p=prev)
    flux = tot(F.zip_with(power, "_p", lambda a, b: F.greatest(F.sqrt(a) - F.sqrt(b), F.lit(0.0))))
    return o.rows().select(
        *keys, *order, cen.alias("centroid"), bw.alias("bandwidth"), flat.alias("flatness"), (low / (middle + 1e-12)).alias("tilt"), (hi / (middle + 1e-12)).alias("hfe"), flux.alias("flux"),
    )


def autocorr_peak(framed: DataFrame, keys: Sequence[str], samples: str, sr: float, lags: tuple[int, int], voiced: float = 0.35) -> DataFrame:
    """T5: best normalised autocorrelation lag in a range and its frequency."""
    n = F.size(samples)
    corr = lambda lag: F.aggregate(
        F.zip_with(F.slice(samples, F.lit(1), n - lag), F.slice(samples, lag + 1, n - lag), lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e
    )
    energy = F.aggregate(samples, F.lit(0.0), lambda s, e: s + e * e)
    best = F.array_max(F.transform(F.sequence(F.lit(lags[0]), F.lit(lags[1])), lambda l: F.struct(corr(l).alias("c"), (-l).alias("l"))))
    s = framed.withColumn("_b", best).withColumn("_e", energy + 1e-12)
    return s.select(*keys, (-F.col("_b.l")).alias("lag"), (F.col("_b.c") / F.col("_e")).alias("peak"), (F.lit(sr) / -F.col("_b.l")).alias("f0"), (F.col("_b.c") / F.col("_e") > voiced).alias("voiced"))


def block_dct(px: Column, side: int = 8) -> Column:
    """Orthonormal 2-D DCT of row-major blocks; one matrix product per Arrow batch."""
    k = np.arange(side)
    c = np.cos(PI * (2 * k[None, :] + 1) * k[:, None] / (2 * side)) * np.sqrt(2 / side)
    c[0] /= np.sqrt(2)
    basis = np.kron(c, c).T

    @F.pandas_udf("array<double>")
    def dct(s: pd.Series) -> pd.Series:
        x = np.stack(s.to_numpy()).astype(np.float64)
        return pd.Series(list(x @ basis))

    return dct(px)


def residual_variance(pixels: DataFrame, keys: Sequence[str], y: str, x: str, v: str) -> DataFrame:
    """Pixel minus its 3 x 3 mean, then variance per asset frame.

    Each pixel is sent to the nine positions it takes part in, so any image size
    works with one aggregate; border means use the pixels that exist.
    """
    off = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    e = pixels.select(*keys, y, x, v, F.explode(off).alias("o"))
    g = e.groupBy(*keys, (F.col(y) + F.col("o.dy")).alias("_y"), (F.col(x) + F.col("o.dx")).alias("_x")).agg(
        F.avg(v).alias("_m"), F.max(F.when((F.col("o.dy") == 0) & (F.col("o.dx") == 0), F.col(v))).alias("_c")
    )
    r = F.col("_c") - F.col("_m")
    return g.filter(F.col("_c").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_pop(r).alias("residual_var"), F.avg(F.abs(r)).alias("residual_mean"))
