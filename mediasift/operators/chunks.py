"""Work on chunked signals (S4, T1, T2, W22): rows hold an array of samples and the place of its first one.

Chunks are cut at tile borders and sent to the tile they belong to, with the few samples
of a neighbour that a window reaches into. What is shuffled are arrays, never samples; a
tile is a key of its own, so a long recording spreads over as many tasks as it has tiles.
The chunks of an asset don't overlap; a hole between two of them ends the windows there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.config import ENF_BANDS
from mediasift.functions.exprs import let, vsum
from mediasift.operators.ordered import Ordered
from mediasift.operators.series import frozen_runs
from mediasift.session import durable
from mediasift.sources.media import scale_pcm

PI = 3.141592653589793


def pieces(chunks: DataFrame, keys: Sequence[str], start: str, samples: str, tile: int, reach: int = 0) -> DataFrame:
    """(keys, tile, at, samples): the parts of each chunk inside every tile [i tile, (i + 1) tile + reach)."""
    s, n = F.col(start).cast("bigint"), F.size(samples)
    c = chunks.filter(n > 0).select(*keys, s.alias("_s"), F.transform(samples, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("_x"))
    end = F.col("_s") + F.size("_x")
    c = c.withColumn("tile", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("_s") - reach) / tile)), F.floor((end - 1) / tile))))
    lo, hi = F.greatest("_s", F.col("tile") * tile), F.least(end, (F.col("tile") + 1) * tile + reach)
    cut = F.slice("_x", (lo - F.col("_s") + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))
    return c.filter(hi > lo).select(*keys, "tile", lo.alias("at"), cut.alias("samples"))


def chunk_frames(chunks: DataFrame, keys: Sequence[str], start: str, samples: str, win: int, hop: int, tile: int = 65_536) -> DataFrame:
    """Overlapping windows straight from chunks: (keys, win, samples).

    Window w covers samples w hop to w hop + win - 1, over as many chunks as it
    takes. A window that isn't whole (end of the asset, hole) is dropped. Null
    samples count as zero, null and empty chunks as absent.
    """
    size = -(-max(tile, win) // hop) * hop
    p = pieces(chunks, keys, start, samples, size, max(win - 1, 0))
    t = p.groupBy(*keys, "tile").agg(F.sort_array(F.collect_list(F.struct("at", "samples"))).alias("_p"))
    t = t.select(*keys, "tile", F.flatten(F.transform("_p", lambda e: e["samples"])).alias("_x"), F.transform("_p", lambda e: F.struct(e["at"].alias("a"), (e["at"] + F.size(e["samples"])).alias("b"))).alias("_p"))
    # stretches without a hole: start, end, and where the stretch begins in the joined samples
    run = lambda a, b, i: F.struct(a.alias("a"), b.alias("b"), i.alias("i"))
    last = lambda acc: F.element_at(acc, -1)
    grow = lambda acc, e: F.when(
        (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["b"] == e["a"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(run(last(acc)["a"], e["b"], last(acc)["i"]))),
    ).when(F.size(acc) > 0, F.concat(acc, F.array(run(e["a"], e["b"], last(acc)["i"] + last(acc)["b"] - last(acc)["a"])))).otherwise(F.array(run(e["a"], e["b"], F.lit(0).cast("bigint"))))
    t = t.select(*keys, "tile", "_x", F.aggregate("_p", F.lit([]).cast("array<struct<a:bigint,b:bigint,i:bigint>>"), grow).alias("_r"))

    # the windows of a tile are made in one expression and only they leave the row: the samples
    # of the tile are never copied to its windows, nor read as a whole for each of them
    def windows(x):
        def of_run(r):
            first = F.ceil(F.greatest(r["a"], F.col("tile") * size) / hop)
            stop = F.least(F.floor((r["b"] - win) / hop), F.floor(((F.col("tile") + 1) * size - 1) / hop))
            cut = lambda w: let(w * hop - r["a"] + r["i"], lambda o: F.transform(F.sequence(o, o + (win - 1)), lambda i: F.get(x, i.cast("int"))))
            one = lambda w: F.struct(w.alias("win"), cut(w).alias("samples"))
            return F.when(stop >= first, F.transform(F.sequence(first, stop), one)).otherwise(F.array().cast("array<struct<win:bigint,samples:array<double>>>"))

        return F.flatten(F.transform("_r", of_run))

    return t.select(*keys, F.explode(let(F.col("_x"), windows)).alias("_w")).select(*keys, "_w.win", "_w.samples")


def mix_chunks(chunks: DataFrame, keys: Sequence[str], ch: str, chunk: str, samples: str, dtype: str = "float") -> DataFrame:
    """(keys, chunk, mono, spread): mean over the channels and their distance, as arrays.

    One row per chunk and channel is shuffled. Where one channel is shorter, the others make the mean.
    """
    g = chunks.groupBy(*keys, chunk).agg(F.sort_array(F.collect_list(F.struct(F.col(ch).alias("c"), F.col(samples).alias("x")))).alias("_c"))
    cell = "struct<s:double,n:int,lo:double,hi:double>"
    one = lambda x: scale_pcm(x, dtype)
    step = lambda a, v: F.struct(
        (F.coalesce(a["s"], F.lit(0.0)) + F.coalesce(v, F.lit(0.0))).alias("s"), (F.coalesce(a["n"], F.lit(0)) + v.isNotNull().cast("int")).alias("n"), F.least(a["lo"], v).alias("lo"), F.greatest(a["hi"], v).alias("hi")
    ).cast(cell)
    acc = F.aggregate(F.filter("_c", lambda e: e["x"].isNotNull()), F.lit([]).cast(f"array<{cell}>"), lambda s, e: F.zip_with(s, F.transform(e["x"], one), step))
    g = g.withColumn("_m", acc)
    return g.select(*keys, chunk, F.transform("_m", lambda m: F.try_divide(m["s"], m["n"])).alias("mono"), F.transform("_m", lambda m: m["hi"] - m["lo"]).alias("spread"))


def chunk_identity(mixed: DataFrame, keys: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """Sample count, mean and whether all channels carry the same signal, from chunk sums."""
    c = mixed.select(*keys, F.size("mono").alias("_n"), vsum(F.col("mono")).alias("_s"), F.array_max("spread").alias("_d"))
    g = c.groupBy(*keys).agg(F.sum("_n").cast("bigint").alias("n_samples"), F.sum("_s").alias("_s"), F.max("_d").alias("_d"))
    return g.select(*keys, "n_samples", F.try_divide("_s", "n_samples").alias("mean"), (F.coalesce("_d", F.lit(0.0)) <= tolerance).alias("identical"))


def pause_frames(chunks: DataFrame, keys: Sequence[str], start: str, samples: str, frame: int = 512, ratio: float = 0.01, least: float = 0.001, split=None) -> DataFrame:
    """(keys, win, rms, peak, floor): frame RMS and the noise floor set by the asset's loudest frame."""
    f = chunk_frames(chunks, keys, start, samples, frame, frame)
    # one number a frame; every later step reads it again
    f = durable(f.select(*keys, "win", F.sqrt(F.aggregate("samples", F.lit(0.0), lambda s, e: s + e * e) / frame).alias("rms")))
    o = Ordered(f, keys, ["win"], split=split).stats(peak=F.max("rms"))
    return o.rows().withColumn("floor", F.greatest(F.lit(least), F.col("peak") * ratio))


def pause_model(chunks: DataFrame, keys: Sequence[str], start: str, samples: str, sr: float, frame: int = 512, ratio: float = 0.01, least: float = 0.001, min_pause: float = 3.5, factor: float = 4.0, split=None) -> DataFrame:
    """Pauses of each asset and those longer than max(min_pause, factor x its median pause).

    A pause is a run of frames below the noise floor. Assets without a whole
    frame give no row, assets without a pause zeros and a null median.
    """
    f = pause_frames(chunks, keys, start, samples, frame, ratio, least, split).withColumn("_d", F.col("rms") - F.col("floor"))
    per = f.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_frames"), F.max("peak").alias("peak"), F.max("floor").alias("floor"), F.count(F.when(F.col("_d") < 0, 1)).alias("n_silent"))
    runs = frozen_runs(f.select(*keys, "win", "_d"), keys, ["win"], "_d", 0.0, 1, split=split)
    # one row per asset and pause length from here on
    hist = runs.groupBy(*keys, "n_rows").agg(F.count(F.lit(1)).alias("_c"), F.min("start_t").alias("_f"))
    mid = hist.groupBy(*keys).agg(F.percentile("n_rows", F.lit(0.5), F.col("_c")).alias("_m"))
    sec = frame / sr
    long = F.greatest(F.lit(min_pause), factor * F.col("_m") * sec)
    odd = F.col("n_rows") * sec > F.col("_t")
    j = _same(hist, mid, keys).withColumn("_t", long)
    tot = j.groupBy(*keys).agg(
        F.sum("_c").alias("n_pauses"), (F.max("_m") * sec).alias("median_pause"), F.max("_t").alias("pause_limit"), F.sum(F.when(odd, F.col("_c")).otherwise(0)).alias("n_anomalous"),
        (F.max("n_rows") * sec).alias("longest_pause"), (F.min(F.when(odd, F.col("_f"))) * sec).alias("first_anomaly"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return _same(per, tot, keys).select(*keys, "n_frames", "n_silent", "peak", "floor", zero("n_pauses"), "median_pause", "pause_limit", zero("n_anomalous"), "longest_pause", "first_anomaly")


def mains_band(chunks: DataFrame, keys: Sequence[str], start: str, samples: str, sr: float, grid: int = 50, seconds: float = 8.0, narrow: float = 0.2, around: float = 10.0, present_db: float = -2.0) -> DataFrame:
    """Power of the mains band and its harmonic against their neighbourhood, in dB.

    The signal is cut into segments of ``seconds``. A segment's DFT bins inside
    the bands of ``ENF_BANDS`` make the powers, those inside +-``narrow`` against +-``around``
    Hz the ratios; by Parseval's theorem they are exact mean squares of the
    band-limited segment (the last one is padded with zeros). A chunk adds one complex sum per bin, turned by
    the phase of its place in the segment, so chunks of any length merge by addition.
    """
    size = int(round(seconds * sr))
    step = sr / size
    bands = []
    for lo, hi in ENF_BANDS[grid]:
        mid = (lo + hi) / 2
        bands.append(((lo, hi), (mid - narrow, mid + narrow), (max(1.0, mid - around), min(sr / 2 - 1, mid + around))))
    inside = lambda f, b: b[0] - 1e-9 <= f <= b[1] + 1e-9
    bins = [b for b in range(1, size // 2) if any(inside(b * step, w) for part in bands for w in part)]

    @F.pandas_udf("array<struct<b:int,re:double,im:double>>")
    def local(s: pd.Series, at: pd.Series) -> pd.Series:
        k, out = np.asarray(bins), []
        for x, a in zip(s, at):
            # bin numbers times places stay whole numbers, so the phase keeps its digits
            turn = np.exp(-2j * PI * (np.outer(k, a + np.arange(len(x))) % size) / size)
            z = turn @ np.asarray(x, dtype=float)
            out.append([{"b": int(b), "re": float(v.real), "im": float(v.imag)} for b, v in zip(k, z)])
        return pd.Series(out)

    p = pieces(chunks, keys, start, samples, size)
    n = p.groupBy(*keys).agg(F.sum(F.size("samples")).cast("bigint").alias("n_samples"), F.count_distinct("tile").alias("n_segments"))
    z = p.select(*keys, "tile", F.explode(local("samples", F.col("at") - F.col("tile") * size)).alias("z"))
    z = z.groupBy(*keys, "tile", "z.b").agg(F.sum("z.re").alias("re"), F.sum("z.im").alias("im"))
    e = z.select(*keys, (F.col("b") * step).alias("f"), ((F.col("re") ** 2 + F.col("im") ** 2) * (2.0 / size)).alias("e"))
    part = lambda b: F.coalesce(F.sum(F.when(F.col("f").between(b[0] - 1e-9, b[1] + 1e-9), F.col("e"))), F.lit(0.0))
    names = [("fundamental", bands[0]), ("harmonic", bands[1])]
    g = e.groupBy(*keys).agg(*[part(b).alias(f"_{w}_{name}") for name, three in names for w, b in zip("bnw", three)])
    out = _same(n, g, keys)
    db = lambda name: F.when(F.col(f"_w_{name}") / F.col("n_samples") < 1e-20, 0.0).otherwise(10 * F.log10(F.greatest(F.col(f"_n_{name}"), F.lit(1e-300)) / F.col(f"_w_{name}")))
    f, h = F.coalesce(db("fundamental"), F.lit(0.0)), F.coalesce(db("harmonic"), F.lit(0.0))
    return out.select(
        *keys, "n_samples", "n_segments", *[F.coalesce(F.try_divide(f"_b_{name}", "n_samples"), F.lit(0.0)).alias(f"{name}_power") for name, _ in names],
        f.alias("fundamental_db"), h.alias("harmonic_db"), (f > present_db).alias("present"), ((h > present_db) & (f <= present_db)).alias("harmonic_only"),
    )


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of per-key rows that matches null keys."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in keys])
