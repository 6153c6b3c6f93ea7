"""Frames stored as square pixel blocks (A16, T7): every block gets the border of its neighbours once.

A block sends its edge rows, columns and corners to the eight blocks around it, so one
shuffle of blocks and thin strips makes all 3 x 3 kernels exact over the whole frame.
Kernels run over Arrow batches of padded blocks; frames are merged from block sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.operators.ordered import Ordered

SUMS = "n sx sxx lap lap2 gx gy hp hp2 res res2 ares edge n_edge inner n_inner".split()


def with_border(blocks: DataFrame, keys: Sequence[str], by: str, bx: str, px: str, side: int) -> DataFrame:
    """(keys, by, bx, px, padded): row-major block and the same with one pixel around it.

    Pixels outside the frame are null. A block is told by (keys, by, bx); frames are whole rectangles of blocks.
    """
    at = {-1: [0], 0: list(range(side)), 1: [side - 1]}  # rows or columns a block gives to a neighbour in that direction
    strips, place = [], [[4, 0]] * (side + 2) ** 2
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            q = (dy + 1) * 3 + dx + 1
            ids = [r * side + c for r in at[dy] for c in at[dx]]
            strips.append(F.struct(F.lit(q).alias("q"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(ids).alias("ids")))
            # the receiver sees the sender on the other side
            rows = {-1: [side + 1], 0: list(range(1, side + 1)), 1: [0]}[dy]
            cols = {-1: [side + 1], 0: list(range(1, side + 1)), 1: [0]}[dx]
            for i, (r, c) in enumerate((r, c) for r in rows for c in cols):
                place[r * (side + 2) + c] = [q, i]
    e = blocks.select(*keys, by, bx, px, F.explode(F.array(*[s.cast("struct<q:int,dy:int,dx:int,ids:array<int>>") for s in strips])).alias("_o"))
    strip = F.when(F.col("_o.q") == 4, F.col(px)).otherwise(F.transform("_o.ids", lambda i: F.get(px, i)))
    e = e.select(*keys, (F.col(by) + F.col("_o.dy")).alias(by), (F.col(bx) + F.col("_o.dx")).alias(bx), F.struct(F.col("_o.q").alias("q"), strip.alias("v")).alias("_e"))
    g = e.groupBy(*keys, by, bx).agg(F.map_from_entries(F.collect_list("_e")).alias("_m")).filter(F.map_contains_key("_m", 4))
    pad = F.transform(F.lit(place), lambda p: F.get(F.try_element_at("_m", p[0]), p[1]))
    return g.select(*keys, by, bx, F.try_element_at("_m", F.lit(4)).alias(px), pad.alias("padded"))


def block_sums(padded: Column, by: Column, bx: Column, side: int, top: float, grid: int = 8) -> Column:
    """Sums of one padded block: levels, Laplacian, gradients, high pass, residual and steps on and off the ``grid``.

    Outside the frame the image is mirrored without its edge for kernels and left out of the local mean.
    """

    @F.pandas_udf(", ".join(f"{c} double" for c in SUMS))
    def sums(p: pd.Series, y: pd.Series, x: pd.Series) -> pd.DataFrame:
        w = side + 2
        a = np.array([np.array(v, dtype=float) for v in p]).reshape(-1, w, w)
        r = a.copy()
        for out, src in ((0, 2), (w - 1, w - 3)):
            r[:, out, :] = np.where(np.isnan(r[:, out, :]), r[:, src, :], r[:, out, :])
        for out, src in ((0, 2), (w - 1, w - 3)):
            r[:, :, out] = np.where(np.isnan(r[:, :, out]), r[:, :, src], r[:, :, out])
        sh = lambda m, dy, dx: m[:, 1 + dy : w - 1 + dy, 1 + dx : w - 1 + dx]
        off = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        c = sh(r, 0, 0)
        lap = sh(r, -1, 0) + sh(r, 1, 0) + sh(r, 0, -1) + sh(r, 0, 1) - 4 * c
        gx = sum(k * (sh(r, dy, 1) - sh(r, dy, -1)) for dy, k in ((-1, 1), (0, 2), (1, 1)))
        gy = sum(k * (sh(r, 1, dx) - sh(r, -1, dx)) for dx, k in ((-1, 1), (0, 2), (1, 1)))
        hp = np.clip(9 * c - sum(sh(r, *o) for o in off), 0.0, top)
        near = np.stack([sh(a, *o) for o in off])
        res = c - np.nansum(near, 0) / np.maximum(1, (~np.isnan(near)).sum(0))
        # steps to the right and downwards; those across a border of the coding grid apart
        i = np.arange(side)
        steps = {True: [0.0, 0.0], False: [0.0, 0.0]}
        for dy, dx, first in ((0, 1, x), (1, 0, y)):
            d = np.abs(sh(a, dy, dx) - sh(a, 0, 0))
            hit = (first.to_numpy()[:, None] * side + i[None, :] + 1) % grid == 0
            hit = np.broadcast_to(hit[:, None, :] if dx else hit[:, :, None], d.shape)
            for on in (True, False):
                m = (hit == on) & ~np.isnan(d)
                steps[on][0] = steps[on][0] + np.where(m, d, 0.0).sum((1, 2))
                steps[on][1] = steps[on][1] + m.sum((1, 2))
        tot = lambda m: np.nansum(m, axis=(1, 2))
        cols = [(~np.isnan(c)).sum((1, 2)), tot(c), tot(c * c), tot(lap), tot(lap**2), tot(np.abs(gx)), tot(np.abs(gy)), tot(hp), tot(hp**2), tot(res), tot(res**2), tot(np.abs(res)), *steps[True], *steps[False]]
        return pd.DataFrame({k: np.asarray(v, dtype=float) for k, v in zip(SUMS, cols)})

    return sums(padded, by, bx)


def frame_rollup(blocks: DataFrame, keys: Sequence[str], frame: str, by: str, bx: str, px: str, side: int = 8, top: float = 1.0, grid: int = 8, split=None) -> DataFrame:
    """Metrics of whole frames from their blocks, and SSIM to the asset's next frame.

    brightness, contrast, sharpness (variance of the Laplacian), blockiness (mean
    absolute Sobel gradients), boundary_ratio (steps across the coding grid over steps inside it;
    null without either), noise (deviation of the high pass cut to 0..``top``), residual_var and
    residual_mean (pixel minus mean of the pixels around it), ssim (from moments merged over
    the blocks both frames have; null on the last frame).
    """
    own = list(keys)
    b = with_border(blocks, [*own, frame], by, bx, px, side)
    s = b.select(*own, frame, block_sums(F.col("padded"), F.col(by), F.col(bx), side, top, grid).alias("_s"))
    t = s.groupBy(*own, frame).agg(F.count(F.lit(1)).alias("n_blocks"), *[F.sum(f"_s.{c}").alias(f"_{c}") for c in SUMS])
    per = lambda c: F.try_divide(f"_{c}", "_n")
    var = lambda s1, s2: F.greatest(per(s2) - per(s1) * per(s1), F.lit(0.0))
    t = t.select(
        *own, frame, "n_blocks", per("sx").alias("brightness"), F.sqrt(var("sx", "sxx")).alias("contrast"), var("lap", "lap2").alias("sharpness"), (per("gx") + per("gy")).alias("blockiness"),
        F.try_divide(F.try_divide("_edge", "_n_edge"), F.try_divide("_inner", "_n_inner")).alias("boundary_ratio"), F.sqrt(var("hp", "hp2")).alias("noise"), var("res", "res2").alias("residual_var"), per("ares").alias("residual_mean"),
    )
    sim = frame_ssim(blocks, own, frame, by, bx, px, top, split)
    cond = F.lit(True)
    for k in [*own, frame]:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    sim = sim.withColumnsRenamed({k: f"_r_{k}" for k in [*own, frame]})
    return t.join(sim, cond, "left").drop(*[f"_r_{k}" for k in [*own, frame]])


def frame_ssim(blocks: DataFrame, keys: Sequence[str], frame: str, by: str, bx: str, px: str, top: float = 1.0, split=None) -> DataFrame:
    """(keys, frame, ssim) to frame + 1, from block moments: inside blocks plus between block means."""
    o = Ordered(blocks.select(*keys, by, bx, frame, F.transform(px, lambda v: v.cast("double")).alias("_a")), [*keys, by, bx], [frame], after=1, split=split)
    o.add(_b=o.next("_a"), _f=o.next(frame))
    p = o.rows().filter(F.col("_f") == F.col(frame) + 1)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, e: s + e)
    n = F.size("_a")
    p = p.withColumns({"_ma": total(F.col("_a")) / n, "_mb": total(F.col("_b")) / n})
    dot = lambda a, am, b, bm: total(F.zip_with(a, b, lambda u, v: (u - F.col(am)) * (v - F.col(bm)))) / n
    p = p.withColumns({"_va": dot("_a", "_ma", "_a", "_ma"), "_vb": dot("_b", "_mb", "_b", "_mb"), "_cv": dot("_a", "_ma", "_b", "_mb")})
    g = p.groupBy(*keys, frame).agg(
        F.avg("_ma").alias("ma"), F.avg("_mb").alias("mb"), (F.avg("_va") + F.var_pop("_ma")).alias("va"), (F.avg("_vb") + F.var_pop("_mb")).alias("vb"), (F.avg("_cv") + F.covar_pop("_ma", "_mb")).alias("cv")
    )
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    c = F.col
    ssim = ((2 * c("ma") * c("mb") + c1) * (2 * c("cv") + c2)) / ((c("ma") * c("ma") + c("mb") * c("mb") + c1) * (c("va") + c("vb") + c2))
    return g.select(*keys, frame, ssim.alias("ssim"))
