"""Fuse detector scores per case. One hash aggregate each, no join, no UDF.

``scores`` has one row per (case, module). Every quantity the rules need is a
conditional sum or maximum, so partial aggregation does the work before the
shuffle and a case of any size costs one small row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.functions.exprs import band, clamp, explode_rules, finding
from mediasift.operators.stats import pick

# Base weights, cut-offs, bonuses and labels of the two fusions.
AUDIO_WEIGHTS = {"enf": 0.30, "noise": 0.22, "compression": 0.18, "reverberation": 0.12, "voice": 0.10, "metadata": 0.08}
AUDIO_UNKNOWN_WEIGHT = 0.05
AUDIO_SIGNAL_MODULES = ("enf", "noise", "compression", "reverberation", "voice")
AUDIO_BONUSES = (0.10, 0.07, 0.05, 0.04, 0.03)
VIDEO_WEIGHTS = {"noise": 0.25, "temporal": 0.20, "metadata": 0.15, "compression": 0.15, "lighting": 0.15, "audio": 0.10}
VERDICT_CUTS = (0.20, 0.40, 0.65)
VERDICTS = ("likely_authentic", "inconclusive", "likely_tampered", "tampered")


def names(c: Column) -> Column:
    """Sorted, comma-joined distinct names; empty text when there are none."""
    return F.array_join(F.sort_array(F.collect_set(c)), ",")


def fuse_audio(
    scores: DataFrame, keys: Sequence[str], weights: Mapping[str, float] = AUDIO_WEIGHTS,
    elevated_cut: float = 0.35, escalate_cut: float = 0.65, escalate_weight: float = 0.08, floor: float = 0.62, metadata_cap: float = 0.25,
) -> DataFrame:
    """F1. Expects module, score, confidence, skipped, snr_db, enf_present."""
    c = F.col
    on = ~c("skipped")
    m, s = c("module"), c("score")
    w = pick(m, weights, AUDIO_UNKNOWN_WEIGHT)
    enf, meta = m == "enf", m == "metadata"
    body = on & ~enf & ~meta
    known = m.isin(*weights)
    hot = on & ~meta & (s >= elevated_cut)
    total = lambda cond, v: F.sum(F.when(cond, v).otherwise(0.0))
    g = scores.groupBy(*keys).agg(
        F.count(F.when(on, 1)).alias("n_active"),
        total(body, w).alias("_w"), total(body, s * w).alias("_sw"), total(body, c("confidence") * w).alias("_cw"),
        F.max(F.when(on & enf, s)).alias("_es"), F.max(F.when(on & enf, c("confidence"))).alias("_ec"), total(on & enf, w).alias("_ew"),
        F.max(F.when(on & enf, (s >= 0.30) | F.coalesce(c("enf_present"), F.lit(False)) | (F.coalesce(c("snr_db"), F.lit(0.0)) > 5.0))).alias("_ep"),
        F.max(F.when(on & meta, s)).alias("_ms"), F.max(F.when(on & meta, c("confidence"))).alias("_mc"), total(on & meta, w).alias("_mw"),
        F.count(F.when(on & m.isin(*AUDIO_SIGNAL_MODULES) & (s >= elevated_cut), 1)).alias("_na"),
        F.max(F.when(body & known, s)).alias("_xk"), F.max(F.when(body & ~known, s)).alias("_xu"),
        F.count(F.when(hot, 1)).alias("n_elevated"), total(hot, s).alias("_hs"), total(hot, s * s).alias("_hq"), total(hot, c("confidence")).alias("_hc"),
        F.max(F.when(hot, s)).alias("_hx"),
        names(F.when(hot, m)).alias("elevated_modules"), names(F.when(~on, m)).alias("skipped_modules"),
    )
    # each step is its own column, so nothing is expanded twice
    g = g.withColumns({"_present": F.coalesce(c("_ep"), F.lit(False)), "_rest": c("_w") + c("_mw"), "_s": F.coalesce(c("_es"), F.lit(0.0))})
    present, rest, es = c("_present"), c("_rest"), c("_s")
    # metadata only corroborates: silent without a signal finding, capped with one
    ms = F.when(c("_na") > 0, F.least(F.coalesce(c("_ms"), F.lit(0.0)), F.lit(metadata_cap))).otherwise(0.0)
    g = g.withColumns({
        # an unmeasurable mains signal hands its weight to the others in proportion
        "_share": F.when(present | (c("_ew") < 1e-9) | (rest < 1e-9), 1.0).otherwise(1.0 + c("_ew") / rest),
        "_mains": F.when(present, c("_ew")).otherwise(0.0), "_meta": ms,
    })
    share, ew = c("_share"), c("_mains")
    g = g.withColumn("_tw", rest * share + ew)
    g = g.withColumn("_base", F.try_divide(c("_sw") * share + es * ew + c("_meta") * c("_mw") * share, c("_tw")))
    esc = lambda x, wt: F.coalesce(F.when((x >= escalate_cut) & (wt >= escalate_weight), x * floor), F.lit(0.0))
    steps = [0.0]
    for b in AUDIO_BONUSES:
        steps.append(steps[-1] + b)
    n = c("n_elevated")
    bonus = F.element_at(F.array(*[F.lit(x) for x in steps]), F.least(F.greatest(n, F.lit(1)), F.lit(len(steps))).cast("int"))
    g = g.withColumns({
        "_lift": F.greatest(c("_base"), esc(c("_xk"), F.lit(1.0)), esc(c("_xu"), AUDIO_UNKNOWN_WEIGHT * share), esc(es, ew)),
        "_factor": F.when(n >= 2, 1.0 + bonus).otherwise(1.0), "_mean": F.try_divide(c("_hs"), n), "_ok": (c("n_active") > 0) & (c("_tw") >= 1e-9),
    })
    std = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(c("_hq"), n) - c("_mean") * c("_mean")))
    agree = F.when(n >= 2, 1.0 + 0.15 * F.greatest(F.lit(0.0), 1.0 - std / (c("_mean") + 1e-6))).otherwise(1.0)
    conf = F.try_divide(c("_cw") * share + F.coalesce(c("_ec"), F.lit(0.0)) * ew + F.coalesce(c("_mc"), F.lit(0.0)) * c("_mw") * share, c("_tw")) * agree
    ok = lambda v, null: F.when(c("_ok"), v).otherwise(null)
    out = g.withColumns({
        "enf_present": present & c("_ok"), "base_score": ok(c("_base"), 0.0), "corroboration": ok(c("_factor"), 1.0),
        "fused": ok(clamp(c("_lift") * c("_factor")), 0.0), "_conf": conf, "n_elevated": ok(n, 0).cast("bigint"),
    })
    out = out.withColumn("confidence", ok(clamp(c("_conf"), 0.30, 0.92), 0.30))
    f = c("fused")
    solo = (c("n_elevated") == 1) & (c("_hx") >= 0.55) & (c("_hc") < 0.65)
    weak = (f >= 0.40) & (F.try_divide(c("_hc"), c("n_elevated")) < 0.50)
    conflict = F.when((f < 0.40) | (c("n_elevated") == 0), "none").when(solo, "sole_supporter").when(weak, "low_confidence").otherwise("none")
    note = F.when(~c("_ok"), "no usable scores").otherwise(
        F.concat_ws(
            "; ", F.when(~c("enf_present"), F.lit("mains signal absent, weight redistributed")),
            F.when(c("skipped_modules") != "", F.concat(F.lit("skipped: "), c("skipped_modules"))),
            F.when(c("n_active") < 3, F.format_string("only %d usable scores", c("n_active"))),
        )
    )
    verdict = F.when(c("_ok"), band(f, VERDICT_CUTS, VERDICTS)).otherwise("inconclusive")
    return out.select(
        *keys, "n_active", "enf_present", "base_score", "fused", "corroboration", "confidence", verdict.alias("verdict"), "n_elevated",
        ok(c("elevated_modules"), "").alias("elevated_modules"), conflict.alias("conflict"), note.alias("note"),
    )


def fuse_video(scores: DataFrame, keys: Sequence[str], weights: Mapping[str, float] = VIDEO_WEIGHTS, elevated_cut: float = 0.30, strong: float = 0.55, low: float = 0.15) -> DataFrame:
    """F2. Expects module, score, uncertainty, reliable."""
    c = F.col
    m, s, u, rel = c("module"), c("score"), c("uncertainty"), c("reliable")
    known = m.isin(*weights)
    adj = F.when(known, pick(m, weights, 0.0) / (u + 0.01) * F.when(rel, 1.0).otherwise(0.5)).otherwise(0.0)
    up = rel & (s >= elevated_cut)
    g = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_modules"), F.sum(adj).alias("_w"), F.sum(s * adj).alias("_sw"), F.sum(F.when(known, s).otherwise(0.0)).alias("_s"),
        F.count(F.when(up, 1)).alias("n_elevated"), F.count(F.when(rel, 1)).alias("_nr"), F.count(F.when(~rel, 1)).alias("_nu"),
        F.avg(u).alias("mean_uncertainty"), F.count(F.when(rel & (s >= strong), 1)).alias("_hi"), F.count(F.when(rel & (s < low), 1)).alias("_lo"),
        names(F.when(up, m)).alias("elevated_modules"), names(F.when(rel & (s < elevated_cut), m)).alias("below_modules"), names(F.when(~rel, m)).alias("unreliable_modules"),
    )
    n = c("n_elevated")
    base = F.when(c("_w") < 1e-9, c("_s") / len(weights)).otherwise(c("_sw") / c("_w"))
    mult = F.when(n <= 1, 1.0).when(n == 2, 1.25).when(n == 3, 1.50).otherwise(1.75)
    out = g.withColumn("base_score", base).withColumn("multiplier", mult).withColumn("fused", F.least(F.lit(1.0), base * mult))
    out = out.withColumn("has_conflict", (c("_hi") > 0) & (c("_lo") > 0))
    f = c("fused")
    edge = F.least(*[F.abs(f - b) for b in VERDICT_CUTS])
    conf = 0.30 + n * 0.12 - c("mean_uncertainty") * 0.40 - F.when(c("has_conflict"), 0.15).otherwise(0.0) - c("_nu") * 0.05 + edge * 0.30
    return out.select(
        *keys, "n_modules", "base_score", "multiplier", "fused", clamp(conf, 0.05, 0.99).alias("confidence"), band(f, VERDICT_CUTS, VERDICTS).alias("verdict"),
        "n_elevated", (n / F.greatest(c("_nr"), F.lit(1))).alias("agreement_ratio"), "mean_uncertainty", "has_conflict", "elevated_modules", "below_modules", "unreliable_modules",
    )


def complete_modules(scores: DataFrame, cases: DataFrame, keys: Sequence[str], expected: Sequence[str]) -> DataFrame:
    """every expected module per case; missing or failed ones score 0, uncertainty 0.5, unreliable.

    The expected names are a fixed list, so the fan-out per case is fixed.
    """
    want = cases.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(x) for x in expected])).alias("module"))
    j = want.join(scores, [*keys, "module"], "left")
    got = F.col("status") == "completed"
    ok = F.coalesce(got, F.lit(False))
    return j.select(
        *keys, "module", F.when(ok, F.col("score")).otherwise(0.0).alias("score"), F.when(ok, F.col("uncertainty")).otherwise(0.5).alias("uncertainty"),
        F.when(ok, F.coalesce("reliable", F.lit(True))).otherwise(False).alias("reliable"), F.coalesce("status", F.lit("skipped")).alias("status"),
    )


def fusion_findings(fused: DataFrame, keys: Sequence[str]) -> DataFrame:
    """verdict, corroboration and conflict findings of a fused video case."""
    c = F.col
    v = c("verdict")
    sev = F.when(v == "tampered", "critical").when(v == "likely_tampered", "high").when(v == "inconclusive", "medium").otherwise("low")
    conf = F.when(v == "likely_tampered", c("confidence") * 0.85).when(v == "inconclusive", 0.40).otherwise(c("confidence"))
    return explode_rules(fused, keys, [
        finding("fusion", "verdict", sev, conf, score=c("fused"), detail=v),
        F.when(c("n_elevated") >= 2, finding("fusion", "corroboration", "high", F.least(F.lit(0.90), c("confidence") + 0.10), score=c("fused"), detail=c("elevated_modules"))),
        F.when(c("has_conflict"), finding("fusion", "partial_domain", "medium", 0.50, score=c("fused"), detail=c("below_modules"))),
    ])
