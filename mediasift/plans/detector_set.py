"""All twelve detectors over one ordered pass and one aggregate of a shared series."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.functions.exprs import clamp, finding
from mediasift.operators import scores as X
from mediasift.operators import series as W
from mediasift.operators.ordered import Ordered
from mediasift.operators.stats import IDLE_CONFIDENCE, MODULE_CONFIDENCE

Get = Callable[[str], Column]


@dataclass(frozen=True)
class Series:
    """What a detector's aggregates may use of the ordered rows: values, steps (absolute change from the row before) and halves."""

    def value(self, name: str) -> Column:
        return F.col(f"v_{name}")

    def step(self, name: str) -> Column:
        return F.col(f"d_{name}")

    def cv(self, name: str) -> Column:
        return F.try_divide(F.stddev_pop(self.value(name)), F.avg(self.value(name)))

    def jump(self, name: str) -> Column:
        """Largest step in units of the mean step."""
        return F.max(self.step(name)) / (F.avg(self.step(name)) + 1e-6)

    def half_ratio(self, name: str) -> Column:
        """Larger over smaller mean of the two halves."""
        first, second = (F.avg(F.when(F.col("_half") == h, self.value(name))) for h in (1, 2))
        return F.try_divide(F.greatest(first, second), F.least(first, second))


@dataclass(frozen=True)
class Spec:
    """A detector: measures it needs, aggregates by name, and finding columns (A20 score) or weighted sub-scores (A21) over them."""

    name: str
    family: str
    needs: tuple[str, ...]
    aggregates: Callable[[Series], Mapping[str, Column]]
    rules: Callable[[Get], Sequence[Column]]
    parts: Callable[[Get], Mapping[str, Column]] | None = None
    min_rows: int = 8

    @property
    def key(self) -> str:
        return f"{self.family}_{self.name}"


SPECS: dict[str, Spec] = {}


def add(spec: Spec) -> Spec:
    SPECS[spec.key] = spec
    return spec


def _risk(c: Get) -> list[Column]:
    r = c("risk")
    return [F.when(r >= 0.9, finding("metadata", "rule_risk", "high", 0.8, 0.70, 1.0)).when(r >= 0.5, finding("metadata", "rule_risk", "low", 0.5, 0.20, 0.5))]


def _sub_rules(module: str, parts: Callable[[Get], Mapping[str, Column]]) -> Callable[[Get], list[Column]]:
    """A finding per sub-score from 0.3 on."""

    def rules(c: Get) -> list[Column]:
        grade = lambda s: F.when(s >= 0.60, "high").when(s >= 0.45, "medium").otherwise("low")
        return [F.when(s >= 0.30, finding(module, name, grade(s), s, s, X.SUB_WEIGHTS[module][name])) for name, s in parts(c).items()]

    return rules


def _video(name: str, needs: tuple[str, ...], aggregates, parts) -> Spec:
    return add(Spec(name, "video", needs, aggregates, _sub_rules(name, parts), parts))


unit = lambda x: clamp(F.coalesce(x, F.lit(0.0)))

# -- audio family -------------------------------------------------------------
add(Spec("metadata", "audio", ("tag_risk",), lambda s: {"risk": F.max(s.value("tag_risk"))}, _risk, min_rows=1))
add(Spec("enf", "audio", ("mains", "mains_snr"), lambda s: {
    "n_frames": F.count(s.value("mains")), "discontinuity": s.jump("mains"), "freq_std": F.stddev_pop(s.value("mains")), "enf_present": F.avg(s.value("mains_snr")) > 0,
    "snr_fund": F.avg(s.value("mains_snr")), "snr_harm": F.max(s.value("mains_snr")),
}, X.enf_rules))
add(Spec("noise", "audio", ("tilt", "high_band", "rms"), lambda s: {
    "tilt_cv": s.cv("tilt"), "hfe_cv": s.cv("high_band"), "rms_cv": s.cv("rms"), "half_ratio": s.half_ratio("rms"), "lossy": F.coalesce(F.bool_or("_lossy"), F.lit(False)),
}, W.noise_rules))
add(Spec("compression", "audio", ("edge_steepness", "edge_hz"), lambda s: {
    "steepness": F.max(s.value("edge_steepness")), "total_drop": F.max(s.value("edge_steepness")), "cutoff": F.avg(s.value("edge_hz")), "ceiling_hz": F.max(s.value("edge_hz")), "n_segments": F.count(s.value("edge_hz")),
    "ceiling_cv": s.cv("edge_hz"), "uncompressed": ~F.coalesce(F.bool_or("_lossy"), F.lit(False)), "lossy": F.coalesce(F.bool_or("_lossy"), F.lit(False)), "bitrate_kbps": F.max("_kbps"), "nyquist": F.max("_nyquist"),
}, X.lowpass_rules))
add(Spec("reverberation", "audio", ("flatness", "sub_bass"), lambda s: {"sfm_cv": s.cv("flatness"), "max_z": s.jump("flatness"), "sub_ratio": s.half_ratio("sub_bass")}, W.room_rules))
add(Spec("voice", "audio", ("pitch", "spectrum"), lambda s: {
    "lsd": F.max(s.step("spectrum")), "f0_ratio": s.half_ratio("pitch"), "f0_max_z": s.jump("pitch"), "f0_cv": s.cv("pitch"), "change_t": F.max_by("_t", s.step("pitch")), "duration": F.max("_t"),
}, lambda c: [*W.voice_rules(c), *X.pitch_rules(c)]))

# -- video family -------------------------------------------------------------
add(Spec("metadata", "video", ("tag_risk",), lambda s: {"risk": F.max(s.value("tag_risk"))}, _risk, min_rows=1))
_video("compression", ("frame_size", "block_score", "gop"), lambda s: {"jump": s.jump("frame_size"), "dct": F.avg(s.value("block_score")), "gop_cv": s.cv("gop")},
       lambda c: {"dct": unit(c("dct")), "bitrate": unit((c("jump") - 3) / 10), "gop": unit(c("gop_cv"))})
_video("temporal", ("difference", "flow", "similarity"), lambda s: {"frozen": F.avg((s.value("difference") < 1.0).cast("double")), "flow_jump": s.jump("flow"), "sim": F.avg(s.value("similarity"))},
       lambda c: {"duplication": unit(c("frozen") * 2), "flow": unit((c("flow_jump") - 2) / 8), "similarity": unit(1 - c("sim"))})
_video("noise", ("residual", "residual_corr"), lambda s: {"corr": F.avg(s.value("residual_corr")), "corr_sd": F.stddev_pop(s.value("residual_corr")), "var_cv": s.cv("residual"), "halves": s.half_ratio("residual")},
       lambda c: {"prnu_consistency": unit(1 - c("corr")), "prnu_temporal": unit(c("corr_sd")), "prnu_spatial": unit(c("var_cv") / 2), "noise_pattern": unit((c("halves") - 1) / 2)})
_video("lighting", ("light", "shadow", "colour"), lambda s: {"jump": s.jump("light"), "shadow_cv": s.cv("shadow"), "colour_ratio": s.half_ratio("colour")},
       lambda c: {"illumination": unit((c("jump") - 2) / 8), "shadow": unit(c("shadow_cv")), "colour_temp": unit(c("colour_ratio") - 1)})
_video("audio", ("centroid", "av_offset"), lambda s: {"jump": s.jump("centroid"), "offset": F.max(F.abs(s.value("av_offset")))},
       lambda c: {"spectral": unit((c("jump") - 2) / 8), "sync": unit(c("offset"))})


def run_all(series: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Mapping[str, Column], specs: Sequence[Spec] | None = None, t: str | None = None, lossy: Column | None = None, kbps: Column | None = None, nyquist: Column | None = None, split=None) -> DataFrame:
    """One row per key and detector: ``keys, family, module, score, confidence, n_checks, n_high, skipped, error, findings``.

    ``measures`` binds the names that detectors need to columns of ``series``; text is read as numbers, and what can't be read is
    null. All rows go through one ordered pass (steps, halves) and one aggregate, whatever the number of detectors. A detector
    whose measures aren't bound, that has too few rows or no readable value of a measure, or whose aggregates aren't
    finite, is skipped for that key with the reason in ``error``; the other detectors of the key aren't touched.

    Audio detectors score their findings (A20), video detectors the weighted sum of their sub-scores (A21).
    """
    use = list(specs or SPECS.values())
    s, c = Series(), F.col
    names = sorted({n for d in use for n in d.needs if n in measures})
    number = lambda m: m.try_cast("double")
    other = {"_t": number(c(t or order[0])), "_lossy": F.lit(None).cast("boolean") if lossy is None else lossy, "_kbps": number(F.lit(None) if kbps is None else kbps), "_nyquist": number(F.lit(None) if nyquist is None else nyquist)}
    rows = series.select(*dict.fromkeys([*keys, *order]), *[number(measures[n]).alias(f"v_{n}") for n in names], *[v.alias(k) for k, v in other.items()])
    o = Ordered(rows, keys, order, before=1, split=split)
    o.add(**{f"d_{n}": F.abs(c(f"v_{n}") - o.prev(f"v_{n}")) for n in names}).position().stats(_n=F.count(F.lit(1)))
    o.add(_half=F.when(c("_i") * 2 < c("_n"), 1).otherwise(2))
    bound = [d for d in use if all(n in measures for n in d.needs)]
    aggs = [a.alias(f"{d.key}__{n}") for d in bound for n, a in d.aggregates(s).items()]
    g = o.rows().groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.count(f"v_{n}").alias(f"_has_{n}") for n in names], *aggs)
    told = g.select(*keys, F.array(*[_verdict(d, d in bound, g) for d in use]).alias("_d"))
    out = told.select(*keys, F.explode("_d").alias("d")).select(*keys, "d.*")
    ok = c("error").isNull()
    return out.select(*keys, "family", "module", F.when(ok, c("score")).otherwise(0.0).alias("score"), F.when(ok, c("confidence")).otherwise(c("idle")).alias("confidence"), F.size("findings").alias("n_checks"), F.size(F.filter("findings", lambda f: f["severity"] == "high")).alias("n_high"), (~ok).alias("skipped"), "error", "findings")


def _verdict(d: Spec, bound: bool, g: DataFrame) -> Column:
    """Struct of one detector over the aggregates of a key."""
    get = lambda n: F.col(f"{d.key}__{n}")
    none = F.array().cast("array<struct<module:string,type:string,severity:string,confidence:double,score:double,weight:double,start_s:double,end_s:double,detail:string>>")
    start, per, top, one, two = MODULE_CONFIDENCE.get(d.name, (0.45, 0.08, 0.9, 0.0, 0.0))
    idle = F.lit(IDLE_CONFIDENCE.get(d.name, 0.50)).alias("idle")
    head = [F.lit(d.family).alias("family"), F.lit(d.name).alias("module")]
    if not bound:
        return F.struct(*head, F.lit("not bound").alias("error"), F.lit(0.0).alias("score"), F.lit(0.0).alias("confidence"), idle, none.alias("findings"))
    error = F.when(F.col("_rows") < d.min_rows, "too few rows")
    for n in d.needs:
        error = error.when(F.col(f"_has_{n}") == 0, f"no value of {n}")
    doubles = [n for n in d.aggregates(Series()) if g.schema[f"{d.key}__{n}"].dataType.typeName() == "double"]
    for n in doubles:
        error = error.when(F.isnan(get(n)) | (F.abs(get(n)) == float("inf")), f"{n} is not finite")
    fired = F.array_compact(F.array(*d.rules(get)))
    fired = F.when(error.isNull(), fired).otherwise(none)
    if d.parts:
        weights = X.SUB_WEIGHTS[d.name]
        score = clamp(sum((s * weights[n] for n, s in d.parts(get).items()), F.lit(0.0)))
        conf = F.lit(1.0) - F.lit({"noise": 0.12, "temporal": 0.10, "audio": 0.15, "lighting": 0.18}.get(d.name, 0.15))
    else:
        told = F.filter(fired, lambda f: f["score"].isNotNull())
        total = lambda of: F.aggregate(told, F.lit(0.0), lambda acc, f: acc + of(f))
        high = F.size(F.filter(told, lambda f: f["severity"] == "high"))
        bonus = F.when(high >= 2, two).when(high == 1, one).otherwise(0.0)
        score = F.when(F.size(told) > 0, F.least(F.lit(1.0), F.coalesce(F.try_divide(total(lambda f: f["score"] * f["weight"]), total(lambda f: f["weight"])), F.lit(0.0)) + bonus)).otherwise(0.0)
        conf = F.when(F.size(told) > 0, F.least(F.lit(top), start + per * F.size(told))).otherwise(idle)
    return F.struct(*head, error.alias("error"), score.alias("score"), conf.cast("double").alias("confidence"), idle, fired.alias("findings"))
