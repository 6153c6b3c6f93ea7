"""Nested sub-results of the video modules to findings, by a rule table compiled into one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.functions.exprs import finding


@dataclass(frozen=True)
class Case:
    """What one kind of signal gives. ``signals`` names the codes (none: all others); texts are SQL over the sub-result's fields."""

    severity: str
    confidence: str
    signals: tuple[str, ...] = ()
    when: str | None = None


@dataclass(frozen=True)
class Part:
    """One sub-result: a struct column ``module_part`` with ``signals array<string>`` and the fields its rules name.

    The first case that fits a signal decides. Confidence is at least ``floor``. ``hits`` are fields with arrays of hit
    times, whose least and largest bound the finding; ``spans`` is a field of (start, end) structs in order; both only for the
    signals in ``placed`` (none: all).
    """

    module: str
    part: str
    kind: str
    uncertainty: str
    cases: tuple[Case, ...]
    floor: float = 0.0
    hits: tuple[str, ...] = ()
    spans: str | None = None
    placed: tuple[str, ...] = ()

    @property
    def column(self) -> str:
        return f"{self.module}_{self.part}"


@dataclass(frozen=True)
class Each:
    """One finding per hit time of a sub-result, the first ``limit`` ones."""

    module: str
    part: str
    kind: str
    hits: str
    limit: int
    severity: str
    confidence: str
    uncertainty: float


# Severities, confidences, caps and uncertainties of the module rules.
EACH = (Each("compression", "bitrate", "bitrate_anomaly", "anomaly_t", 5, "if(score > 0.60, 'high', 'medium')", "least(0.85, score + 0.10)", 0.15),)
PARTS = (
    Part("compression", "bitrate", "unexpected_keyframes", "0.12", (Case("'high'", "0.68", ("keyframes",), "size(keyframe_t) > 0"),), hits=("keyframe_t",)),
    Part("compression", "gop", "irregular_gop", "0.18", (Case("'medium'", "irregularity * 0.85", ("irregular",), "irregularity > 0.45"),)),
    Part("compression", "dct", "double_compression", "0.18", (Case("CASE WHEN score > 0.70 THEN 'high' WHEN score > 0.45 THEN 'medium' ELSE 'low' END", "score"),)),
    Part("temporal", "duplication", "frame_duplication", "0.08", (
        Case("'high'", "least(0.90, 0.50 + frozen_rate * 2)", ("frozen",), "frozen_rate > 0.05"), Case("'medium'", "0.60", ("non_consecutive",)), Case("'low'", "0.35")), spans="segments"),
    Part("temporal", "flow", "flow_discontinuity", "0.15", (
        Case("'high'", "least(0.80, score + 0.10)", ("spike", "reversal")), Case("'medium'", "score", ("coherence", "speed")), Case("'low'", "0.30")), floor=0.15),
    Part("noise", "prnu", "fingerprint_anomaly", "if(reliable, 0.18, 0.30)", (
        Case("'high'", "least(0.85, score + 0.10)", ("strong", "negative", "mismatch")), Case("'low'", "0.25", ("caution", "insufficient")), Case("'medium'", "score")), floor=0.10, hits=("drop_t",), placed=("temporal_drop",)),
    Part("noise", "pattern", "noise_pattern", "0.20", (Case("'high'", "frequency", ("periodic",)), Case("'medium'", "variance", ("variance",)), Case("'low'", "0.30")), floor=0.15),
    Part("lighting", "illumination", "illumination_anomaly", "0.20", (
        Case("'high'", "least(0.80, score + 0.10)", ("significant", "shift")), Case("'medium'", "score", ("abrupt", "inconsistent")), Case("'low'", "0.30")), floor=0.10, hits=("spike_t",)),
    Part("lighting", "shadow", "shadow_anomaly", "0.22", (Case("'medium'", "direction", ("direction",)), Case("'medium'", "ambient", ("ambient",)), Case("'low'", "0.30")), floor=0.10),
    Part("audio", "spectral", "spectral_anomaly", "0.18", (
        Case("'high'", "least(0.85, 0.50 + centroid_ratio / 200)", ("centroid",), "centroid_ratio >= 60"), Case("'medium'", "score", ("centroid", "profile")),
        Case("'medium'", "least(0.70, score + 0.10)", ("rms", "onset")), Case("'low'", "0.30")), floor=0.10, hits=("centroid_t", "rms_t", "onset_t")),
    Part("audio", "sync", "sync_anomaly", "0.15", (
        Case("'high'", "mains", ("mains",)), Case("'medium'", "duration", ("duration",)), Case("'medium'", "start_offset", ("start_offset",)), Case("'low'", "0.25")), floor=0.10),
)


def _fields(df: DataFrame, column: str) -> list[str]:
    return df.schema[column].dataType.names


def _over(df: DataFrame, column: str, text: str) -> Column:
    """SQL text over the fields of a struct column; whole words are field names."""
    import re

    names = sorted(_fields(df, column), key=len, reverse=True)
    return F.expr(re.sub(r"\b(" + "|".join(map(re.escape, names)) + r")\b(?!')", rf"`{column}`.`\1`", text))


def _bounds(df: DataFrame, p: Part) -> tuple[Column, Column]:
    none = F.lit(None).cast("double")
    if p.spans:
        at = F.col(f"{p.column}.{p.spans}")
        return F.try_element_at(at, F.lit(1))["start"], F.try_element_at(at, F.lit(-1))["end"]
    if p.hits:
        empty = F.array().cast("array<double>")
        every = F.concat(*[F.coalesce(F.col(f"{p.column}.{h}"), empty) for h in p.hits])
        return F.array_min(every), F.array_max(every)
    return none, none


def _signal_rules(df: DataFrame, p: Part) -> Column:
    start, end = _bounds(df, p)
    over = lambda t: _over(df, p.column, t)

    def told(s: Column) -> Column:
        def struct(case: Case) -> Column:
            place = s.isin(*p.placed) if p.placed else F.lit(True)
            conf = F.greatest(F.lit(p.floor), over(case.confidence).cast("double"))
            f = finding(p.module, p.kind, over(case.severity), conf, start=F.when(place, start), end=F.when(place, end), detail=s)
            return F.struct(f.alias("f"), over(p.uncertainty).cast("double").alias("uncertainty"))

        tests = []
        for case in p.cases:
            fits = s.isin(*case.signals) if case.signals else F.lit(True)
            tests.append((fits & F.coalesce(over(case.when), F.lit(False)) if case.when else fits, case))
        return reduce(lambda out, t: F.when(t[0], struct(t[1])) if out is None else out.when(t[0], struct(t[1])), tests, None)

    return F.transform(F.coalesce(F.col(f"{p.column}.signals"), F.array().cast("array<string>")), told)


def _hit_rules(df: DataFrame, e: Each) -> Column:
    column = f"{e.module}_{e.part}"
    over = lambda t: _over(df, column, t)
    hits = F.slice(F.array_sort(F.coalesce(F.col(f"{column}.{e.hits}"), F.array().cast("array<double>"))), 1, e.limit)
    return F.transform(hits, lambda t: F.struct(finding(e.module, e.kind, over(e.severity), over(e.confidence).cast("double"), start=t).alias("f"), F.lit(e.uncertainty).alias("uncertainty")))


def subresult_findings(df: DataFrame, keys: Sequence[str], parts: Sequence[Part] = PARTS, each: Sequence[Each] = EACH) -> DataFrame:
    """Findings of all sub-results of each row, one projection and one explode; no shuffle.

    ``df`` has a struct column per sub-result (``compression_bitrate``, ``temporal_flow`` and so on); those it lacks are left out,
    and a null struct, list or field fires nothing of its own: a null confidence counts as its floor.
    Returns ``keys``, the columns of a finding and ``uncertainty``; ``detail`` is the signal's code.
    """
    have = set(df.columns)
    arrays = [_hit_rules(df, e) for e in each if f"{e.module}_{e.part}" in have] + [_signal_rules(df, p) for p in parts if p.column in have]
    if not arrays:
        raise ValueError("no sub-result column")
    fired = df.select(*keys, F.concat(*arrays).alias("_all")).select(*keys, F.explode("_all").alias("_x")).filter(F.col("_x").isNotNull())
    return fired.select(*keys, "_x.f.*", "_x.uncertainty")
