"""Column builders shared by all operators. Everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clamp, keeping null as null (``least``/``greatest`` would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def ramp(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear score through ``points`` [(x, score)], flat outside."""
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(x.isNotNull(), F.lit(float(points[-1][1])))


def tiers(x: Column, segments: Sequence[tuple[float, float, float]], top: tuple[float, float]) -> Column:
    """Score that may jump at each cut.

    ``segments`` = (start, score at start, score at next start); ``top`` =
    (start, score) from which the score stays. 0 below the first start.
    """
    starts = [s[0] for s in segments] + [top[0]]
    out = F.when(x >= top[0], F.lit(float(top[1])))
    for (a, y0, y1), b in reversed(list(zip(segments, starts[1:]))):
        out = out.when(x >= a, F.lit(float(y0)) + (x - a) * ((y1 - y0) / (b - a)))
    return out.when(x.isNotNull(), F.lit(0.0))


def suspicion(x: Column, clean: float, suspect: float, certain: float) -> Column:
    """Up to 0.2 between clean and suspect, 0.5 to 1 between suspect and certain."""
    return tiers(x, [(clean, 0.0, 0.20), (suspect, 0.50, 1.0)], (certain, 1.0))


def steps(x: Column, cuts: Sequence[tuple[float, float]], default: Column | float = 0.0) -> Column:
    """First matching ``x > cut`` wins; ``cuts`` from high to low."""
    out = None
    for cut, score in cuts:
        out = F.when(x > cut, F.lit(score)) if out is None else out.when(x > cut, F.lit(score))
    return out.otherwise(lit(default))


def band(x: Column, cuts: Sequence[float], names: Sequence[str]) -> Column:
    """``names[i]`` for x below ``cuts[i]``; the last name above all cuts."""
    out = None
    for cut, name in zip(cuts, names):
        out = F.when(x < cut, F.lit(name)) if out is None else out.when(x < cut, F.lit(name))
    return out.when(x.isNotNull(), F.lit(names[-1]))


def cv(mean: Column, std: Column, guard: float = 1e-12) -> Column:
    """A5: std / mean, 0 when the mean is not above the guard."""
    return F.when(mean > guard, std / mean).when(mean.isNotNull(), F.lit(0.0))


def circular_gap(a: Column, b: Column) -> Column:
    """Absolute angle between two directions, in [0, pi]."""
    d = F.abs(a - b)
    return F.least(d, F.lit(2 * 3.141592653589793) - d)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("bigint")


# -- vectors ---------------------------------------------------------------
def vsum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, e: s + e.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use inside array lambdas (otherwise it is recomputed per element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)


def centred(a: Column) -> Column:
    return let(F.try_divide(vsum(a), F.size(a)), lambda m: F.transform(a, lambda e: e.cast("double") - m))


def unit(a: Column, eps: float = 0.0) -> Column:
    """Array divided by its length."""
    return let(norm(a) + eps, lambda n: F.transform(a, lambda e: F.try_divide(e.cast("double"), n)))


def unit_centred(a: Column, eps: float = 1e-10) -> Column:
    return let(centred(a), lambda c: unit(c, eps))


def ncc(a: Column, b: Column) -> Column:
    """Normalised cross-correlation of two equal-length arrays."""
    return let(centred(a), lambda x: let(centred(b), lambda y: dot(x, y) / (norm(x) * norm(y) + 1e-10)))


# -- moments ---------------------------------------------------------------
def bimodality(skew: Column, kurt: Column, n: Column) -> Column:
    """Bimodality coefficient scaled to [0, 1]; needs at least four rows."""
    kc = kurt + 3.0 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    return F.when(n > 3, clamp(((skew * skew + 1) / (F.abs(kc) + 3) - 0.2) / 0.8))


# -- hashing ---------------------------------------------------------------
def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as a built-in expression; the key pads are literals."""
    import hashlib

    k = hashlib.sha256(key).digest() if len(key) > 64 else key
    k = k.ljust(64, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in k).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in k).hex()))
    body = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, body), 256)


def json_string(c: Column) -> Column:
    """JSON text of a string column with non-ASCII escaped; null becomes null.

    One regular expression pass per special class keeps this a built-in
    expression. Code points past ASCII are escaped as UTF-16 units.
    """
    esc = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, out in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        esc = F.replace(esc, F.lit(raw), F.lit(out))
    units = F.split(esc, "")

    def unit(ch: Column) -> Column:
        code = F.ascii(ch)
        h = F.lower(F.hex(F.encode(ch, "UTF-16BE")))
        pair = F.when(
            F.length(h) > 4, F.concat(F.lit("\\u"), F.substring(h, 1, 4), F.lit("\\u"), F.substring(h, 5, 4))
        ).otherwise(F.concat(F.lit("\\u"), h))
        return F.when((code < 32) | (code > 126), pair).otherwise(ch)

    plain = ~esc.rlike("[^\\x20-\\x7e]")
    body = F.when(plain, esc).otherwise(F.array_join(F.transform(F.filter(units, lambda u: u != ""), unit), ""))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def stable_id(*parts: str | Column, length: int = 16) -> Column:
    """Deterministic identifier from its parts."""
    return F.substring(F.sha2(F.concat_ws(":", *[col(p).cast("string") for p in parts]), 256), 1, length)


def unit_hash(*parts: Column) -> Column:
    """Deterministic value in [0, 1) from the first 32 bits of an MD5."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0


# -- parsing ---------------------------------------------------------------
def rational(c: Column) -> Column:
    """P3: "30000/1001" or a plain number; null when not parseable or /0."""
    p = F.split(c, "/")
    num, den = F.get(p, 0).try_cast("double"), F.get(p, 1).try_cast("double")
    return F.when(F.size(p) == 1, num).otherwise(F.try_divide(num, den))


def lower_keys(m: Column) -> Column:
    """Map with lower-case keys; the first spelling of a key wins."""
    e = F.transform(F.map_entries(m), lambda kv: F.struct(F.lower(kv["key"]).alias("key"), kv["value"].alias("value")))
    first = lambda a: F.filter(a, lambda kv, i: F.array_position(a["key"], kv["key"]) == i + 1)
    return F.map_from_entries(let(e, first))


def tag(m: Column, *names: str) -> Column:
    """First non-empty tag among ``names`` (case-insensitive)."""
    low = lower_keys(m)
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(low, F.lit(n.lower()))), F.lit("")) for n in names])


def parse_ts(c: Column) -> Column:
    """P5: timestamp from ``yyyy-MM-dd`` or ``yyyy:MM:dd``, with an optional time after a blank or T,
    fraction and zone (Z, +hh:mm, +hhmm); UTC when no zone is given, null for anything else.

    The text is brought to one form and cast, which neither throws nor tries formats in turn.
    """
    c = F.trim(c)
    iso = F.regexp_replace(c, r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")
    iso = F.regexp_replace(iso, r"(:\d{2}[.\d]*[+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(c.rlike(r"^\d{4}[-:]\d{2}[-:]\d{2}([T ]\d|$)"), iso.try_cast("timestamp"))


def tz_offset_hours(c: Column) -> Column:
    """P5: zone offset in hours from trailing ``+hh:mm``/``+hhmm``/``Z``."""
    m = F.regexp_extract(c, r"([+-])(\d{2}):?(\d{2})$", 0)
    sign = F.when(F.substring(m, 1, 1) == "-", -1.0).otherwise(1.0)
    hh = F.regexp_extract(c, r"[+-](\d{2}):?\d{2}$", 1).try_cast("double")
    mm = F.regexp_extract(c, r"[+-]\d{2}:?(\d{2})$", 1).try_cast("double")
    has_time = c.rlike(r"\d{2}:\d{2}")
    return F.when(c.rlike("[zZ]$"), F.lit(0.0)).when(has_time & (m != ""), sign * (hh + mm / 60.0))


def gps(c: Column) -> Column:
    """ISO 6709 ``+52.5200+013.4050/`` to struct(lat, lon); null if absent."""
    pat = r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)"
    lat, lon = F.regexp_extract(c, pat, 1).try_cast("double"), F.regexp_extract(c, pat, 2).try_cast("double")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def gps_valid(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def gps_zone_mismatch(lon: Column, offset_hours: Column, tolerance: float = 2.0) -> Column:
    """Longitude implies about lon/15 hours; true when further off than tolerance."""
    return F.abs(lon / 15.0 - offset_hours) > tolerance


# -- intervals -------------------------------------------------------------
def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """P10: open-interval overlap; touching ends do not overlap."""
    return (a0 < b1) & (a1 > b0)


def timecode(sec: Column) -> Column:
    """P10: MM:SS.mmm."""
    m = F.floor(sec / 60).cast("int")
    return F.format_string("%02d:%06.3f", m, sec - m * 60)


def pixel_box(region: Column, width: Column, height: Column) -> Column:
    """P10: normalised x, y, w, h to whole pixels."""
    part = lambda f, s: (region[f] * s).cast("int").alias(f)
    return F.struct(part("x", width), part("y", height), part("w", width), part("h", height))


# -- levels ----------------------------------------------------------------
SEVERITIES = ("info", "low", "medium", "high", "critical")


def severity_of(p: Column) -> Column:
    """Tampering probability to severity."""
    return band(p, (0.25, 0.45, 0.65, 0.80), SEVERITIES)


def severity_rank(s: Column) -> Column:
    """Case-insensitive rank; unknown names rank lowest."""
    return (F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), F.lower(s)), F.lit(0)), F.lit(1)) - 1).cast("int")


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in SEVERITIES]), rank + 1)


def elevated(score: Column, skipped: Column, cut: float) -> Column:
    """A skipped detector is never elevated."""
    return (~skipped) & (score >= cut)


# -- findings --------------------------------------------------------------
FINDING = (
    "struct<module:string,type:string,severity:string,confidence:double,score:double,weight:double,"
    "start_s:double,end_s:double,detail:string>"
)


def finding(
    module: str | Column,
    type: str | Column,
    severity: str | Column,
    confidence: float | Column | None = None,
    score: float | Column | None = None,
    weight: float | Column | None = None,
    start: Column | None = None,
    end: Column | None = None,
    detail: str | Column | None = None,
) -> Column:
    """One finding struct; scores and confidences are clamped to [0, 1]."""
    num = lambda v: lit(v).cast("double")
    unit = lambda v: clamp(num(v))
    return F.struct(
        lit(module).alias("module"),
        lit(type).alias("type"),
        lit(severity).alias("severity"),
        unit(confidence).alias("confidence"),
        unit(score).alias("score"),
        num(weight).alias("weight"),
        num(start).alias("start_s"),
        num(end).alias("end_s"),
        lit(detail).cast("string").alias("detail"),
    )


def explode_rules(df, keep: Sequence[str], rules: Sequence[Column]):
    """Rows that fire: one output row per non-null finding struct."""
    # the array is its own projection, so the rules run as generated code before the explode
    rows = df.select(*keep, F.array(*rules).alias("_rules")).select(*keep, F.explode("_rules").alias("f"))
    return rows.filter(F.col("f").isNotNull()).select(*keep, "f.*")
