"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import words

# The counted symbols, and frequent function words of four languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = {
    "en": "the of and to in is that it for was on are with as by this be at from or an not",
    "fr": "de la le les et des en un une du que est pour dans qui au par sur pas ne se",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als",
    "es": "de la que el en y a los se del las un por con una su para es al lo como",
}


@dataclass(frozen=True)
class Rule:
    """One row of the threshold table: the metric must lie in [low, high]; None is open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


# Ratios are per word, per line or per letter as the metric's name says; the two base rules are separate.
RULES = (
    Rule("mean_word_length", "chars_per_word", 1.5, 30.0),
    Rule("symbol_ratio", "symbols_per_word", None, 0.1),
    Rule("stop_words", "stop_word_ratio", 0.005, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.7),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.5),
    Rule("exclamations", "exclamations_per_word", None, 0.2),
    Rule("marks", "mark_ratio", None, 0.4),
)


def compile_rules(rules: tuple[Rule, ...], metrics: dict[str, Column]) -> Column:
    """Array of the names of rules a row breaks; a null metric breaks none."""
    broken = []
    for r in rules:
        m = metrics[r.metric]
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (m < F.lit(r.low))
        if r.high is not None:
            bad = bad | (m > F.lit(r.high))
        broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def _repeat_words(w: str, n: str) -> Column:
    """Words inside a 3-word window that occurs twice or more.

    Window hashes are sorted together with their place in one long (hash bits above, place
    below); equal neighbours are compared word by word, so the count doesn't rest on the
    hash. Work is n log n per text.
    """
    at = lambda j: f"cast(s[{j}] & (shiftleft(1L, a.k) - 1) as int)"
    same = " and ".join(f"{w}[{at('j')} + {o}] = {w}[{at('j + 1')} + {o}]" for o in range(3))
    return F.expr(f"""transform(array(named_struct('k', cast(ceil(log2({n} + 1)) as int))), a ->
      transform(array(sort_array(transform(sequence(0, {n} - 3), i ->
          (shiftleft(xxhash64({w}[i], {w}[i+1], {w}[i+2]), a.k) | cast(i as bigint))))), s ->
        transform(array(array_sort(array_distinct(flatten(transform(
            filter(sequence(0, {n} - 4), j -> shiftright(s[j] ^ s[j + 1], a.k) = 0 and {same}),
            j -> array({at('j')}, {at('j + 1')})))))), p ->
          aggregate(transform(p, (y, j) -> least(3, coalesce(get(p, j + 1) - y, 3))), 0L, (t, y) -> t + y))[0])[0])[0]""")


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "quality", min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Every row of ``df`` with one struct column ``into`` of counts, ratios and the verdict.

    Fields: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), the ratios of
    the threshold table (double), ``base_failed``, ``broken`` (names of broken rules) and ``kept``.
    All are Spark expressions in one narrow projection: no user function, no shuffle.

    Null and empty texts have zero words, null ratios, ``base_failed`` true and ``kept`` false.
    Repeated rows and ties are scored alike; an existing column ``into`` is replaced, other
    columns are left as they are; an empty table gives an empty table.
    """
    stops = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    t = F.coalesce(F.col(text), F.lit(""))
    marks = F.regexp_replace(t, r"[A-Za-z\x09-\x0D\x20\x{80}-\x{10FFFF}]+", "")
    keep = [F.col(f"`{c}`") for c in df.columns if c != into]
    base = df.select(F.struct(*keep).alias("_row"), t.alias("_t"), words(t).alias("_w"), marks.alias("_p"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    base = base.select("_row", "_w", "_p", "_l", F.size("_w").alias("_n"))
    c = F.col
    n, lines = c("_n"), F.size("_l")
    counts = base.select(
        "_row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_p") - F.length(F.translate("_p", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (lines - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 4, _repeat_words("_w", "_n")).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_w", lambda x: x.isin(stops))).alias("_stop"),
        F.length("_p").alias("_marks"),
        (F.length("_p") - F.length(F.translate("_p", "!", ""))).alias("_shouts"),
        lines.alias("_lines"),
        F.size(F.filter("_l", lambda x: x.rlike(r"^\s*[-*•]"))).alias("_bullets"),
        F.size(F.filter("_l", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).alias("_dots"),
    )
    per = lambda a, b: F.when(b > 0, a / b)
    metrics = {
        "chars_per_word": per(c("word_chars"), c("n_words")),
        "symbols_per_word": per(c("n_symbols"), c("n_words")),
        "stop_word_ratio": per(c("_stop"), c("n_words")),
        "exclamations_per_word": per(c("_shouts"), c("n_words")),
        "mark_ratio": per(c("_marks"), c("word_chars")),
        "dup_line_ratio": per(c("n_dup_lines"), c("_lines")),
        "bullet_line_ratio": per(c("_bullets"), c("_lines")),
        "ellipsis_line_ratio": per(c("_dots"), c("_lines")),
    }
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = (c("n_words") < min_words) | (100 * c("n_repeat_words") > max_repeat_percent * c("n_words"))
    scored = counts.select("_row", *names, *[m.alias(k) for k, m in metrics.items()], failed.alias("base_failed"), compile_rules(rules, metrics).alias("broken"))
    # always true, but the optimizer can't push a filter on the verdict below the counts, which
    # would write out all their expressions again inside the filter
    whole = F.monotonically_increasing_id() >= 0
    fields = F.struct(*names, *metrics, "base_failed", "broken", (whole & ~c("base_failed") & (F.size("broken") == 0)).alias("kept"))
    return scored.select("_row.*", fields.alias(into))
