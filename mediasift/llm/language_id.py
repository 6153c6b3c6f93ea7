"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

UNKNOWN = "und"
RESULT = "lang_pred string, score double, accepted boolean"
_ALPHA: list[np.ndarray] = []


def _alpha() -> np.ndarray:
    """Which code points are letters; built once per process."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points between single spaces; empty if there is no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _alpha()[c]
    if not letter.any():
        return np.empty(0, np.uint32)
    c = np.where(letter, c, 32)
    keep = letter | np.r_[True, letter[:-1]]
    return np.r_[32, c[keep], 32].astype(np.uint32)


def buckets(c: np.ndarray, bits: int) -> np.ndarray:
    """Hashed places of all 1-, 2- and 3-grams of code points."""
    x = c.astype(np.uint64)
    out, h = [], np.zeros(len(x), np.uint64)
    for n in range(1, 4):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + x[n - 1 :] + np.uint64(n)
        m = h ^ (h >> np.uint64(29))
        out.append(((m * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, np.int64)


@dataclass
class LanguageModel:
    """``table[b]`` is an embedding times the softmax weights: scores of a text are a mean of rows."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int

    def scores(self, text: str, block: int = 1 << 20) -> np.ndarray | None:
        """Calibrated probabilities over the whole text; None without a letter or a label."""
        c = codes(text)
        if not len(c) or not self.labels:
            return None
        total, n = np.zeros(len(self.labels)), 0
        for at in range(0, len(c), block):  # neighbouring blocks share two code points
            b = buckets(c[at : at + block + 2], self.bits)
            total += self.table[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        return _softmax((total / n + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        p = None if text is None else self.scores(text)
        if p is None:
            return UNKNOWN, 0.0, False
        k = int(np.argmax(p))
        return self.labels[k], float(p[k]), bool(p[k] >= self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: list[str], langs: list[str], bits: int = 15, dim: int = 8, epochs: int = 6, rate: float = 4.0, snippet: int = 300, snippets: int = 3, seed: int = 7) -> LanguageModel:
    """Fit on snippets of the texts by mini-batch SGD; a fifth of the texts calibrates.

    The temperature minimises the loss on the calibration snippets, a third of which are short; the
    rejection threshold is the lowest score that 99.9 % of the right answers reach, 0.5 at most.
    """
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    size, k = 1 << bits, len(labels)
    narrow = np.uint16 if bits <= 16 else np.int32  # thousands of snippets are held at once
    emb, w, bias = rng.normal(0, 0.1, (size, dim)), np.zeros((dim, k)), np.zeros(k)
    if not labels:
        return LanguageModel([], np.zeros((size, 0), np.float32), bias, 1.0, 0.5, bits)
    sets: tuple[list, list] = ([], [])
    for i, (t, lang) in enumerate(zip(texts, langs)):
        c = codes(t)
        for s in range(snippets if len(c) else 0):
            width = snippet if s else int(rng.integers(20, 120))
            at = int(rng.integers(0, max(1, len(c) - width + 1)))
            sets[i % 5 == 4 and len(texts) > 20].append((buckets(c[at : at + width], bits).astype(narrow), labels.index(lang)))
    train, held = sets
    # a class counts as much as another, whatever its share
    share = np.bincount([y for _, y in train], minlength=k)
    weight = np.where(share > 0, len(train) / np.maximum(1, share) / k, 0.0)
    parts = max(1, len(train) // 256)
    epochs = max(epochs, -(-280 // parts))  # a small sample gets as many steps as a large one
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(len(train)), parts):
            if not len(part):
                continue
            ids = np.concatenate([train[j][0] for j in part])
            n = np.array([len(train[j][0]) for j in part])
            doc = np.repeat(np.arange(len(part)), n)
            mean = np.stack([np.bincount(doc, emb[ids, d], len(part)) for d in range(dim)], axis=1) / n[:, None]
            y = np.array([train[j][1] for j in part])
            g = _softmax(mean @ w + bias)
            g[np.arange(len(part)), y] -= 1
            g *= weight[y][:, None] / len(part)
            back = (g @ w.T) / n[:, None]
            w -= step * (mean.T @ g)
            bias -= step * g.sum(axis=0)
            for d in range(dim):
                emb[:, d] -= step * 20 * np.bincount(ids, back[doc, d], size)
    table = (emb @ w).astype(np.float32)
    temperature, threshold = 1.0, 0.5
    if held:
        z = np.stack([table[b].mean(axis=0) + bias for b, _ in held])
        y = np.array([v for _, v in held])
        grid = np.geomspace(0.05, 4, 40)
        temperature = float(grid[np.argmin([-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid])])
        p = _softmax(z / temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        threshold = float(min(0.5, np.quantile(right, 0.001))) if len(right) else 0.5
    return LanguageModel(labels, table, bias, temperature, threshold, bits)


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = 4000, max_chars: int = 5_000, min_per_lang: int = 200) -> LanguageModel:
    """Fit on a bounded sample of the labelled rows: about ``max_docs`` texts in proportion to the languages, and of each
    language at least ``min_per_lang`` if it has so many, so that every label is learned, however small its share.

    A text longer than ``max_chars`` gives an excerpt of that length, at a place that its hash names; so the sample has at most
    texts times ``max_chars`` characters. The languages are counted in one pass and all samples are taken in a second, by the hash of
    key and text: the same rows on every run, whatever the number of languages or partitions. Null texts and labels
    are left out; without any row the model knows no label.
    """
    c = F.col
    known = df.filter(c(lang).isNotNull() & c(text).isNotNull()).select(c(text).alias("t"), c(lang).alias("l"), F.xxhash64(c(key).cast("string"), F.lit("lang")).alias("h"))
    counts = {r["l"]: r["count"] for r in known.groupBy("l").count().collect()}
    total = sum(counts.values())
    if not total:
        return fit([], [])
    want = {l: max(min(n, min_per_lang), -(-max_docs * n // total)) for l, n in counts.items()}
    per = lambda f: F.create_map(*[F.lit(x) for l in sorted(counts) for x in (l, f(l))])[c("l")]
    # a hash bound per language leaves a few times what is wanted before anything is sorted
    bound = per(lambda l: int(min(1.0, 4.0 * want[l] / counts[l]) * (1 << 30)) + 1)
    start = 1 + F.pmod(c("h"), F.greatest(F.lit(1), F.length("t") - max_chars + 1)).cast("int")
    few = known.filter(F.pmod(c("h"), F.lit(1 << 30)) < bound).select("l", "h", F.substring("t", start, F.lit(max_chars)).alias("t"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    got = few.withColumn("r", rank).filter(c("r") <= per(lambda l: want[l])).select("h", "t", "l").toArrow()
    got = sorted(zip(*(got.column(x).to_pylist() for x in ("h", "t", "l"))))
    return fit([t for _, t, _ in got], [l for *_, l in got])


def predictor(spark, model: LanguageModel):
    """Column function: text to struct(lang_pred, score, accepted)."""
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf(RESULT)
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for s in parts:
            yield pd.DataFrame([m.predict(t if isinstance(t, str) else None) for t in s], columns=["lang_pred", "score", "accepted"])

    # not deterministic to the optimizer: it then runs once per row, however often it is used
    return predict.asNondeterministic()


def identify(df: DataFrame, model: LanguageModel, text: str = "text", into: str = "lid") -> DataFrame:
    """``df`` with a struct column ``into``: ``lang_pred``, ``score`` (0 to 1) and ``accepted``.

    The whole text is scored. Null texts and texts without a letter get ``und``, 0 and false.
    Repeated rows score alike; an existing column ``into`` is replaced; an empty table stays empty.
    """
    return df.withColumn(into, predictor(df.sparkSession, model)(F.col(text)))


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Rows kept from training: crc32 of the key's text; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))
