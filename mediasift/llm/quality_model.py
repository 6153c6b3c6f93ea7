"""Quality classifier: gated attention over the passages of a document (multiple-instance learning), in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from mediasift.llm.common import few_by_hash

PASSAGE_WORDS = 64
CLASSES, WORD_BUCKETS = 10, 16
WIDTH = CLASSES + WORD_BUCKETS + 5
_KIND: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Class of each code point: lower, upper, other letter, digit, space, line, stop, exclamation, symbol, rest."""
    if not _KIND:
        def kind(i: int) -> int:
            c = chr(i)
            if c.isalpha():
                return 0 if c.islower() else 1 if c.isupper() else 2
            return 3 if c.isdigit() else 5 if c in "\n\r" else 4 if c.isspace() else 6 if c in ".,;:?" else 7 if c in "!¡" else 8 if c in "#*$%&|<>=_~^@+" else 9

        _KIND.append(np.fromiter((kind(i) for i in range(0x110000)), np.int8, 0x110000))
    return _KIND[0]


def _blocks(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters, cut at white space."""
    at = 0
    while at < len(text):
        m = re.compile(r"\s").search(text, at + size)
        end = m.end() if m else len(text)
        yield text[at:end]
        at = end


def encode(text: str | None, block: int = 1 << 20) -> np.ndarray:
    """One row of features per passage of 64 words of the whole text; one row of zeros if it has no word."""
    parts = [x for b in _blocks(text or "", block) if len(x := _encode(b))]
    return np.concatenate(parts) if parts else np.zeros((1, WIDTH), np.float32)


def _encode(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    kind = _kinds()[c.astype(np.int64)].astype(np.int64)
    solid = (kind != 4) & (kind != 5)
    starts = np.flatnonzero(solid & np.r_[True, ~solid[:-1]])
    if not len(starts):
        return np.empty((0, WIDTH), np.float32)
    word = np.maximum(np.cumsum(np.isin(np.arange(len(c)), starts, assume_unique=True)) - 1, 0)
    n_pass = -(-len(starts) // PASSAGE_WORDS)
    passage = word // PASSAGE_WORDS
    chars = np.bincount(passage, minlength=n_pass)[:, None]
    shares = np.bincount(passage * CLASSES + kind, minlength=n_pass * CLASSES).reshape(n_pass, CLASSES) / chars
    mixed = np.where(solid, (c + np.uint64(1)) * (np.arange(len(c), dtype=np.uint64) - starts[word].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))
    mixed ^= mixed >> np.uint64(31)
    h = np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts)
    of = np.arange(len(starts)) // PASSAGE_WORDS
    words = np.bincount(of, minlength=n_pass)
    hashed = np.bincount(of * WORD_BUCKETS + (h >> np.uint64(60)).astype(np.int64), minlength=n_pass * WORD_BUCKETS).reshape(n_pass, WORD_BUCKETS) / words[:, None]
    distinct = np.bincount((np.unique(np.stack([of.astype(np.uint64), h], axis=1), axis=0)[:, 0]).astype(np.int64), minlength=n_pass) / words
    again = np.bincount(of[1:][h[1:] == h[:-1]], minlength=n_pass) / words
    letters = np.bincount(passage[solid], minlength=n_pass) / words
    lone = np.bincount(of, (np.diff(np.r_[starts, len(c)]) <= 2).astype(float), n_pass) / words
    return np.concatenate([shares, hashed, np.stack([distinct, again, np.log1p(letters), lone, np.log1p(words)], axis=1)], axis=1).astype(np.float32)


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class AttentionModel:
    """Passage encoder, gated attention and the score of the weighted passage representation."""

    mean: np.ndarray
    std: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, seg: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - self.mean) / self.std
        h = np.tanh(x @ p["w1"] + p["b1"])
        t, s = np.tanh(h @ p["v"]), _sig(h @ p["u"])
        e = (t * s) @ p["w"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, seg, e)
        a = np.exp(e - top[seg])
        a /= np.bincount(seg, a, n)[seg]
        z = np.stack([np.bincount(seg, a * h[:, j], n) for j in range(h.shape[1])], axis=1)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": _sig(z @ p["c"] + p["b"])}

    def score(self, text: str | None) -> float:
        x = encode(text)
        return float(self.forward(x, np.zeros(len(x), np.int64), 1)["y"][0])


def fit(texts: list[str | None], labels: list[int], hidden: int = 16, gate: int = 8, epochs: int = 30, rate: float = 0.01, seed: int = 3) -> AttentionModel:
    """Adam on the cross-entropy of document labels; the attention weights are learned from them alone."""
    rng = np.random.default_rng(seed)
    bags = [encode(t) for t in texts]
    y = np.asarray(labels, float)
    every = np.concatenate(bags) if bags else np.zeros((1, WIDTH))
    p = {"w1": rng.normal(0, 0.2, (WIDTH, hidden)), "b1": np.zeros(hidden), "v": rng.normal(0, 0.3, (hidden, gate)), "u": rng.normal(0, 0.3, (hidden, gate)), "w": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "b": np.zeros(1)}
    model = AttentionModel(every.mean(axis=0), every.std(axis=0) + 1e-3, p)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    parts = max(1, len(bags) // 128)
    # a small sample gets as many steps as a large one
    for _ in range(max(epochs, -(-600 // parts)) if bags else 0):
        for part in np.array_split(rng.permutation(len(bags)), parts):
            x, n = np.concatenate([bags[j] for j in part]), len(part)
            seg = np.repeat(np.arange(n), [len(bags[j]) for j in part])
            f = model.forward(x, seg, n)
            h, t, s, a = f["h"], f["t"], f["s"], f["a"]
            dy = (f["y"] - y[part]) / n
            dz = dy[:, None] * p["c"]
            dh = a[:, None] * dz[seg]
            da = (h * dz[seg]).sum(axis=1)
            de = a * (da - np.bincount(seg, a * da, n)[seg])
            dts = de[:, None] * p["w"]
            dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
            dh += dt @ p["v"].T + ds @ p["u"].T
            d1 = dh * (1 - h * h)
            g = {"w1": f["x"].T @ d1 + 1e-4 * p["w1"], "b1": d1.sum(axis=0), "v": h.T @ dt, "u": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ dy + 1e-4 * p["c"], "b": dy.sum(keepdims=True)}
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", max_docs: int = 4000, max_chars: int = 50_000) -> AttentionModel:
    """Fit on a bounded sample: the texts, of at most ``max_chars``, of ``max_docs`` labelled keys.

    The sample takes keys by their hash, so it is bounded before it is broadcast to the one
    scan of ``docs``. Null labels are left out and null texts count as empty; without any row
    the model scores every text about alike.
    """
    known = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    hashed = known.withColumn("h", F.xxhash64(F.col("k").cast("string"), F.lit("quality")))
    picked = few_by_hash(hashed, "h", max_docs, known.count()).orderBy("h", "k", "y").limit(max_docs)
    short = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.coalesce(F.length("t"), F.lit(0)) <= max_chars)
    # labelled ids may repeat: which rows stay is settled by hash and text, not by partitions
    near = short.join(F.broadcast(picked), "k").orderBy("h", "k", F.xxhash64("t"), "y").limit(2 * max_docs)
    got = sorted(near.collect(), key=lambda r: (r.k, r.t or "", r.y))
    return fit([r.t for r in got], [r.y for r in got])


def classify(df: DataFrame, model: AttentionModel, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with a double column ``into`` from 0 to 1 over the whole text; higher: label 1 likelier.

    Null, empty and wordless texts are scored as one empty passage. Repeated rows score alike;
    an existing column ``into`` is replaced; an empty table stays empty.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for s in parts:
            yield pd.Series([m.score(t if isinstance(t, str) else None) for t in s], dtype=float)

    return df.withColumn(into, score.asNondeterministic()(F.col(text)))
