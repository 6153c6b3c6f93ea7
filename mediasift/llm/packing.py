"""Best-fit packing of tokenised documents into sequences, with several capacities at once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how byte-level BPE files part a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


def cut(ids: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: full ones, but the first may be shorter."""
    n = len(ids)
    first = n % limit or min(n, limit)
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)]


def fast_encoder(tokenizer_path: str):
    """Text to ids of a byte-level BPE tokenizer file, as a numpy array.

    The file's vocabulary and pattern run in the quicker of two libraries; it is used only if
    the file is of the plain kind it knows (ids in merge order) and gives the same ids as the
    file's own library on a probe text, else that library encodes. It also encodes every text
    that the quicker one gives up on, such as one with a very long run of white space.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path)
    slow = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4")
    spec = json.load(open(tokenizer_path, encoding="utf-8"))
    vocab, special = spec["model"].get("vocab", {}), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
        return slow
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def fast(text: str) -> np.ndarray:
        try:
            return enc.encode_to_numpy(text, allowed_special="all").astype("<u4")
        except Exception:  # its pattern backtracks on a bounded stack
            return slow(text)

    probe = "Ökeiter chßung, it's  12 été\n\t #*& <|endoftext|> naïve  \u3000漢字 x" * 3
    return fast if np.array_equal(fast(probe), slow(probe)) else slow


def token_pieces(df: DataFrame, tokenizer_path: str, ident: str = "doc_id", text: str = "text", limit: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents: ids of the whole text, then ``end_id``, cut at ``limit``.

    Null text is empty and has the end id alone. Repeated rows give repeated pieces. Ids are
    little-endian unsigned 32-bit words under the checksum.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = fast_encoder(tokenizer_path)
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                ids = np.append(encode(text if isinstance(text, str) else ""), np.uint32(end_id)).astype("<u4")
                rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(ids, limit))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return df.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, PIECE_SCHEMA)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm") -> np.ndarray:
    """Bin number of each piece under residual (tokens, documents, attention cost) capacities.

    Pieces go in by falling length. Among the open bins where all three residuals suffice, the
    one with the smallest weighted residual norm after the piece ("norm") or the largest
    weighted dot-product of need and residual ("dot") takes it; ties go to the oldest bin; a
    piece that fits none opens a bin. Attention cost of a piece is its length squared.
    """
    cap = np.asarray(capacity, float)
    w = np.asarray(weights, float) / cap**2
    need = np.stack([lengths, np.ones_like(lengths), lengths.astype(float) ** 2], axis=1).astype(float)
    if (need > cap).any():
        raise ValueError("a piece is larger than a capacity")
    order = np.argsort(-lengths, kind="stable")
    smallest = int(lengths.min()) if len(lengths) else 0
    bins = np.empty(len(lengths), dtype=np.int64)
    left = np.empty((max(1, len(lengths)), 3))  # residuals of the open bins
    ids = np.empty(max(1, len(lengths)), dtype=np.int64)
    n_open = made = 0
    for k in order:
        v = need[k]
        r = left[:n_open]
        fits = np.flatnonzero((r >= v).all(axis=1))
        if len(fits):
            after = r[fits]
            score = ((after - v) ** 2) @ w if rule == "norm" else -((after * v) @ w)
            j = fits[int(np.argmin(score))]
        else:
            j = n_open
            left[j], ids[j] = cap, made
            n_open, made = n_open + 1, made + 1
        bins[k] = ids[j]
        left[j] -= v
        if left[j, 0] < smallest or left[j, 1] < 1:  # nothing more can fit; the order of the rest stays
            left[j : n_open - 1], ids[j : n_open - 1] = left[j + 1 : n_open].copy(), ids[j + 1 : n_open].copy()
            n_open -= 1
    return bins


def pack(pieces: DataFrame, groups: int, limit: int = 2048, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` (gapless from 0), packed inside ``groups`` groups.

    Pieces are dealt to groups by a hash of id, place, checksum and a number among equal pieces, so
    a group is as large as total / groups, also if ids are null or repeat; a group leaves about
    one sequence unfilled. Full pieces fill a sequence alone. The default document and cost
    capacities are the largest that the token capacity allows, so only the score uses them.
    """
    cap = (limit, max_docs or limit, max_cost or limit**2)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        n = frame["length"].to_numpy(np.int64)
        bins = best_fit(n, cap, rule=rule)
        order = np.argsort(bins, kind="stable")
        run_up = np.cumsum(n[order]) - n[order]
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = np.empty(len(n), dtype=np.int64)
        offset[order] = run_up - np.maximum.accumulate(np.where(first, run_up, 0))
        frame["sequence_id"] = (np.int64(frame["_group"].iloc[0]) << 32) + bins
        frame["offset"] = offset
        return frame.drop(columns="_group")

    # equal pieces are counted and numbered, so that nothing depends on the order of rows
    equal = pieces.groupBy("doc_id", "piece", "start", "length", "ids_crc32").agg(F.count(F.lit(1)).alias("_n"))
    each = equal.withColumn("_r", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "_r"), F.lit(groups)).cast("int"))
    grouped = each.drop("_n", "_r")
    return grouped.groupBy("_group").applyInPandas(run, PACKED_SCHEMA)


def pack_documents(df: DataFrame, tokenizer_path: str, ident: str = "doc_id", text: str = "text", limit: int = 2048, docs_per_group: int = 8192, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm") -> DataFrame:
    """Tokenise all documents and pack their pieces: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Only documents of more than ``limit`` tokens are cut. Null and empty texts are one piece of
    one token; repeated rows are packed once each; other columns are ignored; an empty table
    gives an empty table. Tokens themselves aren't shuffled, only (id, place, length, checksum).
    """
    groups = max(1, -(-df.count() // docs_per_group))
    return pack(token_pieces(df, tokenizer_path, ident, text, limit), groups, limit, max_docs, max_cost, rule)
