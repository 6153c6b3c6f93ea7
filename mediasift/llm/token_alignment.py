"""Cross-tokenizer alignment: character spans of two tokenizers as coarse cuts, refined with decoded bytes."""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import written

# Most id pairs that are broadcast: those counted most often, 24 bytes each. The others meet their documents in a shuffle join.
HOT_PAIRS = 200_000

DOC_SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
SPAN_SCHEMA = DOC_SCHEMA + ", a_ids array<int>, a_ends array<long>, b_ids array<int>, b_ends array<long>, cuts array<long>"


@dataclass
class Side:
    """One tokenizer: how to get ids and character spans, and the bytes of each id."""

    encode: object
    table: np.ndarray = field(repr=False)  # bytes of each id
    sizes: np.ndarray = field(repr=False)

    def cuts(self, text: str, data: bytes, at: np.ndarray | None, shift: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and byte ends of the tokens; None if their bytes aren't ``data``.

        ``at`` gives the byte place of each character of ``text`` (None: one byte each). A span that ends on a
        character border gives the end; tokens that are part of a character share its span or have an
        empty one, and take the length of their decoded bytes.
        """
        ids, begin, end = self.encode(text)
        if not len(ids) or b"".join(self.table[ids].tolist()) != data:
            return None
        coarse = (end if at is None else at[end]) + shift
        part = (begin >= end) | np.r_[begin[1:] < end[:-1], False]
        if part.any():
            coarse = np.where(part, np.cumsum(self.sizes[ids]), coarse)
        return ids, coarse


def _arrays(ids: list[int], spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, first and end characters of the tokens."""
    n = len(ids)
    flat = np.fromiter(chain.from_iterable(spans), np.int64, 2 * n)
    return np.fromiter(ids, np.int64, n), flat[::2], flat[1::2]


def byte_level_side(path: str) -> Side:
    """A byte-level BPE file of ``tokenizers``; special strings inside texts are plain text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printable)))}
    table = np.empty(tok.get_vocab_size(), dtype=object)
    for piece, i in tok.get_vocab().items():
        known = all(c in to_byte for c in piece)
        table[i] = bytes(to_byte[c] for c in piece) if known else piece.encode()

    def encode(text: str):
        e = tok.encode(text, add_special_tokens=False)
        return _arrays(e.ids, e.offsets)

    return Side(encode, table, np.array([len(b) for b in table], np.int64))


def piece_side(path: str) -> Side:
    """A ``sentencepiece`` model; it puts a space before the text itself. Spans are those of its immutable
    proto, read through the offset mapping, the form in which the installed version still gives them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = np.empty(sp.get_piece_size(), dtype=object)
    for i in range(len(table)):
        p = sp.id_to_piece(i)
        table[i] = bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    def encode(text: str):
        m = sp.encode_as_offset_mapping(text)
        return _arrays(m["ids"], m["offsets"])

    return Side(encode, table, np.array([len(b) for b in table], np.int64))


# A cut of the spaced text: in front of a space that follows a character which is surely none.
UNSAFE = re.compile(r"[\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff\u2581] ")
SAFE_CUT = re.compile(r"(?<=[^\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff\u2581]) ")
# A part that ends in up to three ASCII marks behind a letter.
TAIL = re.compile(r"(.*[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([!-/:-@\[-`{-~]{1,3})", re.DOTALL)
CROSSING = re.compile(rb"(?=([A-Za-z\x80-\xff][!-/:-@\[-`{-~]))")
# Segments and characters of them in each of the two generations a worker remembers, and characters that are encoded at once.
KNOWN_SEGMENTS, KNOWN_CHARS, CHUNK = 200_000, 10_000_000, 3_000


class Tokens(NamedTuple):
    """Ids and byte ends of both sides over space + text, and the common ends."""

    a_ids: np.ndarray
    a_ends: np.ndarray
    b_ids: np.ndarray
    b_ends: np.ndarray
    cuts: np.ndarray


class Aligner:
    """Aligns the tokens of two tokenizers on many texts.

    No token of either side runs over a space behind a solid character, so a text is cut there into parts that
    each stand for a space and themselves, and each distinct part is encoded and aligned once. A model that
    has a piece with such an inner space gets whole texts. Marks at the end of a part are aligned apart from what
    precedes them, unless some token has that letter and that mark side by side.
    """

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = byte_level_side(path_a), piece_side(path_b)
        self.whole = any(SAFE_CUT.search(t.decode(errors="replace")) for side in (self.a, self.b) for t in side.table)
        self.width = max(len(self.a.table), len(self.b.table))
        # bytes of a letter's end and a mark that a token may join, and what marks behind a letter come to
        self.crossing = {pair for side in (self.a, self.b) for t in side.table for pair in CROSSING.findall(t)}
        self.tails: dict[str, tuple | None] = {}
        # text of each id with each of the separators that may follow it
        self.shown = np.array([f"{i}{s}" for s in (",", "|", ";") for i in range(self.width)], dtype=object)
        # what was met since the last change of generations, and before it: a part met in between stays
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        self.chars = 0

    def align(self, text: str) -> Tokens | None:
        """The tokens of a whole text; None if their bytes aren't those of space + text."""
        spaced = " " + text
        data = spaced.encode()
        at = None
        if len(data) != len(spaced):
            c = np.frombuffer(spaced.encode("utf-32-le"), "<u4")
            at = np.r_[0, np.cumsum(1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))]
        a = self.a.cuts(spaced, data, at, 0)
        b = a and self.b.cuts(text, data, None if at is None else at[1:], 1 if at is None else 0)
        return Tokens(*a, *b, a[1][np.isin(a[1], b[1], assume_unique=True)]) if a and b else None

    def parts(self, text: str) -> list[str]:
        if self.whole:
            return [text]
        parts = SAFE_CUT.split(text) if text[0] == " " or UNSAFE.search(text) else text.split(" ")
        if len(parts) > 1 and not parts[-1]:  # a model puts no space before nothing
            parts[-2:] = [parts[-2] + " "]
        return parts

    def _remember(self, parts: list[str]) -> None:
        """Align parts in one go; halves of those that don't give their bytes back are tried alone."""
        got = self.align(" ".join(parts))
        if got is None:
            if len(parts) == 1:
                self.known[parts[0]] = None
            else:
                self._remember(parts[: len(parts) // 2])
                self._remember(parts[len(parts) // 2 :])
            return
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        ga, gb = np.searchsorted(got.cuts, got.a_ends), np.searchsorted(got.cuts, got.b_ends)
        last_a, last_b = got.cuts[ga] == got.a_ends, got.cuts[gb] == got.b_ends
        place = np.concatenate([last_a * self.width + got.a_ids, 2 * last_b * self.width + got.b_ids])
        order = np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")
        shown = self.shown[place[order]].tolist()
        pairs = ((got.a_ids[last_a] << 32) | got.b_ids[last_b]).tobytes()
        na, nb, nc = (np.searchsorted(e, ends, side="right").tolist() for e in (got.a_ends, got.b_ends, got.cuts))
        i = j = k = 0
        for part, x, y, z in zip(parts, na, nb, nc):
            self.known[part] = (x - i, y - j, z - k, "".join(shown[i + j : x + y]), pairs[8 * k : 8 * z])
            i, j, k = x, y, z

    def _tail(self, tail: str) -> tuple | None:
        """What marks behind a letter add to its part; None if they can't be told apart."""
        if tail not in self.tails:
            got = None
            if b"a" + tail[0].encode() not in self.crossing:
                held, self.known = self.known, {}
                self._remember(["a"])
                self._remember(["a" + tail])
                one, both = self.known["a"], self.known["a" + tail]
                self.known = held
                if both and one and both[3].startswith(one[3]) and both[4].startswith(one[4]):
                    got = (*(x - y for x, y in zip(both[:3], one)), both[3][len(one[3]) :], both[4][len(one[4]) :])
            self.tails[tail] = got
        return self.tails[tail]

    def _split(self, part: str) -> tuple[str, tuple] | None:
        """A part without the marks at its end, and what they add."""
        m = None if self.whole else TAIL.fullmatch(part)
        if not m or m[1][-1].encode()[-1:] + m[2][0].encode() in self.crossing:
            return None
        tail = self._tail(m[2])
        return tail and (m[1], tail)

    def summaries(self, texts: list[str | None]) -> list[tuple | None]:
        """Per text: counts, digest of ``a1,a2|b1;a3|b2,b3`` and the distinct linked id pairs (a id << 32 | b id) with their numbers.

        A text is refused as a whole: None if it is null or empty or any of its bytes is not given back.
        """
        split = [self.parts(t) if t else None for t in texts]
        missing = {p: None for parts in split if parts for p in parts if p not in self.known}
        new = [p for p in missing if p not in self.older]
        self.known.update((p, self.older[p]) for p in missing if p in self.older)
        ends = {p: got for p in new if (got := self._split(p))}
        stems = dict.fromkeys(stem for stem, _ in ends.values() if stem not in self.known)
        self.known.update((p, self.older[p]) for p in stems if p in self.older)
        new = dict.fromkeys(p for p in chain(stems, new) if p not in ends and p not in self.known)
        chunk, size = [], 0
        for p in new:
            # only a part that ends in a solid character can have another behind it
            if self.whole or not p or UNSAFE.match(p[-1] + " "):
                self._remember([p])
                continue
            chunk.append(p)
            size += len(p)
            if size >= CHUNK:
                self._remember(chunk)
                chunk, size = [], 0
        if chunk:
            self._remember(chunk)
        for p, (stem, tail) in ends.items():
            got = self.known[stem]
            self.known[p] = got and tuple(x + y for x, y in zip(got, tail))
        for p in stems:
            if p not in missing:
                del self.known[p]
        out = []
        for parts in split:
            got = [self.known[p] for p in parts] if parts else [None]
            if None in got:
                out.append(None)
                continue
            n_a, n_b, n_groups, shown, pairs = zip(*got)
            keys, n = np.unique(np.frombuffer(b"".join(pairs), np.int64), return_counts=True)
            out.append((sum(n_a), sum(n_b), sum(n_groups), hashlib.sha256("".join(shown)[:-1].encode()).hexdigest(), keys, n))
        self.chars += sum(map(len, missing))
        if len(self.known) > KNOWN_SEGMENTS or self.chars > KNOWN_CHARS:
            self.older, self.known, self.chars = self.known, {}, 0
        return out


@contextmanager
def uncollected():
    """No search for reference cycles inside: the many entries made there hold none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of a worker process; its next task starts with the parts it knows."""
    return Aligner(path_a, path_b)


def _batches(frames: Iterator[pd.DataFrame], rows: int = 200, chars: int = 2_000_000) -> Iterator[list[tuple]]:
    held, size = [], 0
    for f in frames:
        for row in f.itertuples(index=False, name=None):
            held.append(row)
            size += len(row[2]) if isinstance(row[2], str) else 0
            if len(held) >= rows or size >= chars:
                yield held
                held, size = [], 0
    if held:
        yield held


def alignments(df: DataFrame, path_a: str, path_b: str, ident: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """One row per row of ``df``: counts, digest of the groups and the linked id pairs of the text.

    Tokens of both sides cover the bytes of space + text. Byte places where a token of either side ends cut
    them into groups; the two tokens that end there are linked, as no token is empty. ``pairs`` has each linked id pair
    once (a id << 32 | b id) and ``times`` its number of links. With ``spans`` the row also has ids and byte
    ends of all tokens and the common ends (``cuts``). ``row`` numbers rows.

    Null and empty texts, and those whose token bytes differ from space + text on either side, have no tokens: zeros,
    an empty digest and no pairs. Whole texts are encoded; repeated rows come once each; ids may be null; other
    columns are ignored; an empty table gives an empty table.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        al = aligner(path_a, path_b)
        empty = np.empty(0, np.int64)
        none = (0, 0, 0, "", empty, empty)
        names = [c.split()[0] for c in (SPAN_SCHEMA if spans else DOC_SCHEMA).split(", ")]
        for rows in _batches(frames):
            texts = [t if isinstance(t, str) else None for _, _, t in rows]
            out = []
            with uncollected():
                summaries = al.summaries(texts)
            for (row, doc, _), text, got in zip(rows, texts, summaries):
                more = () if not spans else tuple(al.align(text)) if got else (empty,) * 5
                out.append((row, doc, *(got or none), *more))
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    src = df.select(F.monotonically_increasing_id().alias("row"), F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return src.mapInPandas(run, SPAN_SCHEMA if spans else DOC_SCHEMA)


def pair_counts(docs: DataFrame) -> DataFrame:
    """``pair, n, best``: links of each id pair over all documents; ``best`` if no pair of its b id has more."""
    c = F.col
    each = docs.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(c("p.pairs").alias("pair"), c("p.times").alias("n"))
    total = written(each.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = c("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # one row per b id: bounded by the vocabulary
    top = total.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    return total.join(F.broadcast(top), b == c("b")).select("pair", "n", (c("n") == c("top")).alias("best"))


def corpus_links(docs: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``row, n_best, count_sum`` of the rows of ``docs`` (a written table of ``alignments``) that have links.

    A frequent id pair stands in nearly every document. The pairs counted most often, at most ``hot_pairs``, are broadcast;
    a cut by powers of two in their count finds them. The rest meet their documents in a shuffle join, and are
    rare by then. Sums per document are taken before each shuffle.
    """
    c = F.col
    pairs = written(pair_counts(docs), "counts")
    scale = F.floor(F.log2("n")).cast("int")
    cut, held = 64, 0
    for s, n in sorted(pairs.groupBy(scale.alias("s")).count().collect(), reverse=True):
        if held + n > hot_pairs:
            break
        cut, held = s, held + n
    hot, cold = pairs.filter(scale >= cut), pairs.filter(scale < cut)
    each = docs.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", c("p.pairs").alias("pair"), c("p.times").alias("t"))
    met = each.join(F.broadcast(hot), "pair", "left").groupBy("row").agg(
        F.sum(F.when(c("best"), c("t")).otherwise(0)).alias("n_best"), F.sum(F.coalesce(c("t") * c("n"), F.lit(0))).alias("count_sum")
    )
    rare = each.join(F.broadcast(hot), "pair", "left_anti").join(cold, "pair").groupBy("row").agg(
        F.sum(F.when(c("best"), c("t")).otherwise(0)).alias("n_best"), F.sum(c("t") * c("n")).alias("count_sum")
    )
    return met.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_tokenizers(df: DataFrame, path_a: str, path_b: str, ident: str = "doc_id", text: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Per row of ``df``: ``ident, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts links whose id pair is linked as often as any pair of its b id in the whole corpus and
    ``count_sum`` adds the corpus-wide counts of the links. Edge cases as in ``alignments``.
    """
    c = F.col
    docs = written(alignments(df, path_a, path_b, ident, text), "alignments")
    sums = corpus_links(docs, hot_pairs)
    zero = lambda n: F.coalesce(c(n), F.lit(0)).cast("long").alias(n)
    out = docs.select("row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256").join(sums, "row", "left")
    return out.select(c("doc_id").alias(ident), "n_a", "n_b", "n_groups", c("n_groups").alias("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
