"""Conversation structure repair: weighted CYK interval parsing of the turns of each conversation."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediasift.llm.common import written

# A conversation of more turns or characters than this is parsed in blocks by several tasks.
BLOCK_TURNS, BLOCK_CHARS = 4096, 8_000_000

# Costs of the edits; an undeleted truncated turn costs ``TRUNCATED`` more.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3

# States of the form ``(s?(ua)+)?`` and its moves by role initial. A non-terminal of the grammar is a pair of
# states (p, q): the spans that lead from p to q. Its rules are (p, q) -> (p, r) (r, q), a turn kept, given another role
# or deleted between insertions, and insertions alone.
STATES, START, FINAL = range(4), 0, (0, 3)
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

OK, CUT, DROP = ".", "t", "d"  # fault class of a turn: none, truncated, has to be deleted


def product(left: dict, right: dict) -> dict:
    """Cells of a span from those of its two parts: the least (cost, audit) over all middle states.

    An audit's letters fix its cost, so of two audits with one cost and one span neither begins the
    other, and the least of a span is made of least parts.
    """
    out: dict = {}
    for (p, r), (c1, a1) in left.items():
        for q in STATES:
            got = right.get((r, q))
            if got is not None:
                new = (c1 + got[0], a1 + got[1])
                if (p, q) not in out or new < out[p, q]:
                    out[p, q] = new
    return out


def _closure() -> dict:
    """Insertion closure: cells of the empty span."""
    cells = {(p, p): (0, "") for p in STATES}
    once = cells | {(p, q): (INSERT, "I") for (p, s), q in MOVES.items() if s in "ua"}
    for _ in STATES:
        cells = product(cells, once)
    return cells


EMPTY = _closure()


@lru_cache(maxsize=None)
def turn_cells(initial: str, fault: str) -> dict:
    """Cells of one turn with insertions on both sides."""
    cells = {(p, p): (DELETE, "D") for p in STATES}
    if fault != DROP:
        more = TRUNCATED if fault == CUT else 0
        for (p, s), q in MOVES.items():
            if s in "ua":
                cells[p, q] = min(cells.get((p, q), (99, "")), (REROLE + more, "R"))
            if s == initial:
                cells[p, q] = min(cells.get((p, q), (99, "")), (more, "K"))
    return product(product(EMPTY, cells), EMPTY)


@lru_cache(maxsize=1 << 14)
def _short_span(codes: tuple) -> dict:
    if len(codes) == 1:
        return turn_cells(*codes[0])
    half = 1 << (len(codes) - 1).bit_length() - 1
    return product(_short_span(codes[:half]), _short_span(codes[half:]))


def span_cells(codes: list[tuple[str, str]]) -> dict:
    """Cells of a sequence of turns, bottom-up by span length: 8 turns, then 16, 32 and so on.

    The grammar's non-terminals are intervals of states, so every split of a span gives the same cells and one split suffices.
    """
    if not codes:
        return EMPTY
    level = [_short_span(tuple(codes[i : i + 8])) for i in range(0, len(codes), 8)]
    while len(level) > 1:
        level = [product(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def least(cells: dict) -> tuple[int, str]:
    return min(cells[START, f] for f in FINAL if (START, f) in cells)


def apply_audit(audit: str, turns: list[tuple[str, str]], state: int = START) -> tuple[list[str], int]:
    """``role:text`` of the repaired turns and the state after them; the form fixes which role is put in."""
    out, at = [], 0
    for edit in audit:
        initial = "a" if state == 2 else "u"
        if edit == "K":
            role, text = turns[at]
            initial = role[:1]
        elif edit != "D":
            role, text = ("assistant" if initial == "a" else "user"), ("" if edit == "I" else turns[at][1])
        at += edit != "I"
        if edit != "D":
            state = MOVES[state, initial]
            out.append(f"{role}:{text}")
    return out, state


def fault_of(text: str) -> str | None:
    """``blank``, ``truncated`` or None; characters other than ASCII white space count."""
    bare = text.strip(" \t\n\x0b\x0c\r")
    return "blank" if not bare else "truncated" if bare[-1] not in ".!?" else None


def _mark(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Part:
    """Turns of one conversation in order: faults and codes; a whole one or a block of a long one."""

    def __init__(self, turns: list[tuple[str, str]], seen: frozenset = frozenset()):
        self.turns, self.faults, self.codes = turns, [], []
        known = set(seen)
        for role, text in turns:
            fault, mark = fault_of(text), _mark(role, text)
            if fault != "blank" and mark in known:
                fault = "duplicate"
            known.add(mark)
            self.faults.append(fault)
            self.codes.append((role[:1] if role[:1] in ("s", "u", "a") else "", DROP if fault in ("blank", "duplicate") else CUT if fault else OK))

    def counts(self) -> list[int]:
        """Blank, duplicate and truncated turns, and neighbours whose roles can't follow each other."""
        first = [role[:1] for role, _ in self.turns]
        return [*(self.faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(map(illegal, first, first[1:]))]


def illegal(x: str, y: str) -> bool:
    return x + y not in ("su", "ua", "au")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def repair(rows: list[tuple]) -> tuple:
    """The result columns of one conversation whose (turn, role, text) rows come in order."""
    p = Part([(role, text) for _, role, text in rows])
    cost, audit = least(span_cells(p.codes))
    numbers = {int(t) for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    return (gaps, *p.counts(), cost, audit, _digest("\n".join(apply_audit(audit, p.turns)[0])))


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list]]:
    """(key, rows) of sorted frames whose first column is the key; one key's rows are held."""
    last, held = None, []
    for key, *row in _rows(frames):
        if held and key != last:
            yield last, held
            held = []
        last = key
        held.append(row)
    if held:
        yield last, held


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for f in frames:
        yield from f.itertuples(index=False, name=None)


def _frames(rows: Iterator[tuple], schema: str, size: int) -> Iterator[pd.DataFrame]:
    names, held = [c.split()[0] for c in schema.split(", ")], []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


RESULT = "k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
BLOCK = "k string, part long, place long, roles array<string>, texts array<string>, marks array<binary>"
PARSED = "k string, part long, place long, initials array<string>, blank long, duplicate long, truncated long, illegal long, cells string"
SHARE = "k string, part long, place long, audit string, state int, cost long, across int"
PIECE = "k string, part long, place long, lines long, piece string"
ORDER = ("k", "turn", "role", "text")


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations that one task holds, many per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = ((key, *repair([r[1:] for r in held if r[0]])) for key, held in _groups(frames))
        yield from _frames(done, RESULT, 2000)

    ordered = rows.repartition("k").sortWithinPartitions(*ORDER)
    return ordered.select("k", "here", F.col("turn").cast("string"), "role", "text").mapInPandas(run, RESULT)


def _blocks(rows: DataFrame, block_turns: int, block_chars: int) -> DataFrame:
    """Turns in order as bounded blocks ``part, place``: (key, turn) ranges, each cut where a block is full."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def cut():
            held, last, place, size = [], None, 0, 0
            for key, part, role, text in _rows(frames):
                if held and (key != last[0] or len(held) >= block_turns or size >= block_chars):
                    yield *last, place, held
                    held, place, size = [], place + 1, 0
                last = (key, part)
                held.append((role, text))
                size += len(text)
            if held:
                yield *last, place, held

        for key, part, place, held in cut():
            roles, texts = map(list, zip(*held))
            yield from _frames(iter([(key, part, place, roles, texts, sorted({_mark(*t) for t in held}))]), BLOCK, 1)

    ordered = rows.repartitionByRange("k", "turn", F.xxhash64("role", "text")).sortWithinPartitions(*ORDER)
    return ordered.select("k", F.spark_partition_id().cast("long").alias("part"), "role", "text").mapInPandas(run, BLOCK)


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def each():
        for key, part, place, roles, texts, seen in _rows(frames):
            p = Part(list(zip(roles, texts)), frozenset() if seen is None else frozenset(map(bytes, seen)))
            yield key, part, place, [r[:1] for r in roles], *p.counts(), repr(span_cells(p.codes))

    yield from _frames(each(), PARSED, 20)


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of the blocks of a conversation meet; each block gets its share of the audit and the state before it."""

    def each():
        for key, held in _groups(frames):
            level = [ast.literal_eval(cells) for _, _, _, cells in held]
            while len(level) > 1:
                level = [product(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            cost, audit = least(level[0])
            at, state, before = 0, START, None
            for j, (part, place, initials, _) in enumerate(held):
                end, n = at, len(initials)
                while n:
                    n -= audit[end] != "I"
                    end += 1
                end = len(audit) if j == len(held) - 1 else end
                yield key, part, place, audit[at:end], state, cost, int(before is not None and illegal(before, initials[0]))
                turn = iter(initials)
                for edit in audit[at:end]:
                    kept = next(turn) if edit != "I" else None
                    if edit != "D":
                        state = MOVES[state, kept if edit == "K" else "a" if state == 2 else "u"]
                at, before = end, initials[-1]

    yield from _frames(each(), SHARE, 200)


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def each():
        for key, part, place, roles, texts, audit, state in _rows(frames):
            lines, _ = apply_audit(audit, list(zip(roles, texts)), state)
            yield key, part, place, len(lines), "\n".join(lines)

    yield from _frames(each(), PIECE, 1)


def _stream_digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sequential hash per conversation over its pieces, one piece at a time."""

    def each():
        last, sha, some = None, None, False
        for key, lines, piece in _rows(frames):
            if key != last:
                if sha is not None:
                    yield last, sha.hexdigest()
                last, sha, some = key, hashlib.sha256(), False
            if lines:
                sha.update((("\n" if some else "") + piece).encode("utf-8", "surrogatepass"))
                some = True
        if sha is not None:
            yield last, sha.hexdigest()

    yield from _frames(each(), "k string, repaired_sha256 string", 2000)


def _long(rows: DataFrame, block_turns: int, block_chars: int) -> DataFrame:
    """Conversations of any length: blocks are parsed by themselves and only their cells meet in one task.

    An audit and a digest are single values of one conversation, so its audit (a letter per edit) is held
    by one task, while the digest streams over the repaired blocks.
    """
    c = F.col
    ids = ["k", "part", "place"]
    blocks = written(_blocks(rows.filter("here"), block_turns, block_chars), "blocks")
    # the first block of a text owns it; other blocks that hold it take it as seen
    has = blocks.select(*ids, F.explode("marks").alias("mark"))
    owner = has.groupBy("k", "mark").agg(F.min(F.struct("part", "place")).alias("o"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = has.join(owner, ["k", "mark"]).filter((c("part") != c("o.part")) | (c("place") != c("o.place")))
    seen = later.groupBy(*ids).agg(F.collect_list("mark").alias("seen"))
    parsed = written(blocks.drop("marks").join(seen, ids, "left").mapInPandas(_parse, PARSED), "parsed")
    shares = written(parsed.repartition("k").sortWithinPartitions(*ids).select(*ids, "initials", "cells").mapInPandas(_fold, SHARE), "shares")
    pieces = blocks.drop("marks").join(shares.select(*ids, "audit", "state"), ids).select(*ids, "roles", "texts", "audit", "state").mapInPandas(_pieces, PIECE)
    digest = pieces.repartition("k").sortWithinPartitions(*ids).select("k", "lines", "piece").mapInPandas(_stream_digest, "k string, repaired_sha256 string")
    sums = parsed.groupBy("k").agg(*[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal")])
    audit = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("part", "place", "audit"))), lambda s: s["audit"]))
    told = shares.groupBy("k").agg(F.max("cost").alias("cost"), F.sum("across").alias("across"), audit.alias("audit"))
    gaps = rows.filter("here").groupBy("k").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    every = rows.select("k").distinct()
    out = every.join(gaps, "k", "left").join(sums, "k", "left").join(told, "k", "left").join(digest, "k", "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return out.select("k", *[zero(c(n)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated")], zero(c("illegal") + c("across")).alias("illegal"), zero(c("cost")).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_digest(""))).alias("repaired_sha256"))


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", here: str | None = None, block_turns: int = BLOCK_TURNS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per conversation: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows of a conversation go by turn (nulls first), then role and text. The first fault of a row counts: blank,
    duplicate (same role and text earlier in the conversation), truncated. Edits turn the rows into the form
    ``(s?(ua)+)?`` of role initials at the least cost; ``audit`` has the initials of the cheapest edits in order, the least
    in ASCII among equal costs.

    ``here`` names a boolean column: rows where it is false only name their conversation, which is returned even if it has
    no other. Null roles and texts are one space; null conversations are one conversation; null turns count in no gap;
    equal rows are duplicates; a role that begins with none of s, u, a can't be kept; other columns are ignored; an
    empty table gives an empty table. Conversations of more than ``block_turns`` turns or ``block_chars`` characters are
    parsed in blocks by several tasks, with the same result.
    """
    c = F.col
    blank = lambda n: F.coalesce(c(n), F.lit(" "))
    key = F.coalesce(c(conv).cast("string"), F.lit(""))
    rows = df.select(key.alias("k"), (F.lit(True) if here is None else c(here)).alias("here"), c(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    size = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("b"))
    large = written(size.filter((c("n") > block_turns) | (c("b") > block_chars)).select("k"), "large")
    if large.isEmpty():
        out = _whole(rows)
    else:
        out = _whole(rows.join(large, "k", "left_anti")).unionByName(_long(rows.join(large, "k", "left_semi"), block_turns, block_chars))
    return out.select(F.expr("try_cast(nullif(k, '') AS long)").alias(conv), *[x.split()[0] for x in RESULT.split(", ")[1:]])


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, here``: rows harmed by crc32("conv:turn") % 20, to test repair on.

    0 drops the row (``here`` is false), 1 empties the text, 2 takes out ``.!?``, 3 repeats the row, 4 makes it a
    user's. Nulls are one space, also in the hashed text.
    """
    c = F.col
    space = lambda x: F.coalesce(x, F.lit(" "))
    code = F.crc32(F.concat(space(c(conv).cast("string")), F.lit(":"), space(c(turn).cast("string")))) % 20
    rows = df.select(c(conv), c(turn), space(c(role)).alias(role), space(c(text)).alias(text), code.alias("_code"))
    rows = rows.withColumns({role: F.when(c("_code") == 4, "user").otherwise(c(role)), text: F.when(c("_code") == 1, "").when(c("_code") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(c(text)), "here": c("_code") != 0})
    return rows.select(conv, turn, role, text, "here", F.explode(F.array_repeat(F.lit(0), F.when(c("_code") == 3, 2).otherwise(1))).alias("_")).drop("_")
