"""Conversation repair against a brute-force version, whole and in blocks."""

import itertools
import random

import pytest

from mediasift.llm.common import table
from mediasift.llm.conversation_repair import damaged, least, repair, repair_conversations, span_cells
from tests.llm import repair_plain as plain

NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got_of(df):
    rows = df.collect()
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in rows}
    assert len(got) == len(rows)
    return got


def want_of(df):
    return {c: plain.repair(v) for c, v in plain.damage([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]).items()}


def test_all_short_conversations_match_plain():
    kinds = [("user", "a."), ("assistant", "b!"), ("system", "c?"), ("user", ""), ("assistant", "cut"), ("tool", "d."), ("", "e.")]
    for n in range(5):
        for pick in itertools.product(kinds, repeat=n):
            rows = [(i, r, t) for i, (r, t) in enumerate(pick)]
            assert repair(rows) == plain.repair(rows), rows


def test_long_random_conversations_match_plain():
    rng = random.Random(5)
    for n in (7, 8, 9, 31, 64, 200):
        rows = sorted((i // 2, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["", "p.", "q", f"{i}!", f"{i}"])) for i in range(n))
        assert repair(rows) == plain.repair(rows)


def test_empty_conversation():
    assert least(span_cells([])) == (0, "") and plain.repair([]) == repair([])


def test_query_table_matches_plain(spark):
    df = table(spark, "/root/testdata/sf0.01", "conversations")
    assert got_of(repair_conversations(damaged(df), here="here")) == want_of(df)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    rows = [(1, None, "user", "hi."), (1, None, None, None), (1, 2, "assistant", "yes."), (None, 1, "user", "n."), (None, 2, "assistant", "m."), (2, 5, "user", None), (3, 2**53 + 1, "user", "a."), (3, 2**53 + 3, "assistant", "　")]
    rows += [(4, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", "same.", f"t{i}.", f"t{i}", "é."])) for i in range(400)]
    rows += [(5, i % 7, "user", "again.") for i in range(90)] + [(9, 1, "user", "word " * 200_000 + "."), (9, 2, "assistant", "w")]
    rows += [(4, 3, "user", "same.")] * 5
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("turns, chars", [(4096, 8_000_000), (16, 8_000_000), (3, 10)])
def test_odd_rows_whole_and_in_blocks(odd, turns, chars):
    from pyspark.sql import functions as F

    extra = odd.withColumns({n: F.lit(1) for n in ("k", "here", "part", "place", "_code", "audit")})
    assert got_of(repair_conversations(damaged(extra), here="here", block_turns=turns, block_chars=chars)) == want_of(odd)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair_conversations(none).collect() == [] and repair_conversations(damaged(none), here="here").collect() == []
