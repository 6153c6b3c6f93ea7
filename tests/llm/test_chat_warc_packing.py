"""Chat formatting, WARC and packing: exact round trips and edge cases."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediasift.llm.chat_format import CONTROL, format_chats, loss_text, read_chats
from mediasift.llm.common import table
from mediasift.llm.packing import best_fit, pack_documents, token_pieces
from mediasift.llm.q_packing import tokenizer_path
from mediasift.llm.queries import QUERIES, SQL
from mediasift.llm.warc import LoserTree, archive, url_key
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_sql(spark, name):
    ok, msg = compare(QUERIES[name](spark, SF), connect(SF), SQL[name])
    assert ok, msg


def chats(spark):
    nasty = ["", None, "\\", "\\\\<s>", "".join(CONTROL), "<|end|", "<<|end|>>", "a\\<|join|>\\", "line\nbreak", "[/INST][INST]", "<|turn|>user<|body|>", "x" * 200_000]
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "user", "tie b"), (2, 0, "user", "tie a"), (2, 0, "assistant", "tie"), (3, None, None, None), (3, None, None, None), (None, 1, "user", "no conversation"), (4, 1, "<|end|>role\\", "odd role")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit(1) for n in ("_c", "_s", "formatted", "turns")})


def test_chat_round_trip(spark):
    rows, df = chats(spark)
    got = {r.conv_id: r for r in read_chats(format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        # the mask covers the escaped assistant texts, and the whole string once
        assert sum(m.chars for m in got[conv].loss_mask) == len(got[conv].formatted)
        at, said = 0, []
        for m in got[conv].loss_mask:
            said += [got[conv].formatted[at : at + m.chars]] if m.loss else []
            at += m.chars
        assert len(said) == sum(r == "assistant" for r, _ in want) and all(not any(c in s for c in CONTROL) for s in said)
    assert format_chats(df.limit(0)).collect() == []


def test_loss_text_follows_the_mask(spark, monkeypatch):
    rows, df = chats(spark)
    rows = rows + [(5, i, ("user", "assistant")[i % 2], f"\ufeff\U0001f600 {i}\\<s>") for i in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for role in ("assistant", "user"):
        out = format_chats(df, loss_roles=(role,)).select("conv_id", loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
        want = {c: "".join(r[3] or "" for r in sorted((r for r in rows if r[0] == c), key=key) if (r[2] or "") == role) for c in {r[0] for r in rows}}
        assert {r.conv_id: r.loss for r in out.collect()} == want
    # the query shows a mask over other roles
    from mediasift.llm import q_chat

    before = {r.conv_id: r.loss_chars for r in q_chat.op3_chat_format(spark, SF).collect()}
    monkeypatch.setattr(q_chat, "format_chats", lambda d: format_chats(d, loss_roles=("user",)))
    after = {r.conv_id: r.loss_chars for r in q_chat.op3_chat_format(spark, SF).collect()}
    assert before.keys() == after.keys() and before != after


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    assert list(LoserTree([[(x,) for x in r] for r in runs], lambda t: t)) == sorted((x,) for r in runs for x in r)


def test_warc_edges(spark):
    html = "<p>ä\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(5, "http://www.B.example.com/x?y#z", html), (2, "https://b.example.com/x?y", html), (9, None, None), (3, "bad url\r\nX: 1", ""), (2, "https://b.example.com/x?y", html), (None, "http://c/", "only"), (7, "http://a.example.com", "z" * 300_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("captured_at", F.timestamp_seconds(F.lit(0) + F.coalesce("page_id", F.lit(1)))).withColumns({n: F.lit(3) for n in ("hex", "first", "page", "body", "pos")})
    out = archive(d, max_records=2, rows_per_range=2).orderBy("range_no", "range_pos").collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = sorted(((p, len((h or "").encode()), digest(h)) for p, _, h in rows), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest) for r in out), key=str) == want
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in out), key=str)
    assert kinds == sorted([(2, "response", None), (2, "response", None), (5, "revisit", 2), (3, "response", None), (9, "revisit", 3), (None, "response", None), (7, "response", None)], key=str)
    order = [(r.url_key.encode(), r.ts) for r in out]
    assert order == sorted(order) and url_key("http://www.B.example.com:80/x?y#z") == "com,example,b:80)/x?y"
    big = archive(d, min_revisit_bytes=5).collect()
    assert {r.page_id for r in big if r.record_type == "revisit"} == {5}
    assert archive(d.limit(0)).collect() == []


def test_packing_covers_every_token(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = [(1, None), (2, ""), (3, "word " * 7000), (4, "<|endoftext|> é"), (4, "<|endoftext|> é"), (None, "no id")] + [(10 + i, "x y z " * (i * 7)) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("piece", "_group", "length", "id")})
    got = pack_documents(d, tokenizer_path(), docs_per_group=16).collect()
    texts = dict(rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
        ids = np.array([*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and (r.length == 2048 or r.piece == 0)
    for s in by.values():
        s.sort(key=lambda r: r.offset)
        assert s[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in zip(s, s[1:])) and s[-1].offset + s[-1].length <= 2048
    n = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in got) == n
    assert pack_documents(d.limit(0), tokenizer_path()).collect() == [] and token_pieces(d.limit(0), tokenizer_path()).collect() == []


def test_packing_of_very_long_white_space(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = {1: "a" + " " * 1_000_000 + "x", 2: "a" + "\n" * 1_000_000 + "x", 3: "short"}
    got = pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tokenizer_path()).collect()
    for doc, text in texts.items():
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        rows = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        assert sum(r.length for r in rows) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)


def test_packing_deals_null_and_repeated_ids(spark):
    rows = [(None, f"text {i}") for i in range(1500)] + [(7, "the same")] * 1500
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), docs_per_group=100).collect()
    for doc in (None, 7):
        sizes = np.bincount([r.sequence_id >> 32 for r in got if r.doc_id == doc], minlength=30)
        assert sizes.sum() == 1500 and sizes.max() < 120


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(1)
    n = rng.integers(1, 2048, 800)
    for cap in ((2048, 2048, 2048**2), (2048, 3, 2048**2), (2048, 2048, 1.2 * 2047**2 / 1.0)):
        b = best_fit(n, cap, rule=rule)
        assert np.bincount(b, n).max() <= cap[0] and np.bincount(b).max() <= cap[1] and np.bincount(b, n.astype(float) ** 2).max() <= cap[2]
        if cap[1:] == (2048, 2048**2):
            assert b.max() + 1 <= 1.02 * n.sum() / 2048 + 1
    with pytest.raises(ValueError):
        best_fit(np.array([10]), (5, 5, 1e9))
