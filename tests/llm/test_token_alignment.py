"""Token alignment against a plain reading of both vocabularies."""

import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from mediasift.llm import token_alignment as T
from mediasift.llm.common import table
from mediasift.llm.token_alignment import align_tokenizers, alignments, corpus_links, pair_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def plain(texts):
    """Result tuples of (key, text) rows: tokens as bytes, ends by adding lengths up."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    names = {i: p for p, i in tok.get_vocab().items()}
    # bytes of the byte-level alphabet, read off single-byte texts
    alphabet = {}
    for b in range(256):
        for piece in tok.pre_tokenizer.pre_tokenize_str(bytes([b]).decode("latin-1")):
            for ch, raw in zip(piece[0], bytes([b]).decode("latin-1").encode()):
                alphabet[ch] = raw
    for cp in [*range(0x100, 0x800, 16), *range(0x800, 0x10000, 997), *range(0x10000, 0x110000, 9973)]:
        if not 0xD800 <= cp < 0xE000:
            for piece in tok.pre_tokenizer.pre_tokenize_str(chr(cp)):
                alphabet.update(zip(piece[0], chr(cp).encode()))
    out, links = {}, Counter()
    for key, text in texts:
        a = b = []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            pa = [bytes(alphabet[c] for c in names[i]) for i in a]
            pb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(pa) != (" " + text).encode() or b"".join(pb) != (" " + text).encode():
                a = b = []
        if not a:
            out[key] = (0, 0, [], "")
            continue
        end = lambda parts: list(accumulate(map(len, parts)))
        ea, eb, groups, found = end(pa), end(pb), [], []
        ends = defaultdict(lambda: ([], []))
        for side, ids, places in ((0, a, ea), (1, b, eb)):
            for i, e in zip(ids, places):
                ends[e][side].append(i)
        held = ([], [])
        for e in sorted(ends):
            held[0].extend(ends[e][0])
            held[1].extend(ends[e][1])
            if all(ends[e]):
                groups.append((*held, e))
                found += [(i, j) for i in ends[e][0] for j in ends[e][1]]
                held = ([], [])
        links.update(found)
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in groups)
        out[key] = (len(a), len(b), found, hashlib.sha256(shown.encode()).hexdigest(), len(groups))
    top = Counter()
    for (_, j), n in links.items():
        top[j] = max(top[j], n)
    return {k: (0,) * 6 + ("",) if not v[0] else (v[0], v[1], v[4], len(v[2]), sum(links[p] == top[p[1]] for p in v[2]), sum(links[p] for p in v[2]), v[3]) for k, v in out.items()}


TEXTS = [
    None, "", " ", "  two  spaces \n\t x ", "a", "plain words, it's 12 o'clock", "é ü 漢字 🙂🙂 \U0002000b x", "<|endoftext|> </s><s> <unk> <0x41>", "▁ marks a space", "nul \x00 byte \x7f \x85",
    "\r\n", "é combining", "﻿bom", "ﬁ ligature Ⅷ", "plain words, it's 12 o'clock", "‍​", "मानक हिन्दी", " leading", "trailing ", "a" * 3000, "🙂" * 50, "\U0001f468‍\U0001f469‍\U0001f467 family",
]


@pytest.mark.parametrize("hot", [200_000, 3, 0])
def test_odd_texts_match_plain(spark, hot):
    rows = list(enumerate(TEXTS))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(1) for n in ("row", "n_a", "pairs", "pair", "p", "n", "best")})
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in align_tokenizers(df, A, B, hot_pairs=hot).collect()}
    assert got == plain(rows)
    assert got[8] == (0,) * 6 + ("",) and got[6][2] > 3 and got[20][0] > 50


def test_table_matches_plain(spark):
    df = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", F.substring("text", 1, 1500).alias("text"))
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in align_tokenizers(df, A, B, hot_pairs=50).collect()}
    assert got == plain([(r.doc_id, r.text) for r in df.collect()])


def test_spans_cover_the_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in alignments(df, A, B, spans=True).collect():
        n = len((" " + (TEXTS[r.doc_id] or "")).encode())
        if r.n_a:
            assert r.a_ends[-1] == r.b_ends[-1] == n and sorted(set(r.a_ends) & set(r.b_ends)) == r.cuts
            assert len(r.a_ends) == len(r.a_ids) == r.n_a and r.a_ends == sorted(set(r.a_ends)) and r.b_ends == sorted(set(r.b_ends))


def test_repeated_null_and_long_rows(spark):
    long = "word é " * 150_000
    rows = [(1, "same text"), (1, "same text"), (None, "same text"), (2, long), (3, None)]
    out = align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "1", "2", "3", "None"]
    same = [tuple(r[c] for c in COLS) for r in out if r.doc_id in (1, None)]
    assert len(set(same)) == 1 and same[0][5] == 3 * same[0][3] and {r.doc_id: r.n_a for r in out}[2] > 290_000


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert align_tokenizers(none, A, B).collect() == []
    docs = alignments(none, A, B)
    assert pair_counts(docs).collect() == [] and corpus_links(docs).collect() == []


def test_parts_in_use_are_encoded_once(monkeypatch):
    # all parts were forgotten together, the frequent ones too, and again with each task
    monkeypatch.setattr(T, "KNOWN_SEGMENTS", 4)
    al = T.aligner(A, B)
    assert T.aligner(A, B) is al
    met, remember = [], al._remember
    monkeypatch.setattr(al, "_remember", lambda parts: (met.extend(parts), remember(parts)))
    texts = [f"often word{i} rare{i} again often" for i in range(20)]
    got = [al.summaries([t])[0] for t in texts]
    assert met.count("often") == met.count("again") == 1 and len(al.known) + len(al.older) <= 14
    fresh = [T.Aligner(A, B).summaries([t])[0] for t in texts[:3]]
    assert all(x[:4] == y[:4] and (x[4] == y[4]).all() and (x[5] == y[5]).all() for x, y in zip(got, fresh))


def test_marks_behind_a_letter_are_aligned_once(monkeypatch):
    # word, word. and word%%% were three parts that were each encoded
    al = T.Aligner(A, B)
    met, remember = [], al._remember
    monkeypatch.setattr(al, "_remember", lambda parts: (met.extend(parts), remember(parts)))
    texts = [f"lorume{m} é{m} dix7{m} a{m} {m} x{m}y naïve\n{m} it's{m}\nEnd{m}" for m in (",", ".", "'", "''", "%%%", "<s>", ">", "|>", "</s", "$$$$", "_", "\\", "''s", "▁")]
    al.summaries(texts[:-1])
    assert met.count("lorume") == 1 and "lorume," not in met and "lorume%%%" not in met
    got = al.summaries(texts) + [T.Aligner(A, B).summaries([t])[0] for t in texts]
    want = plain(list(enumerate(texts)))
    for i, g in enumerate(got):
        w = want[i % len(texts)]
        assert (g or (0, 0, 0, ""))[:4] == (w[0], w[1], w[2], w[6])
