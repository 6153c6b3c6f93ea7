"""Quality rules, license scan, decontamination, n-gram join: against plain versions, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from mediasift.llm.common import table
from mediasift.llm.decontamination import contaminated, decontaminate
from mediasift.llm.license_scan import license_scan
from mediasift.llm.ngram_jaccard import similarity_classes
from mediasift.llm.quality_rules import Rule, quality_rules
from tests.llm import plain

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c a b c a b c"), (5, "a b c a b c a b c"), (6, LONG), (7, LONG + " tail"), (8, "one two"), (9, "One TWO"),
    (10, "x\n\nx\nx "), (11, "É é # $$ |"), (12, "licensed under CC BY-NC 4.0. cc-by cc by All rights\nreserved"), (13, "licensed under the  apache license, VERSION 2.0"), (None, "a b c a b c a b c"),
]


@pytest.fixture(scope="module")
def edge(spark):
    # extra columns bear names that operators use inside
    d = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return d.withColumns({n: F.lit(7) for n in ("_w", "_n", "_row", "id", "n", "g", "quality", "n_words", "score", "_h", "_id", "x", "y", "_t", "k", "item_id")})


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_quality_counts_match_plain(edge, docs):
    for d in (edge, docs):
        for r in quality_rules(d).select("text", "quality.*").collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain.quality_counts(r.text)
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and (not r.kept or not r.base_failed)


def test_quality_rule_table(spark, edge, nothing):
    good = "the cat and dog of it " * 2 + " ".join(f"word{i}" for i in range(60))
    d = spark.createDataFrame([(1, good), (2, good.replace(" ", "### ", 40)), (3, good.upper().replace(" ", "!! "))], "i int, text string")
    got = {r.i: r.quality for r in quality_rules(d).collect()}
    assert got[1].kept and got[1].broken == [] and "symbol_ratio" in got[2].broken and "exclamations" in got[3].broken and not got[3].kept
    own = quality_rules(d, rules=(Rule("long", "chars_per_word", 100.0),)).select("quality.broken").first()
    assert own.broken == ["long"]
    assert set(quality_rules(edge).columns) == set(edge.columns) and quality_rules(edge).count() == len(TEXTS) and quality_rules(nothing).collect() == []
    assert quality_rules(edge).filter("quality.kept").count() <= 2  # a filter on the verdict runs as fast as the counts


def test_license_base_matches_plain(spark, edge, docs, nothing):
    for d in (edge, docs):
        want = sorted(((r.doc_id, *plain.license_base(r.text)) for r in d.collect()), key=str)
        got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan(d).collect()), key=str)
        assert got == want
    assert license_scan(nothing).collect() == []


def test_license_diagonals_bridge_gaps(spark):
    t = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    words = t.split()
    odd = " ".join(words[:6] + ["oops"] + words[6:])
    rows = [(1, "pre " * 40 + odd), (2, " ".join(words[:9])), (3, "Released under the MIT License. " * 2), (4, "released under mit"), (5, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got[1].labels == "mit" and 0.8 <= got[1].score < 1 and got[2].labels == "" and got[2].score == 0
    assert got[3].labels == "mit" and got[3].score == 1.0 and got[4].labels == ""
    assert got[5].base_labels == "gpl" and got[5].labels == "gpl,gpl-3.0" and got[5].first_word == 7


def test_contamination_matches_plain(spark, edge, docs, nothing):
    bench = table(spark, "/root/testdata/sf0.001", "benchmark")
    want = plain.found_items({r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in bench.collect()})
    got = contaminated(docs, bench).collect()
    assert want and {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got} == want and len(got) == len(want)
    assert all(abs(r.containment - r.n_found / r.n_shingles) < 1e-12 for r in got)
    items = spark.createDataFrame([(1, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5 w6x6"), (1, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5 w6x6"), (2, None), (3, "one two"), (4, "")], "item_id int, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(edge, items).collect()} == {(6, 1), (7, 1)}
    assert contaminated(nothing, items).collect() == [] and contaminated(edge, items.limit(0)).collect() == []
    left = decontaminate(edge, items)
    assert left.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _ in TEXTS if i not in (6, 7))


def test_contamination_is_exact_at_every_share(spark):
    # items of 6 to 60 words with a part left out: containment on both sides of 0.8
    rows, items = [], {}
    for n in range(6, 60, 3):
        w = [f"i{n}k{j}" for j in range(n)]
        items[n] = " ".join(w)
        rows += [(n * 100 + cut, " ".join([f"p{j}" for j in range(50)] + w[: n - cut] + [f"q{j}" for j in range(50)])) for cut in range(min(n, 14))]
    want = plain.found_items(dict(rows), items)
    got = contaminated(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(list(items.items()), "item_id int, text string"))
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got.collect()} == want


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_classes_match_plain(docs, k, percent):
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_classes(docs, k=k, percent=percent).collect()} == plain.classes(texts, k, percent)


def test_classes_edges(edge, nothing):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in similarity_classes(edge).collect()), key=str)
    texts = {i: t for i, t in TEXTS if i is not None}
    one = plain.classes(texts, 3, 90)
    want = sorted([(i, *one[i]) for i, _ in TEXTS if i is not None] + [(None, 3, None)], key=str)
    assert got == want and one[9][1] == 8 and one[7][1] == 6
    assert similarity_classes(nothing).collect() == []


def test_classes_of_large_groups(spark):
    # near copies that link only through their base, a chain, and a passage shared by unlike texts
    base = [f"b{j}" for j in range(120)]
    rows = [(i, " ".join(base[: 3 * (i % 37)] + [f"e{i}"] + base[3 * (i % 37) + 1 :])) for i in range(1, 90)] + [(500, " ".join(base))]
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(i, i + 100))) for i in range(0, 60, 2)]
    rows += [(2000 + i, " ".join([f"p{j}" for j in range(60)] + [f"u{i}v{j}" for j in range(i % 9 + 1)])) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_classes(d).collect()}
    assert got == plain.classes(dict(rows), 3, 90)


@pytest.mark.parametrize("percent", [90, 80])
def test_classes_of_near_copies_around_the_threshold(spark, percent):
    # random edits from few words, families of families, cut ends; the base itself may be missing; ids on several texts
    r = random.Random(7 + percent)
    rows = []
    for family in range(4):
        base = [f"f{family}w{j}" for j in range(100)]
        for i in range(60):
            w = list(base)
            if i % 5 == 0:
                w[40:44] = [f"s{family}{j}" for j in range(4)]
            for _ in range(r.randrange(0 if family else 1, 9)):
                at = r.randrange(len(w))
                w[at : at + 1] = r.choice([[], [f"v{r.randrange(6)}"], [w[at], f"v{r.randrange(6)}"]])
            rows.append((family * 1000 + i, " ".join(w[: r.choice([100, 100, 95, 90])])))
    rows += [(5000 + i, rows[i * 7][1]) for i in range(10)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=percent).collect()}
    want = plain.classes(dict(rows), 3, percent)
    assert got == want and 4 < len({c for _, c in want.values()}) < len(rows) - 20

    # an id on two texts joins the classes of both; neither text is lost to the other's reference
    twice = [(0, rows[70][1]), (0, rows[0][1]), *rows[1:130]]
    both = {x.component_id for x in similarity_classes(spark.createDataFrame(twice, "doc_id long, text string"), percent=percent).collect() if x.doc_id in (0, 1010)}
    assert both == {0}


def test_contaminated_writes_few_files(spark, monkeypatch):
    # each of these small tables came in as many files as there are shuffle partitions
    from mediasift.llm import decontamination as D

    parts, write = {}, D.written
    monkeypatch.setattr(D, "written", lambda df, kind: (parts.update({kind: df.rdd.getNumPartitions()}), write(df, kind))[1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        item = "one two three four five six seven eight nine ten"
        docs = spark.createDataFrame([(i, f"word{i} {item if i % 3 else 'nothing here'} end{i}") for i in range(200)], "doc_id long, text string")
        got = D.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
        assert sorted(r.doc_id for r in got.collect()) == [i for i in range(200) if i % 3]
        few = 2 * spark.sparkContext.defaultParallelism
        assert got.rdd.getNumPartitions() <= few and set(parts) == {"items", "candidates"} and max(parts.values()) <= few
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_link_classes_write_few_files(spark, monkeypatch):
    # every step of the components wrote as many files as there are shuffle partitions
    from mediasift.llm import ngram_jaccard as N

    parts, write = [], N.written
    monkeypatch.setattr(N, "written", lambda df, kind: (parts.append(df.rdd.getNumPartitions()), write(df, kind))[1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "61")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        label = N._classes(None, spark.createDataFrame([(i, i + 1) for i in range(40) if i % 5], "x long, y long"))
        label = N._classes(label, spark.createDataFrame([(5, 6), (100, 101)], "x long, y long"))
        got = {r.id: r.cls for r in label.collect()}
        assert len(got) == 42 and got[6] == got[1] and got[101] == 100 and got[40] == 36
        assert parts and max(parts) <= 2 * spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _unlike(n, passage=40):
    # unlike texts around one passage, which has most of each text's first columns
    return [(i, " ".join([f"p{j}" for j in range(passage)] + [f"u{i}v{j}" for j in range(i % 9 + 12)])) for i in range(n)]


@pytest.mark.parametrize("n, rounds", [(60, 0), (120, 2)])
def test_unlike_texts_of_one_passage_take_few_rounds(spark, monkeypatch, n, rounds):
    # pivots that linked nothing were multiplied with the same rows in five rounds, columns of any size
    from mediasift.llm import ngram_jaccard as N

    seen, candidates = [], N._candidates
    monkeypatch.setattr(N, "_candidates", lambda *a: (seen.append(a[2]), candidates(*a))[1])
    rows = _unlike(n) + [(1000, _unlike(1)[0][1] + " end")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain.classes(dict(rows), 3, 90) and got[1000][1] == 0
    assert len(seen) <= rounds


@pytest.mark.parametrize("percent", [90, 80])
def test_classes_of_large_texts_and_small_bounds(spark, monkeypatch, percent):
    # wide parity bits decide on texts of 300 to 3500 words around the threshold; references and rounds serve small columns too
    from mediasift.llm import ngram_jaccard as N

    monkeypatch.setattr(N, "PAIRS_PER_SET", 1)
    monkeypatch.setattr(N, "COLUMN_SETS", 4)
    r, rows = random.Random(percent), []
    for family, n in enumerate((300, 620, 1500, 3500)):
        base = [f"f{family}w{j}" for j in range(n)]
        for i in range(14):
            w = list(base)
            for at in r.sample(range(n), int(n * r.uniform(0, 0.016 if percent == 90 else 0.035))):
                w[at] = f"v{r.randrange(9)}"
            rows.append((family * 100 + i, " ".join(w[: int(n * r.choice([1, 1, 0.96]))])))
    rows += [(900 + i, t) for i, t in _unlike(20)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent=percent).collect()}
    want = plain.classes(dict(rows), 3, percent)
    assert got == want and 8 < len({c for _, c in want.values()}) < len(rows) - 8
