"""The pipeline, stage by stage, against plain versions; and that the rest does without it."""

import importlib.util

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mediasift.llm.common import table
from mediasift.llm.language_id import held_out, train
from tests.llm import plain

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")


@pytest.fixture(scope="module")
def steps(spark):
    import corpus_pipeline as P

    out, docs = [], table(spark, SF, "documents")
    for _, f in P.STAGES:
        docs = f(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_each_stage_matches_plain(spark, steps):
    src = table(spark, SF, "documents")
    want = {r.doc_id: r.text for r in src.collect()}
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    for s in steps[:-1]:
        assert s.columns == src.columns
    counts = {i: plain.quality_counts(t) for i, t in want.items()}
    base = {i for i, c in counts.items() if c[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    first = ids(steps[0])
    assert first <= base and {i for i in base if counts[i][2] == 0 and "!" not in want[i]} - first == set()
    m = train(src.filter(~held_out(F.col("doc_id"), 4, 2)))
    second = {i for i in first if m.predict(want[i])[2]}
    assert ids(steps[1]) == second and len(second) >= 0.99 * len(first)
    groups = plain.classes({i: want[i] for i in second}, 5, 80)
    third = {i for i in second if groups[i][1] == i}
    assert ids(steps[2]) == third and len(third) < len(second)
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    fourth = third - {d for d, *_ in plain.found_items({i: want[i] for i in third}, items)}
    assert ids(steps[3]) == fourth and len(fourth) < len(third)
    assert ids(steps[4]) == fourth


def test_stage_of_repeated_and_null_ids(spark):
    import corpus_pipeline as P

    t = " ".join(f"w{i}" for i in range(80))
    d = spark.createDataFrame([(3, t), (3, t), (2, t + " x"), (None, "lone text here"), (5, None), (6, ""), (6, "")], "doc_id long, text string")
    got = sorted(str(r.doc_id) for r in P.keep_one_of_class(spark, d, SF).collect())
    assert got == ["2", "5", "6", "None"]


def test_stages_tell_rows_of_one_id_by_their_texts(spark):
    import corpus_pipeline as P

    text = lambda p: " ".join(f"{p}{i}" for i in range(80))
    rows = [(1, text("a")), (1, text("b")), (None, text("c")), (None, text("c") + " x"), (2, text("d")), (3, text("d") + " x"), (3, text("e")), (3, text("e")), (None, text("a") + " y")]
    got = P.keep_one_of_class(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    left = [(r.doc_id, r.text[0]) for r in got]
    assert sorted(left, key=str) == sorted([(1, "a"), (1, "b"), (None, "c"), (2, "d"), (3, "e")], key=str)
    item = max((r.text for r in table(spark, SF, "benchmark").collect()), key=len)
    rows = [(1, text("a")), (1, f"so {item} it is"), (None, f"or {item}"), (None, text("b"))]
    got = P.drop_benchmark(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(((r.doc_id, r.text[0]) for r in got), key=str) == sorted([(1, "a"), (None, "b")], key=str)


def test_entry_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in q} and "pipeline" in q and set(o) <= set(q)


def test_near_copies_of_a_small_table_take_few_steps(spark, monkeypatch):
    # each written table leaves plans and compiled code in the driver; without a large column none is sought for references
    import corpus_pipeline as P
    from mediasift.llm import ngram_jaccard as N

    kinds, write = [], N.written
    monkeypatch.setattr(N, "written", lambda df, kind: (kinds.append(kind), write(df, kind))[1])
    text = lambda p: " ".join(f"{p}{i}" for i in range(80))
    rows = [(1, text("a")), (2, text("a") + " x"), (3, text("b")), (4, text("c"))]
    got = P.keep_one_of_class(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4]
    assert len(kinds) <= 12 and not {"references", "differences"} & set(kinds)


def test_components_run_few_tasks_whatever_the_shuffle_partitions(spark, monkeypatch):
    # the driver keeps a record of each task: small tables of links don't run a stage of all partitions for each exchange
    from mediasift.llm import ngram_jaccard as N

    kinds, write, sc = [], N.written, spark.sparkContext
    monkeypatch.setattr(N, "written", lambda df, kind: (kinds.append(kind), write(df, kind))[1])
    held = {"spark.sql.shuffle.partitions": "101", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        star = spark.createDataFrame([(i, 1) for i in range(2, 9)] + [(21, 20)], "x long, y long")
        assert {(r.node, r.root) for r in N.connected(star).collect()} == {(i, 1) for i in range(1, 9)} | {(20, 20), (21, 20)}
        assert kinds == ["star"]
        mixed = spark.createDataFrame([(7, 3), (3, 9), (9, 2), (9, 2), (5, 5), (40, 30), (30, 41), (12, 41)], "x long, y long")
        sc.setJobGroup("components", "links of two chains")
        got = {(r.node, r.root) for r in N.connected(mixed).collect()}
        assert got == {(i, 2) for i in (2, 3, 7, 9)} | {(i, 12) for i in (12, 30, 40, 41)}
        track = sc.statusTracker()
        stages = {s for j in track.getJobIdsForGroup("components") for s in track.getJobInfo(j).stageIds}
        tasks = sum(i.numTasks for s in stages if (i := track.getStageInfo(s)))
        assert len(stages) > 5 and tasks < 700
        assert N.connected(mixed.limit(0)).collect() == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
