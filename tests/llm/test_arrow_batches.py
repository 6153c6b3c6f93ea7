"""The pipeline's batches of texts are small, and the session's setting comes back."""

import corpus_pipeline as P


def test_batch_rows_while_stages_run(spark, monkeypatch):
    seen, before = [], spark.conf.get(P.BATCH)
    monkeypatch.setattr(P, "STAGES", [("one", lambda s, docs, d: (seen.append(s.conf.get(P.BATCH)), docs.limit(3))[1])])
    assert P.run(spark, "/root/testdata/sf0.001").count() == 3
    assert seen == ["1000"] and spark.conf.get(P.BATCH) == before
