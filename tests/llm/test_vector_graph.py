"""Graph search against brute force: recall, exact order and scores, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediasift.llm.common import table
from mediasift.llm.vector_graph import Graph, build_graph, nearest_neighbours

NAN, INF = float("nan"), float("inf")


def brute(rows, every=100, k=10):
    """{query id: [(score, id)]} of (id, vector) rows with one vector per id."""
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in ok if i % every == 0):
        d = sorted((float(np.sqrt(((ok[i] - ok[q]) ** 2).sum())), i) for i in ok if i != q and len(ok[i]) == len(ok[q]))
        out[q] = d[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shard_rows", [10_000, 900])
def test_recall_on_table(spark, shard_rows):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    want = brute([(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()])
    got = found(nearest_neighbours(df, shard_rows=shard_rows))
    assert got.keys() == want.keys() and all(len(v) == 10 and v == sorted(v) for v in got.values())
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
    exact = {(q, i): s for q, v in want.items() for s, i in v}
    assert all(abs(s - exact[q, i]) < 1e-9 for q, v in got.items() for s, i in v if (q, i) in exact)


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1, 150)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(300)]  # one vector, 300 ids, queries among them
    rows += [(200, [0.0] * 6), (300, None), (400, [1.0, NAN, 1.0, 1.0, 1.0, 1.0]), (500, [INF] * 6), (600, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (700, []), (None, [1.0] * 6)]
    rows += [(800, [3.0, 4.0]), (801, [3.0, 5.0]), (802, [-0.0, 2.0]), (803, [0.0, 2.0]), (900, [7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    clash = df.union(df).withColumns({n: F.lit(1) for n in ("id", "vector", "dim", "shard", "node", "ids", "edges", "query_id", "first")})
    for shard_rows in (10_000, 40):
        got = found(nearest_neighbours(clash, shard_rows=shard_rows))
        assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items() if v}
    assert [i for _, i in got[1000]] == list(range(1001, 1011)) and [i for _, i in got[800]] == [801, 802, 803]
    floats = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert found(nearest_neighbours(floats)).keys() == got.keys()


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest_neighbours(none).collect() == []
    one = spark.createDataFrame([(100, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert nearest_neighbours(one).collect() == []


def test_graph_is_bounded_and_reachable():
    x = np.random.default_rng(0).normal(size=(1500, 12)).astype(np.float32)
    g = Graph(degree=12)
    edges, entry = build_graph(x, g)
    assert edges.shape == (1500, 12) and all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() and k not in r for k, r in enumerate(edges))
    seen, todo = set(entry.tolist()), list(entry)
    while todo:
        new = [int(j) for j in edges[todo.pop()] if j >= 0 and int(j) not in seen]
        seen.update(new)
        todo += new
    assert len(seen) >= 1490
