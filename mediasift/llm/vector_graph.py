"""Approximate nearest neighbours: robust-pruned directed graphs, one per shard, searched by beams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.llm.common import written

# Distinct vectors of one graph: what one task holds.
SHARD_ROWS = 10_000

INDEX_SCHEMA = "dim int, shard int, node int, entry boolean, vector array<double>, ids array<long>, edges array<int>"
HIT_SCHEMA = "query_id long, query_key long, vec_id long, score double"


@dataclass(frozen=True)
class Graph:
    """How graphs are built and searched.

    ``degree`` out-edges at most; ``build_beam`` candidates proposed by each greedy search; ``slack`` relaxes the pruning:
    an edge to c goes if a kept neighbour p has slack * |pc| <= |c - node|; ``beam`` nodes are kept in a search.
    """

    degree: int = 32
    build_beam: int = 40
    slack: float = 1.1
    beam: int = 160


def valid(vector: Column) -> Column:
    """Vectors that take part: not null or empty, all components finite, one of them not zero."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def distinct_vectors(df: DataFrame, ident: str, vector: str, keep: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``vector, ids, dim, shard``: each distinct vector once with its ``keep`` smallest ids.

    A vector that a third of all rows share is cut to its smallest ids before the shuffle, so it is one node. No more
    than ``keep`` of equally near rows can stand among the first ``keep - 1``, so nothing is lost.
    """
    c = F.col
    rows = df.select(c(ident).cast("long").alias("id"), c(vector).cast("array<double>").alias("vector")).filter(c("id").isNotNull() & valid(c("vector")))
    # 0.0 and -0.0 are one number
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    first = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("vector").orderBy("id"))).filter(c("place") <= keep)
    each = first.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    each = written(each.withColumn("dim", F.size("vector")), "vectors")
    counts = {r["dim"]: r["count"] for r in each.groupBy("dim").count().collect()}
    shards = F.lit(1)
    for dim, n in counts.items():
        shards = F.when(c("dim") == dim, -(-n // shard_rows)).otherwise(shards)
    return each.withColumn("shard", F.pmod(F.xxhash64("vector", F.lit(11)), shards).cast("int"))


def _beam_search(x: np.ndarray, norms: np.ndarray, edges: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest nodes found for each row of ``q``: ids (-1: none) and squared distances, nearest first.

    All rows search in step: each expands its nearest unexpanded node and keeps its ``beam`` best.
    """
    b, n = len(q), len(x)
    qn = (q * q).sum(axis=1)
    ids = np.full((b, beam), -1, np.int32)
    dist = np.full((b, beam), np.inf, np.float32)
    done = np.zeros((b, beam), bool)
    start = entry[: min(len(entry), beam)]
    ids[:, : len(start)] = start
    dist[:, : len(start)] = qn[:, None] - 2 * (q @ x[start].T) + norms[start]
    order = np.argsort(dist, axis=1)
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    live = np.arange(b)
    seen = np.zeros((b, n), bool)
    seen[:, start] = True
    while len(live):
        open_ = ~done[live] & (ids[live] >= 0)
        has = open_.any(axis=1)
        live, open_ = live[has], open_[has]
        if not len(live):
            break
        at = open_.argmax(axis=1)
        done[live, at] = True
        near = edges[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
        row, col = np.nonzero(fresh)
        got = near[row, col]
        who = live[row]
        seen[who, got] = True
        d = qn[who] - 2 * np.einsum("ij,ij->i", q[who], x[got]) + norms[got]
        new_d = np.full(near.shape, np.inf, np.float32)
        new_d[row, col] = d
        new_i = np.where(fresh, near, -1)
        # only rows whose neighbours beat their worst change
        better = (new_d < dist[live, -1:]).any(axis=1)
        rows = live[better]
        if not len(rows):
            continue
        all_d = np.concatenate([dist[rows], new_d[better]], axis=1)
        pick = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[rows] = np.take_along_axis(all_d, pick, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], new_i[better]], axis=1), pick, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], np.zeros_like(new_i[better], bool)], axis=1), pick, 1)
        ids[rows] = np.where(np.isfinite(dist[rows]), ids[rows], -1)
    return ids, dist


def _prune(x: np.ndarray, norms: np.ndarray, node: np.ndarray, cand: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Robust pruning of many nodes at once: of the candidates (-1: none), nearest first, those that no kept one covers."""
    cx = x[np.maximum(cand, 0)]
    cn = norms[np.maximum(cand, 0)]
    own = np.maximum(norms[node][:, None] - 2 * np.einsum("bcd,bd->bc", cx, x[node]) + cn, 0)
    dead = (cand < 0) | (cand == node[:, None])
    own[dead] = np.inf
    order = np.argsort(own, axis=1, kind="stable")
    cand, own, dead = (np.take_along_axis(a, order, 1) for a in (cand, own, dead))
    cx, cn = np.take_along_axis(cx, order[:, :, None], 1), np.take_along_axis(cn, order, 1)
    dead |= np.c_[np.zeros(len(cand), bool), cand[:, 1:] == cand[:, :-1]]
    apart = cn[:, :, None] - 2 * (cx @ cx.transpose(0, 2, 1)) + cn[:, None, :]
    out = np.full((len(node), degree), -1, np.int32)
    rows = np.arange(len(node))
    for k in range(degree):
        at = (~dead).argmax(axis=1)
        go = ~dead[rows, at]
        if not go.any():
            break
        out[go, k] = cand[rows, at][go]
        dead |= go[:, None] & (slack * slack * apart[rows, at] <= own)
        dead[rows, at] = True
    return out


def build_graph(x: np.ndarray, g: Graph = Graph(), batch: int = 512, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Out-edges of every node (-1 fills up) and the nodes where searches begin.

    Nodes come in random order in batches that grow up to ``batch``. Greedy searches on the graph so far propose neighbours, robust
    pruning keeps diverse ones, and each gets an edge back; a node with too many edges is pruned again.
    """
    n = len(x)
    norms = (x * x).sum(axis=1)
    edges = np.full((n, g.degree), -1, np.int32)
    rng = np.random.default_rng(seed)
    order = rng.permutation(n)
    middle = np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))
    order = np.r_[middle, order[order != middle]].astype(np.int32)
    entry = order[: min(n, 8)]
    at = 1
    while at < n:
        part = order[at : at + min(batch, max(1, at // 2))]
        found, _ = _beam_search(x, norms, edges, entry[: min(at, len(entry))], x[part], g.build_beam)
        mates = np.broadcast_to(part[:16], (len(part), min(len(part), 16)))
        edges[part] = _prune(x, norms, part, np.concatenate([found, mates], axis=1), g.degree, g.slack)
        _back_edges(x, norms, edges, part, g)
        at += len(part)
    return edges, entry


def _back_edges(x: np.ndarray, norms: np.ndarray, edges: np.ndarray, part: np.ndarray, g: Graph) -> None:
    """An edge back to each node of ``part`` from every node it points to."""
    src = np.repeat(part, g.degree)
    dst = edges[part].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    keep = ~(edges[dst] == src[:, None]).any(axis=1)
    src, dst = src[keep], dst[keep]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    node, start, count = np.unique(dst, return_index=True, return_counts=True)
    if not len(node):
        return
    used = (edges[node] >= 0).sum(axis=1)
    fit = used + count <= g.degree
    rank = np.arange(len(dst)) - np.repeat(start, count)
    easy = np.repeat(fit, count)
    edges[dst[easy], np.repeat(used, count)[easy] + rank[easy]] = src[easy]
    hard = np.flatnonzero(~fit)
    for lo in range(0, len(hard), 256):
        h = hard[lo : lo + 256]
        cand = np.full((len(h), g.degree + int(count[h].max())), -1, np.int32)
        cand[:, : g.degree] = edges[node[h]]
        for i, j in enumerate(h):
            cand[i, g.degree : g.degree + count[j]] = src[start[j] : start[j] + count[j]]
        edges[node[h]] = _prune(x, norms, node[h], cand, g.degree, g.slack)


def _scaled(v: np.ndarray) -> tuple[np.ndarray, float]:
    """Single-precision copy that can't overflow; nearness is not changed."""
    top = float(np.abs(v).max()) if v.size else 1.0
    return (v / top).astype(np.float32), top


def build_index(vectors: DataFrame, g: Graph = Graph()) -> DataFrame:
    """Index rows ``dim, shard, node, entry, vector, ids, edges`` of ``distinct_vectors``: every vector is a node of its shard's graph."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("first", kind="stable").reset_index(drop=True)
        x, _ = _scaled(np.stack(frame["vector"].to_numpy()))
        edges, entry = build_graph(x, g)
        frame["node"] = np.arange(len(frame), dtype=np.int32)
        frame["entry"] = np.isin(frame["node"], entry)
        frame["edges"] = [e[e >= 0] for e in edges]
        return frame[["dim", "shard", "node", "entry", "vector", "ids", "edges"]]

    return vectors.withColumn("first", F.col("ids")[0]).groupBy("dim", "shard").applyInPandas(build, INDEX_SCHEMA)


class Shard:
    """One shard's graph in a task."""

    def __init__(self, vectors: list, ids: list, edges: list, entry: list, g: Graph):
        self.v, self.ids, self.g = np.array(vectors, np.float64), ids, g
        self.x, self.top = _scaled(self.v)
        self.norms = (self.x * self.x).sum(axis=1)
        self.edges = np.full((len(ids), g.degree), -1, np.int32)
        for k, e in enumerate(edges):
            self.edges[k, : len(e)] = e
        self.entry = np.flatnonzero(entry).astype(np.int32)

    def search(self, keys: list[tuple[int, int]], q: np.ndarray, k: int) -> list[tuple]:
        """The ``k`` nearest rows of each query, distances in double precision, ties by id; not the query's own id."""
        with np.errstate(over="ignore", invalid="ignore"):
            found, _ = _beam_search(self.x, self.norms, self.edges, self.entry, (q / self.top).astype(np.float32), max(self.g.beam, k + 1))
            out = []
            for (qid, qkey), row, v in zip(keys, found, q):
                row = row[row >= 0]
                d = np.sqrt(((self.v[row] - v) ** 2).sum(axis=1))
                hits = sorted((s, i) for s, node in zip(d.tolist(), row.tolist()) for i in self.ids[node] if i != qid)[:k]
                out += [(qid, qkey, i, s) for s, i in hits]
        return out


def nearest(index: DataFrame, queries: DataFrame, ident: str, vector: str, k: int = 10, g: Graph = Graph()) -> DataFrame:
    """``query_id, query_key, rank, vec_id, score``: the ``k`` nearest indexed rows found for each distinct query row.

    Each query goes to every shard of its dimension. A task reads one shard's nodes first and then streams the
    queries through beam searches in blocks, so it holds one graph and one block; shard results are cut to ``k`` before they meet.
    """
    c = F.col
    q = queries.select(c(ident).cast("long").alias("query_id"), c(vector).cast("array<double>").alias("vector")).filter(c("query_id").isNotNull() & valid(c("vector")))
    q = q.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).distinct().withColumn("query_key", F.xxhash64("vector")).withColumn("dim", F.size("vector"))
    shards = index.groupBy("dim").agg(F.max("shard").alias("top"))  # one row per dimension
    ask = q.join(F.broadcast(shards), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), "top")))
    none = lambda t: F.lit(None).cast(t)
    ask = ask.select("dim", "shard", F.lit(None).cast("int").alias("node"), F.lit(False).alias("entry"), "vector", none("array<long>").alias("ids"), none("array<int>").alias("edges"), "query_id", "query_key")
    nodes = index.select("*", none("long").alias("query_id"), none("long").alias("query_key"))
    # a query has no node number: it is sorted behind the nodes of its shard
    both = nodes.unionByName(ask).repartition("dim", "shard").sortWithinPartitions("dim", "shard", F.asc_nulls_last("node"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, shard = None, [], None
        for frame in frames:
            for key, f in frame.groupby(["dim", "shard"], sort=True):
                if key != at:
                    at, held, shard = key, [], None
                node = f[f["node"].notna()]
                if len(node):
                    held += list(zip(node["vector"], node["ids"], node["edges"], node["entry"]))
                asked = f[f["node"].isna()]
                for lo in range(0, len(asked), 256):
                    if shard is None:
                        shard = Shard(*map(list, zip(*held)), g)
                        held = []
                    part = asked.iloc[lo : lo + 256]
                    keys = list(zip(part["query_id"].astype("int64").tolist(), part["query_key"].astype("int64").tolist()))
                    yield pd.DataFrame(shard.search(keys, np.array(part["vector"].tolist(), np.float64), k), columns=["query_id", "query_key", "vec_id", "score"])

    hits = both.mapInPandas(run, HIT_SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).filter(c("rank") <= k).select("query_id", "query_key", c("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_neighbours(df: DataFrame, every: int = 100, ident: str = "vec_id", vector: str = "embedding", k: int = 10, g: Graph = Graph(), shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for rows whose id is divisible by ``every`` the ``k`` nearest other rows found.

    Nearness is Euclidean distance on the vectors as they are, in double precision; ties go to the smaller id. Every
    distinct vector is a node of one shard's graph; all shards are searched for all queries.

    Vectors null, empty, zero or with a null or non-finite component take no part, nor do rows without an id. Equal vectors are
    one node with their ids; equal rows act as one. An id that stands on several vectors is a candidate by
    each, and as a query is answered once per vector (``query_key`` in ``nearest``). Only vectors of one dimension
    compare. With fewer than ``k`` candidates all are returned; other columns are ignored; an empty table gives an empty table.
    """
    index = written(build_index(distinct_vectors(df, ident, vector, k + 1, shard_rows), g), "index")
    return nearest(index, df.filter(F.col(ident) % every == 0), ident, vector, k, g).drop("query_key")
