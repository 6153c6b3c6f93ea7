"""U: set operations and connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediasift.session import written


def union_findings(*parts: DataFrame) -> DataFrame:
    """Union by name; columns a part lacks become null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dedupe(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order``; partial aggregation, no window."""
    rest = [c for c in df.columns if c not in by]
    pick = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*by).agg(pick).select(*by, "_r.*")


def components(edges: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """U4: connected components of an edge list, labelled by the smallest node.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond", 2014); every step is a minimum per
    node and a join, and the number of rounds grows with the logarithm of the
    component size. Each round is written once to the shared folder with a mark
    on new edges; it ends when a round changes nothing.
    """
    k = list(keys)
    c = F.col
    e = written(edges.select(*k, F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct().withColumn("new", F.lit(True)), "edges")
    size, before = e.count(), -1
    while size != before or not e.filter("new").isEmpty():
        before = size
        old = e.select(*k, "u", "v")
        both = old.unionByName(old.select(*k, c("v").alias("u"), c("u").alias("v")))
        low = both.groupBy(*k, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # a node that is its own minimum keeps its neighbours as they are: hubs need no join
        large = low.filter("u <> m").select(*k, "u", c("m").alias("v"))
        up = both.filter("v > u").join(low.filter("u <> m"), [*k, "u"]).select(*k, c("v").alias("u"), c("m").alias("v"))
        stay = old.join(low.filter("u <> m").select(*k, c("u").alias("v")), [*k, "v"], "left_anti")
        large = large.unionByName(up).unionByName(stay.select(*k, "u", "v")).filter("u <> v").distinct()
        low2 = large.groupBy(*k, "u").agg(F.min("v").alias("m"))
        small = large.join(low2, [*k, "u"]).filter("v <> m").select(*k, c("v").alias("u"), c("m").alias("v"))
        now = small.unionByName(low2.select(*k, "u", c("m").alias("v"))).filter("u <> v").distinct()
        e = written(now.join(old.withColumn("had", F.lit(True)), [*k, "u", "v"], "left").select(*k, "u", "v", c("had").isNull().alias("new")), "edges")
        size = e.count()
    roots = e.select(*k, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(*k, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def rank_findings(df: DataFrame, severity: str, weight: Column, ident: str) -> DataFrame:
    """O1: HIGH to LOW, then heavier modules first, then id."""
    from mediasift.functions.exprs import severity_rank

    return df.orderBy(severity_rank(F.col(severity)).desc(), weight.desc(), F.col(ident))
