"""Benchmark decontamination: MinHash containment search by size classes, exact verification; DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediasift.llm.common import LICENSE_GAP, few_files, non_empty, written

# Most rows that a table of ids or hashes may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table for broadcast if its counted size allows it."""
    return F.broadcast(df) if df.count() <= limit else df


def _shingles(text: Column, k: int) -> tuple[Column, Column]:
    words = non_empty(F.split(F.lower(F.coalesce(text, F.lit(""))), LICENSE_GAP))
    hashed = F.expr(f"transform(sequence(0, _n - {k}), i -> xxhash64({', '.join(f'_w[i + {j}]' for j in range(k))}))")
    return words, F.when(F.col("_n") >= k, hashed).otherwise(F.array().cast("array<bigint>"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs ``doc_id, item_id, n_shingles, n_found, containment`` with ``n_found >= threshold * n_shingles``.

    Words are runs of letters and digits, lower-cased; ``n_shingles`` counts the distinct
    ``k``-word shingles of the item and ``n_found`` those that the document has.

    Search: items are parted by size into classes [2^c, 2^(c+1)). A class has one sketch width,
    the number of smallest hashes (a bottom-k MinHash) that its largest size needs, floor(U -
    threshold * U) + 1: a document that holds the threshold share of an item can't miss all of
    them, so no pair is lost. Document hashes above the largest sketch value are left out before
    the join, and a document too short for an item is no candidate. Verification: only texts of
    candidate documents are shingled again and counted against all shingles of their items.

    Null texts and texts of fewer than ``k`` words have no shingles and match nothing, on either
    side. Repeated items and documents (same id) act as one; other columns are ignored; an
    empty table on either side gives no pairs.
    """
    c = F.col
    words, hashes = _shingles(c("_t"), k)

    def shingled(df, *ids):
        return df.select(*ids, words.alias("_w")).select(*ids, "_w", F.size("_w").alias("_n")).select(*ids, "_n", hashes.alias("_hs"))

    it = shingled(items.select(c(item_id).alias("_item"), c(item_text).alias("_t")), "_item")
    it = it.select("_item", F.explode_outer("_hs").alias("_g")).filter(c("_g").isNotNull()).distinct()
    it = it.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("_item")))
    upper = F.pow(F.lit(2.0), F.floor(F.log2("_size")) + 1) - 1
    it = it.withColumn("_width", F.floor(upper * (1 - threshold) + 1e-9) + 1).withColumn("_rank", F.row_number().over(Window.partitionBy("_item").orderBy("_g")))
    full = it.select("_item", "_g", "_size", F.ceil(c("_size") * threshold - 1e-9).alias("_need"), (c("_rank") <= c("_width")).alias("_sketch"))
    full = written(few_files(full), "items")
    sketch = full.filter("_sketch")
    top = sketch.agg(F.max("_g")).first()[0]
    if top is None:
        top = -(2**63)

    d = shingled(docs.select(c(doc_id).alias("_id"), c(text).alias("_t")), "_id")
    low = d.select("_id", "_n", F.explode_outer(F.filter("_hs", lambda h: h <= F.lit(top))).alias("_g"))
    cand = low.join(small(sketch.select("_g", "_item", "_need")), "_g").filter(c("_n") - k + 1 >= c("_need"))
    cand = written(few_files(cand.groupBy("_id", "_item").agg(F.max("_need").alias("_need"))), "candidates")

    texts = docs.select(c(doc_id).alias("_id"), c(text).alias("_t")).join(small(cand.select("_id").distinct()), "_id", "left_semi")
    have = shingled(texts, "_id").select("_id", F.explode_outer("_hs").alias("_g"))
    hit = have.join(small(full.select("_g", "_item", "_size")), "_g").select("_id", "_item", "_size", "_g").distinct()
    found = hit.groupBy("_id", "_item").agg(F.max("_size").alias("n_shingles"), F.count(F.lit(1)).alias("n_found"))
    out = found.join(cand, ["_id", "_item"]).filter(c("n_found") >= c("_need"))
    return few_files(out.select(c("_id").alias(doc_id), c("_item").alias(item_id), "n_shingles", "n_found", (c("n_found") / c("n_shingles")).alias("containment")))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **kw) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns kept, null ids kept."""
    bad = written(few_files(contaminated(docs, items, doc_id=doc_id, **kw).select(doc_id).distinct()), "leaks")
    return docs.join(small(bad), doc_id, "left_anti")
