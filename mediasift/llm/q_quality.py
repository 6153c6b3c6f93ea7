"""op9: quality score of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.llm.common import table
from mediasift.llm.language_id import held_out
from mediasift.llm.quality_model import classify, train
from mediasift.llm.registry import query


@query()
def op9_quality_model(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels").select("doc_id", "quality")
    seen = lambda df: df.filter(~held_out(F.col("doc_id"), 3, 1))
    model = train(seen(docs), seen(labels))
    out = classify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
