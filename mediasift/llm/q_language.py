"""op8: language of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.llm.common import table
from mediasift.llm.language_id import held_out, identify, train
from mediasift.llm.registry import query


@query()
def op8_language_id(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"), 4, 2)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lid.lang_pred", "lid.score", "lid.accepted")
