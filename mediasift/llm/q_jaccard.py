"""op6: classes of documents that links of 3-word Jaccard 0.9 connect."""

from __future__ import annotations

from mediasift.llm.common import table
from mediasift.llm.ngram_jaccard import similarity_classes
from mediasift.llm.registry import query


@query()
def op6_ngram_jaccard(spark, d):
    return similarity_classes(table(spark, d, "documents").select("doc_id", "text"))
