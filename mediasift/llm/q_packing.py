"""op5: all documents packed into sequences of 2048 tokens."""

from __future__ import annotations

from mediasift.llm.common import table
from mediasift.llm.packing import pack_documents
from mediasift.llm.registry import query


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op5_best_fit_packing(spark, d):
    return pack_documents(table(spark, d, "documents").select("doc_id", "text"), tokenizer_path())
