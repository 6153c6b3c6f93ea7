"""op13: tokens of two tokenizers aligned over all documents."""

from __future__ import annotations

from mediasift.llm.common import table
from mediasift.llm.registry import query
from mediasift.llm.token_alignment import align_tokenizers


@query()
def op13_token_alignment(spark, d):
    import public_tokenizers

    docs = table(spark, d, "documents").select("doc_id", "text")
    return align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
