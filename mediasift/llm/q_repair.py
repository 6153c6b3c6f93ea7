"""op12: damaged conversations and their cheapest repair."""

from __future__ import annotations

from mediasift.llm.common import table
from mediasift.llm.conversation_repair import damaged, repair_conversations
from mediasift.llm.registry import query


@query()
def op12_conversation_repair(spark, d):
    return repair_conversations(damaged(table(spark, d, "conversations")), here="here")
