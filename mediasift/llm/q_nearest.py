"""op11: ten nearest vectors of every hundredth row."""

from __future__ import annotations

from mediasift.llm.common import table
from mediasift.llm.registry import query
from mediasift.llm.vector_graph import nearest_neighbours


@query()
def op11_nearest_neighbours(spark, d):
    return nearest_neighbours(table(spark, d, "embeddings").select("vec_id", "embedding"))
