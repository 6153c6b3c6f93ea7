"""op2: benchmark passages in all documents."""

from __future__ import annotations

from mediasift.llm.common import table
from mediasift.llm.decontamination import contaminated
from mediasift.llm.registry import query

_W = r"list_filter(string_split_regex(lower(coalesce(text,'')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

SQL = f"""WITH s AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w)-3)) AS i FROM (SELECT item_id, {_W} AS w FROM benchmark))),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w)-3)) AS i FROM (SELECT doc_id, {_W} AS w FROM documents)))
SELECT doc_id, s.item_id, max(n) AS n_shingles, count(*) AS n_found, count(*)/max(n) AS containment FROM d JOIN s ON d.g = s.g JOIN n ON s.item_id = n.item_id GROUP BY doc_id, s.item_id HAVING 10*count(*) >= 8*max(n)"""


@query(SQL)
def op2_decontamination(spark, d):
    return contaminated(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", "text"))
