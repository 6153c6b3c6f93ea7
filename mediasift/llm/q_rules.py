"""op1: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.llm.common import table
from mediasift.llm.quality_rules import quality_rules
from mediasift.llm.registry import query

_STOPS = "the of and to in is that it for was on are with as by this be at from or an not de la le les et des en un une du que est pour dans qui au par sur pas ne se der die und den von zu das mit sich auf für ist im dem nicht ein eine als el y a los del las por con su para es al lo como"

SQL = rf"""WITH b AS (SELECT doc_id, coalesce(text,'') AS t, list_filter(string_split_regex(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
 list_filter(string_split(coalesce(text,''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || chr(10) || w[i+1] || chr(10) || w[i+2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w)-1)) AS i FROM b)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS m FROM g) WHERE m > 1),
rw AS (SELECT doc_id, sum(least(3, coalesce(nx - i, 3))) AS k FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM r) GROUP BY doc_id),
c AS (SELECT b.doc_id, len(w) AS n, len(array_to_string(w,'')) AS wc, len(regexp_replace(t,'[^#*$%&|<>]','','g')) AS sy, len(l)-len(list_distinct(l)) AS du, coalesce(k,0) AS rp, len(l) AS nl,
 len(list_filter(w, lambda x: x IN ({",".join(repr(x) for x in _STOPS.split())}))) AS st, len(regexp_replace(t,'[A-Za-z\x09-\x0D\x20\x{{80}}-\x{{10FFFF}}]','','g')) AS mk, len(t)-len(replace(t,'!','')) AS ex,
 len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS bu, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS el FROM b LEFT JOIN rw ON b.doc_id = rw.doc_id),
f AS (SELECT *, n < 50 OR 100*rp > 50*n AS bf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(wc AS BIGINT) AS word_chars, CAST(sy AS BIGINT) AS n_symbols, CAST(du AS BIGINT) AS n_dup_lines, CAST(rp AS BIGINT) AS n_repeat_words, bf AS base_failed,
 NOT bf AND wc/n >= 1.5 AND wc/n <= 30 AND sy/n <= 0.1 AND st/n >= 0.005 AND ex/n <= 0.2 AND du/nl <= 0.7 AND bu/nl <= 0.9 AND el/nl <= 0.5 AND mk/wc <= 0.4 AS kept FROM f"""


@query(SQL)
def op1_quality_rules(spark, d):
    q = quality_rules(table(spark, d, "documents").select("doc_id", "text"), "text", into="q")
    return q.select("doc_id", *[F.col(f"q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
