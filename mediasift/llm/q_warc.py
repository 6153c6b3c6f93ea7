"""op4: all pages written as WARC and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.llm.common import table
from mediasift.llm.registry import query
from mediasift.llm.warc import archive

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_NIBBLES = "".join(f"{k:04b}" for k in range(16))

SQL = f"""WITH p AS (SELECT page_id, coalesce(html,'') AS h, sha1(coalesce(html,'')) AS x FROM pages),
g AS (SELECT x, min(page_id) AS f FROM p GROUP BY x),
b AS (SELECT page_id, strlen(h) AS n, array_to_string(list_transform(range(1, 41), lambda i: substr('{_NIBBLES}', CAST(4*strpos('0123456789abcdef', substr(p.x, i, 1))-3 AS BIGINT), 4)), '') AS b, f FROM p JOIN g ON p.x = g.x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('{_B32}', CAST(1 + {' + '.join(f"{16 >> k}*CAST(substr(b, CAST(5*i+{k + 1} AS BIGINT), 1) AS INT)" for k in range(5))} AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM b"""


@query(SQL)
def op4_warc(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", "html", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id")).alias("captured_at"))
    return archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
