"""op10: license scan over all documents."""

from __future__ import annotations

from mediasift.llm.common import table
from mediasift.llm.license_scan import license_scan
from mediasift.llm.registry import query


@query()
def op10_license_scan(spark, d):
    return license_scan(table(spark, d, "documents").select("doc_id", "text"))
