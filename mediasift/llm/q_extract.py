"""op7: main text of all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediasift.llm.common import table
from mediasift.llm.html_extract import extract, train
from mediasift.llm.registry import query


@query()
def op7_html_extract(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", "html")
    out = extract(pages, train(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
