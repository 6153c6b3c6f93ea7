"""All queries of this subpackage: importing the modules fills the registry."""

from mediasift.llm import q_alignment, q_chat, q_decontam, q_extract, q_jaccard, q_language, q_license, q_nearest, q_packing, q_quality, q_repair, q_rules, q_warc  # noqa: F401
from mediasift.llm.registry import QUERIES, SQL  # noqa: F401
