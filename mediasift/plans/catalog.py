"""All registered queries: importing the modules fills the registry."""

from mediasift.plans import flagship, q_detectors, q_fusion, q_joins, q_rules, q_scores, q_series, q_sources, q_spectral, q_stats, q_subresults  # noqa: F401
from mediasift.plans.registry import QUERIES, SQL  # noqa: F401
