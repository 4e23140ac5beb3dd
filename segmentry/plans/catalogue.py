"""All registered queries."""

from segmentry.plans import table_queries  # noqa: F401
from segmentry.plans import feature_queries  # noqa: F401
from segmentry.plans import cluster_queries  # noqa: F401
from segmentry.plans import job_queries  # noqa: F401
from segmentry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
