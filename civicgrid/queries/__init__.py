"""All registered queries."""

from . import aggregate_queries, cluster_queries, money_queries, numeric_queries, photo_queries, plan_queries, source_queries, spatial_queries, stream_queries, text_queries, view_queries  # noqa: F401
from .registry import REGISTRY, run  # noqa: F401
