"""All registered queries of the reference's own operators."""

from __future__ import annotations

from . import carbon_queries, evaluation_queries, graph_queries, ops_queries, quality_queries, retrieval_queries, routing_queries, stream_queries, structure_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
