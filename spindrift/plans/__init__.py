"""Registered queries by area; importing this package fills the registry."""

from . import claim_queries, feed_queries, fit_queries, grid_queries, model_queries, more_queries, reading_queries, registry, sheet_queries, stats_queries, stream_queries  # noqa: F401
