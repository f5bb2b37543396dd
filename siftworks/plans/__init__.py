"""Registered queries; importing the modules registers them."""

from . import enrichment_queries, evaluation_queries, metric_queries, scan_queries  # noqa: F401
