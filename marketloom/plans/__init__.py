"""Registered queries, grouped by subject."""

from __future__ import annotations

from importlib import import_module

SUBJECTS = (
    "price_queries", "text_queries", "sentiment_queries", "feature_queries", "evaluation_queries",
    "report_queries", "vector_queries", "model_queries", "stream_queries",
)


def load_all() -> None:
    """Import every subject so its queries are registered."""
    for subject in SUBJECTS:
        import_module(f"marketloom.plans.{subject}")
