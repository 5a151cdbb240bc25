"""Registered queries, grouped by family."""

from importlib import import_module

FAMILIES = ["market_queries", "text_queries", "value_queries", "match_queries", "hazard_queries", "ingest_queries", "pipeline_queries", "extract_queries", "stream_queries", "history_queries", "place_queries", "area_queries"]


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"proplytics.plans.{family}")
