"""File sinks for exports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; every task writes its own part, in the order of the rows."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_geojson(features: DataFrame, path: str) -> None:
    """One Feature per line, written by every task (newline-delimited GeoJSON)."""
    features.select("feature").write.mode("overwrite").text(path)
