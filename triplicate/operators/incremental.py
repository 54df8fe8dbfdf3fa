"""Matching anew of the projects alone whose documents changed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from triplicate.operators.matching import match_units
from triplicate.operators.units import aggregate_units
from triplicate.sources.store import BUCKETS, replace_keys, rows_of


def replace_documents(path: str, fresh: DataFrame, buckets: int = BUCKETS) -> None:
    """Line items of whole documents in place of all of the same project and source type, in a table kept by project."""
    slots = fresh.select("project_id", "source_type").distinct()
    held = rows_of(path, "project_id", fresh, buckets)
    kept = held.join(slots, ["project_id", "source_type"], "left_anti").select(*fresh.columns)
    replace_keys(path, "project_id", fresh, kept.unionByName(fresh), buckets)


def rematch(items: str, groups: str, touched: DataFrame, buckets: int = BUCKETS) -> None:
    """Groups of the touched projects, in a table kept by project, as their line items now have it."""
    fresh = match_units(aggregate_units(rows_of(items, "project_id", touched, buckets)))
    replace_keys(groups, "project_id", touched, fresh, buckets)
