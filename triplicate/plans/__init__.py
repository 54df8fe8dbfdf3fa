"""Queries composed of operators: summaries, lists, reports, review state."""
