"""Operators on tables of line items, units, readings, pages and dictionaries."""
