"""Operators for preparing large text corpora, each one a Spark job over whole tables.

Nothing outside this subpackage imports it.
"""
