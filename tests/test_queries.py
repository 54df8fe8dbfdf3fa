"""Queries against their SQL on the smallest tables, where these are there."""

import glob
import os

import duckdb
import pytest

from triplicate.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
FAST = ("sku_normalize", "size_parse", "classify_parts", "item_pairs", "spec_and_finish", "quantities", "project_states", "activity_daily", "sliding_hits", "dictionary_import", "line_gaps", "readings_merged", "difference_summary", "contested_groups", "contested_differences", "readings_paired", "dictionary_decisions", "review_outcomes", "page_texts", "catalogue_rows", "displayed_texts", "field_sizes", "item_text_issues", "document_verdicts", "documents_reviewed")


def _plain(v):
    return None if v is None else round(v, 6) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", FAST)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    found = con.execute(oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(at) == columns
    assert ours == sorted(repr([_plain(r[at[c]]) for c in columns]) for r in found.fetchall())
