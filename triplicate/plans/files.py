"""Queries over files that Spark writes from the table of parts and reads back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplicate.operators.dictionary import KEYWORDS
from triplicate.sources import tabular
from triplicate.sources.line_items import table
from triplicate.sources.scratch import shared_folder

_KINDS = ("panel", "Crown trim", "metallic", "Freight charge", "gizmo", "Wall unit", "FILLER", "pull knob")
#: Rows of a workbook at most.
_BLOCK = 500


def _parts(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    code = F.when(k % 6 != 0, F.concat(F.lit(' "'), "p_name", F.lit('", '), k.cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", code.alias("code"), F.col("p_type").alias("description"), F.element_at(F.lit(list(_KINDS)), (k % len(_KINDS) + 1).cast("int")).alias("kind"))


def catalogue_csv(spark, sf_dir):
    """Parts written as CSV files with a mark of byte order and read back by the names of their columns."""
    path = f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}"
    named = _parts(spark, sf_dir).select(F.col("p_size").alias("﻿Weight"), F.col("code").alias("Item #"), F.col("description").alias("Product Description"), F.col("kind").alias("Product Type"))
    named.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)
    found = tabular.catalogues(tabular.records(tabular.files(spark, path).where("path like '%.csv'")))
    return found.select("code", "description", "category", "confidence", "error")


def _workbooks(spark, sf_dir) -> DataFrame:
    """path and content of workbooks of ``_BLOCK`` parts each, with a second sheet of numbers."""

    def book(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("p_partkey")
        first = [["Model Number", None, "Desc", "TYPE"]] + [[r.code, None, r.description, r.kind] for r in rows.itertuples()]
        second = [[int(r.p_partkey), None, r.p_size + 0.5] for r in rows.itertuples()]
        content = tabular.workbook({"Codes & kinds": first, "Sizes": second})
        return pd.DataFrame({"path": [f"block-{rows['block'].iloc[0]}.xlsx"], "content": [content]})

    dealt = _parts(spark, sf_dir).withColumn("block", F.floor(F.col("p_partkey") / _BLOCK))
    return dealt.groupBy("block").applyInPandas(book, "path string, content binary")


def catalogue_sheets(spark, sf_dir):
    """Parts written as workbooks and read back."""
    return tabular.catalogues(tabular.records(_workbooks(spark, sf_dir))).select("path", "row", "code", "description", "category", "confidence", "error")


def workbook_texts(spark, sf_dir):
    """Workbooks as texts, sheet by sheet."""
    return tabular.sheet_texts(_workbooks(spark, sf_dir))


_NAMES = ("a.PDF", "b.jpeg", "c.xlsx", "d.xls", "e.docx", "f.doc", "g.exe", "csv", "h.csv", "i.TIF", "j.md")


def media_types(spark, sf_dir):
    """Which files may be uploaded, by their endings."""
    name = F.concat(F.col("p_partkey").cast("string"), F.element_at(F.lit(list(_NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", tabular.media_type(name).alias("media_type"))


_INFER = "CASE " + " ".join(f"WHEN regexp_matches(lower(kind), '{'|'.join(words)}') THEN '{c}'" for c, words in KEYWORDS.items()) + " ELSE 'UNKNOWN' END"
_LISTED = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"
_P = f"""p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 6 <> 0 THEN ' "' || p_name || '", ' || p_partkey END AS code, p_type AS description, {_LISTED}[p_partkey % {len(_KINDS)} + 1] AS kind FROM part)"""

SQL = {
    "catalogue_csv": f"WITH {_P} SELECT trim(code) AS code, description, CASE WHEN kind = 'FILLER' THEN kind WHEN kind = 'panel' THEN 'PANEL' ELSE {_INFER} END AS category, CAST(1 AS DOUBLE) AS confidence, NULL::VARCHAR AS error FROM p WHERE code IS NOT NULL",
    "catalogue_sheets": f"""WITH {_P}, n AS (SELECT *, p_partkey // {_BLOCK} AS block, row_number() OVER (PARTITION BY p_partkey // {_BLOCK} ORDER BY p_partkey) + 1 AS row FROM p)
        SELECT 'block-' || block || '.xlsx' AS path, CAST(row AS INT) AS row, trim(code) AS code, description, {_INFER} AS category, CAST(1 AS DOUBLE) AS confidence, NULL::VARCHAR AS error FROM n WHERE code IS NOT NULL""",
    "workbook_texts": f"""WITH {_P} SELECT 'block-' || p_partkey // {_BLOCK} || '.xlsx' AS path, '--- SHEET: Codes & kinds ---' || chr(10) || 'Model Number | Desc | TYPE' || chr(10) || string_agg(concat_ws(' | ', code, description, kind), chr(10) ORDER BY p_partkey)
        || chr(10) || chr(10) || '--- SHEET: Sizes ---' || chr(10) || string_agg(p_partkey || ' | ' || p_size || '.5', chr(10) ORDER BY p_partkey) AS text, NULL::VARCHAR AS error FROM p GROUP BY p_partkey // {_BLOCK}""",
    "media_types": f"""SELECT p_partkey, CASE p_partkey % {len(_NAMES)} WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 3 THEN 'application/vnd.ms-excel'
        WHEN 4 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 5 THEN 'application/msword' WHEN 8 THEN 'text/csv' WHEN 9 THEN 'image/tiff' WHEN 10 THEN 'text/markdown' END AS media_type FROM part""",
}
QUERIES = [catalogue_csv, catalogue_sheets, workbook_texts, media_types]
