"""What is computed for each row stands where Spark compiles it, and shortcuts agree with what they cut short."""

import itertools
import re

from pyspark.sql import functions as F

from triplicate.functions import dimensions
from triplicate.functions.equivalence import codes_differ, with_features
from triplicate.functions.text import canonical_finish, same_finish, significant_tokens
from triplicate.operators.crosscheck import discrepancies, with_members

_UNIT = (
    "project_id long, side string, unit_id string, ord int, category string, quantity int, manuf_code string, substitution_sku string, source_type string,"
    "primary struct<raw_sku:string,description:string,dimensions:{0},finish:string,door_style:string,species:string,construction:string,drawer_box:string,price:string,"
    "quantity:int,quantity_resolution:struct<confidence_status:string>,substitution_sku:string,modifications:string>"
).format(dimensions.TYPE)


def _generators(df):
    """What the plan's generators take apart; anything but a column is evaluated there without being compiled."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"Generate (?:pos)?explode\((.{0,40})", plan)


def test_nothing_is_computed_in_generators(spark):
    groups = spark.createDataFrame([(1, "D-1", None, None, "MISSING", "alone")], "project_id long, design_id string, order_id string, ack_id string, status string, decided string")
    members = with_members(groups, spark.createDataFrame([], _UNIT))
    items = spark.createDataFrame([("B36", None, "CABINET", "30W")], "raw_sku string, description string, category string, size string").withColumn("dimensions", dimensions.parse(F.col("size")))
    for df, n in ((discrepancies(members), 2), (with_features(items), 3)):
        found = _generators(df)
        assert len(found) == n and all(re.match(r"\w+#\d+\)", g) for g in found), found
    assert [r["field"] for r in discrepancies(members).collect()] == ["item_presence"]


def test_only_what_marks_words_is_sought(spark):
    rows = spark.createDataFrame([("Maple  walnut, MAPLE door",), ("N/A",), (" none ",), (None,), ("oak-3 Kiwi",), ("with hood",), ("Ébène noir",)], "t string")
    tokens = significant_tokens(F.col("t"))
    assert [r[0] for r in rows.select(tokens).collect()] == [["maple", "walnut"], [], [], [], [], [], ["noir"]]


def test_sizes_contradict_where_the_reason_says_so(spark):
    texts = (None, "30W x 34H", "30.04W", "33W x 34H x 24D", "30 x 36", "OPENING 30", "opening 30", "OPENING 33 x 20", "24D")
    rows = spark.createDataFrame(list(itertools.product(texts, texts)), "x string, y string").select(dimensions.parse(F.col("x")).alias("a"), dimensions.parse(F.col("y")).alias("b"))
    a, b = F.col("a"), F.col("b")
    got = rows.select(dimensions.equivalent(a, b), ~dimensions.reason(a, b).endswith("MISMATCH")).collect()
    assert all(r[0] == r[1] for r in got) and {r[0] for r in got} == {True, False}


def test_equal_texts_need_no_normal_form(spark):
    texts = (None, "", "n/a", "N/A", "Cocoa", "COCOA ", "cocoa", "Atlanta birch  cocoa", "Jute")
    a, b = F.col("x"), F.col("y")
    got = spark.createDataFrame(list(itertools.product(texts, texts)), "x string, y string").select(same_finish(a, b), F.coalesce(canonical_finish(a) == canonical_finish(b), F.lit(False))).collect()
    assert all(r[0] == r[1] for r in got)
    codes = [("B36-12", "b36 12"), ("B36-12", "B36/12_L"), ("B36", "W36"), ("--", "."), (None, "B36"), ("N/A", "B36")]
    assert [r[0] for r in spark.createDataFrame(codes, "x string, y string").select(codes_differ(a, b)).collect()] == [False, False, True, True, False, False]
