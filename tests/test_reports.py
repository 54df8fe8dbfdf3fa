from pyspark.sql import functions as F

from triplicate.functions.dimensions import parse_fields
from triplicate.operators import readings
from triplicate.operators import report as rep
from triplicate.operators.crosscheck import discrepancies, with_members
from triplicate.operators.matching import match_units
from triplicate.operators.units import aggregate_units
from triplicate.sources.line_items import COLUMNS


def _members(spark, *rows):
    """Checked groups of items given as (side, ord, code, quantity, finish)."""
    numbers = {"project_id": "long", "organization_id": "long", "ord": "int", "quantity": "int"}
    schema = ", ".join(f"{c} {numbers.get(c, 'string')}" for c in COLUMNS)
    made = [{"project_id": 1, "side": s, "source_type": s, "item_id": f"{s[0]}{n}", "ord": n, "raw_sku": code, "quantity": q, "finish": f, "category": "CABINET"} for s, n, code, q, f in rows]
    items = spark.createDataFrame([tuple(m.get(c) for c in COLUMNS) for m in made], schema).withColumn("dimensions", F.lit(None).cast("struct<width:double,height:double,depth:double,opening:string,axis_certainty:string,raw:string>"))
    units = aggregate_units(items)
    members = with_members(match_units(units), units).cache()
    return members, discrepancies(members)


def test_report_has_a_row_for_each_difference_and_one_for_a_group_without(spark):
    members, found = _members(
        spark, ("DESIGN", 1, "B30", 1, "Oak"), ("ORDER", 1, "B30", 2, "Oak"), ("ACK", 1, "B30", 2, "Pine"), ("DESIGN", 2, "W12", 1, None), ("ORDER", 2, "W12", 1, None), ("ACK", 2, "W12", 1, None)
    )
    reviews = spark.createDataFrame([(1, "D1", "quantity", "ORDER", "ESCALATE", 2, 2), (1, "D1", None, None, "NOTE", 1, 1)], "project_id long, leader string, field string, introduced_at string, action string, at int, review_id int")
    names = spark.createDataFrame([(1, "Kitchen")], "project_id long, project_name string")
    report = rep.full_report(members, found, reviews, names)
    assert tuple(report.columns) == rep.COLUMNS
    rows = {(r.match_group_id, r.discrepancy_type): r for r in report.collect()}
    assert set(rows) == {("1/D1", "quantity"), ("1/D1", "finish"), ("1/D2", "")}
    q, plain = rows["1/D1", "quantity"], rows["1/D2", ""]
    assert (q.review_status, q.status, q.final_quantity, q.project_name) == ("ESCALATE", "CHANGED", "2", "Kitchen")
    assert rows["1/D1", "finish"].review_status == "ESCALATE"  # the last review of the group
    assert (plain.status, plain.review_status, plain.design_finish, plain.design_dimensions) == ("MATCHED", "", "", "-")
    empty = rep.full_report(members, found, reviews.limit(0), names.limit(0))
    assert {r.review_status for r in empty.collect()} == {"OPEN", ""} and {r.project_name for r in empty.collect()} == {""}


def test_report_is_written_in_order(spark, tmp_path):
    members, found = _members(spark, ("DESIGN", 2, "B30", 1, None), ("DESIGN", 1, "W12", 1, None))
    none = spark.createDataFrame([], "project_id long, leader string, field string, introduced_at string, action string, at int, review_id int")
    rep.write_report(rep.full_report(members, found, none, spark.createDataFrame([], "project_id long, project_name string")), str(tmp_path / "r"))
    back = spark.read.option("header", True).csv(str(tmp_path / "r"))
    assert tuple(back.columns) == rep.COLUMNS and [r.match_group_id for r in back.collect()] == ["1/D1", "1/D2"]


def test_override_supersedes_and_compares_anew(spark):
    members, found = _members(spark, ("DESIGN", 1, "B30", 1, "Oak"), ("ORDER", 1, "B30", 2, "Pine"), ("DESIGN", 2, "W12", 1, None), ("ORDER", 2, "W12", 3, None))
    changes = spark.createDataFrame([(1, "O1", "finish", "oak"), (1, "O1", "quantity", "5")], "project_id long, unit_id string, field string, value string")
    after, rows = rep.overridden(members, found, changes)
    assert sorted((r.design_id, r.field, r.status, r.order_value) for r in rows.collect()) == [
        ("D1", "finish", "SUPERSEDED", "Pine"), ("D1", "quantity", "OPEN", "5"), ("D1", "quantity", "SUPERSEDED", "2"), ("D2", "quantity", "OPEN", "3"),
    ]
    assert {r.design_id: r.o.quantity for r in after.collect()} == {"D1": 5, "D2": 3}
    untouched = rep.overridden(members, found, changes.limit(0))[1]
    assert untouched.count() == found.count() and untouched.where("status <> 'OPEN'").count() == 0


def test_next_steps(spark):
    g = spark.createDataFrame([(1, "MATCHED"), (1, "OUT_OF_SCOPE"), (2, "MATCHED"), (2, "EXTRA"), (2, "EXTRA"), (2, "UNCERTAIN"), (3, "OUT_OF_SCOPE")], "project_id long, status string")
    steps = {r.project_id: [(s.step, s.n) for s in r.steps] for r in rep.next_steps(g).collect()}
    assert steps == {1: [("PROCEED", 1)], 2: [("EXTRA", 2), ("UNCERTAIN", 1), ("FINALIZE", 4)]}


def test_documents_reviewed(spark):
    docs = spark.createDataFrame([(1, "ORDER", "old", "FAILED", 1), (1, "CABINET_LIST", "new", "COMPLETED", 2), (1, "DESIGN", None, "UPLOADED", 1)], "project_id long, kind string, name string, state string, added int")
    rows = rep.documents_reviewed(docs.select("project_id").distinct(), docs).collect()
    assert sorted((r.role, r.name, r.state) for r in rows) == [("ACKNOWLEDGEMENT", "Not uploaded", "Missing"), ("CABINET_LIST", "new", "COMPLETED"), ("DESIGN", "-", "UPLOADED")]


def test_texts_as_shown(spark):
    cases = {None: "-", "  ": "-", "None": "-", "plain\\": "plain", '["x", null, "y"]': "x; y", "{}": "-", '{"w": "3", "depth": "4"}': "3 × 4", '{"opening": "A"}': "A", "{broken": "{broken"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "given string, shown string")
    assert [(r.given, r.found) for r in rows.select("given", "shown", rep.format_text(F.col("given")).alias("found")).where("not (shown <=> found)").collect()] == []


def test_sizes_by_fields(spark):
    rows = spark.createDataFrame([({"w": '36"', "Height": "x"},), ({"opening": "O\\"},), ({"a": "", "b": "12 x 3"},), ({},), (None,)], "m map<string,string>")
    s = [r.s for r in rows.select(parse_fields(F.col("m")).alias("s")).collect()]
    assert (s[0].width, s[0].height, s[1].opening, s[2].width, s[2].height, s[3], s[4]) == (36.0, None, "O", 12.0, 3.0, None, None)


def test_verdicts_on_items_and_documents(spark):
    rows = spark.createDataFrame([("A" * 19, "x", "y", 2.0), ("A" * 19 + "+", None, None, None), (None, "501", "3W", 0.1)], "sku string, quantity_text string, size_text string, confidence double")
    assert [r.issues for r in readings.issues(rows).collect()] == [["SUSPICIOUS_MERGED_SKU", "INVALID_QUANTITY", "UNPARSEABLE_DIMENSIONS", "OUT_OF_BOUNDS_CONFIDENCE"], [], ["EMPTY_SKU", "UNUSUALLY_LARGE_QUANTITY"]]
    docs = spark.createDataFrame([(1,), (2,), (3,)], "d long")
    items = spark.createDataFrame([(1, "*1", None), (1, "3", False), (2, "1", True)], "d long, line string, c boolean")
    found = {r.d: (r.n_items, r.issues, r.verdict) for r in readings.document_issues(docs, items, "d", "line", "c").collect()}
    assert found == {1: (2, ["LINE_NUMBER_GAP"], "VALID"), 2: (1, ["RECONCILIATION_CONFLICT"], "UNCERTAIN"), 3: (0, ["EMPTY_EXTRACTION"], "UNCERTAIN")}
