"""Changes of dictionaries: order, first wins, and that the same changes twice change nothing."""

from triplicate.operators import dictionary_changes as dc

BASE = [("M1", 1, "B 36", "CABINET", "base", None, True, True, 1, None), ("M1", 2, "W30", "CABINET", None, "g", False, True, 3, 5), ("M2", 3, "b  36", "PANEL", None, None, True, False, 1, None)]


def applied(spark, base, *changes):
    rows = [(n, a, m, e, *more, *[None] * (6 - len(more))) for n, a, m, e, *more in changes]
    after, verdicts = dc.apply_changes(spark.createDataFrame(base, dc.ENTRY), spark.createDataFrame(rows, dc.CHANGE))
    return sorted((tuple(r) for r in after.collect()), key=str), {r.change_id: r.verdict for r in verdicts.collect()}


CHANGES = (
    (10, "CREATE", "M1", 101, "b36", "PANEL"), (11, "CREATE", "M1", 102, " b  36 ", "PANEL"), (12, "UPDATE", "M1", 1, None, None, "new", None, None, False), (13, "DELETE", "M1", 1), (14, "UPDATE", "M1", 1, None, None, "late"),
    (15, "CREATE", "M1", 103, "B 36", "PANEL", "again"), (16, "DEACTIVATE", "M1", 103), (17, "UPDATE", "M2", 1, None, None, "other maker"), (4, "UPDATE", "M1", 2, None, None, "before its last change"),
    (18, "CREATE", "M1", 104, "  ", "PANEL"), (19, "CREATE", "M1", 105, "Z9", "GADGET"), (20, "UPDATE", "M2", 3, None, "GADGET"), (21, "SHOUT", "M2", 3), (22, None, "M2", 3),
)


def test_changes_in_order(spark):
    after, verdicts = applied(spark, BASE, *CHANGES)
    assert after == sorted([BASE[1], BASE[2], ("M1", 101, "b36", "PANEL", None, None, True, True, 1, 10), ("M1", 103, "B 36", "PANEL", "again", None, True, False, 2, 16)], key=str)
    exists, lost = "Code already exists for this manufacturer", "Dictionary entry not found"
    assert verdicts == {10: "APPLIED", 11: exists, 12: "APPLIED", 13: "APPLIED", 14: lost, 15: "APPLIED", 16: "APPLIED", 17: lost, 4: "Already applied", 18: "Code cannot be empty", 19: "Invalid category", 20: "Invalid category", 21: "Unknown action", 22: "Unknown action"}
    again, second = applied(spark, after, *CHANGES)
    assert again == after and second[16] == "Already applied"
    assert applied(spark, BASE) == (sorted(BASE, key=str), {}) and applied(spark, [], *CHANGES[:1])[0] == [after[0]]


def test_imports_and_approvals(spark):
    dictionary = spark.createDataFrame(BASE, dc.ENTRY)
    rows = spark.createDataFrame([(1, "B 36", "panel", "x"), (2, "T84", "Panel ", " y "), (3, "t84", "PANEL", ""), (4, "", "PANEL", ""), (5, "Q1", "odd", ""), (6, "Q2", "FILLER", " ")], "row_id long, code string, category string, description string")
    new = dc.import_changes(rows, dictionary, "M1", 500, 900)
    assert sorted((r.change_id, r.entry_id, r.code, r.category, r.description) for r in new.collect()) == [(902, 502, "T84", "PANEL", "y"), (906, 506, "Q2", "FILLER", None)]
    after, verdicts = dc.apply_changes(dictionary, new)
    assert after.count() == 5 and {r.verdict for r in verdicts.collect()} == {"APPLIED"}
    books = spark.createDataFrame([("M1", 1, "b  36", "PANEL", None, "PENDING"), ("M1", 2, "N1", "PANEL", None, "PENDING"), ("M1", 3, "n1", "PANEL", None, "PENDING"), ("M1", 4, "N2", "PANEL", None, "REJECTED"), ("M1", 5, "N3", "PANEL", None, "PENDING")], "maker string, row_id long, code string, category string, description string, status string")
    edits = spark.createDataFrame([(1, 5, "UPDATE", "N4", None, None), (2, 5, "REJECT", None, None, None), (3, 5, "UPDATE", "N5", None, None), (4, 4, "UPDATE", "N9", None, None), (5, 9, "REJECT", None, None, None), (6, 2, "UPDATE", None, "FILLER", None)], "edit_id long, row_id long, action string, code string, category string, description string")
    edited, said = dc.edit_rows(books, edits)
    assert {r.edit_id: r.verdict for r in said.collect()} == {1: "APPLIED", 2: "APPLIED", 3: "Only pending rows can be edited", 4: "Only pending rows can be edited", 5: "Spec book row not found", 6: "APPLIED"}
    for asked, kept in ((None, []), (spark.createDataFrame([(3,), (3,)], "row_id long"), [1, 2])):
        rows, added = dc.approve(edited, dictionary, asked)
        assert {r.row_id: r.status for r in rows.collect()} == {n: "PENDING" if n in kept else "REJECTED" if n > 3 else "APPROVED" for n in range(1, 6)}
        assert [(r.row_id, r.category) for r in added.collect()] == [(3, "PANEL") if asked else (2, "FILLER")]
