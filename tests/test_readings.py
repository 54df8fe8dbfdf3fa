import random
import time
from itertools import product

from pyspark.sql import functions as F

from triplicate.operators.projects import anchors_once, evidence
from triplicate.operators.readings import ALIKE, CONFUSED, LEAST_EVIDENCE, align, alike, likeness, merge, paired_by_evidence, spellings


def test_spellings_are_all_of_up_to_two_misread_letters():
    other = {c: {a if c == b else b for a, b in CONFUSED if c in (a, b)} for c in "".join(CONFUSED)}
    for code in ("B36-1OS", "0Z8", "XYQ", "11111111112"):
        at = [i for i, c in enumerate(code) if c in other][:8]
        every = ["".join(s) for s in product(*({c} | (other.get(c, set()) if i in at else set()) for i, c in enumerate(code)))]
        assert spellings(code) == sorted(s for s in every if sum(x != y for x, y in zip(s, code)) <= 2)
    assert spellings(None) == [] and likeness("BASE OAK", None) == 0.0 and likeness("A", "A") == 1.0


def test_repeats_pair_by_evidence_and_never_by_order(spark):
    schema = "document_id long, ord int, sku string, page_number int, description string, quantity string"
    one = spark.createDataFrame([(1, 1, "B36", 1, "base", "1"), (1, 2, "B36", 2, "wall", "2"), (1, 3, "W3O", 4, "x", "5"), (1, 4, None, 1, None, None), (1, 5, "T8", None, None, None)], schema)
    two = spark.createDataFrame([(1, 1, "b36", 2, "zz", "2"), (1, 2, "B36", 9, "qq", "7"), (1, 3, "W30", 4, "y", "5"), (1, 4, "TB", None, "t", None)], schema)
    found = {(r.o and r.o.ord, r.v and r.v.ord, r.basis) for r in align(one, two).collect()}
    assert found == {(2, 1, "REPEATED_CODE"), (3, 3, "MISREAD_CODE"), (1, None, "OCR_ONLY"), (4, None, "OCR_ONLY"), (5, None, "OCR_ONLY"), (None, 2, "VISION_ONLY"), (None, 4, "VISION_ONLY")}


def test_pruned_pairs_are_those_of_all_pairs():
    rng = random.Random(6)
    texts = [None, "", "BASE OAK", "BASE OAK 2", "WALL OAK", "WALL MAPLE DOOR", "TALL"]
    same = lambda x, y: x is not None and x == x and x == y
    for _ in range(150):
        one, other = ([(n, rng.choice([1, 2, None]), rng.choice(texts), rng.choice([1, 2, float("nan"), None])) for n in rng.sample(range(50), rng.randint(0, 12))] for _ in range(2))
        scored = [(2 * same(a[1], b[1]) + 2 * (likeness(a[2], b[2]) >= ALIKE) + same(a[3], b[3]), a[0], b[0]) for a in one for b in other]
        taken, wanted = (set(), set()), []
        for score, o, v in sorted((s for s in scored if s[0] >= LEAST_EVIDENCE), key=lambda t: (-t[0], *t[1:])):
            if o not in taken[0] and v not in taken[1]:
                taken[0].add(o)
                taken[1].add(v)
                wanted.append((o, v))
        assert sorted(paired_by_evidence(one, other)) == sorted(wanted)
    for _ in range(500):
        a, b = ("".join(rng.choice("ABC ") for _ in range(rng.randint(0, 9))) for _ in range(2))
        assert alike(a, b) == (likeness(a, b) >= ALIKE)


def test_many_rows_of_one_code_in_one_document():
    rng = random.Random(1)
    rows = [(n, rng.randint(1, 400), f"BASE CABINET {rng.choice('ABCDEFGH') * rng.randint(1, 30)}", rng.randint(1, 5)) for n in range(20_000)]
    began = time.time()
    found = paired_by_evidence(rows, rows)
    assert time.time() - began < 120 and len(found) == 20_000 and all(rows[o][1:] == rows[v][1:] for o, v in found)


def test_merging_fields(spark):
    side = "struct<sku:string,quantity:string,description:string,unit_price:string,total_price:string,dimensions:string,notes:string,finish:string>"
    rows = [
        (1, ("B36", "2", "base", "10.00", None, "36x24", None, "oak"), ("b36", "2.0", " BASE ", "10.0", "20", "36 x 24", "seen", " "), "EXACT_CODE"),
        (2, ("B36", "N/A", "a", None, None, None, "text", None), ("B36", "3", "b", None, None, None, None, None), "EXACT_CODE"),
        (3, ("B36", "3", None, None, None, None, None, None), ("B36", "n/a", None, None, None, None, None, None), "EXACT_CODE"),
        (4, None, ("B36", "1", None, None, None, None, None, None), "VISION_ONLY"),
        (5, ("B3O", "1", None, None, None, None, None, None), ("B30", "1", None, None, None, None, None, None), "MISREAD_CODE"),
    ]
    aligned = spark.createDataFrame(rows, f"document_id long, o {side}, v {side}, basis string")
    told = {r.document_id: r for r in merge(aligned).collect()}
    assert told[1].conflicts == ["unit_price", "dimensions"] and (told[1].sku, told[1].unit_price, told[1].total_price, told[1].dimensions, told[1].notes, told[1].finish) == ("b36", "10.00", "20", "36x24", "seen", "oak")
    assert told[2].conflicts == ["description"] and (told[2].quantity, told[2].description, told[2].notes) == ("3", "b", "text")
    assert (told[3].quantity, told[3].verdict, told[4].verdict) == ("3", "VERIFIED", "UNCERTAIN")
    assert told[5].conflicts == ["sku"] and told[5].sku == "B3O" and {r.document_id: r.sku for r in merge(aligned, spatial=True).collect()}[5] == "B30"


def test_evidence_is_judged_by_the_page(spark):
    pages = spark.createDataFrame([(1, 1, "PROCESSED", "Line 7:  Base\n Cabinet B36"), (1, 2, "EMPTY", "Base"), (1, 3, "PROCESSED", ""), (1, 4, "PROCESSED", None)], "d long, page int, status string, raw_text string")
    cases = [
        ((1, "base cabinet", "X"), "VERIFIED", None), ((1, "no such text", "b36"), "VERIFIED", None), ((1, "no such text", "b37"), "UNCERTAIN", "SOURCE_TEXT_MISMATCH"), ((1, "no such text", None), "UNCERTAIN", "SOURCE_TEXT_MISMATCH"),
        ((1, "  ", "b36"), "UNCERTAIN", "EMPTY_EVIDENCE"), ((None, None, "b36"), "UNCERTAIN", "EMPTY_EVIDENCE"), ((0, "", "b36"), "UNCERTAIN", "EMPTY_EVIDENCE"), ((None, "base", "b36"), "UNCERTAIN", None), ((9, "base", "b36"), "UNCERTAIN", "INVALID_EVIDENCE"),
        ((2, "base", "b36"), "UNCERTAIN", None), ((3, "base", "b36"), "UNCERTAIN", None), ((4, "", "b36"), "UNCERTAIN", None),
    ]
    items = spark.createDataFrame([(1, n, *c[0]) for n, c in enumerate(cases)], "d long, n int, page int, said string, sku string")
    found = {r.n: (r.verdict, r.issue) for r in evidence(items, pages, ["d", "page"]).collect()}
    assert found == {n: c[1:] for n, c in enumerate(cases)}


def test_values_as_they_are_shown(spark):
    from triplicate.functions.display import format_display

    cases = {'{"Opening": "", "W": 12}': '12"W', '{"width": "12\\" w"}': '12" w', '[{"w": 1}, 2, "null"]': '1"W, 2, —', "{'x': 'it'}": "x: it", "{'x': 'it's'}": "{'x': 'it's'}", '{"a": {"b": {"c": 1}}}': 'a: b: {"c":1}', "[1, 2": "[1, 2", "None": "—"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    assert {r.v: r.shown for r in df.select("v", format_display(F.col("v")).alias("shown")).collect()} == cases


def test_an_anchor_is_taken_once(spark):
    left = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 8)], "d long, page int")
    right = spark.createDataFrame([(1, 3), (1, 4), (1, 12)], "d long, page int")
    assert sorted((r.page, r.anchor) for r in anchors_once(left, right, "d", "page").collect()) == [(1, 3), (2, 4)]


def test_lines_of_both_readings_are_made_once(spark, monkeypatch):
    """Readings are read several times; neither numbers nor groups the lines of orders anew for that."""
    from triplicate.operators import readings
    from triplicate.plans import services

    plans = []
    monkeypatch.setattr(readings, "align", lambda *two: (plans.extend(x._jdf.queryExecution().executedPlan().toString() for x in two), align(*two))[1])
    services.readings_merged(spark, "/root/testdata/sf0.001")
    services.readings_paired(spark, "/root/testdata/sf0.001")
    assert len(plans) == 4 and not any("Window" in p or "Exchange" in p for p in plans)
