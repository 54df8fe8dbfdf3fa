from pyspark.sql import functions as F

from triplicate.functions import dimensions, text
from triplicate.functions.classification import classify
from triplicate.functions.equivalence import item_match, with_features
from triplicate.operators.dictionary import header_column


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_codes(spark):
    assert one(spark, text.normalize_sku, "  cab-24-l  ", "X36   2DR", "null", "-", "\tb 1 ", None) == ["CAB-24-L", "X36 2DR", None, None, "B 1", None]
    assert one(spark, text.sku_tokens, "CAB-24-L", "B36 1TD BUTT", "WALL_3012/R", None) == [["CAB", "24", "L"], ["B36", "1TD", "BUTT"], ["WALL", "3012", "R"], []]


def test_quantities(spark):
    assert one(spark, text.normalize_quantity, "01", "1.0", "Qty: 2", "QTY 12 EA", "3 PCS", "N/A", "-3") == [1, 1, 2, 12, 3, None, 3]


def test_finishes(spark):
    rows = spark.createDataFrame([("Dewdrop", "JAMESTOWN PHW DEWDROP"), ("DEWDROP", "ALPINE"), (None, None), ("", "OAK")], "a string, b string")
    assert [r[0] for r in rows.select(text.same_finish(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_sizes(spark):
    def parsed(*values):
        return [r and (r.width, r.height, r.depth, r.axis_certainty) for r in one(spark, dimensions.parse, *values)]

    assert parsed('12"', "36W x 12H x 24D", "36 x 12 x 24", "N/A", "nothing", "W:36 H:12 D:24", "37 1/4 X 44 3/4") == [
        (12.0, None, None, "SINGLE_VALUE"),
        (36.0, 12.0, 24.0, "EXPLICIT"),
        (36.0, 12.0, 24.0, "UNLABELED"),
        None,
        None,
        (None, 36.0, 12.0, "EXPLICIT"),
        (37.0, 1.0, 4.0, "UNLABELED"),
    ]
    rows = spark.createDataFrame([('12"', "12 W"), ("36W x 12H x 24D", "36W x 15H x 24D"), (None, "3 W"), ('30" opening', "30 Opening")], "a string, b string")
    a, b = dimensions.parse(F.col("a")), dimensions.parse(F.col("b"))
    assert [r[0] for r in rows.select(dimensions.equivalent(a, b)).collect()] == [True, False, True, True]


def test_categories(spark):
    rows = spark.createDataFrame(
        [("X", "Freight surcharge"), ("DEP1W", "DISHWASHER END PANEL"), ("B36", None), ("BF3", None), ("BFH12", None), ("Q-FILLER-9", None), ("Z TK", None), ("B36", "Display 1 – 48in Range Kitchen"), (None, None), ("QQ", "hutch mld")],
        "s string, d string",
    )
    found = [r[0] for r in rows.select(classify(F.col("s"), F.col("d"))["category"]).collect()]
    assert found == ["COMMERCIAL_CHARGE", "PANEL", "CABINET", "FILLER", "ACCESSORY", "FILLER", "MOLDING", "CABINET", "UNKNOWN", "MOLDING"]


def test_specs(spark):
    assert one(spark, text.normalize_spec, "ply", "QS-OAK", "hard maple", "sc", " Walnut ", None, "-") == ["PLYWOOD", "QUARTER SAWN OAK", "MAPLE", "SOFT-CLOSE", "WALNUT", None, None]
    assert one(spark, text.canonical_finish, "Dewdrop", "Jamestown  PHW Dewdrop", "N/A", "apex oak jute fx", "ALPINE") == ["DEWDROP", "DEWDROP", None, "JUTE", "ALPINE"]


def test_headers(spark):
    rows = spark.createDataFrame([(1, "Item #"), (2, "SKU"), (3, "Product Type"), (4, "Desc."), (5, "Weight"), (6, "Cabinet Code")], "id int, header string")
    assert [r.field for r in header_column(rows).orderBy("id").collect()] == ["code", "code", "category", "description", None, "code"]


def test_items(spark):
    cases = [
        ("B36-1TD", None, "B36 1TD", None, None, "NORMALIZED_EXACT"), ("B361TD", None, "B36 1TD", None, None, "NORMALIZED_EXACT"), ("CAB-24-L", None, "CAB-24-R", None, None, "ORIENTATION_MISMATCH"),
        ("BASE123", None, "WALL123", None, None, "NO_MATCH"), ("SB33", None, "SB33 BUTT", None, None, "NORMALIZED_EXACT"), ("BFHC12", "HUTCH COLUMN BASE 12", "BPFHC12", "HUTCH COLUMN BASE 12", None, "MANUFACTURER_VARIANT"),
        (None, "wall end panel", None, "WALL  END PANEL", None, "NORMALIZED_EXACT"), (None, None, None, None, None, "BOTH_EMPTY"), ("W30", None, None, None, None, "ONE_EMPTY"), ("W3030", None, "X77", None, "W3030", "EXPLICIT_SUBSTITUTION"),
        ("W36", "WALL DOOR BASE", "V24", "WALL DOOR BASE", None, "DIMENSION_CONFLICT"), ("BPS12", "PANEL BASE 12", "BP52", "PANEL BASE 12", None, "MANUFACTURER_VARIANT"), ("b36  butt", None, "B36 BUTT", None, None, "EXACT"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s1 string, t1 string, s2 string, t2 string, sub string, wanted string")
    side = lambda n: (F.col(f"s{n}").alias("raw_sku"), F.col(f"t{n}").alias("description"), F.lit("CABINET").alias("category"), dimensions.parse(F.lit(None).cast("string")).alias("dimensions"))
    a = with_features(rows.select("i", "wanted", *side(1))).select("i", "wanted", F.col("f").alias("a"))
    b = with_features(rows.select("i", "sub", *side(2)), substitution="sub").select("i", F.col("f").alias("b"))
    found = a.join(b, "i").select("i", "wanted", item_match(F.col("a"), F.col("b")).alias("found")).orderBy("i").collect()
    assert [(r.i, r.found) for r in found] == [(r.i, r.wanted) for r in found]


def test_texts_are_read_once_however_often_they_are_asked(spark):
    """Sizes, classes and keys compute a text once, not for each branch; and sizes with decimals and without agree."""
    from triplicate.functions.equivalence import block_keys, with_features

    df = spark.createDataFrame([(1, "12.5W x 30H", "base", "CABINET")], "id int, a string, description string, category string")
    written = lambda c: df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
    assert written(dimensions.parse(F.col("a"))).count("translate(a#") == 1
    assert written(classify(F.col("a"), F.col("description"))).count("cast(description#") == 2
    keyed = with_features(df.select("id", F.col("a").alias("raw_sku"), "description", "category", dimensions.parse(F.col("a")).alias("dimensions"))).select(block_keys(F.col("f")).alias("k"))
    assert keyed.select("k.own")._jdf.queryExecution().analyzed().toString().count("array_sort") <= 2
    texts = ["12W x 30H x 24D", "12.0W x 30.0H x 24.0D", "1.2.3W", "30 h", 'opening 12"', "5 x 6 x 7", "w12", " none "]
    found = [r[0] and tuple(r[0])[:3] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(dimensions.parse(F.col("t"))).collect()]
    assert found == [(12, 30, 24), (12, 30, 24), (2.3, None, None), (None, 30, None), (12, None, None), (5, 6, 7), (12, None, None), None]
