from pyspark.sql import functions as F

from triplicate.functions.dimensions import parse
from triplicate.operators.crosscheck import discrepancies, finalize, with_members
from triplicate.operators.matching import match_units
from triplicate.operators.units import aggregate_units
from triplicate.sources.line_items import COLUMNS

_TYPES = {"project_id": "long", "organization_id": "long", "ord": "int", "quantity": "int"}


def items(spark, *rows):
    """Rows as (side, id, sku, further columns by name)."""
    full = []
    for n, (side, id_, sku, more) in enumerate(rows):
        given = {"project_id": 1, "organization_id": 1, "side": side, "source_type": "ACKNOWLEDGEMENT" if side == "ACK" else side, "item_id": id_, "ord": n, "raw_sku": sku, "category": "CABINET", "quantity": 1} | more
        full.append(tuple(given.get(c) for c in COLUMNS))
    schema = ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in COLUMNS)
    return spark.createDataFrame(full, schema).withColumn("dimensions", parse(F.col("size_text")))


def decided(spark, *rows):
    units = aggregate_units(items(spark, *rows)).cache()
    groups = match_units(units)
    members = with_members(groups, units).cache()
    found = discrepancies(members)
    final = {(r.design_id, r.order_id, r.ack_id): r.status for r in finalize(members, found).collect()}
    return final, [(r.field, r.introduced_at, r.severity) for r in found.orderBy("design_id", "position").collect()]


def test_three_way_and_split_lines(spark):
    final, found = decided(
        spark,
        ("DESIGN", "d1", "BT36B-2", {"quantity": 2}), ("ORDER", "o1", "BT36B-2", {"quantity": 1}), ("ORDER", "o2", "BT36B-2", {"quantity": 2}), ("ACK", "a1", "BT36B 2", {"quantity": 3}),
    )
    assert final == {("d1", "o1", "a1"): "CHANGED"}
    assert found == [("quantity", "ORDER", "Warning")]


def test_missing_extra_and_restored(spark):
    final, found = decided(
        spark, ("DESIGN", "d1", "A123", {}), ("DESIGN", "d2", "QR96X9", {}), ("ACK", "a2", "QR96X9", {}), ("ORDER", "o3", "ZZ77", {}), ("ACK", "a4", "YY88", {}),
    )
    assert final == {("d1", None, None): "MISSING", ("d2", None, "a2"): "CHANGED", (None, "o3", None): "EXTRA", (None, None, "a4"): "EXTRA"}
    assert sorted(found) == sorted([("item_presence", "ORDER", "Critical"), ("item_presence", "ACKNOWLEDGEMENT", "Critical"), ("item_presence", "DESIGN", "Critical"), ("item_presence", "DESIGN", "Warning")])


def test_ambiguous_duplicates_abstain(spark):
    final, _ = decided(spark, ("DESIGN", "d1", "3DB21", {"finish": "WHITE"}), ("DESIGN", "d2", "3DB21", {"finish": "OAK"}), ("ORDER", "o1", "3DB21", {}))
    assert "UNCERTAIN" in final.values()
    members = [i for key in final for i in key if i]
    assert sorted(members) == ["d1", "d2", "o1"]


def test_sizes_tell_duplicates_apart(spark):
    final, _ = decided(
        spark,
        ("DESIGN", "d1", "BF330", {"size_text": "30W", "finish": "WHITE"}), ("DESIGN", "d2", "BF330", {"size_text": "33W", "finish": "GREY"}),
        ("ORDER", "o1", "BF330", {"size_text": "33W", "finish": "GREY"}), ("ORDER", "o2", "BF330", {"size_text": "30W", "finish": "WHITE"}),
    )
    assert set(final) == {("d1", "o2", None), ("d2", "o1", None)}


def test_cabinet_list_by_two_codes(spark):
    listed = {"source_type": "CABINET_LIST"}
    final, _ = decided(spark, ("DESIGN", "d1", "B36", {}), ("ORDER", "o1", "B36", listed | {"manuf_code": "MANUF-B36X"}), ("ACK", "a1", "MANUF-B36X", {}))
    assert set(final) == {("d1", "o1", "a1")}
    final, found = decided(spark, ("DESIGN", "d1", "B36", {}), ("ORDER", "o1", "B36", listed))
    assert final == {("d1", "o1", None): "UNCERTAIN"}
    assert found == [("manufacturer_code", "CABINET_LIST", "Warning")]


def test_every_unit_is_in_one_group(spark):
    import random

    rng = random.Random(3)
    rows = [(side, f"{side[0]}{i}", rng.choice(["B36", "B36 L", "W30", "W30-BUTT", None]), {"finish": rng.choice(["WHITE", "OAKEN", None]), "size_text": rng.choice(["30W", "33W", None])}) for side in ("DESIGN", "ORDER", "ACK") for i in range(12)]
    units = aggregate_units(items(spark, *rows)).cache()
    placed = [i for g in match_units(units).collect() for i in (g.design_id, g.order_id, g.ack_id) if i]
    assert sorted(placed) == sorted(r.unit_id for r in units.collect())


def test_shared_keys_lose_no_pair(spark):
    import random

    from triplicate.functions.equivalence import ITEM_EQUAL, item_match, with_features
    from triplicate.operators.edges import PAIRS, equivalence_edges

    rng = random.Random(1)
    codes = ["B36", "B36 L", "B36-R", "b36butt", "B36 BUTT", "B", "W30", "W30-BUTT", "BW 30", None, "--", "BFHC12", "BPFHC12", "3 6"]
    said = [None, "hutch column base 12", "wall door", "wall door base", "base 36 left"]
    rows = [
        (side, f"{side[0]}{i}", rng.choice(codes), {"description": rng.choice(said), "size_text": rng.choice(["30W", "33W", None]), "finish": str(i), "substitution_sku": rng.choice([None, "B36", "W30 BUTT"]) if side == "ACK" else None})
        for side in ("DESIGN", "ORDER", "ACK") for i in range(25)
    ]
    units = aggregate_units(items(spark, *rows)).cache()
    found = [(r.pair, r.a, r.b, r.match) for r in equivalence_edges(units.withColumn("listed", F.lit(False))).collect()]
    base = with_features(units.select("project_id", "side", "unit_id", "raw_sku", "description", "category", "dimensions", "substitution_sku"), substitution="substitution_sku").cache()
    all_pairs = set()
    for x, y in PAIRS:
        a = base.where(F.col("side") == x).select(F.col("unit_id").alias("a"), F.col("f").alias("fa"))
        b = base.where(F.col("side") == y).select(F.col("unit_id").alias("b"), F.col("f").alias("fb"))
        pairs = a.crossJoin(b).select("a", "b", item_match(F.col("fa"), F.col("fb")).alias("m")).where(F.col("m").isin(*ITEM_EQUAL))
        all_pairs |= {(x[0] + y[0], r.a, r.b, r.m) for r in pairs.collect()}
    assert len(found) == len(set(found)) and set(found) == all_pairs


def test_composite_keys_lose_no_variant(spark):
    """Descriptions, numbers and sizes at random: the same edges as all pairs, variants by number and by size among them."""
    import random

    from triplicate.functions.equivalence import ITEM_EQUAL, item_match, with_features
    from triplicate.operators.edges import PAIRS, equivalence_edges

    rng = random.Random(7)
    words = ["hutch", "column", "base", "wall", "door", "maple", "plain", "left", "36", "012", "fluted"]
    code = lambda: rng.choice(["BFHC", "BPFHC", "HBCF", "BH", "S"]) + rng.choice(["", "", "5", "S", "12", "36", "12S6"])
    sizes = [None, "30W", "30.04W", "30W x 34H", "34H", "33W x 30H", "opening 12", '15" opening']
    rows = [
        (side, f"{side[0]}{i}", rng.choice([code(), code(), None]), {"description": " ".join(rng.sample(words, rng.randint(0, 4))), "size_text": rng.choice(sizes), "finish": str(i)})
        for side in ("DESIGN", "ORDER", "ACK") for i in range(60)
    ]
    units = aggregate_units(items(spark, *rows)).cache()
    found = [(r.pair, r.a, r.b, r.match) for r in equivalence_edges(units.withColumn("listed", F.lit(False))).collect()]
    base = with_features(units.select("project_id", "side", "unit_id", "raw_sku", "description", "category", "dimensions", "substitution_sku"), substitution="substitution_sku").cache()
    all_pairs = set()
    for x, y in PAIRS:
        a = base.where(F.col("side") == x).select(F.col("unit_id").alias("a"), F.col("f").alias("fa"))
        b = base.where(F.col("side") == y).select(F.col("unit_id").alias("b"), F.col("f").alias("fb"))
        pairs = a.crossJoin(b).select("a", "b", item_match(F.col("fa"), F.col("fb")).alias("m")).where(F.col("m").isin(*ITEM_EQUAL))
        all_pairs |= {(x[0] + y[0], r.a, r.b, r.m) for r in pairs.collect()}
    assert len(found) == len(set(found)) and set(found) == all_pairs
    numbers = lambda p: {d for d in __import__("re").findall("[0-9]+", p)}
    text = {u: f"{more.get('description')} {sku}".replace("S", "5") for _, u, sku, more in rows}
    variants = [(a, b) for _, a, b, m in found if m == "MANUFACTURER_VARIANT"]
    assert len(variants) > 50 and any(not numbers(text[a]) & numbers(text[b]) for a, b in variants)


def test_candidates_grow_with_the_units_of_a_project(spark):
    """Units that share words but no number: so many candidates as units, not as pairs."""
    from triplicate.functions.equivalence import block_keys, with_features
    from triplicate.operators.edges import candidate_pairs

    def candidates(n: int) -> int:
        rows = spark.range(n).select(
            F.lit(1).alias("project_id"), F.concat(F.lit("u"), "id").alias("unit_id"), F.element_at(F.lit(["DESIGN", "ORDER", "ACK"]), (F.col("id") % 3 + 1).cast("int")).alias("role"), F.lit(False).alias("listed"),
            F.concat(F.lit("B"), (F.floor(F.col("id") / 3) + 1000).cast("string"), F.lit("X")).alias("raw_sku"), F.lit("MAPLE WALL DOOR BASE").alias("description"), F.lit("CABINET").alias("category"),
            parse(F.concat((F.col("id") % 9 + 12).cast("string"), F.lit("W"))).alias("dimensions"),
        )
        k = with_features(rows).select("project_id", "unit_id", "role", "listed", block_keys(F.col("f")).alias("k"))
        return candidate_pairs(k.select("*", "k.keys", "k.own").drop("k")).count()

    assert candidates(600) == 1000 and candidates(10_002) == 16_670  # three pairs of sides and two of one's own for each three units


def test_a_shared_makers_code(spark):
    listed = {"source_type": "CABINET_LIST", "manuf_code": "M777"}
    final, _ = decided(spark, ("DESIGN", "d1", "B36", {}), ("DESIGN", "d2", "W30", {}), ("ORDER", "o1", "B36", listed), ("ORDER", "o2", "W30", listed), ("ACK", "a1", "M777", {}))
    assert set(final) == {("d1", "o1", "a1"), ("d2", "o2", None)}


def test_a_cabinet_list_binds_the_whole_project(spark):
    listed = {"source_type": "CABINET_LIST"}
    final, _ = decided(spark, ("DESIGN", "d2", "W30", {}), ("ORDER", "o1", "B36", listed | {"manuf_code": "M36"}), ("ACK", "a2", "W30", {}))
    assert final == {("d2", None, None): "MISSING", (None, "o1", None): "EXTRA", (None, None, "a2"): "EXTRA"}


def test_components_of_large_projects_decide_alike(spark, monkeypatch):
    import random

    from triplicate.operators import matching

    rng = random.Random(8)
    codes = ["B36", "B36 L", "W30", "W30-BUTT", "T84", "T84-X", "Q9-11", None]
    rows = [(side, f"{side[0]}{i}", rng.choice(codes), {"finish": rng.choice(["WHITE", "OAKEN", "WALNUT", None]), "size_text": rng.choice(["30W", "33W", None])}) for side in ("DESIGN", "ORDER", "ACK") for i in range(30)]
    units = aggregate_units(items(spark, *rows)).cache()
    whole = sorted(map(str, match_units(units).collect()))
    monkeypatch.setattr(matching, "LARGE", 2)
    assert sorted(map(str, match_units(units).collect())) == whole


def test_each_saying_is_judged_once(spark, monkeypatch):
    """Features are made for each distinct saying, however many projects repeat it."""
    from triplicate.operators import edges

    seen = []
    features = edges.with_features
    monkeypatch.setattr(edges, "with_features", lambda items, *more, **named: (seen.append(items.count()), features(items, *more, **named))[1])
    rows = [(side, f"{side[0]}{p}", "B36", {"project_id": p}) for p in range(5) for side in ("DESIGN", "ORDER", "ACK")]
    units = aggregate_units(items(spark, *rows)).withColumn("listed", F.lit(False))
    found = edges.equivalence_edges(units).groupBy("project_id").count().collect()
    assert sum(seen) == 1 and sorted(r["count"] for r in found) == [5] * 5


def test_features_of_parts_are_not_broadcast(spark):
    from triplicate.plans import reconciliation

    plan = reconciliation.item_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_keys_that_nobody_owns_are_left_out(spark):
    from triplicate.functions.equivalence import block_keys, with_features
    from triplicate.operators import edges

    rows = [(side, f"{side[0]}{n}", pattern % n, {}) for n in range(9) for side, pattern in (("DESIGN", "B3%d-12-N1"), ("ORDER", "b3%d 12 n1"), ("ACK", "B3%d12N1"))]
    units = aggregate_units(items(spark, *rows))
    said = F.struct("raw_sku", "description", "category", "dimensions", "substitution_sku").alias("said")
    known = with_features(units.select("unit_id", F.col("side").alias("role"), said).select("unit_id", "role", "said", "said.*"), substitution="substitution_sku").select("unit_id", "role", "said", block_keys(F.col("f")).alias("k"))
    known = known.select("unit_id", "role", "said", F.monotonically_increasing_id().alias("saying"), "k.keys", "k.own").cache()
    met = edges._met(known).cache()
    owned = {k for r in met.collect() for k in r.own}
    keys = lambda df: sum(len(r["keys"]) for r in df.collect())
    assert met.count() == len(rows) and all(set(r["keys"]) <= owned for r in met.collect()) and keys(met) < keys(known) / 2
    whole = known.select(F.lit(1).alias("project_id"), "unit_id", "role", F.lit(False).alias("listed"), "keys", "own")
    fewer = whole.drop("keys").join(met.join(known.select("unit_id", "saying"), "saying").select("unit_id", "keys"), "unit_id")
    pairs = lambda df: sorted(map(str, edges.candidate_pairs(df).collect()))
    assert pairs(fewer) == pairs(whole) and pairs(whole)


def test_tables_on_the_way_to_a_stored_one_are_deleted(spark, tmp_path):
    import glob

    from triplicate.sources import scratch

    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    tables = lambda: set(glob.glob(scratch.shared_folder(spark).removeprefix("file:") + "/cut-*"))
    before = tables()
    inner = lambda: scratch.stored("inner", spark, [f"{tmp_path}/t.parquet"], lambda: scratch.cut(spark.range(4)), alone=True)
    outer = scratch.stored("outer", spark, [f"{tmp_path}/t.parquet"], lambda: scratch.cut(scratch.cut(spark.range(5)).unionAll(inner())), alone=True)
    assert outer.count() == 9 and inner().count() == 4 and len(tables() - before) == 2
    shared = scratch.cut(spark.range(2))
    scratch.stored("other", spark, [f"{tmp_path}/t.parquet"], lambda: scratch.cut(shared))
    assert len(tables() - before) == 5  # without alone others may read what was cut


def test_members_carry_no_features_of_codes(spark):
    units = aggregate_units(items(spark, ("DESIGN", "d1", "B36", {}), ("ACK", "a1", "B36", {})))
    assert "f" not in with_members(match_units(units), units).schema["d"].dataType.names
