"""Groups that come with their units, in one pass, and what makes that pass short."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from test_matching import items
from triplicate.functions.dimensions import parse, with_sizes
from triplicate.functions.text import once, specified, trimmed
from triplicate.operators.batches import whole_groups
from triplicate.operators.crosscheck import with_members
from triplicate.operators.matching import match_members, match_units
from triplicate.operators.units import aggregate_units
from triplicate.sources.line_items import line_items

SF = "/root/testdata/sf0.001"


def _units(spark, n=40):
    rng = random.Random(5)
    codes = ["B36", "B36 L", "W30", "W30-BUTT", "T84", "Q9-11", None]
    rows = [
        (side, f"{side[0]}{p}-{i}", rng.choice(codes), {"project_id": p, "finish": rng.choice(["WHITE", "OAKEN", "PLUMISH", None]), "size_text": rng.choice(["30W", "33W x 2.5D", None]), "substitution_sku": rng.choice([None, "B36"]) if side == "ACK" else None}
         | ({"source_type": "CABINET_LIST", "manuf_code": rng.choice([None, "W30"])} if side == "ORDER" and p % 3 == 0 else {}))
        for p in range(n) for side in ("DESIGN", "ORDER", "ACK") for i in range(rng.randint(1, 4))
    ]
    return aggregate_units(items(spark, *rows)).cache()


def test_members_come_with_groups_as_joins_give_them(spark):
    units = _units(spark)
    joined = with_members(match_units(units), units)
    both = [sorted(str(r.asDict(True)) for r in df.select(sorted(joined.columns)).collect()) for df in (joined, match_members(units))]
    assert both[0] == both[1] and len(both[0]) > 100


def test_groups_are_those_decided_one_after_another(spark, monkeypatch):
    """What hangs together simply is decided at once; the same as if all were decided in order."""
    import numpy as np

    from triplicate.operators import matching

    units = _units(spark)
    once_ = sorted(map(str, match_units(units).collect()))

    def all_in_order(rows):
        bincount = np.bincount
        try:
            matching.np.bincount = lambda x, minlength=0: np.maximum(bincount(x, minlength=minlength), 2)  # as if each component had several of a side
            return groups_of(rows)
        finally:
            matching.np.bincount = bincount

    groups_of = matching._groups_of
    edges = matching.equivalence_edges(units.withColumn("listed", F.lit(False)))
    rows = _rows_for(units, edges)
    plain, slow = (groups_of(rows), all_in_order(rows))
    told = lambda x: sorted(zip(*x[1].tolist(), x[2].tolist(), x[3].tolist(), strict=True))
    assert told(plain) == told(slow) and len(once_) > 100


def _rows_for(units, edges):
    """The rows of one task, without cabinet lists."""
    side = F.element_at(F.create_map(*(F.lit(x) for p in (("DESIGN", 0), ("ORDER", 1), ("ACK", 2)) for x in p)), F.col("side"))
    flags = side + F.when(F.col("dimensions").isNotNull(), 4).otherwise(0) + F.when(F.coalesce("substitution_sku", F.lit("")) != "", 16).otherwise(0) + F.when(specified(F.col("raw_sku")), 256).otherwise(0)
    axes = F.array(*(F.col(f"dimensions.{c}") for c in ("width", "height", "depth"))).alias("axes")
    facts = units.select("project_id", F.lit("").alias("component"), "ord", "unit_id", flags.cast("int").alias("flags"), axes, F.array("dimensions.opening", F.coalesce(F.lower("finish"), F.lit(""))).alias("texts"))
    rows = facts.unionByName(edges.select("project_id", F.lit("").alias("component"), "a", "b", "same_code"), allowMissingColumns=True)
    return pa.Table.from_batches(rows.orderBy("project_id", F.col("a").asc_nulls_first(), "ord", "unit_id").toArrow().combine_chunks().to_batches()).combine_chunks().to_batches()[0]


def test_whole_groups_keep_what_belongs_together():
    rng = random.Random(2)
    keys = sorted(rng.choices(range(40), k=300))
    table = pa.table({"k": keys, "n": list(range(300))})
    for size in (1, 7, 64, 300):
        out = list(whole_groups(iter(table.to_batches(max_chunksize=size)), ("k",)))
        assert [n for b in out for n in b.column("n").to_pylist()] == list(range(300))
        assert len({k for b in out for k in set(b.column("k").to_pylist())}) == sum(len(set(b.column("k").to_pylist())) for b in out) == len(set(keys))


def test_keys_meet_in_one_task_as_in_a_join(spark):
    from triplicate.operators.edges import candidate_pairs, pairs_within

    rng = random.Random(4)
    rows = []
    for p in range(30):
        for i in range(rng.randint(1, 12)):
            keys = rng.sample(range(25), rng.randint(1, 6))
            rows.append((p, f"u{i}", rng.choice(["DESIGN", "ORDER", "ACK", "MAKER"]), p % 3 == 0, keys, keys[: rng.randint(1, len(keys))], rng.randint(0, 9)))
    df = spark.createDataFrame(rows, "project_id long, unit_id string, role string, listed boolean, keys array<long>, own array<long>, saying long")
    first = lambda c: F.translate(F.substring(c, 1, 1), "M", "O")
    joined = candidate_pairs(df, itself=False).select("project_id", F.concat(first("role_a"), first("role_b")).alias("pair"), "a", "b", "saying_a", "saying_b")
    assert sorted(map(str, pairs_within(df).collect())) == sorted(map(str, joined.collect())) and joined.count() > 100


def test_large_projects_meet_by_a_join(spark, monkeypatch):
    from triplicate.operators import edges

    units = _units(spark, 12)
    within = sorted(map(str, match_units(units).collect()))
    monkeypatch.setattr(edges, "LARGE", 5)
    assert sorted(map(str, match_units(units).collect())) == within


def test_sizes_by_columns_are_those_by_one_expression(spark):
    texts = (None, "", "n/a", "30W x 34H x 24D", "30 x 34", '15" W', "12.5W x 3", "opening 30 x 20", "tall", "24 D", "7", "\\ 30w", "1.5", " 3H ", "99" * 20 + "W")
    rows = with_sizes(spark.createDataFrame([(t,) for t in texts], "size_text string")).withColumn("whole", parse(F.col("size_text")))
    got = rows.collect()
    assert [r["dimensions"] for r in got] == [r["whole"] for r in got] and sum(r["whole"] is not None for r in got) == 11


def test_trimming_is_as_by_all_blanks(spark):
    from triplicate.functions.text import _BLANKS

    texts = [None, "", "a", " a", "a ", "\ta b\n", " x", "x ", "é", " é", "a　", "\x7fa", "none", " none", "N/A", "nones", "-", " - "]
    c = F.col("t")
    upper = F.upper(F.btrim(c, F.lit(_BLANKS)))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(trimmed(c), F.btrim(c, F.lit(_BLANKS)), specified(c), c.isNotNull() & ~upper.isin("", "NONE", "NULL", "N/A", "-")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)


def test_what_is_made_once_is_not_made_for_a_filter(spark):
    df = once(spark.range(3).withColumn("t", F.col("id").cast("string")), "x", F.struct(F.regexp_replace("t", "1", "2").alias("y")))
    plan = df.select("x.y")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and [r.x.y for r in df.collect()] == ["0", "2", "2"]


def test_units_of_a_projects_lines_are_not_shuffled_again(spark):
    """Lines are dealt out by project once, for their numbers and for all that follows."""
    from triplicate.operators import matching

    units = aggregate_units(line_items(spark, SF)).withColumn("__words", matching._scope_words())
    plan = matching._marked(units, F.lit(False))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1


def test_neighbouring_lines_meet_where_they_are(spark):
    """Both sides of the comparison are dealt out by their project's lines, so that no features are shuffled, nor units."""
    from triplicate.plans import reconciliation

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query, n in ((reconciliation.code_pairs, 0), (reconciliation.units_aggregate, 0)):
            plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall(r"Exchange hashpartitioning\(project_id", plan)) == n and "Exchange hashpartitioning(l_orderkey" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
