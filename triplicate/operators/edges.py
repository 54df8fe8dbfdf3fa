"""Which units of a project are the same item: pairs found by shared keys, then judged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplicate.functions.equivalence import ITEM_EQUAL, block_keys, codes_equal, item_match, with_features
from triplicate.operators.batches import whole_groups
from triplicate.sources.scratch import cut

#: Pairs of sides that are compared; a side with itself tells of competition.
PAIRS = (("DESIGN", "ORDER"), ("DESIGN", "ACK"), ("ORDER", "ACK"), ("DESIGN", "DESIGN"), ("ORDER", "ORDER"))
#: Units of a project from which on they meet by a join rather than in one task's memory.
LARGE = 1_000


def equivalence_edges(units: DataFrame, itself: bool = True) -> DataFrame:
    """(project_id, pair, a, b, match, same_code): the equivalent pairs of units, ``pair`` by the first letters of sides.

    Every way to match implies a shared key that is one's own (see :func:`block_keys`), so own keys meet all keys of a
    project. ``listed`` says that the project's order is a cabinet list; its orders then meet acknowledgements by the
    maker's code alone, and designs that meet acknowledgements only tell of competition. Units of one side meet in both
    directions, and with ``itself`` a unit meets itself unless it has neither code nor description.

    What units say of themselves repeats from project to project, and matching depends on that alone. So features and
    keys are computed once for each distinct saying, and each distinct pair of sayings is judged once. Keys that no saying
    has as its own can't meet any and are left out before units take them. Units of a project then come to one task once,
    where their keys meet (see :func:`pairs_within`); those of projects of ``LARGE`` units and more meet by a join. ``n_units``
    tells how many a project has and is counted where it is absent.
    """
    if "n_units" not in units.columns:
        units = units.withColumn("n_units", F.count("*").over(Window.partitionBy("project_id")))
    sayings = lambda sku: F.struct(F.col(sku).alias("raw_sku"), "description", "category", "dimensions", "substitution_sku").alias("said")
    plain = units.select("project_id", "unit_id", F.col("side").alias("role"), "listed", "n_units", sayings("raw_sku"))
    makers = units.where((F.col("side") == "ORDER") & F.col("listed") & F.col("manuf_code").isNotNull())
    every = plain.unionByName(makers.select("project_id", "unit_id", F.lit("MAKER").alias("role"), "listed", "n_units", sayings("manuf_code")))
    # Dealt out by number: sayings are few bytes, by which Spark would give them to one task, but take long each.
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = with_features(every.select("said").distinct().repartition(n).select("said", "said.*"), substitution="substitution_sku").select("said", "f", block_keys(F.col("f")).alias("k"))
    known = cut(known.select(F.monotonically_increasing_id().alias("saying"), "said", "f", "k.keys", "k.own"))
    rows = every.join(_met(known), "said").drop("said")
    columns = ("project_id", "pair", "a", "b", "saying_a", "saying_b")
    pairs = pairs_within(rows.where(F.col("n_units") < LARGE))
    large = units.where(F.col("n_units") >= LARGE)
    if not large.isEmpty():
        far = candidate_pairs(cut(rows.where(F.col("n_units") >= LARGE)), itself=False)
        pair = F.concat(F.translate(F.substring("role_a", 1, 1), "M", "O"), F.substring("role_b", 1, 1)).alias("pair")
        pairs = pairs.unionByName(far.withColumn("pair", pair).select(*columns))
    if itself:
        alone = rows.where("role in ('DESIGN', 'ORDER')").withColumn("pair", F.repeat(F.substring("role", 1, 1), F.lit(2)))
        pairs = pairs.unionByName(alone.select("project_id", "pair", F.col("unit_id").alias("a"), F.col("unit_id").alias("b"), F.col("saying").alias("saying_a"), F.col("saying").alias("saying_b")))
    pairs = cut(pairs)
    features = lambda n: known.select(F.col("saying").alias(f"saying_{n}"), F.col("f").alias(f"f{n}"))
    judged = pairs.select("saying_a", "saying_b").distinct().repartition(n).join(features("a"), "saying_a").join(features("b"), "saying_b").select(
        "saying_a", "saying_b", item_match(F.col("fa"), F.col("fb")).alias("match"), codes_equal(F.col("fa"), F.col("fb")).alias("same_code")
    )
    equal = cut(judged.where(F.col("match").isin(*ITEM_EQUAL)))
    return pairs.join(equal, ["saying_a", "saying_b"]).select("project_id", "pair", "a", "b", "match", "same_code")


_ROLES = ("DESIGN", "ORDER", "ACK", "MAKER")
_PAIRS = pa.schema([("project_id", pa.int64()), ("pair", pa.string()), ("a", pa.string()), ("b", pa.string()), ("saying_a", pa.int64()), ("saying_b", pa.int64())])


def pairs_within(rows: DataFrame) -> DataFrame:
    """project_id, pair, a, b, saying_a, saying_b: what :func:`candidate_pairs` finds but a unit with itself, each pair once.

    Rows come by project in one shuffle and are sorted by their keys there, some projects at a time.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own_first = F.concat("own", F.array_except("keys", "own")).alias("keys")
    role = (F.array_position(F.array(*map(F.lit, _ROLES)), F.col("role")) - 1).alias("role")
    thin = rows.where(F.col("role").isin(*_ROLES)).select("project_id", "unit_id", role, "listed", "saying", own_first, F.size("own").alias("n_own"))
    return thin.repartition(n, "project_id").sortWithinPartitions("project_id").mapInArrow(_near, "project_id long, pair string, a string, b string, saying_a long, saying_b long")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, ("project_id",)):
        yield _near_in(rows)


def _near_in(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Pairs within projects whose units are all here."""
    project, role, saying, n_own = (rows.column(c).to_numpy() for c in ("project_id", "role", "saying", "n_own"))
    listed = rows.column("listed").to_numpy(zero_copy_only=False)
    lists = rows.column("keys")
    n, counts, keys = len(project), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    unit = np.repeat(np.arange(n), counts)
    own = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts) < n_own[unit]
    order = np.lexsort((keys, project[unit]))
    unit, own, keys = unit[order], own[order], keys[order]
    # Runs of one key in one project.
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (project[unit[1:]] != project[unit[:-1]])][: len(keys)])
    lengths = np.diff(np.r_[starts, len(keys)])
    run = np.repeat(np.arange(len(starts)), lengths)
    # Each that has the key as its own meets all of the run.
    at = np.flatnonzero(own & (lengths[run] > 1))
    met = lengths[run[at]]
    one = np.repeat(unit[at], met)
    other = unit[np.repeat(starts[run[at]] - (np.cumsum(met) - met), met) + np.arange(met.sum())]
    apart = one != other
    one, other = one[apart], other[apart]
    wanted = np.zeros((4, 4), dtype=bool)
    for x, y in (*PAIRS, ("MAKER", "ACK")):
        wanted[_ROLES.index(x), _ROLES.index(y)] = True
    by_list = lambda x, y: (role[x] == 1) & (role[y] == 2) & listed[x]
    forth = wanted[role[one], role[other]] & ~by_list(one, other)
    back = wanted[role[other], role[one]] & ~by_list(other, one)
    a, b = np.divmod(np.unique(np.r_[one[forth] * n + other[forth], other[back] * n + one[back]]), n)
    letters = np.array(["D", "O", "A", "O"], dtype=object)
    ids = rows.column("unit_id")
    columns = [pa.array(project[a]), pa.array(letters[role[a]] + letters[role[b]], pa.string()), ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(saying[a]), pa.array(saying[b])]
    return pa.RecordBatch.from_arrays(columns, schema=_PAIRS)


def _met(known: DataFrame) -> DataFrame:
    """saying, said, own and keys, of these those that are some saying's own."""
    owned = known.select(F.explode("own").alias("key")).distinct()
    met = known.select("saying", F.explode("keys").alias("key")).join(owned, "key").groupBy("saying").agg(F.collect_list("key").alias("keys"))
    return known.select("saying", "said", "own").join(met, "saying")  # each has own keys, so none is lost


def candidate_pairs(rows: DataFrame, itself: bool = True) -> DataFrame:
    """project_id, role_a, role_b, a, b: pairs of the roles to compare that share a key which is own to one of them.

    Rows have project_id, unit_id, role, listed, keys and own, and possibly saying, which then comes as saying_a and
    saying_b. Each pair comes once, with the least of such keys; a unit with itself only if ``itself``.
    """
    more = ("saying",) if "saying" in rows.columns else ()
    thin = rows.select("project_id", "unit_id", "role", "listed", "keys", "own", *more)
    # Besides its key each row has the own keys below it: a pair that shares one of these meets there as well.
    keyed = lambda c: thin.withColumn("key", F.explode(c)).withColumns({"less": F.filter("own", lambda k: k < F.col("key")), "is_own": F.array_contains("own", F.col("key"))}).drop("own")
    own, every = keyed("own").alias("a"), keyed("keys").alias("b")
    pairs = [(x, y, F.lit(True)) for x, y in PAIRS if (x, y) != ("ORDER", "ACK")]
    pairs += [("ORDER", "ACK", ~F.col("a.listed")), ("MAKER", "ACK", F.lit(True))]

    def wanted(one: str, other: str) -> Column:
        when = F.lit(False)
        for x, y, holds in pairs:
            when = when | ((F.col(f"{one}.role") == x) & (F.col(f"{other}.role") == y) & holds)
        return when

    # One has the key as its own. It is the pair's first unit, or its second where the first has not.
    forth, back = wanted("a", "b"), wanted("b", "a") & ~F.col("b.is_own")
    meet = (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.key") == F.col("b.key")) & (wanted("a", "b") | wanted("b", "a"))
    if not itself:
        meet = meet & ((F.col("a.unit_id") != F.col("b.unit_id")) | (F.col("a.role") != F.col("b.role")))
    joined = own.join(every, meet)
    # A pair is judged at the first shared key that is one's own: the others would only repeat it.
    before = lambda x, y: (F.size(f"{x}.less") > 0) & F.arrays_overlap(f"{x}.less", f"{y}.keys")
    first = ~before("a", "b") & ~before("b", "a")

    def made(one: str, other: str) -> Column:
        columns = [F.col(f"{x}.{c}").alias(f"{c}_{n}") for c in ("role", "unit_id", *more) for x, n in ((one, "a"), (other, "b"))]
        return F.struct(*columns)

    both = F.array_compact(F.array(F.when(forth, made("a", "b")), F.when(back, made("b", "a"))))
    found = joined.where((forth | back) & first).select(F.col("a.project_id").alias("project_id"), F.explode(both).alias("x"))
    return found.select("project_id", "x.role_a", "x.role_b", F.col("x.unit_id_a").alias("a"), F.col("x.unit_id_b").alias("b"), *(f"x.{c}_{n}" for c in more for n in "ab"))
