"""Groups of units, at most one from each document, that are the same item, each with its status.

Equivalent units are found by joins (see :mod:`triplicate.operators.edges`). Units and their links then meet by project
and are decided in the order of their lines.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from triplicate.functions.dimensions import TOLERANCE
from triplicate.functions.text import significant_tokens, specified
from triplicate.operators.batches import packed, unpacked, whole_groups
from triplicate.operators.crosscheck import member
from triplicate.operators.edges import equivalence_edges
from triplicate.sources.scratch import cut

GROUP = "project_id long, design_id string, order_id string, ack_id string, status string, decided string"


def _scope_words() -> Column:
    return F.array_union(significant_tokens(F.col("finish")), significant_tokens(F.col("door_style")))


def split_scope(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units in scope, and design units out of it: those whose finish and door share no word with any order or acknowledgement.

    A project without such words on those sides, and a unit without any, excludes nothing. One window by
    project; a project's distinct words are few however many units it has.
    """
    rows = _marked(units.withColumn("__words", _scope_words()), F.lit(False)).drop("__words", "listed", "n_units")
    return rows.where("not __out").drop("__out"), rows.where("__out").drop("__out")


def _marked(rows: DataFrame, lists: Column) -> DataFrame:
    """Rows with ``__words`` get ``__out``, whether they are out of scope, ``listed``, whether ``lists`` holds for one of their project, and its number of units in scope and out of it.

    A window, since units that come from one project's lines are there together already and then need no shuffle.
    """
    of_project = Window.partitionBy("project_id")
    told = (F.col("side") != "DESIGN") & (F.size("__words") > 0)
    rows = rows.withColumns(
        {"__said": F.collect_set(F.when(told, F.col("__words"))).over(of_project), "listed": F.max(lists).over(of_project), "n_units": F.count("*").over(of_project)}
    )
    out = (F.col("side") == "DESIGN") & (F.size("__words") > 0) & (F.size("__said") > 0) & ~F.arrays_overlap("__words", F.flatten("__said"))
    return rows.withColumn("__out", F.coalesce(out, F.lit(False))).drop("__said")


@dataclass(slots=True)
class _Unit:
    id: int
    side: str
    width: float | None
    height: float | None
    depth: float | None
    opening: str | None
    sized: bool
    said: str
    observed: bool
    substituted: bool
    maker: bool
    listed: bool

    @property
    def words(self) -> frozenset:
        return frozenset(self.said.split())


def _fits(x: _Unit, y: _Unit) -> bool:
    """Both sizes are there and don't contradict."""
    if not x.sized or not y.sized:
        return False
    given = lambda v: v is not None and not math.isnan(v)
    if x.opening and y.opening:
        if x.opening.upper() == y.opening.upper():
            return True
        if given(x.width) and given(y.width):
            return x.width == y.width
    axes = ((x.width, y.width), (x.height, y.height), (x.depth, y.depth))
    return not any(given(v) and given(w) and abs(v - w) > TOLERANCE for v, w in axes)


def _closest(unit: _Unit, candidates: list[_Unit]) -> _Unit | None:
    """The one candidate that shares most words, an observed finish or door breaking ties; none if that leaves several."""
    words = unit.words
    rank = [(len(words & c.words), c.observed) for c in candidates]
    ranked = sorted(rank, reverse=True)
    if not ranked or not ranked[0][0] or ranked[1:2] == ranked[:1]:
        return None
    return candidates[rank.index(ranked[0])]


class _Group:
    """Decides the units of one project, or of one component of its links, in order, each at most once."""

    def __init__(self, units: list[_Unit], edges: Iterable[tuple[str, int, int, bool]], listed: bool) -> None:
        self.units = {u.id: u for u in units}
        self.at = {u.id: n for n, u in enumerate(units)}
        self.listed = listed
        self.free = set(self.units)
        self.codes: set[tuple[str, str]] = set()
        self.links: dict[tuple[str, str], list[str]] = defaultdict(list)  # by pair, from its first side and from its second
        for pair, a, b, same in edges:
            self.links[pair, a].append(b)
            if pair[0] != pair[1]:
                self.links[pair[::-1], b].append(a)
            if same:
                self.codes.add((a, b))
        self.groups: list[tuple[_Unit | None, _Unit | None, _Unit | None, bool, str]] = []

    def linked(self, pair: str, unit: str, free: bool = True) -> list[_Unit]:
        """Units of the pair's second side linked with one of its first, in order, only undecided ones if ``free``."""
        found = {x for x in self.links.get((pair, unit), ()) if not free or x in self.free}
        return [self.units[x] for x in sorted(found, key=self.at.__getitem__)]

    def commit(self, d: _Unit | None, o: _Unit | None, a: _Unit | None, how: str, unsure: bool = False) -> None:
        self.groups.append((d, o, a, unsure, how))
        self.free -= {u.id for u in (d, o, a) if u}

    def in_order(self, found: dict[str, _Unit]) -> list[_Unit]:
        return sorted(found.values(), key=lambda u: self.at[u.id])

    def design(self, d: _Unit) -> None:
        orders = self.linked("DO", d.id)
        reached = {a.id: a for o in orders for a in self.linked("OA", o.id)}
        if not self.listed:
            reached |= {a.id: a for a in self.linked("DA", d.id)}
        acks = self.in_order(reached)
        alike = self.linked("DD", d.id)
        # Rivals of the first candidates count even if they are decided already.
        for_order = self.linked("OD", orders[0].id, free=False) if orders else []
        for_ack = self.linked("AD", acks[0].id, free=False) if acks else []
        order_contested, ack_contested = len(for_order) > 1, len(for_ack) > 1
        counts, single = (len(orders), len(acks)), len(alike) == 1
        if single and not order_contested and not ack_contested and counts in ((1, 1), (0, 1)):
            self.commit(d, orders[0] if orders else None, acks[0], "alone")
        elif single and not order_contested and len(orders) == 1 and (not acks or ack_contested):
            self.commit(d, orders[0], None, "alone")
        elif len(alike) > 1 or max(counts) > 1 or order_contested or ack_contested:
            o = next((o for o in orders if _fits(d, o)), None) or _closest(d, orders)
            a = next((a for a in acks if _fits(o or d, a)), None) or _closest(o or d, acks)
            if o or a:
                self.commit(d, o, a, "in order")
            else:
                rivals = {x.id: x for x in [*alike, *(for_order if order_contested else []), *(for_ack if ack_contested else [])]}
                self.rescue(list(rivals.values()), orders, acks)

    def rescue(self, rivals: list[_Unit], orders: list[_Unit], acks: list[_Unit]) -> None:
        """Rivals whose own words point to an order or acknowledgement that no other claims get it; the rest is unsure."""
        able = sorted((x for x in rivals if x.id in self.free and x.words), key=lambda x: (len(x.words), x.id), reverse=True)
        wishes = {x.id: (_closest(x, orders), _closest(x, acks)) for x in able}
        claims: dict[str, int] = defaultdict(int)
        for wish in wishes.values():
            for u in wish:
                if u:
                    claims[u.id] += 1
        for x in able:
            o, a = wishes[x.id]
            if (o or a) and all(claims[u.id] == 1 for u in (o, a) if u):
                self.commit(x, o, a, "in order")
        for x in rivals:
            if x.id in self.free:
                self.commit(x, None, None, "in order", True)
        for side, left in (("o", orders), ("a", acks)):
            for u in left:
                if u.id in self.free:
                    self.commit(None, u if side == "o" else None, u if side == "a" else None, "in order", True)

    def order(self, o: _Unit) -> None:
        if self.listed and not o.maker:
            self.commit(None, o, None, "alone", True)
            return
        alike, acks = self.linked("OO", o.id), self.linked("OA", o.id)
        if len(alike) == 1 and len(acks) == 1:
            self.commit(None, o, acks[0], "alone")
        else:
            unsure = len(alike) > 1 or len(acks) > 1
            self.commit(None, o, None, "in order" if unsure else "alone", unsure)

    def decide(self) -> Iterator[tuple[str | None, str | None, str | None, str, str]]:
        sides = {s: [u for u in self.units.values() if u.side == s] for s in ("DESIGN", "ORDER", "ACK")}
        for d in sides["DESIGN"]:
            if d.id in self.free:
                self.design(d)
        for o in sides["ORDER"]:
            if o.id in self.free:
                self.order(o)
        for u in sides["DESIGN"] + sides["ACK"]:
            if u.id in self.free:
                self.commit(u if u.side == "DESIGN" else None, None, u if u.side == "ACK" else None, "alone")
        for d, o, a, unsure, how in self.groups:
            yield d and d.id, o and o.id, a and a.id, self.status(d, o, a, unsure), how

    def status(self, d: _Unit | None, o: _Unit | None, a: _Unit | None, unsure: bool) -> str:
        if unsure:
            return "UNCERTAIN"
        if d and o and a:
            return "MATCHED" if not a.substituted and (d.id, o.id) in self.codes and (o.id, a.id) in self.codes else "CHANGED"
        if d and o:
            if o.listed and not o.maker:
                return "UNCERTAIN"
            return "MATCHED" if (d.id, o.id) in self.codes else "CHANGED"
        if d:
            return "CHANGED" if a else "MISSING"
        return "EXTRA"


#: Units of a project from which on its components are decided apart from one another.
LARGE = 10_000
_SIDES = ("DESIGN", "ORDER", "ACK")
#: A unit's flags, the n-th as bit n, behind the two bits of its side.
_FLAGS = ("sized", "observed", "substituted", "maker", "cabinet_list", "listed", "itself")
_FACTS = ("unit_id", "flags", "axes", "texts")
_IDS = ("design_id", "order_id", "ack_id")


def _decided(held: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Groups of units that come by project and component, in the order of their lines, each followed by its links.

    The columns that units hold come with each group three times, after ``d_``, ``o_`` and ``a_``.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ("project_id", "component")):
            units, chosen, status, how = _groups_of(rows)
            at = [pa.array(c, mask=c < 0) for c in chosen]
            project = units.column("project_id").take(pa.array(np.max(chosen, axis=0)))
            columns = {"project_id": project, **{i: units.column("unit_id").take(c) for i, c in zip(_IDS, at, strict=True)}, "status": pa.array(status, pa.string()), "decided": pa.array(how, pa.string())}
            columns |= {f"{letter}_{h}": units.column(h).take(c) for letter, c in zip("doa", at, strict=True) for h in held}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return decide


def _groups_of(rows: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """The units of these rows; each group's units by their number there (-1 for none), a row for each side; its status; how it was decided.

    What hangs together with at most one unit of each side leaves nothing to choose and is decided for all at once, the
    rest by :class:`_Group`, in order.
    """
    linked = rows.column("a").is_valid().to_numpy(zero_copy_only=False)
    place = np.cumsum(np.r_[False, _changes(rows, "project_id") | _changes(rows, "component")])
    units, links = rows.filter(pa.array(~linked)), rows.filter(pa.array(linked))
    n = units.num_rows
    # Names are a project's own.
    names = pa.concat_arrays([units.column("unit_id"), links.column("a"), links.column("b")]).dictionary_encode()
    key = names.indices.to_numpy().astype(np.int64) + len(names.dictionary) * np.r_[place[~linked], place[linked], place[linked]]
    order = np.argsort(key[:n], kind="stable")
    a, b = order[np.searchsorted(key[:n], key[n:], sorter=order)].reshape(2, -1)
    same = links.column("same_code").to_numpy(zero_copy_only=False).astype(bool)
    flags = units.column("flags").to_numpy(zero_copy_only=False).astype(np.int64)
    side = flags & 3
    flag = {f: (flags >> n & 1).astype(bool) for n, f in enumerate(_FLAGS, 2)}
    listed, itself, substituted = flag["listed"], flag["itself"], flag["substituted"]
    itself[a[a == b]] = True
    a, b, same = a[a != b], b[a != b], same[a != b]

    label = _labels(n, a, b)
    several = np.bincount(label * 3 + side, minlength=3 * n).reshape(n, 3).max(axis=1) > 1
    odd = np.bincount(label[listed | ~itself & (side < 2)], minlength=n) > 0
    simple = ~(several | odd)[label]

    # Of each component its unit of each side and its links: DESIGN to ORDER, DESIGN to ACK, ORDER to ACK.
    of = np.full((3, n), -1)
    of[side[simple], label[simple]] = np.flatnonzero(simple)
    link, alike = np.zeros((3, n), dtype=bool), np.zeros((3, n), dtype=bool)
    ours = simple[a]
    pair = side[a[ours]] + side[b[ours]] - 1
    link[pair, label[a[ours]]] = True
    alike[pair, label[a[ours]]] |= same[ours]
    of, link, alike = (x[:, label[simple & (label == np.arange(n))]] for x in (of, link, alike))
    has = of >= 0
    apart = has.all(axis=0) & ~link[0]  # the design takes the acknowledgement and leaves the order
    equal = alike[0] & (~has[2] | alike[2] & ~substituted[of[2]])
    d, o, k = has
    status = np.select([d & o & ~apart & equal, d & (o | k), d], ["MATCHED", "CHANGED", "MISSING"], "EXTRA")
    left = of[:, apart].copy()
    left[[0, 2]] = -1
    of[1, apart] = -1
    chosen, status = [np.c_[of, left]], [status, np.full(left.shape[1], "EXTRA")]
    how = [np.full(chosen[0].shape[1], "alone")]

    if not simple.all():
        found = list(_in_order(units, np.flatnonzero(~simple), a[~ours], b[~ours], same[~ours], label, side, flag))
        *at, said, way = zip(*found, strict=True)
        chosen.append(np.array(at))
        status.append(np.array(said))
        how.append(np.array(way))
    return units, np.concatenate(chosen, axis=1), np.concatenate(status).astype(object), np.concatenate(how).astype(object)


def _changes(rows: pa.RecordBatch, column: str) -> np.ndarray:
    c = rows.column(column)
    return pc.not_equal(c.slice(1), c.slice(0, max(len(c) - 1, 0))).to_numpy(zero_copy_only=False)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n units the least one that links lead to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _in_order(units: pa.RecordBatch, chosen: np.ndarray, a: np.ndarray, b: np.ndarray, same: np.ndarray, label: np.ndarray, side: np.ndarray, flag: dict[str, np.ndarray]) -> Iterator[tuple[int, int, int, str, str]]:
    """Groups of the chosen units, a component at a time."""
    some = units.take(pa.array(chosen))
    # By way of NumPy, since to_pylist makes an object of Arrow for each value. Missing numbers come as NaN.
    flat = lambda c, n: some.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n).tolist()
    told = (flag[f][chosen].tolist() for f in ("sized", "observed", "substituted", "maker", "cabinet_list", "itself"))
    of: dict[int, list[_Unit]] = defaultdict(list)
    edges: dict[int, list[tuple]] = defaultdict(list)
    letters = {}
    for n, where, s, axes, (opening, said), sized, observed, substituted, maker, cabinet_list, itself in zip(chosen.tolist(), label[chosen].tolist(), side[chosen].tolist(), flat("axes", 3), flat("texts", 2), *told, strict=True):
        of[where].append(_Unit(n, _SIDES[s], *axes, opening, sized, said, observed, substituted, maker, cabinet_list))
        letters[n] = "DOA"[s]
        if itself and s < 2:
            edges[where].append((letters[n] * 2, n, n, False))
    for where, x, y, equal in zip(label[a].tolist(), a.tolist(), b.tolist(), same.tolist(), strict=True):
        edges[where].append((letters[x] + letters[y], x, y, equal))
    for where, those in of.items():
        for d, o, k, status, how in _Group(those, edges[where], bool(flag["listed"][where])).decide():
            yield *(-1 if x is None else x for x in (d, o, k)), status, how


def _with_components(units: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with ``component``: in projects of ``LARGE`` units and more the least unit that is reachable, else empty.

    Decisions only follow links, so components are independent of one another. Labels spread along the links of such
    projects until nothing changes.
    """
    none = F.lit("").alias("component")
    large = cut(units.where(F.col("n_units") >= LARGE).select("project_id").distinct())
    if large.isEmpty():
        return units.select("*", none), edges.select("*", none)
    ours = lambda df: df.join(large, "project_id", "left_semi")
    arcs = ours(edges).where("a <> b").select("project_id", "a", "b")
    arcs = cut(arcs.unionAll(arcs.select("project_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(ours(units).select("project_id", F.col("unit_id").alias("a"), F.col("unit_id").alias("component")))
    before = None
    while True:
        heard = arcs.join(label.withColumnRenamed("a", "b"), ["project_id", "b"]).groupBy("project_id", "a").agg(F.min("component").alias("heard"))
        next_ = label.join(heard, ["project_id", "a"], "left").select("project_id", "a", F.least("component", "heard").alias("component"))
        # What one's label is labelled with is reachable too: chains shorten by half in each round.
        of_label = next_.select("project_id", F.col("a").alias("component"), F.col("component").alias("further"))
        label = cut(next_.join(of_label, ["project_id", "component"]).select("project_id", "a", F.col("further").alias("component")))
        now = label.agg(F.sum(F.xxhash64("a", "component").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    units = units.join(label.withColumnRenamed("a", "unit_id"), ["project_id", "unit_id"], "left")
    filled = lambda df: df.withColumn("component", F.coalesce("component", F.lit("")))
    return filled(units), filled(edges.join(label, ["project_id", "a"], "left"))


def match_units(units: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """project_id, design_id, order_id, ack_id, status, decided: every unit in exactly one group.

    Status is MATCHED, CHANGED, MISSING, EXTRA, UNCERTAIN or OUT_OF_SCOPE. ``decided`` tells whether a group's units had
    no rivals ("alone"), were chosen among several by the project's lines in order, or were out of scope. Units and
    their links meet in one shuffle by project and are decided as they stream through, some projects at a time; large
    projects are dealt out by component, so a task holds what belongs together and no more.
    """
    return _matched(units, edges, {})


def match_members(units: DataFrame) -> DataFrame:
    """The same groups, each side's unit with them as ``d``, ``o``, ``a`` (see :func:`triplicate.operators.crosscheck.member`).

    What is compared later travels along with what decides, so that nothing has to be joined to the groups.
    """
    return _matched(units, None, {"held": member()})


def _matched(units: DataFrame, edges: DataFrame | None, held: dict[str, Column]) -> DataFrame:
    lists = F.coalesce((F.col("side") == "ORDER") & (F.col("source_type") == "CABINET_LIST"), F.lit(False))
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    observed = F.coalesce(F.col("finish_status") == "OBSERVED", F.lit(False)) | F.coalesce(F.col("door_style_status") == "OBSERVED", F.lit(False))
    # Only what is compared travels on.
    marked = _marked(units.withColumn("__words", _scope_words()), lists).select(
        "project_id", "side", "unit_id", "ord", "listed", "n_units", "__out", "raw_sku", "description", "category", "dimensions", "substitution_sku", "manuf_code",
        F.array_join(F.array_union("__words", significant_tokens(F.col("notes"))), " ").alias("said"), observed.alias("observed"), given("substitution_sku").alias("substituted"),
        given("manuf_code").alias("maker"), F.coalesce(F.col("source_type") == "CABINET_LIST", F.lit(False)).alias("cabinet_list"),
        (specified(F.col("raw_sku")) | specified(F.col("description"))).alias("itself"), *(c.alias(name) for name, c in held.items()),
    )
    marked = cut(marked)
    inside, outside = marked.where(~F.col("__out") & F.col("side").isin("DESIGN", "ORDER", "ACK")), marked.where("__out")
    links = equivalence_edges(inside, itself=False) if edges is None else edges
    flags = (F.array_position(F.array(*map(F.lit, _SIDES)), F.col("side")) - 1).cast("int")
    for n, f in enumerate(_FLAGS, 2):
        flags = flags.bitwiseOR(F.when(F.col(f), 1 << n).otherwise(0))
    axes = F.array(*(F.col(f"dimensions.{c}") for c in ("width", "height", "depth"))).alias("axes")
    facts = inside.withColumn("sized", F.col("dimensions").isNotNull()).select("project_id", "ord", "n_units", "unit_id", flags.alias("flags"), axes, F.array("dimensions.opening", "said").alias("texts"), *held)
    facts, links = _with_components(facts, links)
    rows = facts.unionByName(links.select("project_id", "component", "a", "b", "same_code"), allowMissingColumns=True)
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartition(n, "project_id", "component").sortWithinPartitions("project_id", "component", F.col("a").asc_nulls_first(), "ord", "unit_id")
    none = F.lit(None).cast("string")
    excluded = outside.select("project_id", F.col("unit_id").alias("design_id"), none.alias("order_id"), none.alias("ack_id"), F.lit("OUT_OF_SCOPE").alias("status"), F.lit("scope").alias("decided"), *(F.col(c).alias("d") for c in held))
    kind = marked.schema["held"].dataType if held else StructType()
    thin = sorted_.select("project_id", "component", *_FACTS, *(packed(F.col("held"), kind, "held") if held else ()), "a", "b", "same_code")
    along = [f for f in thin.schema.fields if f.name.startswith("held_")]
    schema = StructType.fromDDL(GROUP)
    for letter in "doa":
        for f in along:
            schema = schema.add(f"{letter}_{f.name}", f.dataType)
    decided = thin.mapInArrow(_decided(tuple(f.name for f in along)), schema)
    whole = decided.select(*StructType.fromDDL(GROUP).names, *(unpacked(kind, f"{letter}_held").alias(letter) for letter in ("doa" if held else ())))
    return whole.unionByName(excluded, allowMissingColumns=True)
