"""Differences within matched groups, field by field, each with the document where it first appears."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplicate.functions import dimensions
from triplicate.functions.equivalence import codes_differ
from triplicate.functions.text import alike, normalize_spec, normalize_text, once, same_finish, specified

#: Categories in which differences do not matter for what is bought.
SUPPRESSED = ("MOLDING", "ACCESSORY", "ARCHITECTURAL_ANNOTATION", "APPLIANCE", "COMMERCIAL_CHARGE")
_SIDES = (("d", "DESIGN", "design_id"), ("o", "ORDER", "order_id"), ("a", "ACK", "ack_id"))


def member() -> Column:
    """Of a unit what is compared: its first line's values and its whole quantity."""
    of_first = ("raw_sku", "description", "dimensions", "finish", "door_style", "species", "construction", "drawer_box", "price")
    return F.struct(
        "category", "quantity", "manuf_code", "substitution_sku", "source_type", *(F.col(f"primary.{c}").alias(c) for c in of_first),
        F.col("primary.quantity").alias("own_quantity"), F.col("primary.quantity_resolution").alias("quantity_resolution"), F.col("primary.substitution_sku").alias("own_substitution"),
        F.col("primary.modifications").alias("modifications"), F.col("ord").alias("line"),
    )


def with_members(groups: DataFrame, units: DataFrame) -> DataFrame:
    """Groups with each side's unit as a struct ``d``, ``o``, ``a`` (see :func:`member`).

    Three joins; :func:`triplicate.operators.matching.match_members` gives the same where units are matched.
    """
    out = groups
    first = units.select("project_id", "side", "unit_id", member().alias("member"))
    for letter, side, key in _SIDES:
        of = first.where(F.col("side") == side).select("project_id", F.col("unit_id").alias(key), F.col("member").alias(letter))
        out = out.join(of, ["project_id", key], "left")
    return out


def _category() -> Column:
    cats = [F.col(f"{s}.category") for s, _, _ in _SIDES]
    return F.coalesce(*(F.when(c != "UNKNOWN", c) for c in cats), *cats)


def discrepancies(members: DataFrame) -> DataFrame:
    """One row for each difference: group ids, field, the three values as text, introduced_at, severity, explanation, position.

    Whether each rule holds is computed once, before anything is made of it, and groups for which none does are left out
    there. What the others give stands in one projection, in a fixed order, and is exploded: no shuffle. Fields are
    compared only where both sides give them. Suppressed categories and groups out of scope have none.
    """
    d, o, a = F.col("d"), F.col("o"), F.col("a")
    has = {s: F.col(key).isNotNull() for s, _, key in _SIDES}
    unknown = F.coalesce(_category(), F.lit("")) == "UNKNOWN"
    text = lambda c: c.cast("string")

    hits: list[Column] = []

    def row(when: Column, name: str, values: tuple, introduced: str, severity, explanation) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        told = F.lit(explanation) if isinstance(explanation, str) else explanation
        cells = [v if isinstance(v, Column) else F.lit(v).cast("string") for v in values]
        hits.append(F.coalesce(when, F.lit(False)).alias(f"r{len(hits)}"))
        return F.when(
            F.col(f"__hit.r{len(hits) - 1}"),
            F.struct(
                F.lit(name).alias("field"), cells[0].alias("design_value"), cells[1].alias("order_value"), cells[2].alias("ack_value"),
                F.lit(introduced).alias("introduced_at"), level.alias("severity"), told.alias("explanation"),
            ),
        )

    graded = F.when(unknown, "Warning").otherwise("Critical")
    no_maker = (F.col("status") == "UNCERTAIN") & (o["source_type"] == "CABINET_LIST") & o["manuf_code"].isNull()
    first = [row(no_maker, "manufacturer_code", (d["raw_sku"], o["raw_sku"], a["raw_sku"]), "CABINET_LIST", "Warning", "listed without the maker's code")]
    D, O, A = has["d"], has["o"], has["a"]  # noqa: N806, E741
    alone = [
        row(D & ~O & ~A, "item_presence", ("PRESENT", "MISSING", "MISSING"), "DESIGN", graded, "in the design only"),
        row(~D & O & ~A, "item_presence", ("ABSENT", "ADDED", "OMITTED"), "ORDER", graded, "added in the order, not acknowledged"),
        row(~D & ~O & A, "item_presence", ("ABSENT", "ABSENT", "PRESENT"), "ACKNOWLEDGEMENT", graded, "in the acknowledgement only"),
    ]
    rules = [
        row(D & ~O & A, "item_presence", ("PRESENT", "OMITTED", "RESTORED"), "DESIGN", "Warning", "left out of the order, restored in the acknowledgement"),
        row(~D & O & A, "item_presence", ("ABSENT", "PRESENT", "PRESENT"), "ORDER", graded, "added in the order and acknowledged"),
    ]
    skus = (d["raw_sku"], o["raw_sku"], a["raw_sku"])
    substituted = F.coalesce(a["own_substitution"], F.lit("")) != ""
    reference = F.when(specified(o["raw_sku"]), o["raw_sku"]).otherwise(d["raw_sku"])
    rules.append(row(A & substituted, "sku", skus, "ACKNOWLEDGEMENT", "Warning", F.concat(F.lit("substitutes "), a["own_substitution"])))
    varied = A & ~substituted & codes_differ(a["raw_sku"], reference)
    rules.append(row(varied, "sku", skus, "ACKNOWLEDGEMENT", "Info", "the maker writes the code otherwise"))
    review = d["quantity_resolution"]["confidence_status"] == "NEEDS_REVIEW"
    rules.append(row(review, "quantity_resolution", (text(d["own_quantity"]), text(o["quantity"]), text(a["quantity"])), "DESIGN", "Warning", "views disagree on the quantity"))
    qd, qo, qa = d["quantity"], o["quantity"], a["quantity"]
    q = (text(qd), text(qo), text(qa))
    in_order = F.coalesce(qd != qo, F.lit(False))
    in_ack = ~in_order & F.coalesce(qo != qa, F.lit(False))
    then = F.when(qa == qd, F.concat(F.lit(" (reverted to "), text(qa), F.lit(")"))).when(qa.isNotNull(), F.concat(F.lit(", confirmed as "), text(qa))).otherwise("")
    rules.append(row(in_order, "quantity", q, "ORDER", "Warning", F.concat(F.lit("design "), text(qd), F.lit(", order "), text(qo), then)))
    rules.append(row(in_ack, "quantity", q, "ACKNOWLEDGEMENT", "Warning", F.concat(F.lit("order "), text(qo), F.lit(", acknowledged "), text(qa))))
    rules.append(row(~in_order & ~in_ack & qo.isNull() & (qd != qa), "quantity", q, "ACKNOWLEDGEMENT", "Warning", F.concat(F.lit("design "), text(qd), F.lit(", acknowledged "), text(qa))))

    def steps(name: str, values: tuple, differ, told: tuple, chained: bool = False) -> None:
        """Design against order, and order against acknowledgement; with ``chained`` the second only without the first."""
        vd, vo, va = values
        one = F.coalesce(differ(d, o, vd, vo) & vd.isNotNull() & vo.isNotNull(), F.lit(False))
        two = F.coalesce(differ(o, a, vo, va) & vo.isNotNull() & va.isNotNull(), F.lit(False))
        for hit, at in ((one, "ORDER"), (two & ~one if chained else two, "ACKNOWLEDGEMENT")):
            rules.append(row(hit, name, told, at, "Warning", F.lit(f"{name} changed")))

    of = lambda name: tuple(x[name] for x in (d, o, a))
    steps("dimensions", of("dimensions"), lambda x, y, v, w: ~dimensions.equivalent(v, w), tuple(x["raw"] for x in of("dimensions")))
    steps("finish", of("finish"), lambda x, y, v, w: ~same_finish(v, w), of("finish"))
    steps("door_style", tuple(map(normalize_text, of("door_style"))), lambda x, y, v, w: ~alike(x["door_style"], y["door_style"]) & (v != w), of("door_style"))
    for name in ("species", "construction", "drawer_box"):
        steps(name, tuple(map(normalize_spec, of(name))), lambda x, y, v, w, n=name: ~alike(x[n], y[n]) & (v != w), of(name), chained=True)

    def present(rows: list[Column]) -> Column:
        return F.array_compact(F.array(*rows))

    found = F.when(first[0].isNotNull(), F.array(first[0])).when(F.size(present(alone)) > 0, present(alone)).otherwise(present(rules))
    suppressed = _category().isin(*SUPPRESSED)
    open_ = members.where((F.col("status") != "OUT_OF_SCOPE") & ~F.coalesce(suppressed, F.lit(False)))
    held = once(open_, "__hit", F.struct(*hits)).where(reduce(or_, (F.col(f"__hit.r{n}") for n in range(len(hits)))))
    rows = held.select("project_id", "design_id", "order_id", "ack_id", found.alias("found"))
    # Outer for the same reason as in ``once``.
    return rows.select("project_id", "design_id", "order_id", "ack_id", F.posexplode_outer("found").alias("position", "x")).where("position is not null").select(
        "project_id", "design_id", "order_id", "ack_id", "position", "x.*", F.lit("OPEN").alias("status"), F.lit("HIGH").alias("confidence")
    )


def truth() -> Column:
    """What holds in the end: the acknowledgement's unit, else the order's, else the design's."""
    return F.coalesce(F.when(F.col("ack_id").isNotNull(), F.col("a")), F.when(F.col("order_id").isNotNull(), F.col("o")), F.col("d"))


_KEYS = ("project_id", "design_id", "order_id", "ack_id")


def finalize(members: DataFrame, found: DataFrame, promote: bool = True) -> DataFrame:
    """Groups with what holds in the end: the acknowledgement's values, else the order's, else the design's.

    A group without differences is RESOLVED_AUTO, one with some PENDING_REVIEW; with ``promote`` the latter's MATCHED
    becomes CHANGED.
    """
    key = F.concat_ws("|", *(F.coalesce(c, F.lit("-")) for c in ("design_id", "order_id", "ack_id")))
    counts = found.groupBy("project_id", key.alias("__key")).agg(F.count("*").alias("n_discrepancies"))
    rows = members.withColumn("__key", key).withColumn("__truth", truth()).join(counts, ["project_id", "__key"], "left")
    n = F.coalesce("n_discrepancies", F.lit(0)).cast("long")
    status = F.when((F.col("status") == "MATCHED") & (n > 0), "CHANGED").otherwise(F.col("status")) if promote else F.col("status")
    t = F.col("__truth")
    return rows.select(
        *_KEYS, status.alias("status"), n.alias("n_discrepancies"), t["raw_sku"].alias("final_sku"), t["quantity"].alias("final_quantity"),
        t["finish"].alias("final_finish"), t["door_style"].alias("final_door_style"), t["price"].alias("final_price"),
        F.when(n == 0, "RESOLVED_AUTO").otherwise("PENDING_REVIEW").alias("final_status"),
    )
