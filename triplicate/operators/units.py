"""Units: what one document says of one thing, over all lines that name it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplicate.functions.classification import classify
from triplicate.functions.text import display_number, normalize_sku, normalize_text

#: How far a kind of view is trusted.
VIEW_PRIORITY = {"SCHEDULE": 4, "ELEVATION": 3, "FLOORPLAN": 2, "LEGEND": 1}
RESOLUTION = "struct<resolved_quantity:int,quantity_source:string,resolution_method:string,confidence_status:string,floorplan_qty:int,winner_qty:int>"


def _given(c: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0


def resolve_views(items: DataFrame) -> DataFrame:
    """Of the views that show one code in one display, keeps those of the most trusted kind.

    Among these, rows with a finish or door go before rows without. What stays takes a missing finish or door from
    what goes, and where floor plans go, gets ``quantity_resolution``: both counts and which one holds. Rows without
    a view pass with a null resolution, and are not shuffled. One shuffle of the others, by project, side, code and display.
    """
    plain = items.where(F.coalesce("view_type", F.lit("")) == "").withColumn("quantity_resolution", F.lit(None).cast(RESOLUTION))
    items = items.where(F.col("view_type") != "")
    display = F.coalesce(display_number(F.col("position"), rooms=False), normalize_text(F.col("position")), F.lit("unknown"))
    key = F.concat(F.coalesce(normalize_sku(F.col("raw_sku")), F.lit("")), F.lit("|"), display)
    priority = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in VIEW_PRIORITY.items() for x in p)), F.col("view_type")), F.lit(0))
    w = Window.partitionBy("project_id", "side", "__key")
    marked = items.withColumns({"__key": key, "__p": priority, "__said": _given("finish") | _given("door_style")})
    marked = marked.withColumn("__top", F.col("__p") == F.max("__p").over(w))
    marked = marked.withColumn("__any", F.max(F.col("__top") & F.col("__said")).over(w))
    marked = marked.withColumn("__stays", F.col("__top") & (F.col("__said") | ~F.col("__any")))
    ordered = w.orderBy("ord", "item_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gone = ~F.col("__stays")
    first = lambda c: F.first(F.when(gone & _given(c), F.col(c)), ignorenulls=True).over(ordered)
    plan = F.max(F.when(gone & (F.col("view_type") == "FLOORPLAN"), F.coalesce("quantity", F.lit(0)))).over(w)
    own = F.coalesce("quantity", F.lit(0))

    def resolution(value: Column, source: Column, method: str, status: str) -> Column:
        return F.struct(
            value.cast("int").alias("resolved_quantity"), source.alias("quantity_source"), F.lit(method).alias("resolution_method"),
            F.lit(status).alias("confidence_status"), F.col("__plan").cast("int").alias("floorplan_qty"), own.cast("int").alias("winner_qty"),
        )

    resolved = (
        F.when(F.col("__plan") > own, resolution(F.col("__plan"), F.lit("FLOORPLAN"), "floorplan_higher_inferred", "INFERRED"))
        .when(F.col("__plan") == own, resolution(own, F.lit("AGREED"), "views_agree", "HIGH"))
        .when(F.col("__plan").isNotNull(), resolution(own, F.col("view_type"), "elevation_higher_flagged", "NEEDS_REVIEW"))
    )
    marked = marked.withColumns({"__plan": plan, "__finish": first("finish"), "__door": first("door_style")}).where("__stays")
    return marked.withColumns(
        {
            "finish": F.when(_given("finish"), F.col("finish")).otherwise(F.coalesce("__finish", "finish")),
            "door_style": F.when(_given("door_style"), F.col("door_style")).otherwise(F.coalesce("__door", "door_style")),
            "quantity_resolution": resolved.cast(RESOLUTION),
        }
    ).select(*items.columns, "quantity_resolution").unionByName(plain)


def unit_key() -> Column:
    """Lines of one document are one unit if they agree in code, finish, door and, where viewed, display."""
    sku = normalize_sku(F.col("raw_sku"))
    part = lambda c: F.coalesce(normalize_text(F.col(c)), F.lit(""))
    place = F.when(F.coalesce(F.col("view_type"), F.lit("")) != "", F.coalesce(display_number(F.col("position"), rooms=True), F.lit(""))).otherwise("")
    return F.when(sku.isNull(), F.concat(F.lit("#"), F.col("item_id"))).otherwise(F.concat_ws("|", sku, part("finish"), part("door_style"), place))


#: What a unit takes from the first line that gives it, and what comes with that.
_FIRST = {"description": (), "size_text": ("dimensions",), "finish": ("finish_status",), "door_style": ("door_style_status",), "notes": (), "substitution_sku": ()}


def aggregate_units(items: DataFrame) -> DataFrame:
    """One row for each unit, named by its first line.

    ``quantity`` sums what is given, or is the resolved one of a single viewed line. The first line's own values are
    in ``primary``, with which fields are compared; ``description``, ``dimensions``, ``finish``, ``door_style``,
    ``notes`` and ``substitution_sku`` are each the first that is given, with which units are matched. A null or
    unknown category is found by rule. Input without ``quantity_resolution`` is taken as resolved. A unit's lines meet
    in one shuffle and one sort: an aggregation of whole rows would sort them twice and keep no fewer, since most units are
    a single line.
    """
    if "quantity_resolution" not in items.columns:
        items = resolve_views(items)
    kept = [c for c in items.columns if c not in ("project_id", "side")]
    in_order = Window.partitionBy("project_id", "side", "unit_key").orderBy("ord", "item_id", "quantity")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c, more: F.first(F.when(_given(c), F.struct(c, *more)), ignorenulls=True).over(whole)
    rows = items.withColumn("unit_key", unit_key()).withColumns(
        {
            "nth": F.row_number().over(in_order),
            "raw_line_count": F.count("*").over(whole),
            "total": F.sum("quantity").over(whole).cast("int"),
            "lines": F.collect_list(F.struct("item_id", "quantity")).over(whole),
            **{f"first_{c}": first(c, more) for c, more in _FIRST.items()},
        }
    )
    grouped = rows.where("nth = 1").withColumn("primary", F.struct(*kept)).drop(*kept)
    p = F.col("primary")
    found = classify(p["raw_sku"], p["description"], p["dimensions"])
    known = F.when(~F.coalesce(p["category"], F.lit("UNKNOWN")).isin("UNKNOWN", ""), p["category"])
    resolved = p["quantity_resolution"]["resolved_quantity"]
    return grouped.select(
        "project_id",
        "side",
        p["item_id"].alias("unit_id"),
        p["ord"].alias("ord"),
        p["raw_sku"].alias("raw_sku"),
        F.coalesce(known, found["category"]).alias("category"),
        F.when((F.col("raw_line_count") == 1) & resolved.isNotNull(), resolved).otherwise(F.col("total")).alias("quantity"),
        F.coalesce(F.col("first_description.description"), p["description"]).alias("description"),
        F.col("first_size_text.dimensions").alias("dimensions"),
        F.coalesce(F.col("first_finish.finish"), p["finish"]).alias("finish"),
        F.col("first_finish.finish_status").alias("finish_status"),
        F.coalesce(F.col("first_door_style.door_style"), p["door_style"]).alias("door_style"),
        F.col("first_door_style.door_style_status").alias("door_style_status"),
        F.coalesce(F.col("first_notes.notes"), p["notes"]).alias("notes"),
        F.col("first_substitution_sku.substitution_sku").alias("substitution_sku"),
        F.when(F.coalesce(p["manuf_code"], F.lit("")) != "", p["manuf_code"]).alias("manuf_code"),
        p["source_type"].alias("source_type"),
        "raw_line_count",
        F.col("lines.item_id").alias("raw_line_ids"),
        F.col("lines.quantity").alias("raw_quantities"),
        "primary",
    )
