"""Projects, their documents, readings, reviews and reports, as operators on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Document types without which a project isn't complete; of the last two one is enough.
REQUIRED, EITHER = ("DESIGN", "ACKNOWLEDGEMENT"), ("ORDER", "CABINET_LIST")

def chosen(df: DataFrame, column: str, value: str | None, domain: tuple[str, ...]) -> DataFrame:
    """Rows with this value, whatever its case; a value outside the domain, or none, filters nothing."""
    wanted = (value or "").upper()
    return df.where(F.upper(column) == wanted) if wanted in domain else df


def missing_documents(documents: DataFrame, project: str, kind: str) -> DataFrame:
    """For each project the required types that it lacks, and whether it lacks none. One partial aggregation."""
    held = documents.groupBy(project).agg(F.collect_set(kind).alias("kinds"))
    lacking = [F.when(~F.array_contains("kinds", k), F.lit(k)) for k in REQUIRED]
    lacking.append(F.when(~F.arrays_overlap("kinds", F.array(*map(F.lit, EITHER))), F.lit("ORDER or CABINET_LIST")))
    missing = F.array_compact(F.array(*lacking))
    return held.select(project, missing.alias("missing"), (F.size(missing) == 0).alias("ready"))


def progress(status: Column, total: Column, resolved: Column, documents: Column) -> Column:
    """How far a project is, in per cent, by its state, its differences and its documents."""
    reviewed = F.when(total > 0, 70 + F.floor(resolved / total * 30)).otherwise(90)
    drafted = F.when(documents <= 0, 0).when(documents == 1, 33).when(documents == 2, 66).otherwise(100)
    return (
        F.when(status.isin("FINALIZED", "COMPLETED"), 100).when(status == "PROCESSING", 70).when(status == "REVIEW_REQUIRED", reviewed).when(status == "FAILED", 25).otherwise(drafted)
    ).cast("int")


def attempts(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds each row's number among those of its key, and whether it is the latest."""
    w = Window.partitionBy(key)
    ordered = w.orderBy(*order)
    return rows.withColumns({"attempt": F.row_number().over(ordered), "is_latest": F.row_number().over(ordered) == F.count("*").over(w)})


def to_extract(documents: DataFrame, cached: DataFrame, identity: list[str]) -> DataFrame:
    """Documents of which no cached extraction has the same identity; nulls equal one another."""
    a, b = documents.alias("a"), cached.select(*identity).distinct().alias("b")
    same = F.lit(True)
    for c in identity:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same, "left_anti")


def replaced(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """What there is with the fresh rows in place of all rows of their keys; doing it twice changes nothing."""
    return existing.join(fresh.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(fresh.select(*existing.columns))


def format_size(size: Column) -> Column:
    """A parsed size as text: the opening, or its axes with a sign between; a hyphen where there is none."""
    axes = F.array_compact(F.array(*(F.regexp_replace(size[k].cast("string"), "\\.0$", "") for k in ("width", "height", "depth"))))
    return F.when(size.isNull(), "-").when(F.coalesce(size["opening"], F.lit("")) != "", size["opening"]).when(F.size(axes) > 0, F.array_join(axes, " × ")).otherwise("-")


def field_label(field: Column) -> Column:
    """A field's name as a heading."""
    return F.coalesce(F.try_element_at(F.create_map(F.lit("item_presence"), F.lit("Item presence"), F.lit("sku"), F.lit("SKU")), field), F.initcap(F.replace(field, F.lit("_"), F.lit(" "))))


def parsed(json: Column, path: str) -> Column:
    """A value in a JSON text; the text itself where it is not JSON."""
    whole = F.try_parse_json(json)
    return F.when(whole.isNull(), json).otherwise(F.try_variant_get(whole, path, "string"))


def evidence(items: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Items with ``verdict``, VERIFIED or UNCERTAIN, and ``issue``, if any: whether their page says what they say it says.

    Items have the key's columns, the last of them a page's number, ``said`` and ``sku``; pages have the key, once each,
    ``status`` and ``raw_text``. A page verifies an item by its text or by its code. EMPTY_EVIDENCE: neither page nor
    text, or no text; INVALID_EVIDENCE: no such page; SOURCE_TEXT_MISMATCH: neither stands there. Pages that were not
    processed or hold no text can't verify anything, which is no issue.
    """
    plain = lambda c: F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "(?U)\\s+", " ")))
    named = F.coalesce(F.col(key[-1]), F.lit(0)) != 0
    joined = items.join(pages.select(*key, F.col("raw_text").alias("page_text"), F.col("status").alias("page_status"), F.lit(True).alias("page_there")), key, "left")
    said, sku, text = plain(F.col("said")), plain(F.col("sku").cast("string")), plain(F.col("page_text"))
    there = F.col("page_there").isNotNull() & named
    readable = there & (F.col("page_status") == "PROCESSED") & (F.coalesce("page_text", F.lit("")) != "")
    holds = lambda c: (c != "") & F.contains(text, c)
    issue = (
        F.when(~named & (said == ""), "EMPTY_EVIDENCE").when(named & ~there, "INVALID_EVIDENCE").when(~F.coalesce(readable, F.lit(False)), None)
        .when(said == "", "EMPTY_EVIDENCE").when(~(holds(said) | holds(sku)), "SOURCE_TEXT_MISMATCH")
    )
    verified = F.coalesce(readable, F.lit(False)) & (said != "") & (holds(said) | holds(sku))
    return joined.withColumns({"verdict": F.when(verified, "VERIFIED").otherwise("UNCERTAIN"), "issue": issue}).drop("page_text", "page_status", "page_there")


def needs_sight(pages: DataFrame, items: DataFrame, key: list[str], blocks: int = 3, letters: int = 80) -> DataFrame:
    """For each page why it has to be read by sight: EMPTY, SPARSE, NO_ITEMS, NO_QUANTITY or NO_FINISH on an elevation; null if not."""
    elevation = F.col("view_type") == "ELEVATION"
    shown = items.groupBy(*key, "display").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("quantity", F.lit(0)) == 0).alias("bare"),
        F.count_if(elevation).alias("elevations"), F.count_if(elevation & (F.trim("finish") != "")).alias("finished"),
    )
    of_page = shown.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("bare").alias("bare"), F.count_if((F.col("elevations") > 0) & (F.col("finished") == 0)).alias("unfinished"))
    size = F.length(F.trim(F.coalesce("raw_text", F.lit(""))))
    why = (
        F.when(size == 0, "EMPTY").when((F.col("n_blocks") < blocks) | (size < letters), "SPARSE").when(F.coalesce("n", F.lit(0)) == 0, "NO_ITEMS")
        .when(F.col("bare") > 0, "NO_QUANTITY").when(F.col("unfinished") > 0, "NO_FINISH")
    )
    return pages.join(of_page, key, "left").select(*key, why.alias("why"))


def reading_order(blocks: DataFrame, key: list[str], most: int = 60, letters: int = 500, page: int = 4000) -> DataFrame:
    """Each page's text, blocks in the order in which one reads: by lines of ten units' height, then from left to right."""
    line = F.bround(F.col("y") / 10) * 10
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(line, "x", "block_id"))
    kept = blocks.withColumn("nth", nth).where(F.col("nth") <= most)
    parts = F.array_sort(F.collect_list(F.struct("nth", F.substring("text", 1, letters).alias("t"))))
    return kept.groupBy(*key).agg(F.substring(F.array_join(F.transform(parts, lambda p: p["t"]), "\n"), 1, page).alias("text"))


def whole_text(pages: DataFrame, key: str, page: str) -> DataFrame:
    """A document's text with a line before each page that tells its number."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("n"), F.col("text").alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: F.concat(F.lit("--- PAGE "), p["n"].cast("string"), F.lit(" ---\n"), p["t"])), "\n").alias("text"))


def anchors_once(left: DataFrame, right: DataFrame, key: str, page: str, within: int = 3) -> DataFrame:
    """For each page of ``left``, in order, the nearest of ``right`` 1 to ``within`` pages on that no page before took.

    A document's pages, a few hundred at most, are folded in one row; pages without an anchor have no row.
    """
    pages = left.groupBy(key).agg(F.sort_array(F.collect_set(page)).alias("from_")).join(right.groupBy(key).agg(F.collect_set(page).alias("to")), key)
    kind = dict(left.dtypes)[page]
    none = F.array().cast(f"array<struct<page:{kind},anchor:{kind}>>")

    def take(acc: Column, p: Column) -> Column:
        open_ = F.filter("to", lambda e: (e > p) & (e <= p + within) & ~F.exists(acc, lambda t: t["anchor"] == e))
        found = F.array_min(open_)
        return F.when(found.isNull(), acc).otherwise(F.concat(acc, F.array(F.struct(p.alias("page"), found.alias("anchor")))))

    return pages.select(key, F.explode(F.aggregate("from_", none, take)).alias("x")).select(key, F.col("x.page").alias(page), "x.anchor")


#: Pages of one call by its kind, and prices of a million tokens in and out by model; others cost the last.
PAGES_OF_A_CALL = {"text": 3, "vision": 6, "ocr": 6, "spec_book": 10}
PRICES = {
    "gpt-4o": (5.00, 15.00),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4.1": (2.00, 8.00),
    "gpt-4.1-mini": (0.40, 1.60),
    "gemini-1.5-flash": (0.075, 0.30),
    "gemini-2.0-flash": (0.10, 0.40),
    "gemini-2.5-flash": (0.15, 0.60),
    "gemini-3.8-flash": (0.15, 0.60),
}
OTHER_PRICE = (5.00, 15.00)
#: What each state that one chooses stands for.
SHOWN_STATES = {"READY": ("COMPLETED",), "PROCESSING": ("PROCESSING", "UPLOADED"), "FAILED": ("FAILED",)}


def batch_number(page: Column, kind: str) -> Column:
    """The call, from 0, in which a page is read."""
    return F.floor((page - 1) / PAGES_OF_A_CALL[kind]).cast("long")


def cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """A call's cost, exact to six places; a model without a price costs ``OTHER_PRICE``."""
    price = lambda i: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for m, p in PRICES.items() for x in (m, round(p[i] * 1000)))), model), F.lit(round(OTHER_PRICE[i] * 1000)))
    return F.round((tokens_in * price(0) + tokens_out * price(1)).cast("decimal(38,9)") / F.lit(10**9).cast("decimal(38,9)"), 6)


def matching_documents(documents: DataFrame, search: str = "", kind: str = "ALL", state: str = "ALL") -> DataFrame:
    """Documents by part of their name, whatever its case, by type and by a state that may stand for several."""
    if search.strip():
        documents = documents.where(F.contains(F.lower(F.coalesce("filename", F.lit(""))), F.lit(search.lower())))
    if kind != "ALL":
        documents = documents.where(F.col("document_type") == kind)
    return documents.where(F.col("status").isin(*SHOWN_STATES[state])) if state in SHOWN_STATES else documents


def sorted_projects(projects: DataFrame, mode: str, key: str) -> DataFrame:
    """Projects in one of four orders, by time of change (of making where there is none) or by name; another mode sorts by key.

    Names are compared as people sort them, letters before their case and accents.
    """
    changed, name = F.coalesce("updated_at", "created_at"), F.collate("name", "UNICODE")
    orders = {"updated_desc": changed.desc(), "updated_asc": changed.asc(), "name_asc": name.asc(), "name_desc": name.desc()}
    return projects.orderBy(*([orders[mode]] if mode in orders else []), key)
