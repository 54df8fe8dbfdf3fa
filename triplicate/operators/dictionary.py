"""Makers' code dictionaries: lookup of codes and aliases, import of files with duplicates and errors."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplicate.functions.classification import classify
from triplicate.functions.text import header_key, normalize_sku

CATEGORIES = ("CABINET", "PANEL", "FILLER", "MOLDING", "ACCESSORY", "APPLIANCE", "ARCHITECTURAL_ANNOTATION", "COMMERCIAL_CHARGE", "UNKNOWN")
#: A dictionary of fewer rows is broadcast; beyond it the join shuffles by maker and code.
BROADCAST_ROWS = 200_000

#: What the columns of a catalogue may be called, letters and digits alone.
HEADERS = {
    "code": ("code", "sku", "item", "itemcode", "itemnumber", "productcode", "model", "modelnumber", "partnumber", "cabinetcode"),
    "description": ("description", "desc", "name", "productname", "productdescription", "itemdescription", "itemname"),
    "category": ("category", "type", "producttype", "itemtype", "producttcategory"),
}
#: Parts of words by which a catalogue's own category is told, in the order in which they are tried.
KEYWORDS = {
    "COMMERCIAL_CHARGE": ("charge", "freight", "surcharge", "tariff", "shipping"),
    "MOLDING": ("molding", "moulding", "crown", "trim"),
    "APPLIANCE": ("appliance", "range", "refrigerator", "dishwasher", "microwave"),
    "ARCHITECTURAL_ANNOTATION": ("architectural", "annotation", "soffit"),
    "ACCESSORY": ("accessory", "hardware", "hinge", "pull", "knob"),
    "PANEL": ("panel",),
    "FILLER": ("filler",),
    "CABINET": ("cabinet", "base", "wall", "vanity", "tall"),
}
#: Why something is no cabinet.
EXCLUSIONS = {
    "COMMERCIAL_CHARGE": "NON_CABINET_CHARGE", "MOLDING": "NON_CABINET_MOLDING", "ACCESSORY": "NON_CABINET_ACCESSORY",
    "APPLIANCE": "NON_CABINET_APPLIANCE", "ARCHITECTURAL_ANNOTATION": "NON_CABINET_ANNOTATION",
}


def infer_category(text: Column) -> Column:
    """The category that a catalogue's text names, or that its words tell; UNKNOWN otherwise."""
    plain, lower = F.upper(F.trim(text)), F.lower(text)
    out = F.when(plain.isin(*CATEGORIES), plain)
    for category, parts in KEYWORDS.items():
        out = out.when(lower.rlike("|".join(parts)), category)
    return F.coalesce(out, F.lit("UNKNOWN"))


def catalogue(rows: DataFrame) -> DataFrame:
    """code, description, category, confidence of a catalogue whose columns may have any of the names in ``HEADERS``.

    The first column of each kind counts. Rows without a code are left out; without a column for it the catalogue is
    refused. Read a file with ``spark.read.csv(path, header=True)``; a mark of byte order at its start does no harm.
    """
    keys = {c: re.sub("[^a-z0-9]", "", c.lower().strip()) for c in rows.columns}
    first = {field: next((c for c in rows.columns if keys[c] in names), None) for field, names in HEADERS.items()}
    if first["code"] is None:
        raise ValueError("no column for codes among " + ", ".join(rows.columns))
    cell = lambda field: F.trim(F.col(f"`{first[field]}`").cast("string")) if first[field] else F.lit(None).cast("string")
    found = rows.select(cell("code").alias("code"), cell("description").alias("description"), infer_category(cell("category")).alias("category"), F.lit(1.0).alias("confidence"))
    return found.where(F.coalesce(F.length("code"), F.lit(0)) > 0)


def decide(items: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Items with a decision: category, level, source, reasons, and further spellings of the code.

    The maker's current entries come first, by the item's code and then by its other ``spellings`` in turn: HIGH, EXACT or
    ALIAS. Else the rules decide: MEDIUM by a description or a known pattern, LOW by less, UNCERTAIN by nothing or where
    two readings of the code disagree. Needs item_id, maker, sku, spellings, description, dimensions, code_conflict.
    """
    code = normalize_sku(F.col("code"))
    w = Window.partitionBy("maker", "spelling").orderBy("entry_id")
    current = dictionary.where("is_current").withColumn("spelling", code).where("spelling is not null")
    # A group's codes come once, each with its first entry and the next, so that lists grow with codes and not with entries.
    ids = current.where("alias_group is not null and entry_id is not null").select("maker", "alias_group", "code", "entry_id").distinct()
    ids = ids.withColumn("nth", F.row_number().over(Window.partitionBy("maker", "alias_group", "code").orderBy("entry_id"))).where("nth <= 2")
    codes = ids.groupBy("maker", "alias_group", "code").agg(F.min("entry_id").alias("id"), F.max(F.when(F.col("nth") == 2, F.col("entry_id"))).alias("next"))
    mates = codes.groupBy("maker", "alias_group").agg(F.collect_list(F.struct("id", "next", "code")).alias("mates"))
    entries = current.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("maker", "spelling", F.struct("entry_id", "category", "is_primary", "alias_group").alias("entry"))
    tried = F.concat(F.array(normalize_sku(F.col("sku"))), F.transform(F.coalesce("spellings", F.array().cast("array<string>")), normalize_sku))
    asked = items.select("item_id", "maker", F.posexplode(tried).alias("nth", "spelling")).where("spelling is not null")
    hit = asked.join(entries, ["maker", "spelling"]).groupBy("item_id", "maker").agg(F.min_by("entry", "nth").alias("entry"))
    # An entry's fellows come to the items that it was found for, not to every entry.
    own = F.col("entry.entry_id")
    fellows = F.transform(F.filter("mates", lambda m: (m["id"] != own) | ((m["id"] == own) & m["next"].isNotNull())), lambda m: F.struct(F.when(m["id"] == own, m["next"]).otherwise(m["id"]).alias("id"), m["code"].alias("code")))
    others = F.transform(F.array_sort(fellows), lambda m: m["code"])
    hit = hit.withColumn("alias_group", F.col("entry.alias_group")).join(mates, ["maker", "alias_group"], "left").select("item_id", F.col("entry").withField("siblings", F.coalesce(others, F.array().cast("array<string>"))).alias("entry"))
    rule = classify(F.col("sku"), F.col("description"), F.col("dimensions"))
    rows = items.withColumn("rule", F.explode(F.array(rule))).join(hit, "item_id", "left")
    found, by = F.col("entry").isNotNull(), F.col("rule.rule")
    excluded = F.try_element_at(F.create_map(*(F.lit(x) for pair in EXCLUSIONS.items() for x in pair)), F.col("rule.category"))
    source = (
        F.when(found, F.when(F.col("entry.is_primary"), "MANUFACTURER_EXACT").otherwise("MANUFACTURER_ALIAS")).when(by == "description", "DOCUMENT_CONTEXT")
        .when(excluded.isNotNull(), "PATTERN_ONLY").when(by == "code", "NKBA_GENERIC").when(by.isin("token", "size"), "PATTERN_ONLY").otherwise("NONE")
    )
    sure = F.col("rule.confidence")
    ruled = F.when((sure >= 0.85) & source.isin("DOCUMENT_CONTEXT", "NKBA_GENERIC"), "MEDIUM").when(sure > 0, "LOW").otherwise("UNCERTAIN")
    conflict = F.coalesce("code_conflict", F.lit(False)) & ~found
    level = F.when(found, "HIGH").when(conflict, "UNCERTAIN").otherwise(ruled)
    because = (
        F.when(excluded.isNotNull(), excluded).when(by == "description", "DOCUMENT_CONTEXT_MATCH").when(by.isin("code", "token", "size"), "NKBA_PATTERN_MATCH")
        .when(sure > 0, "AMBIGUOUS_SKU").otherwise("INSUFFICIENT_EVIDENCE")
    )
    unmatched = F.when(normalize_sku(F.col("sku")).isNotNull() & F.col("maker").isNotNull(), "NO_MANUFACTURER_MATCH")
    reasons = F.when(found, F.array(F.when(F.col("entry.is_primary"), "EXACT_MANUFACTURER_MATCH").otherwise("MANUFACTURER_ALIAS_MATCH"))).otherwise(
        F.array_compact(F.array(because, unmatched, F.when(conflict & (ruled != "UNCERTAIN"), "OCR_VISION_CONFLICT")))
    )
    variants = F.array_distinct(F.array_compact(F.concat(F.array("sku"), F.coalesce("spellings", F.array().cast("array<string>")), F.coalesce("entry.siblings", F.array().cast("array<string>")))))
    return rows.select(
        "item_id", F.coalesce("entry.category", "rule.category").alias("category"), level.alias("level"), source.alias("source"), reasons.alias("reasons"), variants.alias("variants"),
    )


def lookup(items: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Items with the dictionary's category and how it was found: EXACT, ALIAS or none.

    Of current entries that spell a code alike the first holds.
    """
    code = normalize_sku(F.col("code"))
    w = Window.partitionBy("maker", "spelling").orderBy("entry_id")
    entries = dictionary.where("is_current").withColumn("spelling", code).withColumn("nth", F.row_number().over(w)).where("nth = 1")
    entries = entries.select(
        "maker", "spelling", F.col("category").alias("found_category"), F.when(F.col("is_primary"), "EXACT").otherwise("ALIAS").alias("found_by")
    )
    small = dictionary.limit(BROADCAST_ROWS).count() < BROADCAST_ROWS
    entries = F.broadcast(entries) if small else entries
    return items.withColumn("spelling", normalize_sku(F.col("sku"))).join(entries, ["maker", "spelling"], "left").drop("spelling")


def import_check(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to import with a verdict: INVALID without a code or with an unknown category, DUPLICATE of one before or of ``existing``, else NEW."""
    code = normalize_sku(F.col("code"))
    category = F.upper(F.trim("category"))
    valid = code.isNotNull() & F.coalesce(category.isin(*CATEGORIES), F.lit(False))
    marked = rows.withColumns({"normalized": code, "valid": valid})
    nth = F.row_number().over(Window.partitionBy("normalized", "valid").orderBy("row_id"))
    known = existing.select(normalize_sku(F.col("code")).alias("normalized"), F.lit(True).alias("known")).distinct()
    marked = marked.withColumn("nth", nth).join(known, "normalized", "left")
    verdict = F.when(~F.col("valid"), "INVALID").when((F.col("nth") > 1) | F.col("known"), "DUPLICATE").otherwise("NEW")
    return marked.select("row_id", "normalized", verdict.alias("verdict"))


def header_column(headers: DataFrame) -> DataFrame:
    """Which field each header of a catalogue names, if any."""
    key = header_key(F.col("header"))
    out = F.lit(None).cast("string")
    for field, names in reversed(HEADERS.items()):
        out = F.when(key.isin(*names), field).otherwise(out)
    return headers.withColumn("field", out)
