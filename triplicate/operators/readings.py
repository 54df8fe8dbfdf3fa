"""Two readings of one document (by text and by sight): alignment, merging with conflicts, validation."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from triplicate.functions.dimensions import parse
from triplicate.functions.text import leading_line_number, normalize_quantity, normalize_sku, normalize_text
from triplicate.sources.scratch import cut

#: Fields that are compared besides the code, and those for which the reading by text is preferred.
FIELDS = ("quantity", "description", "finish", "door_style", "line_number", "unit_price", "total_price", "dimensions")
TEXT_FIRST = ("sku", "quantity", "price", "unit_price", "total_price", "line_number", "dimensions", "code", "item_code")
LARGE_QUANTITY, LONG_CODE = 500, 18


#: Letters and digits that are read for one another.
CONFUSED = ("0O", "1I", "1L", "5S", "8B", "2Z")
#: Letters of a code that may be another, from its start, and how many of them at once.
POSITIONS, SUBSTITUTIONS = 8, 2
#: What page (2), description (2) and quantity (1) must come to before rows whose codes don't settle it are paired.
LEAST_EVIDENCE, ALIKE = 3, 0.6


def spellings(code: str | None) -> list[str]:
    """The code and what it may have been, had up to ``SUBSTITUTIONS`` of its letters been misread."""
    if not code:
        return []
    other: dict[str, str] = {}
    for a, b in CONFUSED:
        other[a], other[b] = other.get(a, "") + b, other.get(b, "") + a
    at = [i for i, c in enumerate(code) if c in other][:POSITIONS]
    found, last = {code}, {code}
    for _ in range(SUBSTITUTIONS):
        last = {s[:i] + c + s[i + 1 :] for s in last for i in at if s[i] == code[i] for c in other[code[i]]}
        found |= last
    return sorted(found)


def likeness(a: str | None, b: str | None) -> float:
    """How alike two texts are, from 0 to 1, by the longest blocks that they share; 0 if one says nothing."""
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def alike(a: str | None, b: str | None) -> bool:
    """Whether two texts are alike enough; most that aren't are told by their lengths and letters alone."""
    if not a or not b:
        return False
    if a == b:
        return True
    if 2 * min(len(a), len(b)) < ALIKE * (len(a) + len(b)):
        return False
    match = SequenceMatcher(None, a, b)
    return match.quick_ratio() >= ALIKE and match.ratio() >= ALIKE


def _same(x, y) -> bool:
    return x is not None and x == x and x == y


def paired_by_evidence(one: list[tuple], other: list[tuple]) -> list[tuple[int, int]]:
    """Pairs of rows (ord, page, text, quantity) of most evidence first, each row once; ties in the rows' order.

    From most evidence to least, rows in order take the first free row that agrees with them: on page, text and quantity,
    then on page and text, then on page and quantity or text and quantity. What agrees on more and is still free would
    have been taken before. So rows wait in queues by what they say, and only texts are compared, each pair of them once.
    """
    by: dict[tuple, list[int]] = defaultdict(list)
    for ord_, page, text, count in sorted(other, key=lambda r: r[0], reverse=True):
        for key in ((0, page, text, count), (1, page, text), (2, page, count), (3, text, count)):
            by[key].append(ord_)
    texts = {r[2] for r in other}
    like: dict[str | None, list[str | None]] = {t: [x for x in texts if alike(t, x)] for t in {r[2] for r in one}}
    taken: tuple[set, set] = (set(), set())

    def head(key: tuple) -> int | None:
        queue = by.get(key)
        while queue and queue[-1] in taken[1]:
            queue.pop()
        return queue[-1] if queue else None

    def wanted(level: int, page, text, count) -> Iterator[tuple]:
        paged, counted = _same(page, page), _same(count, count)
        if level < 3 and paged and (counted or level == 2):
            yield from ((0, page, t, count) if level == 1 else (1, page, t) for t in like[text])
        elif level == 3 and counted:
            if paged:
                yield (2, page, count)
            yield from ((3, t, count) for t in like[text])

    out = []
    for level in (1, 2, 3):
        for ord_, *said in sorted(one, key=lambda r: r[0]):
            if ord_ not in taken[0]:
                found = min((v for v in map(head, wanted(level, *said)) if v is not None), default=None)
                if found is not None:
                    taken[0].add(ord_)
                    taken[1].add(found)
                    out.append((ord_, found))
    return out


def _greedy(scored: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Pairs of most evidence first, each row once; ties in the rows' order."""
    taken: tuple[set, set] = (set(), set())
    out = []
    for _, o, v in sorted(scored, key=lambda t: (-t[0], t[1], t[2])):
        if o not in taken[0] and v not in taken[1]:
            taken[0].add(o)
            taken[1].add(v)
            out.append((o, v))
    return out


def _facts(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What rows are paired by; ``ord`` tells the rows of a document apart."""
    return rows.select(
        *keys, "ord", normalize_sku(F.col("sku")).alias("code"), F.col("page_number").cast("long").alias("page"),
        normalize_text(F.col("description")).alias("said"), normalize_quantity(F.col("quantity").cast("string")).alias("count"),
    )


def _grouped(rows: DataFrame, by: list[str], rest: list[str], pair: Callable[[list[tuple]], list[tuple[int, int]]], basis: str, schema: StructType) -> DataFrame:
    """Pairs within each value of ``by``, as rows stream through a value at a time; ``schema`` begins with leading ones of ``by``."""
    arrow = to_arrow_schema(schema)
    kept = len(schema) - 3

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*by, *rest)), strict=True):
                if row[: len(by)] != held:
                    out += [(*held[:kept], x, y, basis) for x, y in pair(group)]
                    held, group = row[: len(by)], []
                group.append(row[len(by) :])
            yield made(out)
        yield made([(*held[:kept], x, y, basis) for x, y in pair(group)])

    return rows.select(*by, *rest).repartition(*by).sortWithinPartitions(*by, *rest[:2]).mapInArrow(run, schema)


def align(ocr: DataFrame, vision: DataFrame, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Rows of both readings side by side (structs ``o`` and ``v``) with a ``basis``; what has no counterpart stands alone.

    A code that occurs once in each reading is a pair (EXACT_CODE). Where it repeats, rows are paired by evidence of page,
    description and quantity (REPEATED_CODE), never by their order. What is left is paired on the same page by codes
    that may have been misread (MISREAD_CODE), with such evidence too. Every row comes out exactly once. One shuffle by
    document and code brings both readings together; rows of a code that repeats are compared where they can agree.
    """
    facts = cut(_facts(ocr, keys).withColumn("side", F.lit(0)).unionByName(_facts(vision, keys).withColumn("side", F.lit(1))))
    by_code = Window.partitionBy(*keys, "code")
    counted = facts.where("code is not null").withColumns({f"n{side}": F.count_if(F.col("side") == side).over(by_code) for side in (0, 1)})
    met = counted.where("n0 > 0 and n1 > 0")
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("ord")))
    exact = met.where("n0 = 1 and n1 = 1").groupBy(*keys, "code").agg(at(0).alias("o_ord"), at(1).alias("v_ord")).select(*keys, "o_ord", "v_ord", F.lit("EXACT_CODE").alias("basis"))
    ord_ = facts.schema["ord"].dataType
    found = StructType([*facts.select(*keys).schema, StructField("o_ord", ord_), StructField("v_ord", ord_), StructField("basis", StringType())])

    def repeated(group: list[tuple]) -> list[tuple[int, int]]:
        return paired_by_evidence(*([r[1:] for r in group if r[0] == side] for side in (0, 1)))

    pairs = cut(exact.unionByName(_grouped(met.where("n0 > 1 or n1 > 1"), [*keys, "code"], ["side", "ord", "page", "said", "count"], repeated, "REPEATED_CODE", found)))

    done = pairs.select(*keys, F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).alias("ord")) for side, c in enumerate(("o_ord", "v_ord"))))).alias("x")).select(*keys, "x.*")
    rest = facts.where("code is not null and page is not null").join(done, [*keys, "side", "ord"], "left_anti")
    left, right = rest.where("side = 0"), rest.where("side = 1")

    @F.pandas_udf("array<string>")
    def misread(codes: pd.Series) -> pd.Series:
        return codes.map(spellings)

    @F.pandas_udf("int")
    def evidence(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([2 + 2 * alike(w, x) + _same(y, z) for w, x, y, z in zip(a, b, c, d, strict=True)], dtype="int32")

    maybe = left.select(*keys, "page", F.col("ord").alias("o_ord"), F.col("said").alias("o_said"), F.col("count").alias("o_count"), F.explode(misread("code")).alias("code"))
    seen = right.select(*keys, "page", "code", F.col("ord").alias("v_ord"), F.col("said").alias("v_said"), F.col("count").alias("v_count"))
    scored = maybe.join(seen, [*keys, "page", "code"]).withColumn("score", evidence("o_said", "v_said", "o_count", "v_count")).where(F.col("score") >= LEAST_EVIDENCE)

    pairs = cut(pairs.unionByName(_grouped(scored, list(keys), ["score", "o_ord", "v_ord"], _greedy, "MISREAD_CODE", found)))
    rows = lambda df, name: df.select(*keys, F.col("ord").alias(f"{name}_ord"), F.struct(*df.columns).alias(name))
    with_o = rows(ocr, "o").join(pairs, [*keys, "o_ord"], "left")
    whole = with_o.join(rows(vision, "v"), [*keys, "v_ord"], "full")
    alone = F.when(F.col("o").isNull(), "VISION_ONLY").when(F.col("v").isNull(), "OCR_ONLY").otherwise(F.col("basis"))
    return whole.select(*keys, "o", "v", alone.alias("basis"))


def _norm(field: str, c: Column) -> Column:
    """A field's value as it is compared; prices, sizes and other values as they stand. A blank is none."""
    text = c.cast("string")
    if field == "sku":
        return normalize_sku(text)
    if field == "quantity":
        return normalize_quantity(text).cast("string")
    if field in ("description", "finish", "door_style", "line_number"):
        return F.when(F.length(normalize_text(text)) > 0, normalize_text(text))
    return F.when(text != "", text)


def merge(aligned: DataFrame, spatial: bool = False) -> DataFrame:
    """Each row's merged fields, its basis, the fields in conflict and whether it is VERIFIED or UNCERTAIN.

    Sight is the base; what it leaves out is filled from the text, which is no conflict. In a conflict sight is preferred
    for spatial documents, else the text in ``TEXT_FIRST`` and sight in the others. Fields that aren't compared are
    merged as well. Rows with a counterpart and no conflict are VERIFIED, rows that stand alone are not.
    """
    o, v = F.col("o"), F.col("v")
    held = [f.name for f in aligned.schema["o"].dataType.fields]
    picked, conflicts = [], []
    for f in ("sku", *FIELDS):
        if f not in held:
            continue
        a, b = _norm(f, o[f]), _norm(f, v[f])
        differ = a != b
        first, second = (o[f], v[f]) if f in TEXT_FIRST and not spatial else (v[f], o[f])
        preferred = F.coalesce(F.when(F.trim(first.cast("string")) != "", first), second)
        conflicts.append(F.when(differ, F.lit(f)))
        picked.append(F.when(differ, preferred).when(b.isNull() & a.isNotNull(), o[f]).otherwise(F.coalesce(v[f], o[f])).alias(f))
    named = {*[c for c in aligned.columns if c not in ("o", "v")], "sku", *FIELDS}
    others = [F.coalesce(v[f], o[f]).alias(f) for f in held if f not in named]
    found = F.array_compact(F.array(*conflicts))
    return aligned.select(
        *[c for c in aligned.columns if c not in ("o", "v", "basis")], *picked, *others, "basis", found.alias("conflicts"),
        F.when((F.size(found) > 0) | o.isNull() | v.isNull(), "UNCERTAIN").otherwise("VERIFIED").alias("verdict"),
    )


def issues(items: DataFrame) -> DataFrame:
    """Adds ``issues``, what is wrong with each row's code, quantity, size and confidence, in a fixed order.

    Where there is ``quantity_text`` the quantity is read from it, and a text without one is INVALID_QUANTITY. Where
    there is ``size_text``, a given text without a size is UNPARSEABLE_DIMENSIONS.
    """
    written, sized = "quantity_text" in items.columns, "size_text" in items.columns
    sku, q = normalize_sku(F.col("sku")), normalize_quantity(F.col("quantity_text")) if written else F.col("quantity")
    unread = F.col("quantity_text").isNotNull() & q.isNull() if written else F.lit(False)
    rules = [
        F.when(sku.isNull(), "EMPTY_SKU"),
        F.when((F.length(sku) > LONG_CODE) & ~F.col("sku").rlike("[-/ _+]"), "SUSPICIOUS_MERGED_SKU"),
        F.when(unread, "INVALID_QUANTITY").when(q < 0, "NEGATIVE_QUANTITY").when(q > LARGE_QUANTITY, "UNUSUALLY_LARGE_QUANTITY"),
        F.when(F.col("size_text").isNotNull() & parse(F.col("size_text")).isNull(), "UNPARSEABLE_DIMENSIONS") if sized else F.lit(None).cast("string"),
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), "OUT_OF_BOUNDS_CONFIDENCE"),
    ]
    return items.withColumn("issues", F.array_compact(F.array(*rules))).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence")))


def document_issues(documents: DataFrame, items: DataFrame, key: str, line: str, conflict: str) -> DataFrame:
    """For each document its number of items, what is wrong with it as a whole, and its verdict.

    A document with items in conflict or without items is UNCERTAIN; missing line numbers alone leave it VALID.
    """
    n = leading_line_number(F.col(line))
    seen = items.groupBy(key).agg(F.count("*").alias("n_items"), F.max(F.coalesce(conflict, F.lit(False))).alias("c"), F.count_distinct(n).alias("numbers"), (F.max(n) - F.min(n) + 1).alias("span"))
    found = F.array_compact(F.array(F.when(F.col("c"), "RECONCILIATION_CONFLICT"), F.when(F.col("n_items").isNull(), "EMPTY_EXTRACTION"), F.when(F.col("span") > F.col("numbers"), "LINE_NUMBER_GAP")))
    verdict = F.when(F.col("c") | F.col("n_items").isNull(), "UNCERTAIN").otherwise("VALID")
    return documents.select(key).join(seen, key, "left").select(key, F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), found.alias("issues"), verdict.alias("verdict"))


def line_gaps(items: DataFrame, key: str, line: str) -> DataFrame:
    """For each document the line numbers that are missing between its first and last, none for less than two lines."""
    n = leading_line_number(F.col(line))
    seen = items.withColumn("__n", n).where("__n is not null").groupBy(key).agg(F.sort_array(F.collect_set("__n")).alias("seen"))
    span = F.sequence(F.element_at("seen", 1), F.element_at("seen", -1))
    return seen.select(key, F.array_except(span, F.col("seen")).alias("missing")).where(F.size("missing") > 0)


def first_seen(items: DataFrame, keys: tuple[str, ...], order: str, fields: tuple[str, ...]) -> DataFrame:
    """One row for each key: every field the first that is given, by partial aggregation; rows without a key pass."""
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    whole = items.where(complete).groupBy(*keys).agg(*(F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields), F.max("confidence").alias("confidence"))
    return items.where(~complete).select(*keys, *fields, "confidence").unionByName(whole)


def nearest_after(left: DataFrame, right: DataFrame, key: str, page: str, within: int = 3) -> DataFrame:
    """For each page of ``left`` the nearest one of ``right`` in the same document, 1 to ``within`` pages on.

    The range is spelled out as ``within`` keys, so the join is by equality.
    """
    wanted = left.select(key, page, F.explode(F.sequence(F.col(page) + 1, F.col(page) + within)).alias("anchor"))
    found = wanted.join(right.select(key, F.col(page).alias("anchor")).distinct(), [key, "anchor"])
    return found.groupBy(key, page).agg(F.min("anchor").alias("anchor"))
