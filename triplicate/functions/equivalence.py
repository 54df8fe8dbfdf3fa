"""Whether two item codes, or two items with their descriptions and sizes, are the same thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplicate.functions import dimensions
from triplicate.functions.text import MARKS, constants, decomposed, known, normalize_sku, normalize_text, once, sku_tokens, specified

#: Tokens of a code, and words of a description, that give a side.
LEFT, RIGHT = ("L", "LH", "LEFT", "BLL"), ("R", "RH", "RIGHT", "BLR")

#: Words that name a kind of item, and words that say nothing.
ANCHORS = (
    "BASE", "WALL", "TALL", "VANITY", "SINK", "DRAWER", "DOOR", "BUTT", "FLUSH", "PANEL", "HUTCH", "COLUMN",
    "PENINSULA", "WASTE", "BASKET", "FILLER", "CORNER", "SPICE", "RACK", "TRAY", "ROLLOUT", "END", "EXTENDED",
    "OVEN", "MICROWAVE", "BLIND", "ANGLE", "DIAGONAL", "FRAME", "GLASS",
)
STOPWORDS = (
    "THE", "AND", "OR", "IN", "ON", "AT", "TO", "FOR", "WITH", "BY", "OF",
    "A", "AN", "EA", "EACH", "PC", "PCS", "CABINET", "YORKTOWNE", "KITCHEN",
)

#: What :func:`with_features` adds to an item; pairs are judged by these alone.
FEATURES = ("sku", "tokens", "parts", "compact", "kind", "text", "numbers", "text_numbers", "as_digits", "sides", "words", "letters", "size_", "sub")


def codes_differ(one: Column, other: Column) -> Column:
    """Whether two codes as written are given and don't mean the same."""
    # Equal without marks is enough, and most often so.
    bare = lambda c: F.translate(F.upper(c), MARKS, "")
    alike = (bare(one) == bare(other)) & (bare(one) != "")
    pair = known({"a": normalize_sku(one), "b": normalize_sku(other)}, lambda x: known({"a": _as_code(x["a"]), "b": _as_code(x["b"])}, lambda y: ~codes_equal(y["a"], y["b"])))
    return specified(one) & specified(other) & (one != other) & F.when(alike, False).otherwise(pair)


def _array(*values: str) -> Column:
    return constants(*values)


def _all(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))


def with_features(items: DataFrame, sku: str = "raw_sku", substitution: str | None = None, size: str = "dimensions") -> DataFrame:
    """Adds a struct ``f`` with everything about an item that comparisons need, computed once for each item."""
    said = F.concat(
        F.when(F.col("__x.text").rlike("\\b(?:LEFT|LH)\\b"), _array("L")).otherwise(F.array().cast("array<string>")),
        F.when(F.col("__x.text").rlike("\\b(?:RIGHT|RH)\\b"), _array("R")).otherwise(F.array().cast("array<string>")),
    )
    kind = F.when(F.col("category").isin("APPLIANCE", "COMMERCIAL_CHARGE", "ARCHITECTURAL_ANNOTATION"), F.col("category")).when(
        F.coalesce(F.col("category"), F.lit("")).isin("", "UNKNOWN"), None
    )
    kind = F.when(F.coalesce(F.col("category"), F.lit("UNKNOWN")).isin("UNKNOWN", ""), None).otherwise(F.coalesce(kind, F.lit("COMPONENT")))
    code, text = F.col("__x.code"), F.col("__x.text")
    first = once(items, "__x", F.struct(normalize_sku(F.col(sku)).alias("code"), normalize_text(F.col("description")).alias("text")))
    first = once(first, "__t", F.when(code.isNotNull(), sku_tokens(code)).otherwise(F.array().cast("array<string>")))
    made = F.struct(
            code.alias("sku"),
            F.col("__t").alias("tokens"),
            decomposed(F.col("__t")).alias("parts"),
            F.array_join("__t", "").alias("compact"),
            kind.alias("kind"),
            F.coalesce(text, F.lit("")).alias("text"),
            _all(code, "[0-9]+").alias("numbers"),
            _all(text, "[0-9]+").alias("text_numbers"),
            _all(F.translate(code, "S", "5"), "[0-9]+").alias("as_digits"),
            F.array_union(F.array_intersect(F.col("__t"), _array(*LEFT, *RIGHT)), said).alias("sides"),
            F.array_except(_all(text, "[A-Z0-9/]+"), _array(*STOPWORDS)).alias("words"),
            _all(code, "[A-Z]").alias("letters"),
            F.col(size).alias("size_"),
            (normalize_sku(F.col(substitution)) if substitution else F.lit(None).cast("string")).alias("sub"),
    )
    return once(first, "f", made).drop("__t", "__x")


def _within(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def _sides_conflict(a: Column, b: Column) -> Column:
    left, right = _array(*LEFT), _array(*RIGHT)
    on = F.arrays_overlap
    return (on(a, left) & on(b, right)) | (on(a, right) & on(b, left))


def code_match(a: Column, b: Column) -> Column:
    """How two codes match, from features: EXACT_MATCH, DELIMITER_EQUIVALENCE, COMPACT_EQUIVALENCE, ORIENTATION_MISMATCH,
    TOKEN_SUBSET_MATCH, NO_MATCH, BOTH_EMPTY or ONE_EMPTY; the first of these that holds."""
    return (
        F.when(a["sku"].isNull() & b["sku"].isNull(), "BOTH_EMPTY")
        .when(a["sku"].isNull() | b["sku"].isNull(), "ONE_EMPTY")
        .when(a["sku"] == b["sku"], "EXACT_MATCH")
        .when((a["tokens"] == b["tokens"]) & (F.size(a["tokens"]) > 0), "DELIMITER_EQUIVALENCE")
        .when((a["compact"] == b["compact"]) & (a["compact"] != ""), "COMPACT_EQUIVALENCE")
        .when((F.size(a["parts"]) == 0) | (F.size(b["parts"]) == 0), "NO_MATCH")
        .when(_sides_conflict(a["parts"], b["parts"]), "ORIENTATION_MISMATCH")
        .when(_within(a["parts"], b["parts"]) | _within(b["parts"], a["parts"]), "TOKEN_SUBSET_MATCH")
        .otherwise("NO_MATCH")
    )


CODE_EQUAL = ("EXACT_MATCH", "DELIMITER_EQUIVALENCE", "COMPACT_EQUIVALENCE", "TOKEN_SUBSET_MATCH")


def codes_equal(a: Column, b: Column) -> Column:
    return code_match(a, b).isin(*CODE_EQUAL)


def _long(numbers: Column) -> Column:
    """Numbers of ten and more."""
    return F.filter(numbers, lambda n: F.length(F.regexp_replace(n, "^0+", "")) >= 2)


def item_match(a: Column, b: Column) -> Column:
    """How two items match, the second of them possibly a substitution for the first; the first kind that holds.

    EXACT, NORMALIZED_EXACT, EXPLICIT_SUBSTITUTION and MANUFACTURER_VARIANT mean the same item; CATEGORY_MISMATCH,
    BOTH_EMPTY, ONE_EMPTY, AMBIGUOUS, DIMENSION_CONFLICT, ORIENTATION_MISMATCH and NO_MATCH don't.
    """
    on = F.arrays_overlap
    facts = {
        "codes": code_match(a, b),
        "sized": a["size_"].isNotNull() & b["size_"].isNotNull(),
        "substitutes": F.coalesce(b["sub"].isNotNull() & a["sku"].isNotNull() & codes_equal(a, _as_code(b["sub"])), F.lit(False)),
    }

    def by_code(x: Column) -> Column:
        contained = F.contains(a["text"], b["text"]) | F.contains(b["text"], a["text"])
        unfit = x["sized"] & ~dimensions.equivalent(a["size_"], b["size_"])
        return (
            F.when(a["kind"] != b["kind"], "CATEGORY_MISMATCH")
            .when(x["substitutes"], "EXPLICIT_SUBSTITUTION")
            .when(x["codes"] == "BOTH_EMPTY", F.when((a["text"] != "") & (b["text"] != "") & contained, "NORMALIZED_EXACT").otherwise("BOTH_EMPTY"))
            .when(x["codes"] == "ONE_EMPTY", "ONE_EMPTY")
            .when(x["codes"] == "EXACT_MATCH", "EXACT")
            .when(x["codes"].isin("DELIMITER_EQUIVALENCE", "COMPACT_EQUIVALENCE"), "NORMALIZED_EXACT")
            .when(x["codes"] == "TOKEN_SUBSET_MATCH", F.when(unfit, "AMBIGUOUS").otherwise("NORMALIZED_EXACT"))
        )

    def by_description() -> Column:
        values = {
            "long_a": _long(a["numbers"]),
            "long_b": _long(b["numbers"]),
            "all_a": F.array_union(a["numbers"], a["text_numbers"]),
            "all_b": F.array_union(b["numbers"], b["text_numbers"]),
            "common": F.array_intersect(a["words"], b["words"]),
            "letters": F.size(F.array_intersect(a["letters"], b["letters"])) / F.greatest(F.size(F.array_union(a["letters"], b["letters"])), F.lit(1)),
        }

        def shared(x: Column) -> Column:
            long_shared = on(x["long_a"], x["all_b"]) | on(x["long_b"], x["all_a"])
            read = on(F.array_union(a["as_digits"], a["text_numbers"]), F.array_union(b["as_digits"], b["text_numbers"]))
            fit = a["size_"].isNotNull() & b["size_"].isNotNull() & dimensions.equivalent(a["size_"], b["size_"])
            more = {"long_shared": long_shared, "backed": on(a["numbers"], b["numbers"]) | fit | read | long_shared, "common": x["common"]}
            return known(
                more,
                lambda y: F.when((F.size(x["long_a"]) > 0) & (F.size(x["long_b"]) > 0) & ~y["long_shared"], "DIMENSION_CONFLICT")
                .when(_sides_conflict(a["sides"], b["sides"]), "ORIENTATION_MISMATCH")
                .when(y["backed"] & (on(y["common"], _array(*ANCHORS)) | (F.size(y["common"]) >= 2)) & (x["letters"] >= 0.6), "MANUFACTURER_VARIANT")
                .when((F.size(y["common"]) >= 3) & ~y["backed"], "AMBIGUOUS")
                .otherwise("NO_MATCH"),
            )

        return known(values, shared)

    return known(facts, lambda x: F.coalesce(by_code(x), by_description()))


def _as_code(sub: Column) -> Column:
    """A substitution's code with the features that codes are compared by."""
    made = lambda x: F.struct(x["sku"].alias("sku"), x["tokens"].alias("tokens"), decomposed(x["tokens"]).alias("parts"), F.array_join(x["tokens"], "").alias("compact"))
    return known({"sku": sub, "tokens": sku_tokens(sub)}, made)


ITEM_EQUAL = ("EXACT", "NORMALIZED_EXACT", "EXPLICIT_SUBSTITUTION", "MANUFACTURER_VARIANT")


def _tagged(keys: Column, tag: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(tag), k))


def _longest(tokens: Column) -> Column:
    """The longest token, the greatest of several, as an array; empty without tokens."""
    ranked = F.transform(tokens, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))
    return F.when(F.size(tokens) > 0, F.array(F.array_max(ranked)["t"])).otherwise(F.array().cast("array<string>"))


#: Widths are sought in bins so wide, this far to either side: somewhat more than what counts as equal.
_BIN, _ASIDE = 4 * dimensions.TOLERANCE, 1.5 * dimensions.TOLERANCE


def _crossed(words: Column, marks: Column) -> Column:
    return F.flatten(F.transform(words, lambda w: F.transform(marks, lambda m: F.concat(F.lit("v"), w, F.lit("#"), m))))


def _variant_keys(f: Column) -> dict[str, Column]:
    """Words, and marks that cross with them to all keys and to own ones under which variants meet.

    Variants meet by a word of the description together with a number or a size. They share a word that names a kind, or
    two others; of those two at least one is not a unit's last in a fixed order, so the last is left out. They also share
    a number of two digits, or any number or size that backs them. Where no number is shared, one of their codes has no
    number of two digits, and sizes that don't contradict back them: equal openings, widths close to one another, or an
    unknown width. Only units of such a code then have these keys as own. Without words there are no marks either.
    """
    none = F.array().cast("array<string>")
    kinds = F.array_intersect(f["words"], _array(*ANCHORS))
    others = F.array_sort(F.transform(F.array_except(f["words"], _array(*ANCHORS)), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    words = known({"kinds": kinds, "others": others}, lambda x: F.concat(x["kinds"], F.transform(F.slice(x["others"], 1, F.greatest(F.size(x["others"]) - 1, F.lit(0))), lambda o: o["w"])))
    numbers = F.transform(F.array_distinct(F.concat(f["numbers"], f["text_numbers"], f["as_digits"])), lambda n: F.concat(F.lit("n"), n))
    size = f["size_"]
    width = F.when(~F.isnan(size["width"]), size["width"])
    bin_ = lambda x: F.concat(F.lit("w"), F.floor(x / _BIN).cast("string"))
    opening = F.when(size["opening"] != "", F.array(F.concat(F.lit("o"), F.upper(size["opening"]))))
    of_size = F.concat(_array("any"), F.array(F.coalesce(bin_(width), F.lit("no"))), F.coalesce(opening, none))
    sought = F.when(width.isNull(), _array("any")).otherwise(
        F.concat(F.array_distinct(F.array(bin_(width - _ASIDE), bin_(width), bin_(width + _ASIDE))), _array("no"), F.coalesce(opening, none))
    )
    sized, worded = size.isNotNull(), F.size(f["words"]) > 0
    return {
        "words": F.when(worded, words).otherwise(none),
        "numbers": F.when(worded, numbers).otherwise(none),
        "of_size": F.when(worded & sized, of_size).otherwise(none),
        "sought": F.when(worded & sized & (F.size(_long(f["numbers"])) == 0), sought).otherwise(none),
    }


def block_keys(f: Column) -> Column:
    """A struct of ``keys`` and ``own``, some of these, as hashes: any two matching items share a key that is one's own.

    Equal codes share the code, or its letters without marks. Where one code's parts lie within the other's, its
    longest token does. Variants share a word together with a number or size. Items without a code share the key for that.
    """
    none = F.array().cast("array<string>")
    sub = sku_tokens(f["sub"])
    has = f["sub"].isNotNull()
    whole = F.concat(F.array(F.coalesce(f["sku"], F.lit("")), f["compact"]), F.when(has, F.array(f["sub"], F.array_join(sub, ""))).otherwise(none))
    coded = _tagged(F.concat(whole, _longest(f["tokens"]), F.when(has, _longest(sub)).otherwise(none)), "c")
    parts = _tagged(F.concat(f["parts"], F.when(has, decomposed(sub)).otherwise(none)), "c")
    hashed = lambda texts: F.array_distinct(F.transform(texts, lambda k: F.xxhash64(k)))

    def made(x: Column) -> Column:
        own = F.concat(x["coded"], _crossed(x["words"], F.concat(x["numbers"], x["sought"])))
        every = F.concat(own, x["parts"], _crossed(x["words"], F.concat(x["numbers"], x["of_size"])))
        return F.struct(hashed(every).alias("keys"), hashed(own).alias("own"))

    return known({"coded": coded, "parts": parts, **_variant_keys(f)}, made)
