"""Sizes of items: parsing of texts and comparison by axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplicate.functions.text import known, specified, trimmed

TYPE = "struct<width:double,height:double,depth:double,opening:string,axis_certainty:string,raw:string>"
_NUMBER = "([0-9]+(?:\\.[0-9]+)?)"
_WHOLE = "([0-9]+)\\s*([WHD])?"
#: Inches by which sizes may differ.
TOLERANCE = 0.05


def _axis(text: Column, letters: str) -> Column:
    return _double(F.regexp_extract_all(text, F.lit(f"(?i){_NUMBER}\\s*(?:{letters})"), F.lit(1)))


def _double(found: Column, k: int = 1) -> Column:
    """The k-th of the texts found; null without it. An empty text would be cast by way of an exception, which is slow."""
    return F.get(found, F.lit(k - 1)).try_cast("double")


def parse(raw: Column) -> Column:
    """Width, height, depth, opening, how certain the axes are, and the text.

    A number before an axis's letter is that axis; numbers without letters are width, height and depth in turn; one
    number alone is a width. Null where nothing is specified or no number is found.
    """
    unquoted = F.translate(raw, "\\\"'", "")
    none = F.lit(None)

    def made(w, h, d, o, certainty: str) -> Column:
        return F.struct(
            w.cast("double").alias("width"), h.cast("double").alias("height"), d.cast("double").alias("depth"),
            o.cast("string").alias("opening"), F.lit(certainty).alias("axis_certainty"), trimmed(F.replace(raw, F.lit("\\"), F.lit(""))).alias("raw"),
        )

    def read(x: Column) -> Column:
        nth = lambda k: _double(x["numbers"], k)
        width, height, depth = x["width"], x["height"], x["depth"]
        return (
            F.when(F.upper(x["text"]).contains("OPENING"), made(nth(1), none, none, x["text"], "EXPLICIT"))
            .when(F.coalesce(width, height, depth).isNotNull(), made(width, height, depth, none, "EXPLICIT"))
            .when(F.size(x["numbers"]) >= 2, made(nth(1), nth(2), nth(3), none, "UNLABELED"))
            .when(F.size(x["numbers"]) == 1, made(nth(1), none, none, none, "SINGLE_VALUE"))
        )

    def numbered(x: Column) -> Column:
        numbers = lambda text, pattern=_NUMBER, group=1: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        any_ = {"text": x["text"], "numbers": numbers(x["text"])}
        any_ |= {"width": _axis(x["text"], "W|WIDTH"), "height": _axis(x["text"], "H|HEIGHT"), "depth": _axis(x["text"], "D|DEPTH")}
        # Without decimals, each number's letter is the one that follows it, so that one pattern finds all axes.
        capital = F.translate(x["text"], "whd", "WHD")
        whole = {"text": x["text"], "numbers": numbers(capital, _WHOLE), "letters": numbers(capital, _WHOLE, 2)}
        at = lambda y, letter: F.get(y["numbers"], F.array_position(y["letters"], letter).cast("int") - 1).try_cast("double")
        axes = lambda y: {"width": at(y, "W"), "height": at(y, "H"), "depth": at(y, "D")}
        plain = known(whole, lambda y: known({"text": y["text"], "numbers": y["numbers"], **axes(y)}, read))
        return F.when(F.contains(x["text"], F.lit(".")), known(any_, read)).otherwise(plain)

    return F.when(specified(raw), known({"text": unquoted}, lambda x: known({"text": trimmed(x["text"])}, numbered)))


def with_sizes(rows: DataFrame, raw: str = "size_text", name: str = "dimensions") -> DataFrame:
    """Rows with :func:`parse` of a column. It goes from one column to the next without lambdas, so that Spark compiles it."""
    t, numbers = F.col("__text"), F.col("__numbers")
    rows = rows.withColumn("__text", F.when(specified(F.col(raw)), trimmed(F.translate(raw, "\\\"'", ""))))
    every = lambda text, pattern, group=1: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    decimal, capital = F.contains(t, F.lit(".")), F.translate(t, "whd", "WHD")
    rows = rows.withColumns({"__numbers": F.when(decimal, every(t, _NUMBER)).otherwise(every(capital, _WHOLE)), "__letters": F.when(~decimal, every(capital, _WHOLE, 2))})
    at = lambda letter: F.get(numbers, F.array_position("__letters", letter).cast("int") - 1).try_cast("double")
    axes = {"width": "W|WIDTH", "height": "H|HEIGHT", "depth": "D|DEPTH"}
    rows = rows.withColumns({f"__{a}": F.when(decimal, _axis(t, letters)).otherwise(at(letters[0])) for a, letters in axes.items()})
    given = [F.col(f"__{a}") for a in axes]
    opening = F.upper(t).contains("OPENING")
    explicit = F.coalesce(*given).isNotNull()
    several = F.size(numbers) >= 2
    certainty = F.when(opening | explicit, "EXPLICIT").when(several, "UNLABELED").otherwise("SINGLE_VALUE")
    size = F.struct(
        F.when(opening | ~explicit, _double(numbers)).otherwise(given[0]).alias("width"),
        *(F.when(opening, None).when(explicit, c).when(several, _double(numbers, k)).alias(a) for k, (a, c) in enumerate(zip(("height", "depth"), given[1:], strict=True), 2)),
        F.when(opening, t).alias("opening"), certainty.alias("axis_certainty"), trimmed(F.replace(F.col(raw), F.lit("\\"), F.lit(""))).alias("raw"),
    )
    return rows.withColumn(name, F.when(opening | (F.size(numbers) > 0), size)).drop("__text", "__numbers", "__letters", *(f"__{a}" for a in axes))


def parse_fields(fields: Column) -> Column:
    """A size given by fields, a map of names to texts: long, short and capital names, quotes and units left aside.

    Without axes and opening, the first text that isn't blank is parsed by :func:`parse`; null where that fails too.
    """
    named = lambda *names: F.coalesce(*(F.when(fields[n] != "", fields[n]) for n in names))
    number = lambda c: _double(F.regexp_extract_all(F.regexp_replace(c, "[\\\\\"']", ""), F.lit(_NUMBER), F.lit(1)))
    opening = trimmed(F.replace(named("opening", "Opening"), F.lit("\\"), F.lit("")))
    axes = {a: number(named(a, a[0], a.capitalize(), a[0].upper())) for a in ("width", "height", "depth")}
    whole = F.struct(*(c.alias(a) for a, c in axes.items()), opening.alias("opening"), F.lit("EXPLICIT").alias("axis_certainty"), F.to_json(fields).alias("raw"))
    text = F.try_element_at(F.filter(F.map_values(fields), lambda v: trimmed(v) != ""), F.lit(1))
    return F.when(F.coalesce(*axes.values(), F.when(opening != "", 0.0)).isNotNull(), whole).otherwise(parse(text))


def reason(a: Column, b: Column) -> Column:
    """Why two parsed sizes agree or not. Only ``AXIS_..._MISMATCH`` and an unequal opening width contradict."""
    both = lambda axis: a[axis].isNotNull() & b[axis].isNotNull()
    out = F.when(a.isNull() & b.isNull(), "BOTH_UNSPECIFIED").when(a.isNull() | b.isNull(), "ONE_UNSPECIFIED")
    openings = (a["opening"] != "") & (b["opening"] != "")
    out = out.when(openings & (F.upper(a["opening"]) == F.upper(b["opening"])), "OPENING_MATCH")
    out = out.when(openings & both("width"), F.when(a["width"] == b["width"], "OPENING_WIDTH_MATCH").otherwise("OPENING_WIDTH_MISMATCH"))
    for axis in ("width", "height", "depth"):
        out = out.when(both(axis) & (F.abs(a[axis] - b[axis]) > TOLERANCE), f"AXIS_{axis.upper()}_MISMATCH")
    out = out.when(both("width") | both("height") | both("depth"), "EXPLICIT_AXES_MATCH")
    plain = lambda s: F.regexp_replace(F.upper(s["raw"]), "(?U)[\\s\"'\\-]+", "")
    out = out.when((plain(a) == plain(b)) & (plain(a) != ""), "RAW_NORMALIZED_MATCH")
    return out.otherwise("INSUFFICIENT_DATA_TO_CONTRADICT")


def equivalent(a: Column, b: Column) -> Column:
    """False only if both are specified and contradict one another, that is where :func:`reason` ends with MISMATCH."""
    both = lambda axis: a[axis].isNotNull() & b[axis].isNotNull()
    openings = F.coalesce((a["opening"] != "") & (b["opening"] != ""), F.lit(False))
    apart = F.lit(False)
    for axis in ("width", "height", "depth"):
        apart = apart | (both(axis) & (F.abs(a[axis] - b[axis]) > TOLERANCE))
    by_opening = F.when(F.upper(a["opening"]) == F.upper(b["opening"]), False).when(both("width"), a["width"] != b["width"]).otherwise(apart)
    return ~F.coalesce(F.when(openings, by_opening).otherwise(apart), F.lit(False))
