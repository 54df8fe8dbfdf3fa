"""Normalization of texts, item codes and quantities, as column expressions that Spark compiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that mean that nothing is specified.
UNSPECIFIED = ("", "NONE", "NULL", "N/A", "-")

#: Names of materials, species and drawer boxes that stand for another one.
SPEC_ALIASES = {
    "PLY": "PLYWOOD",
    "FB": "FURNITURE BOARD",
    "FURNITUREBOARD": "FURNITURE BOARD",
    "SOLID": "SOLID WOOD",
    "PARTICLEBOARD": "PARTICLE BOARD",
    "QS OAK": "QUARTER SAWN OAK",
    "QS-OAK": "QUARTER SAWN OAK",
    "QSOAK": "QUARTER SAWN OAK",
    "QUARTERSAWN OAK": "QUARTER SAWN OAK",
    "HARD MAPLE": "MAPLE",
    "DT": "DOVETAIL",
    "SOFT CLOSE": "SOFT-CLOSE",
    "SOFTCLOSE": "SOFT-CLOSE",
    "SC": "SOFT-CLOSE",
    "SIDEMOUNT": "SIDE MOUNT",
}

#: Finishes known to be the same colour.
FINISH_ALIASES = {
    "JAMESTOWN PHW DEWDROP": "DEWDROP",
    "JAMESTOWN PHW DEWDROP PLY": "DEWDROP",
    "JAMESTOWN PHW DEWDROP PLY B": "DEWDROP",
    "MONROE PHW SAGEWOOD": "SAGEWOOD",
    "MONROE PHW SAGEWOOD PLY": "SAGEWOOD",
    "MONROE PHW SAGEWOOD PLY B": "SAGEWOOD",
    "HAMPTON PHW ALPINE": "ALPINE",
    "HAMPTON PHW ALPINE PLY": "ALPINE",
    "HAMPTON PHW ALPINE PLY B": "ALPINE",
    "ATLANTA BIRCH COCOA": "COCOA",
    "APEX MAPLE DRIFT": "DRIFT",
    "APEX OAK JUTE": "JUTE",
    "APEX OAK JUTE FX": "JUTE",
}

#: Words of finishes and doors that say nothing about which one it is, among those of four letters or more.
CONFIG_STOPWORDS = ("with", "door", "style", "finish", "hood", "valance", "construction")

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = "(?U)\\s+"
#: All characters that ``(?U)\\s`` matches.
_BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: What stands between the parts of a code.
MARKS = _BLANKS + "-_./"


def constants(*values: str) -> Column:
    """An array of fixed texts. One call to the JVM makes it, where a literal for each would take as many calls as there are texts."""
    return F.expr(f"array({', '.join(map(_quoted, values))})")


def _quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def known(values: dict[str, Column], use: Callable[[Column], Column]) -> Column:
    """``use`` of a struct of these values, each computed once however often it stands in the result."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), use), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once however often it is used.

    It passes through a generator of one row; else the optimizer would write the value out anew wherever a field of it is
    used. The generator gets a column, since Spark compiles no expression that stands within a generator, and is an outer
    one, since for others Spark filters by the array's size first, which would compute the value a second time.
    """
    return df.withColumn(name, F.array(value)).withColumn(name, F.explode_outer(name))


def _bare(c: Column) -> Column:
    """True only for texts with a visible ASCII character at both ends, never null."""
    last = F.substring(c, -1, 1)
    return F.coalesce((c >= "!") & (c < "\x7f") & (last >= "!") & (last < "\x7f"), F.lit(False))


def trimmed(c: Column) -> Column:
    """Without white space around, any kind of it counted."""
    # Trimming by a set of characters takes long; most texts have nothing to trim.
    c = c.cast("string")
    return F.when(_bare(c), c).otherwise(F.btrim(c, F.lit(_BLANKS)))


def _says_nothing(upper: Column) -> Column:
    return upper.isin(*UNSPECIFIED)


def specified(c: Column) -> Column:
    """Whether a text says anything, never null."""
    # All that says nothing is short.
    long = _bare(c) & (F.length(c) > max(map(len, UNSPECIFIED)))
    return c.isNotNull() & (long | ~_says_nothing(F.upper(trimmed(c))))


def normalize_text(c: Column) -> Column:
    """Upper case with single spaces; null where nothing is specified."""
    # No such text holds white space, so that need not be made single before asking.
    bare = trimmed(c)
    return F.when(_says_nothing(F.upper(bare)), None).otherwise(F.upper(F.regexp_replace(bare, _SPACE, " ")))


def normalize_sku(c: Column) -> Column:
    """An item code in upper case with single spaces, its marks kept; null where nothing is specified."""
    return normalize_text(c)


def sku_tokens(c: Column) -> Column:
    """Parts of a code between spaces, hyphens, underscores, dots and slashes."""
    parts = F.filter(F.split(F.upper(trimmed(c)), "(?U)[\\s\\-_./]+"), lambda t: t != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def decomposed(tokens: Column) -> Column:
    """The tokens and, besides, their runs of letters and of digits."""
    runs = F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit("[A-Z]+|[0-9]+"), F.lit(0))))
    return F.array_union(tokens, runs)


def _alias(base: Column, aliases: dict[str, str]) -> Column:
    named = F.expr(f"map({', '.join(_quoted(x) for pair in aliases.items() for x in pair)})")
    return F.coalesce(F.try_element_at(named, base), base)


def normalize_spec(c: Column) -> Column:
    """A material, species or drawer box by its one name."""
    return _alias(normalize_text(c), SPEC_ALIASES)


def canonical_finish(c: Column) -> Column:
    return _alias(normalize_text(c), FINISH_ALIASES)


def alike(a: Column, b: Column) -> Column:
    """Whether two texts agree but for capitals, never null. Normalized they are then equal, or both null, so that most pairs need no more."""
    return F.coalesce(F.upper(a) == F.upper(b), F.lit(False))


def same_finish(a: Column, b: Column) -> Column:
    """True if both are specified and of one colour, else false, never null."""
    return F.when(alike(a, b), specified(a)).otherwise(F.coalesce(canonical_finish(a) == canonical_finish(b), F.lit(False)))


def normalize_quantity(c: Column) -> Column:
    """The first run of digits of a text as an integer; null where there is none. A sign is not read."""
    return F.expr("cast(null as int)") if c is None else F.regexp_extract(normalize_text(c), "([0-9]+)", 1).try_cast("int")


def significant_tokens(c: Column) -> Column:
    """Lower-case words of four letters or more that tell a finish or door from another."""
    # By one pattern and without lambdas, which Spark does not compile. Letters of other scripts never become Latin ones here.
    upper = F.upper(trimmed(c))
    plain = F.when(upper.isin(*UNSPECIFIED), "").otherwise(F.coalesce(F.translate(upper, _CAPITALS, _CAPITALS.lower()), F.lit("")))
    return F.array_except(F.regexp_extract_all(plain, F.lit("[a-z0-9]{4,}"), F.lit(0)), constants(*CONFIG_STOPWORDS))


def display_number(position: Column, rooms: bool) -> Column:
    """``display_N`` of a position; rooms count as displays where ``rooms`` is set; null without a number."""
    n = F.regexp_extract(position, "(?i)(?:display|room)\\s*([0-9]+)" if rooms else "(?i)display\\s*([0-9]+)", 1)
    return F.when(n != "", F.concat(F.lit("display_"), n))


def leading_line_number(c: Column) -> Column:
    """The whole number of a line label such as ``*12``; decimals have none."""
    plain = F.regexp_replace(trimmed(c), "^\\*+", "")
    return F.when(plain.rlike("^[0-9]+$"), plain.try_cast("int"))


def header_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def safe_filename(c: Column) -> Column:
    """A file name without parent references and slashes, other unusual characters as underscores."""
    return F.regexp_replace(F.regexp_replace(c, "\\.\\.|[/\\\\]", ""), "[^A-Za-z0-9._-]", "_")


def parse_flag(c: Column) -> Column:
    """Whether a text says yes; an empty one does."""
    return F.coalesce(F.lower(trimmed(c)).isin("", "1", "true", "yes", "y"), F.lit(True))
