"""Values as people read them: sizes, lists and fields of JSON texts in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for nothing, texts that say nothing, and fields that aren't shown.
NOTHING = "—"
SILENT = ("", "null", "None", "undefined")
HIDDEN = ("axis_certainty", "unit", "raw")
_AXES = (("width", "W"), ("height", "H"), ("depth", "D"))


def _plain(c: Column) -> Column:
    """A field's value without backslashes, a whole number without its zeros."""
    return F.regexp_replace(F.trim(F.replace(c, F.lit("\\"), F.lit(""))), "^(-?[0-9]+)\\.0+$", "$1")


def _size(fields: Column) -> Column:
    """A size's opening or its axes; null where there is neither."""
    named = lambda n: F.coalesce(*(F.try_element_at(fields, F.lit(x)) for x in (n, n[0], n.capitalize(), n[0].upper())))
    opening = F.coalesce(F.try_element_at(fields, F.lit("opening")), F.try_element_at(fields, F.lit("Opening")))
    parts = []
    for axis, letter in _AXES:
        text = _plain(named(axis))
        told = F.lower(text).rlike("[whd]$") | F.contains(text, F.lit('"'))
        parts.append(F.when(named(axis).isin("", "null"), None).when(told, text).otherwise(F.concat(text, F.lit(f'"{letter}'))))
    axes = F.array_compact(F.array(*parts))
    return F.when(opening != "", opening).when(F.size(axes) > 0, F.array_join(axes, " × "))


def _known(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def format_display(c: Column, depth: int = 2) -> Column:
    """A value as it is shown: a dash for nothing; sizes by their axes, lists and other fields of JSON one after another.

    What looks like JSON and isn't, and what is nested deeper than ``depth``, is shown as it stands.
    """
    text = F.trim(c)
    either = lambda kind: F.coalesce(F.from_json(text, kind), F.from_json(F.replace(text, F.lit("'"), F.lit('"')), kind))
    inner = (lambda v: format_display(v, depth - 1)) if depth > 1 else _plain

    def of_fields(fields: Column) -> Column:
        entries = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*HIDDEN) & ~F.coalesce(e["value"], F.lit("")).isin("", "null"))
        nested = lambda v: F.when(v.rlike("^\\s*[{\\[]"), inner(v)).otherwise(_plain(v))
        told = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), nested(e["value"]).alias("value")))
        told = F.filter(told, lambda e: ~e["value"].isin("", NOTHING))
        words = F.array_join(F.transform(told, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
        return F.coalesce(_size(fields), F.when(words != "", words), F.lit(NOTHING))

    def of_list(items: Column) -> Column:
        return F.when(F.size(items) == 0, NOTHING).otherwise(F.array_join(F.transform(items, inner), ", "))

    is_map, is_list = text.rlike("(?s)^\\{.*\\}$"), text.rlike("(?s)^\\[.*\\]$")
    shown = F.when(is_map, _known(either("map<string,string>"), of_fields)).when(is_list, _known(either("array<string>"), of_list))
    unread = F.when(is_map, either("map<string,string>").isNull()).when(is_list, either("array<string>").isNull()).otherwise(True)
    return F.when(c.isNull() | text.isin(*SILENT), NOTHING).when(unread, F.when(is_map | is_list, _plain(text)).otherwise(text)).otherwise(shown)
