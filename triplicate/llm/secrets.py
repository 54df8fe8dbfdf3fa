"""Secrets in texts by patterns and by sliding-window entropy, in DataFrame expressions alone."""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplicate.llm.common import table, texts

KINDS = ("assign", "access", "hex")
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Runs are taken whole, so the least length can stand in the pattern: a run that is too short has no other match.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: What may be a secret by its letters: a run long enough to hold a window.
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
#: The letters of candidates.
LETTERS = string.ascii_letters + string.digits + "+/_-"
WINDOW = 20
#: Matches of a text that are summed up at a time.
SLICE = 256
#: Bits per letter from which on a window of a class is taken for random.
LEAST_BITS = {"hex": 3.0, "mixed": 3.7}
#: Candidates that match one of these are known not to be secrets: identifiers of the form of a UUID,
#: placeholders and alphabets.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "(?i)example|placeholder|your[_-]|dummy|sample|changeme|xxxx|0000",
    "(?i)abcdefghij|0123456789|qwerty",
)
#: Paths of words as well. Without a repeated group, which Java matches by recursion, so that one long path ends the JVM.
PATH, PATH_NOT = "^[a-z][a-z/_-]*[/_-][a-z0-9]+$", "[/_-][/_-]"


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """[(start, end, found)] of the matches whose ``group`` has ``least`` letters or more.

    What stands between matches and the matches themselves, side by side, give the offsets by running lengths. Matches
    are summed up in slices of ``SLICE``, so the work grows with their number and not with its square.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    size = (lambda m: F.length(F.regexp_extract(m, pattern, group))) if group else F.length
    pairs = F.zip_with(
        gaps, found, lambda gap, m: F.struct(gap.alias("gap"), F.length(m).alias("n"), (size(m) >= least).alias("good"), m.alias("m"))
    )
    span_type = "array<struct<start:int,end:int,found:string>>"
    none, nothing = F.array().cast(span_type), F.array().cast(f"array<{span_type}>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["n"]
        span = F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("found"))
        return F.struct(end.alias("at"), F.when(x["good"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def slice_(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return _once(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    parts = _once(F.filter(pairs, lambda p: p["m"].isNotNull()), _sliced)
    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), nothing.alias("out")), slice_, lambda acc: F.flatten(acc["out"]))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def _sliced(whole: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(whole)), F.lit(SLICE))
    return F.transform(starts, lambda k: F.slice(whole, k, SLICE))


def _outside(candidates: Column, base: Column) -> Column:
    """Candidates that no span of ``base`` holds: both in one order of their starts, with the furthest end so far."""
    one = lambda s, k, found: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), found.alias("found"))
    both = F.array_sort(F.concat(F.transform(base, lambda b: one(b, 0, F.lit(""))), F.transform(candidates, lambda c: one(c, 1, c["found"]))))
    span_type = "array<struct<start:int,end:int,found:string>>"
    none, nothing = F.array().cast(span_type), F.array().cast(f"array<{span_type}>")

    def step(acc: Column, x: Column) -> Column:
        free = (x["k"] == 1) & (x["end"] > acc["reach"])
        span = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"))
        reach = F.when(x["k"] == 0, F.greatest(acc["reach"], x["end"])).otherwise(acc["reach"])
        return F.struct(reach.alias("reach"), F.when(free, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def slice_(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["reach"].alias("reach"), none.alias("out")), step)
        return _once(inner, lambda i: F.struct(i["reach"].alias("reach"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

    left = F.aggregate(_once(both, _sliced), F.struct(F.lit(-1).alias("reach"), nothing.alias("out")), slice_, lambda acc: F.flatten(acc["out"]))
    return F.when((F.size(candidates) == 0) | (F.size(base) == 0), candidates).otherwise(left)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _g(count: Column) -> Column:
    """n * log2(n) of a count within a window."""
    values = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]
    return F.element_at(F.array(*map(F.lit, values)), count + 1)


def most_bits(candidate: Column) -> Column:
    """The largest Shannon entropy, in bits per letter, of any window of ``WINDOW`` letters.

    One fold over the letters carries the counts of a window's letters and the sum of n * log2(n) over them: with each
    letter that enters and the one that leaves two counts and their two terms change. Time grows with the length.
    """
    letters = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(LETTERS), c))
    zeros = F.array_repeat(F.lit(0), len(LETTERS) + 1)

    def pairs(at: Column) -> Column:
        return F.zip_with(at, F.concat(F.array_repeat(F.lit(0), WINDOW), at), lambda enters, leaves: F.struct(enters.alias("in"), leaves.alias("out")))

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["in"], x["out"]
        full = leaves > 0
        left = F.element_at(acc["counts"], leaves + 1)
        less = acc["now"] + F.when(full, _g(left - 1) - _g(left)).otherwise(0.0)
        held = F.element_at(acc["counts"], enters + 1) - F.when(full & (leaves == enters), 1).otherwise(0)
        now = less - _g(held) + _g(held + 1)
        counts = F.transform(acc["counts"], lambda n, k: n + F.when(k == enters, 1).otherwise(0) - F.when(full & (k == leaves), 1).otherwise(0))
        seen = acc["seen"] + 1
        least = F.when(seen >= WINDOW, F.least(acc["least"], now)).otherwise(acc["least"])
        return F.struct(now.alias("now"), least.alias("least"), counts.alias("counts"), seen.alias("seen"))

    start = F.struct(F.lit(0.0).alias("now"), F.lit(math.inf).alias("least"), zeros.alias("counts"), F.lit(0).alias("seen"))
    rows = F.filter(_once(letters, pairs), lambda p: p["in"] > 0)
    least = F.aggregate(rows, start, step, lambda acc: acc["least"])
    return F.lit(math.log2(WINDOW)) - least / WINDOW


def _random(found: Column) -> Column:
    allowed = found.rlike(PATH) & ~found.rlike(PATH_NOT)
    for pattern in ALLOWED:
        allowed = allowed | found.rlike(pattern)
    is_hex = found.rlike("^[0-9a-fA-F]+$")
    mixed = found.rlike("[0-9]") & found.rlike("[A-Za-z]")
    least = F.when(is_hex, LEAST_BITS["hex"]).otherwise(LEAST_BITS["mixed"])
    return F.when(mixed & ~allowed, most_bits(found) >= least).otherwise(F.lit(False))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (of pattern matches), base_sha256, spans (all), n_added.

    An empty table gives no rows; texts and candidates may be of any length. A candidate that lies inside a pattern's match is not told again; others count as kind ``entropy``. One pass
    over whole texts in Spark's own expressions; null and empty texts have no spans; repeated rows give repeated
    rows; columns besides doc_id and text are not read.
    """
    text = F.col("text")
    by_kind = texts(docs).select(
        "doc_id",
        "text",
        _matches(text, ASSIGN, 1, 6).alias("assign"),
        _matches(text, ACCESS, 0, 0).alias("access"),
        _matches(text, HEX, 0, 0).alias("hex"),
        F.filter(_matches(text, CANDIDATE, 0, 0), lambda s: s["found"].rlike("[0-9]")).alias("candidates"),
    )

    def named(spans: Column, name: str, k: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(name).alias("name")))

    base = F.concat(*(named(F.col(kind), kind, k) for k, kind in enumerate(KINDS)))
    outside = by_kind.withColumn("base", base).withColumn(
        "candidates",
        F.filter(_outside(F.col("candidates"), F.col("base")), lambda c: _random(c["found"])),
    )
    return outside.select(
        "doc_id",
        *(F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(_told(F.col("base")), 256).alias("base_sha256"),
        _told(F.concat("base", named(F.col("candidates"), "entropy", len(KINDS)))).alias("spans"),
        F.size("candidates").cast("long").alias("n_added"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return find_secrets(table(spark, sf_dir, "documents"))
