"""Personal data in texts, plain or disguised, with offsets into the text as it was written."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplicate.llm.common import map_batches, plainly_named, prepare, table, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Detection -----------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """An address starts where the run of letters before its @ does, so only the signs @ need a look."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _small(number: str) -> bool:
    number = number.lstrip("0")
    return len(number) <= 3 and int(number or 0) <= 255


def _ips(text: str) -> Iterable[tuple[int, int]]:
    """Every four parts, one after another, of numbers joined by dots."""
    for m in _DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            at, parts = m.start(), m[0].split(".")
            for k in range(0, len(parts) - 3, 4):
                end = at + sum(map(len, parts[k : k + 4])) + 3
                if all(map(_small, parts[k : k + 4])):
                    yield at, end
                at = end + 1


def detect(text: str) -> list[Span]:
    """Leftmost non-overlapping identifiers of each kind, by kind and then start; offsets in code points."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


# Transducers ---------------------------------------------------------------


class Rewritten:
    """A text after edits, and the way back from its offsets to those of the text before."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]) -> None:
        out, self.at, self.edits, done, size = [], [], edits, 0, 0
        for start, end, by in edits:
            out += [source[done:start], by]
            size += start - done
            self.at.append(size)
            size += len(by)
            done = end
        out.append(source[done:])
        self.text = "".join(out)

    def _back(self, offset: int, last: bool) -> int:
        """The source offset of the character at ``offset``, or past it if ``last``; a rewritten stretch counts as one."""
        k = bisect_right(self.at, offset) - 1
        while k >= 0 and not self.edits[k][2] and self.at[k] == offset:
            k -= 1  # what was only left out stands before the character
        if k < 0:
            moved = 0
            base = offset
        else:
            start, end, by = self.edits[k]
            if offset < self.at[k] + len(by):
                return end if last else start
            base, moved = offset - self.at[k] - len(by), end
        position = base + moved
        j = k + 1
        while j < len(self.edits) and self.edits[j][0] <= position and not self.edits[j][2]:
            position += self.edits[j][1] - self.edits[j][0]
            j += 1
        return position + last

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._back(start, False), self._back(end - 1, True)


def _alike() -> dict[int, str]:
    """Look-alikes of ASCII characters, each one character for one."""
    # Cyrillic and Greek letters, dashes, dots, spaces and signs, each followed by what it looks like.
    pairs = (
        "аa вb сc еe ѕs іi јj оo рp хx уy ԁd һh ӏl ԛq ԝw АA ВB СC ЕE ЅS ІI ЈJ ОO РP ХX УY ԀD НH ӀI ԚQ ԜW КK МM ТT ЗZ "
        "οo αa νv ρp τt υu χx ιi κk γy εe ωw ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ıi ɡg ɑa "
        "‐- ‑- ‒- –- —- ―- −- ﹣- ․. 。. ｡. ·. ・. ﹒. ٫. ﹫@ ﹢+ ∔+ ➕+"
    )
    table = {ord(p[0]): p[1] for p in pairs.split()}
    wide = [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2469), *range(0x2070, 0x208A), *range(0x24B6, 0x24EA), 0xB2, 0xB3, 0xB9]
    for c in wide:  # full-width, mathematical, circled, raised and lowered forms
        if len(plain := unicodedata.normalize("NFKC", chr(c))) == 1 and plain.isascii() and plain.isprintable():
            table[c] = plain
    for c in range(0x660, 0x10000):  # digits of other scripts
        if c not in table and unicodedata.category(chr(c)) == "Nd":
            table[c] = str(unicodedata.decimal(chr(c)))
    for c in (0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000):
        table[c] = " "
    return table


_ALIKE = _alike()
_UNSEEN = re.compile("[­​-‏⁠-⁤﻿]")
_STRANGE = frozenset(map(chr, _ALIKE)) | {c for c in map(chr, range(0x10000)) if _UNSEEN.match(c)}
_STRANGE_LATIN = tuple(c for c in sorted(_STRANGE) if c < "\u0100")

#: The digits' names in English, German, French and Spanish, from zero to nine.
_DIGIT_NAMES = (
    "zero oh null zéro cero",
    "one eins un uno",
    "two zwei deux dos",
    "three drei trois tres",
    "four vier quatre cuatro",
    "five fünf cinq cinco",
    "six sechs seis",
    "seven sieben sept siete",
    "eight acht huit ocho",
    "nine neun neuf nueve",
)
_DIGIT = {name: str(d) for d, names in enumerate(_DIGIT_NAMES) for name in names.split()}
_NAME = "(?:" + "|".join(sorted(_DIGIT, key=len, reverse=True)) + ")"
_TIMES = {"double": 2, "triple": 3}
_ONE = rf"(?:(?:double|triple)[ -])?{_NAME}"
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:plus[ ,-]{{1,2}})?{_ONE}(?:[ ,.\n-]{{1,2}}{_ONE})*(?![^\W_])")
_DOT_SIGN = r"[ _-](?:dot|punkt|punto)[ _-]|[\[({<]\s{0,3}(?:dot|\.|punkt|punto|point)\s{0,3}[\])}>]"
_BESIDE_BEFORE = re.compile(rf"(?i)(?:[0-9]|\+|{_DOT_SIGN})[ _,.()\n-]{{0,3}}\Z")
_BESIDE_AFTER = re.compile(rf"(?i)[ ,.()\n-]{{0,3}}(?:[0-9]|{_DOT_SIGN})")
_BESIDE_RUN = re.compile(r"[ ,.()\n-]{1,3}")
_PLUS = re.compile(r"(?i)(?<![^\W_])plus[ -](?=[0-9])")
_SPELLED_PART = re.compile(rf"(?i)(?<![^\W_])(?:{_ONE}|plus)(?![^\W_])")
_MIXED = re.compile(r"(?<![^\W_])[0-9OoIl]+(?![^\W_])")
_MIXED_HINT = re.compile(r"[0-9](?:(?=[OoIl])|(?<=[OoIl][0-9]))")
_AS_DIGIT = str.maketrans("OoIl", "0011")

_BRACKETED_AT = re.compile(r"(?i)\s{0,3}[\[({<]\s{0,3}(?:at|@|ät|arroba|arobase)\s{0,3}[\])}>]\s{0,3}")
_BRACKETED_DOT = re.compile(r"(?i)\s{0,3}[\[({<]\s{0,3}(?:dot|\.|punkt|punto|point)\s{0,3}[\])}>]\s{0,3}")
_WORD_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9])[ _-]{1,2}(?:dot|punkt|punto)[ _-]{1,2}(?=[A-Za-z0-9])")
_WORD_AT = re.compile(r"(?i)(?<=[A-Za-z0-9])[ _-]{1,2}(?:at|arroba|arobase)[ _-]{1,2}(?=([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})(?![A-Za-z0-9]))")
_BRACKET_HINT = re.compile(r"(?i)[\[({<]\s{0,3}(?:at|@|ät|arroba|arobase|dot|\.|punkt|punto|point)\s{0,3}[\])}>]")
_HOST_HINT = re.compile(r"\.(?<=[A-Za-z0-9-]\.)[A-Za-z0-9]")
_DIGIT_WORDS = frozenset([*_DIGIT, "plus"])
_PARTING = {c: " " for c in range(128) if not chr(c).isalnum()}
_DOT_WORDS = ("dot", "punkt", "punto")
_IDENTIFIER = re.compile(r"[0-9._%+-]")


def _unseen(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "") for m in _UNSEEN.finditer(text)]


def _digits(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Spelled digits become digits, those of one run without gaps; letters like digits do so in numbers.

    The first edits are of runs of three names or more. The second take shorter ones too, where they stand behind a
    plus or beside digits, a disguised dot or another run that is taken, and leave a dot between two names.
    """
    runs = []
    for run in _SPELLED.finditer(text):
        parts = list(_SPELLED_PART.finditer(text, run.start(), run.end()))
        runs.append((run.start(), run.end(), parts, sum(p[0].lower() != "plus" for p in parts) > 2))
    taken = [long or parts[0][0].lower() == "plus" or bool(_BESIDE_BEFORE.search(text, max(0, a - 24), a) or _BESIDE_AFTER.match(text, b)) for a, b, parts, long in runs]
    for order in (range(1, len(runs)), range(len(runs) - 2, -1, -1)):
        for k in order:
            near = k - 1 if order.step > 0 else k + 1
            lo, hi = min(k, near), max(k, near)
            taken[k] = taken[k] or taken[near] and bool(_BESIDE_RUN.fullmatch(text, runs[lo][1], runs[hi][0]))
    first, second = [], []
    for (_, _, parts, long), take in zip(runs, taken, strict=True):
        for k, p in enumerate(parts if take else ()):
            *times, name = p[0].lower().replace("-", " ").split()
            by = "+" if name == "plus" else _DIGIT[name] * _TIMES.get(times[0] if times else "", 1)
            end = parts[k + 1].start() if k + 1 < len(parts) else p.end()
            if long:
                first.append((p.start(), end, by))
            second.append((p.start(), p.end() if text[p.end() : end] == "." else end, by))
    rest = [(m.start(), m.end(), "+") for m in _PLUS.finditer(text)]
    if _MIXED_HINT.search(text):
        for m in _MIXED.finditer(text):
            if not m[0].isdigit() and any(map(str.isdigit, m[0])):
                rest.append((m.start(), m.end(), m[0].translate(_AS_DIGIT)))
    return sorted(first + rest), sorted(second + rest)


def _dots(text: str) -> list[tuple[int, int, str]]:
    found = {m.span(): "." for p in (_BRACKETED_DOT, _WORD_DOT) for m in p.finditer(text)}
    return _apart(found)


def _apart(found: dict[tuple[int, int], str]) -> list[tuple[int, int, str]]:
    edits: list[tuple[int, int, str]] = []
    for (start, end), by in sorted(found.items()):
        if not edits or start >= edits[-1][1]:
            edits.append((start, end, by))
    return edits


def _ats(text: str, disguised: Callable[[int, int], bool]) -> list[tuple[int, int, str]]:
    """A word "at" counts only before a host with disguised dots, or after what looks like an account's name."""
    found = {m.span(): "@" for m in _BRACKETED_AT.finditer(text)}
    for m in _WORD_AT.finditer(text):
        account = m.start()
        while account and text[account - 1] in _LOCAL:
            account -= 1
        if disguised(*m.span(1)) or _IDENTIFIER.search(text, account, m.start()):
            found[m.span()] = "@"
    return _apart(found)


def _strange(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _STRANGE.isdisjoint(set(text))
    return any(c in text for c in _STRANGE_LATIN)


def _may_spell(lower: str) -> bool:
    """Whether a name of a digit or a plus stands in a text, between any signs."""
    return not _DIGIT_WORDS.isdisjoint(lower.translate(_PARTING).split())


def _normalized(plain: str, steps: list[Rewritten], digits: list[tuple[int, int, str]], may_dot: bool) -> list[Span]:
    """Identifiers of a text after edits of its digits, dots and ats, as spans of the text before all steps."""
    steps = list(steps)

    def rewrite(edits: list[tuple[int, int, str]]) -> None:
        nonlocal plain
        if edits:
            steps.append(Rewritten(plain, edits))
            plain = steps[-1].text

    rewrite(digits)
    if may_dot:
        before = len(steps)
        rewrite(_dots(plain))
        dots = steps[-1].at if len(steps) > before else []
        rewrite(_ats(plain, lambda a, b: bisect_left(dots, a) < bisect_left(dots, b)))
    found = []
    for kind, start, end in detect(plain) if steps else ():
        for step in reversed(steps):
            start, end = step.back(start, end)
        found.append((kind, start, end))
    return found


def disguised(text: str) -> list[Span]:
    """Identifiers that show only once the text is normalized, as spans of the text as it was."""
    plain = text
    steps: list[Rewritten] = []
    if not text.isascii() and _strange(text):
        plain = text.translate(_ALIKE)  # one for one: no offset moves
        if plain != text or _UNSEEN.search(plain):
            steps = [Rewritten(plain, _unseen(plain))]
            plain = steps[-1].text
    lower = plain.lower()
    digits, more = _digits(plain) if _may_spell(lower) or _MIXED_HINT.search(plain) else ([], [])
    may_dot = bool(any(w in lower for w in _DOT_WORDS) or _BRACKET_HINT.search(plain) or _HOST_HINT.search(plain))
    found = _normalized(plain, steps, digits, may_dot)
    if more != digits:
        # Short runs can also lengthen what is an identifier without them, so both readings count.
        known = _Cover(found)
        wider = [s for s in _normalized(plain, steps, more, may_dot) if not known.holds(s[1], s[2])]
        new = {k: _Cover([s for s in wider if s[0] == k]) for k in KINDS}
        found = [s for s in found if not new[s[0]].holds(s[1], s[2])] + wider
    return found


class _Cover:
    """Whether one of the spans holds a stretch: of those that begin no later, the furthest end tells."""

    def __init__(self, spans: list[Span]) -> None:
        ordered = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in ordered]
        self.reach = list(accumulate((b for _, b in ordered), max))

    def holds(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start)
        return at > 0 and self.reach[at - 1] >= end


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Identifiers as written, and those that the transducers add; an added span never lies inside one of its kind."""
    base = detect(text)
    added = disguised(text)
    if added and base:
        known = {k: _Cover([s for s in base if s[0] == k]) for k in KINDS}
        added = [s for s in added if not known[s[0]].holds(s[1], s[2])]
    return base, added


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def redact(text: str, spans: list[Span]) -> str:
    """Each stretch of overlapping spans replaced by the kind of its first."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


# Operators -----------------------------------------------------------------


def _find_all():
    def step(batch: pa.RecordBatch) -> dict:
        columns: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
        for text in batch.column("text").to_pylist():
            base, added = find(text)
            kinds = [s[0] for s in base]
            for k in KINDS:
                columns[f"n_{k}"].append(kinds.count(k))
            columns["base_sha256"].append(hashlib.sha256(told(base).encode()).hexdigest())
            columns["spans"].append(told(base + added))
            columns["n_added"].append(len(added))
        return {"doc_id": batch.column("doc_id"), **columns}

    return step


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of identifiers as written), base_sha256, spans (all), n_added.

    One pass over whole texts without a shuffle. Null and empty texts have no spans; repeated rows give repeated
    rows; an empty table gives none; columns besides doc_id and text are not read.
    """
    prepare(docs.sparkSession)
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return map_batches(texts(docs), _find_all, schema)


def _redact_all():
    def step(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column("text").to_pylist():
            if text is not None:
                base, added = find(text)
                text = redact(text, base + added) if base or added else text
            out.append(text)
        return {c: batch.column(c) for c in batch.schema.names} | {"text": pa.array(out, pa.string())}

    return step


def redact_pii(docs: DataFrame) -> DataFrame:
    """The same rows and columns, with every identifier in text replaced by its kind in brackets; null stays null.

    Repeated rows are treated alike; an empty table gives no rows; columns may have any names and types.
    """
    prepare(docs.sparkSession)
    plain = plainly_named(docs)
    return map_batches(plain, _redact_all, plain.schema).toDF(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", F.col("text")))
