"""Scalar helpers: strings, entities, wildcards, numbers, dates, paths. Column forms where tables need them, Python where plans are built."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- strings ---------------------------------------------------------------------------------------------------------


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by code points."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def starts_with_ignoring_case(s: Column, prefix: Column) -> Column:
    return F.lower(s).startswith(F.lower(prefix))


def fuzzy_factor(a: Column, b: Column) -> Column:
    """1 - edit distance / length of a."""
    return 1 - F.levenshtein(a, b) / F.length(a)


def common_prefix(strings: list[str]) -> str:
    def two(a: str, b: str) -> str:
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[:n]

    return reduce(two, strings) if strings else ""


def wrap(text: str, width: int) -> list[str]:
    """Greedy lines of at most `width` characters; longer words stand alone."""
    lines: list[str] = []
    for w in text.split():
        if lines and len(lines[-1]) + 1 + len(w) <= width:
            lines[-1] += " " + w
        else:
            lines.append(w)
    return lines


#: Entity names beyond those of HTML.
EXTRA_ENTITIES = {"slash": "/", "backslash": "\\", "space": " ", "hyphen": "-"}


class UnknownEntity(ValueError):
    pass


def resolve_entities(s: str) -> str:
    """&#47; &#x2f; &slash; and the names of HTML; an unknown name is an error."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name.startswith("#"):
            return chr(int(name[2:], 16) if name[1:2] in "xX" else int(name[1:]))
        if name in EXTRA_ENTITIES:
            return EXTRA_ENTITIES[name]
        if f"{name};" in html.entities.html5:
            return html.entities.html5[f"{name};"]
        raise UnknownEntity(name)

    return re.sub(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);", one, s)


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def strip_html(s: Column) -> Column:
    """The text without tags."""
    return F.regexp_replace(s, "<[^>]*>", "")


def wildcard_position(pattern: str) -> int:
    """Where the first * or ? stands, or -1."""
    return next((i for i, c in enumerate(pattern) if c in "*?"), -1)


def wildcard_regex(pattern: str) -> str:
    """* is any run, ? any one character; the rest is literal. Anchored at both ends."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def literal_prefix(regex: str) -> str:
    """The leading part that is plain words, spaces and hyphens; a character that a quantifier follows isn't part of it."""
    prefix = re.match(r"[\w\s-]*", regex)[0]
    return prefix[:-1] if prefix and regex[len(prefix) : len(prefix) + 1] in tuple("*?{") else prefix


# --- numbers ---------------------------------------------------------------------------------------------------------


def int_value(s: Column) -> Column:
    """The first run of digits, or null."""
    return F.regexp_extract(s, r"^\D*(\d+)", 1).try_cast("bigint")


def float_value(s: Column) -> Column:
    """The number that the text is; missing text is 0, other text null."""
    return F.when(s.isNull() | (F.trim(s) == ""), F.lit(0.0)).otherwise(s.try_cast("double"))


# --- dates -----------------------------------------------------------------------------------------------------------

_CLASSES = {"year": r"\d{4}", "month": r"\d{1,2}", "day": r"\d{1,2}", "hour": r"\d{1,2}", "minute": r"\d{1,2}", "second": r"\d{1,2}", "subsec": r"\d{1,9}"}
_PARTS = ("year", "month", "day", "hour", "minute", "second", "subsec")

#: Date forms: parts are named, with an optional number of digits; other strings are literal; ("?", ...) is optional.
ISO = (("year", 4), ("?", "-", ("month", 2), ("?", "-", ("day", 2), ("?", "T", ("hour", 2), ("?", ":", ("minute", 2), ("?", ":", ("second", 2), ("?", ".", "subsec")))))))
YYYY_MM_DD = (("year", 4), "-", ("month", 2), "-", ("day", 2))
DDMMYYYY = (("day", 2), "/", ("month", 2), "/", ("year", 4))
MMDDYYYY = (("month", 2), "/", ("day", 2), "/", ("year", 4))


def compile_form(form: tuple) -> tuple[str, list[str]]:
    """A regular expression and the names of its groups, for Java as for Python."""
    names: list[str] = []

    def one(item) -> str:
        if isinstance(item, str):
            if item in _CLASSES:
                names.append(item)
                return f"({_CLASSES[item]})"
            return re.escape(item)
        if item[0] == "?":
            return "(?:" + "".join(map(one, item[1:])) + ")?"
        if item[0] == "*":
            return "(?:" + "".join(map(one, item[1:])) + ")*"
        names.append(item[0])
        return rf"(\d{{{item[1]}}})"

    return "".join(map(one, form)), names


def date_value(s: Column, form: tuple = YYYY_MM_DD) -> Column:
    """The timestamp that a text's first match of the form gives; missing parts are the first month and day, and zero; null without a match."""
    pattern, names = compile_form(form)
    got = {n: F.regexp_extract(s, pattern, i + 1).try_cast("int") for i, n in enumerate(names) if n != "subsec"}
    part = lambda n, otherwise: F.coalesce(got[n], F.lit(otherwise)) if n in got else F.lit(otherwise)
    seconds = part("second", 0).cast("decimal(16,6)")
    if "subsec" in names:
        fraction = F.concat(F.lit("0."), F.substring(F.regexp_extract(s, pattern, names.index("subsec") + 1), 1, 6)).try_cast("decimal(16,6)")
        seconds = seconds + F.coalesce(fraction, F.lit(0).cast("decimal(16,6)"))
    year = F.coalesce(got["year"], F.year(F.current_date())) if "year" in got else F.year(F.current_date())
    made = F.try_make_timestamp(year, part("month", 1), part("day", 1), part("hour", 0), part("minute", 0), seconds)
    return F.when(s.rlike(pattern), made)


class InvalidDate(ValueError):
    pass


@dataclass(frozen=True)
class PartialDate:
    """A date of a query, known to the precision of its last part."""

    parts: tuple[int, ...]
    offset: timedelta = timedelta(0)

    def interval(self) -> tuple[datetime, datetime]:
        """[lower, upper): all moments that the parts fit, in UTC."""
        p = self.parts
        given = [*p[:6], *(1, 1, 0, 0, 0)[len(p) - 1 :]] if len(p) < 6 else list(p[:6])
        lower = datetime(*given[:6]) + timedelta(microseconds=p[6] if len(p) > 6 else 0)
        if len(p) == 1:
            upper = lower.replace(year=lower.year + 1)
        elif len(p) == 2:
            upper = lower.replace(year=lower.year + lower.month // 12, month=lower.month % 12 + 1)
        else:
            upper = lower + (timedelta(days=1), timedelta(hours=1), timedelta(minutes=1), timedelta(seconds=1), timedelta(microseconds=1))[len(p) - 3]
        utc = lambda d: (d - self.offset).replace(tzinfo=timezone.utc)
        return utc(lower), utc(upper)


def parse_query_date(s: str) -> PartialDate:
    """YYYY, YYYYMM, YYYYMMDD, then T or a space and hh, hhmm, hhmmss with a fraction; Z or +hhmm; parts may be set apart by - : / or spaces."""
    m = re.fullmatch(r"\s*(\d{4})(?:[-/ ]?(\d{2})(?:[-/ ]?(\d{2})(?:[T ]?(\d{2})(?::?(\d{2})(?::?(\d{2})(?:\.?(\d{1,6}))?)?)?)?)?)?\s*(Z|[+-]\d{2}:?\d{2})?\s*", s)
    if not m:
        raise InvalidDate(s)
    parts = [int(x) for x in m.groups()[:6] if x is not None]
    if m[7] is not None:
        parts.append(int(m[7].ljust(6, "0")))
    offset = timedelta(0)
    if m[8] and m[8] != "Z":
        digits = m[8][1:].replace(":", "")
        offset = timedelta(hours=int(digits[:2]), minutes=int(digits[2:])) * (-1 if m[8][0] == "-" else 1)
    date = PartialDate(tuple(parts), offset)
    try:
        date.interval()
    except ValueError as e:
        raise InvalidDate(s) from e
    return date


# --- paths -----------------------------------------------------------------------------------------------------------


def relative_path(path: Column, root: Column) -> Column:
    return F.when(path.startswith(root), F.substr(path, F.length(root) + 1)).otherwise(path)


def absolute_path(path: Column, root: Column) -> Column:
    return F.when(path.startswith(F.lit("/")), path).otherwise(F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), path))


def file_suffix(path: Column) -> Column:
    """What follows the last hyphen of the file name without its extension."""
    return F.substring_index(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""), "-", -1)


#: Seconds from the start of 1900 to the start of 1970, both UTC.
UNIVERSAL_TO_UNIX = 2_208_988_800


def universal_time_text(seconds: Column, form: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Seconds since 1900 (UTC) as text, in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds - UNIVERSAL_TO_UNIX), form)
