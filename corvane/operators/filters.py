"""The null-aware pattern language of list and search queries, as predicates that reach the scan.

`null` and `not-null` (any case) test for nulls; `!x` is NOT LIKE, anything else LIKE: case-insensitive,
% and _ are wildcards, a backslash is an ordinary character. An absent filter (None or '') lets all
rows pass. NOT LIKE, as in SQL, doesn't hold for nulls.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import all_of, any_of

_DATE = re.compile(r"\s*(<=|>=|==|!=|<|>|=)\s*'?(\d{4}-\d{2}-\d{2})'?\s*")
_OPS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__, "=": Column.__eq__, "==": Column.__eq__, "!=": Column.__ne__}


def _like(c: Column, pattern: str) -> Column:
    return c.ilike(pattern.replace("\\", "\\\\"))


def rich(c: Column, value: str | None) -> Column:
    """One column against one filter value."""
    word = (value or "").strip().lower()
    if not value:
        return F.lit(True)
    if word == "null":
        return c.isNull()
    if word == "not-null":
        return c.isNotNull()
    return ~_like(c, value[1:]) if value.startswith("!") else _like(c, value)


def rich_any(columns: list[Column], value: str | None) -> Column:
    """Several columns against one value: any may match; `!` negates the whole group; `null` means any is null."""
    if not value:
        return F.lit(True)
    if value.startswith("!"):
        return ~any_of([_like(c, value[1:]) for c in columns])
    if value.strip().lower() == "not-null":
        return all_of([c.isNotNull() for c in columns])
    return any_of([rich(c, value) for c in columns])


def contains(c: Column, text: str) -> Column:
    """Substring, without wildcards."""
    return F.contains(F.lower(c), F.lit(text.lower()))


def upper_exact(c: Column, value: str | None) -> Column:
    return c == value.upper() if value else F.lit(True)


def date_filter(c: Column, value: str | None) -> Column:
    """`null`, `not-null` or an operator and an ISO date; ValueError for anything else."""
    if not value:
        return F.lit(True)
    word = value.strip().lower()
    if word in ("null", "not-null"):
        return c.isNull() if word == "null" else c.isNotNull()
    m = _DATE.fullmatch(value)
    if not m:
        raise ValueError(f"not a date filter: {value!r}")
    return _OPS[m[1]](c.cast("date"), F.lit(dt.date.fromisoformat(m[2])))


def since_until(c: Column, since: str | None = None, until: str | None = None) -> Column:
    """Inclusive bounds, ISO dates only."""
    day, out = c.cast("date"), []
    if since:
        out.append(day >= F.lit(dt.date.fromisoformat(since)))
    if until:
        out.append(day <= F.lit(dt.date.fromisoformat(until)))
    return all_of(out)


def eligible(c: Column, kinds: Iterable[str]) -> Column:
    return F.lower(F.trim(c, F.lit(" \t\r\n"))).isin([k.lower() for k in kinds])


def label_number(label: Column, digits: int) -> Column:
    """The leading digits after a label's prefix of `digits` characters; null if there are none."""
    return F.regexp_extract(F.substring(label, digits + 1, 99), r"^([0-9]+)", 1).try_cast("bigint")


def in_bracket(prefix: Column, number: Column, start: Column, end: Column, digits: int) -> Column:
    """Whether a number lies in the range of two numbered labels with the same prefix; an absent end is open.

    Labels are six or seven characters longer than the prefix. Only the first character after the prefix
    has to be a digit, and leading digits are the number.
    """
    def labelled(c: Column) -> Column:
        return F.length(c).isin(digits + 6, digits + 7) & (F.substring(c, 1, digits) == prefix) & F.substring(c, digits + 1, 1).rlike("^[0-9]")

    return labelled(start) & (number >= label_number(start, digits)) & (end.isNull() | (labelled(end) & (number <= label_number(end, digits))))


def upper_rich(c: Column, value: str | None) -> Column:
    """`rich` for columns that hold upper case: the pattern is upper-cased, the words null and not-null are not."""
    return rich(c, value if not value or value.strip().lower() in ("null", "not-null") else value.upper())


def any_list(columns: list[Column], value: str | None) -> Column:
    """Several delimited lists as one: `null` if all are empty; LIKE on upper case; `!` negates the whole, and empty lists count as ''."""
    if not value:
        return F.lit(True)
    empty = all_of([F.coalesce(c, F.lit("")) == "" for c in columns])
    word = value.strip().lower()
    if word in ("null", "not-null"):
        return empty if word == "null" else ~empty
    held = any_of([_like(F.upper(F.coalesce(c, F.lit(""))), value.removeprefix("!").upper()) for c in columns])
    return ~held if value.startswith("!") else held


def fold(filters: dict[str, str | None], columns: dict[str, str], dates: Iterable[str] = ()) -> Column:
    """All of a map of filters: name -> value, with `columns` naming the column of each; `dates` are compared as days. Unknown names are an error."""
    unknown = sorted(set(filters) - set(columns))
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(unknown)}")
    return all_of([(date_filter if name in dates else rich)(F.col(columns[name]), value) for name, value in filters.items() if value])


def limited(n: int, most: int) -> int:
    """A limit between 0 and `most`; ValueError beyond."""
    if not 0 <= n <= most:
        raise ValueError(f"the limit has to lie between 0 and {most}")
    return n


def release_filter(value: str) -> str:
    if len(value) > 32:
        raise ValueError("a release has 32 characters at most")
    return value


def spec_filter(value: str) -> str:
    """A specification number, a pattern of one, or a null test."""
    word = value.strip().lower()
    if word not in ("null", "not-null") and not re.fullmatch(r"!?[\d.%_-]+", value.strip()):
        raise ValueError(f"not a specification: {value!r}")
    return value


def id_filter(value: str) -> tuple[str, int]:
    """Prefix and number of a document number; ValueError for other shapes."""
    m = re.fullmatch(r"([RSC][1-9P][-sw])(\d{6,7})", value.strip(), re.I)
    if not m:
        raise ValueError(f"not a document number: {value!r}")
    return m[1].upper() if m[1][2] == "-" else m[1][:2].upper() + m[1][2].lower(), int(m[2])


class DateSet:
    """Disjoint inclusive ranges of days, each side possibly open."""

    def __init__(self, ranges: Iterable[tuple[dt.date | None, dt.date | None]] = ((None, None),)):
        low, high, one = dt.date.min, dt.date.max, dt.timedelta(days=1)
        out: list[list[dt.date]] = []
        for a, z in sorted((a or low, z or high) for a, z in ranges):
            if a > z:
                continue
            if out and (out[-1][1] == high or a <= out[-1][1] + one):
                out[-1][1] = max(out[-1][1], z)
            else:
                out.append([a, z])
        self.ranges = tuple((None if a == low else a, None if z == high else z) for a, z in out)

    @classmethod
    def parse(cls, texts: Iterable[str]) -> DateSet:
        """All of some comparisons, such as `>= 2024-01-01`."""
        out = cls()
        for text in texts:
            m = _DATE.fullmatch(text)
            if not m:
                raise ValueError(f"not a date comparison: {text!r}")
            d, one = dt.date.fromisoformat(m[2]), dt.timedelta(days=1)
            out &= cls({"<": [(None, d - one)], "<=": [(None, d)], ">": [(d + one, None)], ">=": [(d, None)], "=": [(d, d)], "==": [(d, d)], "!=": [(None, d - one), (d + one, None)]}[m[1]])
        return out

    @classmethod
    def last_year(cls, today: dt.date) -> DateSet:
        try:
            start = today.replace(year=today.year - 1)
        except ValueError:  # 29 February
            start = today.replace(year=today.year - 1, day=28)
        return cls([(start, today)])

    def __and__(self, other: DateSet) -> DateSet:
        low, high = dt.date.min, dt.date.max
        return DateSet([(max(a or low, c or low), min(b or high, d or high)) for a, b in self.ranges for c, d in other.ranges])

    def __or__(self, other: DateSet) -> DateSet:
        return DateSet([*self.ranges, *other.ranges])

    def __contains__(self, day: dt.date) -> bool:
        return any((a is None or a <= day) and (z is None or day <= z) for a, z in self.ranges)

    def predicate(self, c: Column) -> Column:
        """Or of ranges; nothing for an empty set, everything for the unbounded one."""
        if self.ranges == ((None, None),):
            return F.lit(True)
        day = c.cast("date")
        return any_of([all_of([*([day >= F.lit(a)] if a else []), *([day <= F.lit(z)] if z else [])]) for a, z in self.ranges])
