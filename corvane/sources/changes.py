"""Change-request documents as Markdown: the detector, the cover page's fields, and blocks of marked changes."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_of, cover_release, let
from .web import table_function

_GAP = r"(?:\s*\|)*\s*"


def is_change_request(text: Column) -> Column:
    """Whether a document has the form's head cell and the row that names specification, CR, rev and current version (whose values may be empty)."""
    head = text.rlike(r"(?im)\|[ \t]*CHANGE[ \t\x0b\f]+REQUEST[ \t]*\|")
    value = r"[^|]*\|"
    row = text.rlike(rf"(?is)\|\s*\d{{2}}\.\d{{3}}(?:-\d)?\s*\|{_GAP}CR\s*\|{_GAP}{value}{_GAP}rev\s*\|{_GAP}{value}{_GAP}Current\s+version\s*:\s*\|")
    return F.coalesce(head & row, F.lit(False))


#: Fields of a cover page and the labels of the cells before them.
LABELS = {
    "title": "title:", "source": "source to wg:", "tsg": "source to tsg:", "related_wis": "work item code:", "date": "date:", "cr_cat": "category:", "release": "release:",
    "reason_for_change": "reason for change:", "consequences_if_not_approved": "consequences if not approved:", "clauses_affected": "clauses affected:",
    "other_comments": "other comments:", "summary_of_change": "summary of change:", "revision_history": "this cr's revision history:",
}
_IDENTITY = {"cr_num": "cr", "rev": "rev", "version": "current version:"}
_LONG = ("reason_for_change", "consequences_if_not_approved", "summary_of_change", "other_comments", "revision_history")


def cover_page(text: Column, most_chars: int = 0) -> Column:
    """A struct of the cover page's fields, null where they're blank: of the first line that has a field's label, the next cell that isn't blank, unless that is a label itself.

    Specification, CR, revision and version stand in one line. A CR or revision number that isn't digits is cleared, the revision `-`
    is 0, the release is `Rel-n`; long fields are cut to `most_chars` if that is positive.
    """
    def fields(rows: Column) -> Column:
        def first(*labels: str) -> Column:
            return F.get(F.filter(rows, lambda r: all_of([F.array_contains(r["low"], x) for x in labels])), F.lit(0))

        def after(row: Column, label: str, labels: tuple[str, ...]) -> Column:
            at = F.array_position(row["low"], label).cast("int")
            return F.when(~F.get(row["low"], at).isin(*labels), F.get(row["cells"], at))

        out: dict[str, Column] = {}
        head = first(*_IDENTITY.values())
        spec = F.get(head["cells"], F.array_position(head["low"], "cr").cast("int") - 2)
        known = spec.rlike(r"^\d{2}\.\d{3}(?:-\d)?$")
        out["spec"] = F.when(known, spec)
        for name, label in _IDENTITY.items():
            out[name] = F.when(known, after(head, label, tuple(_IDENTITY.values())))
        digits = lambda c: F.when(c.rlike("^[0-9]+$"), c)
        out["cr_num"], out["rev"] = digits(out["cr_num"]), F.when(out["rev"] == "-", "0").otherwise(digits(out["rev"]))
        out["version"] = F.when(out["version"].rlike(r"^\d+\.\d+\.\d+$"), out["version"])
        for name, label in LABELS.items():
            out[name] = after(first(label), label, tuple(LABELS.values()))
        out["release"] = cover_release(out["release"])
        if most_chars > 0:
            out |= {name: F.left(out[name], F.lit(most_chars)) for name in _LONG}
        return F.struct(*[F.nullif(c, F.lit("")).alias(name) for name, c in out.items()])

    def cells(line: Column) -> Column:
        return F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c != "")

    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: F.contains(x, F.lit("|")))
    rows = F.transform(lines, lambda x: let(cells(x), lambda c: F.struct(c.alias("cells"), F.transform(c, F.lower).alias("low"))))
    return let(rows, fields)


_MARK = re.compile(r"</?(?:ins|del)>", re.I)
_HEADING = re.compile(r"\s*#{1,9}\s+(?:<ins>)?\s*((?:Annex\s+)?[A-Z]?\d*(?:\.?\d+[A-Za-z]*)*)(?=[\s:(<]|$)", re.I)
_TABLE = re.compile(r"\s*\**\s*Table\s+([0-9A-Za-z][0-9A-Za-z.-]*)\s*[:.]", re.I)


def _heading(line: str) -> str:
    m = _HEADING.match(line)
    return m[1].strip() if m and m[1].strip() else ""


def _table(line: str) -> str:
    m = _TABLE.match(line)
    return f"Table {m[1]}" if m else ""


def _spans(line: str) -> list[str]:
    """Clauses and tables named inside the marks of a line, with what became of them."""
    out = []
    for kind, suffix in (("ins", " (new)"), ("del", " (del)")):
        for m in re.finditer(rf"<{kind}>(.*?)</{kind}>", line, re.I | re.S):
            name = _heading(m[1]) or _table(m[1])
            if name:
                out.append(name + suffix)
    return out


def change_blocks(text: str | None, gap: int = 2, context: int = 2) -> list[tuple[list[str], str]]:
    """(clauses, text) of each run of marked lines: at most `gap` plain lines part marked ones of a run, a heading ends it; `context` lines around it are shown.

    Clauses are the heading and table that the run stands under, tables that follow in it, and those that its marks name.
    """
    if gap < 0 or context < 0:
        raise ValueError("gap and context can't be negative")
    lines = (text or "").splitlines()
    runs: list[tuple[int, int, list[str]]] = []
    heading = table = ""
    open_ = False
    for i, line in enumerate(lines):
        marked = bool(_MARK.search(line))
        if not marked and _heading(line):
            heading, open_ = _heading(line), False
            continue
        if not marked and _table(line):
            table = _table(line)
            if open_:
                runs[-1][2].append(table)
            continue
        if not marked:
            continue
        if open_:  # tables between don't count as plain lines
            plain = sum(1 for x in lines[runs[-1][1] + 1 : i] if not _table(x))
            open_ = plain <= gap
        if open_:
            runs[-1] = (runs[-1][0], i, runs[-1][2])
        else:
            runs.append((i, i, [x for x in (heading, table) if x]))
            open_ = True
        runs[-1][2].extend(_spans(line))
    return [(list(dict.fromkeys(names)), "\n".join(lines[max(0, a - context) : z + 1 + context])) for a, z, names in runs]


def change_table(rows: DataFrame, key: str, text: str, gap: int = 2, context: int = 2) -> DataFrame:
    """key, clauses, text: one row for each block of changes."""
    return table_function(rows, [text], key, [("clauses", pa.list_(pa.string()), "array<string>"), ("text", pa.string(), "string")], lambda t: change_blocks(t, gap, context))
