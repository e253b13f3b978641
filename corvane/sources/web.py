"""HTML sources: links, Markdown, listings as rows, and mail bodies without quotes. Standard-library parsing in Arrow batches."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

_UNSAFE = ("javascript:", "vbscript:", "data:")
_DROP = {"script", "style", "template", "noscript", "head"}


def table_function(rows: DataFrame, inputs: list[str], keep: str, fields: list[tuple[str, pa.DataType, str]], f: Callable[..., list[tuple]]) -> DataFrame:
    """Each row of `rows` as the rows that `f` makes of its inputs, with the key column `keep` in front."""
    kind = dict(rows.dtypes)[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, *r) for k, *xs in zip(*(batch.column(c).to_pylist() for c in [keep, *inputs]), strict=True) for r in f(*xs)]
            cols = list(zip(*out, strict=True)) if out else [()] * (1 + len(fields))
            types = [batch.schema.field(keep).type, *(t for _, t, _ in fields)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [keep, *(n for n, _, _ in fields)])

    return rows.select(keep, *inputs).mapInArrow(run, ", ".join([f"{keep} {kind}", *(f"{n} {d}" for n, _, d in fields)]))


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[list[str]] = []
        self.open = False

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href"):
            self.found.append([dict(attrs)["href"], ""])
            self.open = True

    def handle_endtag(self, tag):
        self.open = self.open and tag != "a"

    def handle_data(self, data):
        if self.open:
            self.found[-1][1] += data


def links_of(url: str | None, html: str | None) -> list[tuple[int, str, str]]:
    p = _Links()
    p.feed(html or "")
    out = []
    for i, (href, label) in enumerate(p.found):
        try:
            out.append((i, urljoin(url or "", href), " ".join(label.split())))
        except ValueError:
            continue
    return out


def links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, position, target, label of each link, targets made absolute."""
    return table_function(pages, [url, html], key, [("position", pa.int32(), "int"), ("target", pa.string(), "string"), ("label", pa.string(), "string")], links_of)


class _Tables(HTMLParser):
    """Rows of table cells (text, first link) in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            self.cell = ["", ""]
            self.rows[-1].append(self.cell)
        elif tag == "a" and self.cell is not None and not self.cell[1]:
            self.cell[1] = dict(attrs).get("href") or ""

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


def table_rows(html: str | None) -> list[list[tuple[str, str]]]:
    p = _Tables()
    p.feed(html or "")
    return [[(" ".join(c[0].split()), c[1]) for c in r] for r in p.rows if r]


def named_rows(html: str | None, wanted: dict[str, tuple[str, ...]]) -> list[dict[str, str]]:
    """Rows of the first table whose header names all wanted columns, exactly or else as a part of the heading."""
    rows = table_rows(html)
    for i, r in enumerate(rows):
        heads = [c[0].lower() for c in r]
        at = {}
        for name, options in wanted.items():
            j = next((heads.index(o) for o in options if o in heads), None)
            if j is None:
                j = next((k for o in options for k, h in enumerate(heads) if o in h), None)
            if j is not None:
                at[name] = j
        if len(at) == len(wanted):
            return [{n: x[j][0] for n, j in at.items()} | {"link": next((c[1] for c in x if c[1]), "")} for x in rows[i + 1 :] if len(x) > max(at.values())]
    return []


_MEETING = {"name": ("meeting", "name"), "title": ("title",), "location": ("town", "location"), "start": ("start",), "end": ("end",)}


def meetings_of(html: str | None) -> list[tuple[str, str, str, str, str]]:
    """Meetings of a calendar page; cancelled ones, bad dates and ends before starts are left out; the last row of a name wins."""
    out = {}
    for r in named_rows(html, _MEETING):
        dates = [m[0] if (m := re.search(r"\d{4}-\d{2}-\d{2}", r[k])) else "" for k in ("start", "end")]
        if "cancel" in (r["name"] + r["title"]).lower() or not all(dates) or dates[0] > dates[1]:
            continue
        out[r["name"]] = (r["name"], r["title"], r["location"], *dates)
    return list(out.values())


def meetings(pages: DataFrame, key: str, html: str) -> DataFrame:
    return table_function(pages, [html], key, [(n, pa.string(), "string") for n in ("name", "title", "location", "start_date", "end_date")], meetings_of)


def directory_of(url: str | None, html: str | None) -> list[tuple[str, str, bool]]:
    """Direct children of a listing on the same host: name, address, whether a folder."""
    base, out = urlsplit(url or ""), {}
    folder = base.path if base.path.endswith("/") else base.path + "/"
    for _, target, _ in links_of(url if (url or "").endswith("/") else f"{url}/", html):
        t = urlsplit(target)
        name = t.path.removeprefix(folder)
        if t.netloc == base.netloc and t.path.startswith(folder) and name.strip("/") and "/" not in name.strip("/") and not t.query:
            out.setdefault(target, (name.strip("/"), target, name.endswith("/")))
    return list(out.values())


def directory(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    return table_function(pages, [url, html], key, [("name", pa.string(), "string"), ("address", pa.string(), "string"), ("is_folder", pa.bool_(), "boolean")], directory_of)


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.dropped = 0
        self.href: list[str | None] = []

    def handle_starttag(self, tag, attrs):
        if tag in _DROP:
            self.dropped += 1
        elif tag in ("p", "div", "br", "tr", "table", "ul", "ol", "article", "section"):
            self.out.append("\n" if tag in ("br", "tr") else "\n\n")
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag == "a":
            href = (dict(attrs).get("href") or "").strip()
            safe = bool(href) and not re.sub(r"[\s\x00-\x1f]", "", href).lower().startswith(_UNSAFE)
            self.href.append(href if safe else None)
            self.out.append("[" if safe else "")

    def handle_endtag(self, tag):
        if tag in _DROP:
            self.dropped = max(0, self.dropped - 1)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag == "a" and self.href:
            href = self.href.pop()
            self.out.append(f"]({href})" if href else "")
        elif tag in ("p", "div") or re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.dropped:
            self.out.append(re.sub(r"\s+", " ", data))


def markdown_of(html: str | None) -> str:
    p = _Markdown()
    p.feed(html or "")
    text = "".join(p.out)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", text)).strip()


def markdown(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, markdown; unsafe links keep their label only."""
    return table_function(pages, [html], key, [("markdown", pa.string(), "string")], lambda h: [(markdown_of(h),)])


#: What a mail client writes before what is quoted or forwarded, and the names of a mail's header lines.
_BETWEEN_RULES = {"original message", "forwarded message", "reply message", "message d'origine"}
_ALONE = {"begin forwarded message:"}
_HEADS = {"from": "from", "sent": "date", "date": "date", "to": "to", "cc": "cc", "subject": "to"}
_WEEKDAYS = {"mon", "tue", "wed", "thu", "fri", "sat", "sun"}


def _is_dated(words: list[str]) -> bool:
    """Whether the words begin with a short weekday, an ISO day, or a month's name and a day in either order."""
    one, two = (*[w.strip(",.") for w in words[:2]], "", "")[:2]
    named = lambda a, b: a.isalpha() and 3 <= len(a) <= 9 and b.isdigit() and len(b) <= 2
    iso = one.split("-")
    return one in _WEEKDAYS or named(one, two) or named(two, one) or [len(x) for x in iso] == [4, 2, 2] and all(x.isdigit() for x in iso)


def _kind(line: str) -> str:
    """blank, quote, cut (what follows is old), wrote, on (the first half of wrote), a header's name, or text."""
    if not line:
        return "blank"
    if line.startswith((">", "&gt;")):
        return "quote"
    low = " ".join(line.casefold().split())
    if low in _ALONE or low[:2].strip("-_") == "" and low[-2:].strip("-_") == "" and low.strip("-_ ") in _BETWEEN_RULES:
        return "cut"
    words = low.split()
    if words[0] == "on" and _is_dated(words[1:]):
        return "wrote" if low.removesuffix(":").rstrip().endswith(" wrote") and low.endswith(":") else "on"
    name, colon, rest = line.replace("**", "").partition(":")
    return _HEADS.get(name.strip().casefold(), "text") if colon and rest.strip() else "text"


def _old_from(kinds: list[str], ends: list[bool], i: int) -> bool:
    """Whether a reply or forward begins at line i. `ends` tells which lines end in `wrote:`."""
    kind, rest = kinds[i], [k for k in kinds[i + 1 :] if k != "blank"]
    if kind == "from":
        seen = set(itertools.takewhile(lambda k: k in _HEADS.values(), rest[:6]))
        return {"date", "to"} <= seen
    if kind == "wrote":
        return not rest or rest[0] == "quote"
    if kind == "on" and i + 1 < len(ends) and ends[i + 1]:
        return len(rest) > 1 and rest[1] == "quote"
    return kind == "cut"


def unquoted(body: str | None) -> str:
    """A message without quoted lines and without what follows a reply or forward mark; single blank lines at most."""
    lines = re.split(r"\r\n?|\n", body or "")
    bare = [x.strip() for x in lines]
    kinds = [_kind(x) for x in bare]
    ends = [x.casefold().endswith("wrote:") for x in bare]
    stop = next((i for i in range(len(lines)) if _old_from(kinds[: i + 60], ends, i)), len(lines))
    kept = [line for line, k in zip(lines[:stop], kinds, strict=False) if k != "quote"]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def without_quotes(messages: DataFrame, key: str, body: str) -> DataFrame:
    return table_function(messages, [body], key, [("text", pa.string(), "string")], lambda b: [(unquoted(b),)])
