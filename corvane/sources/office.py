"""Office archives from a `binaryFile` source: members, workbook rows, document and slide text; read by the standard library in Arrow batches."""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ID, let
from ..operators.chunking import Block
from .web import table_function

#: What the first lines of a document of each family hold.
_FAMILIES = (("wid", r"3GPP™ Work Item Description", 20), ("ls", r"^\s*Title:\s+(?:Reply\s+)?LS\s+on\s+", 10), ("discussion", r"^\s*Title:\s+Discussion\s+on\s+", 10))


def content_family(markdown: Column) -> Column:
    """wid, ls or discussion, by the first lines that aren't blank; null for others."""
    def of(lines: Column) -> Column:
        found = [F.when(F.exists(F.slice(lines, 1, n), lambda x: x.rlike(pattern)), name) for name, pattern, n in _FAMILIES]  # noqa: B023
        return F.coalesce(*found)

    return let(F.filter(F.split(markdown, r"\r\n|[\n\r]"), lambda x: F.trim(x) != ""), of)


class ArchiveError(ValueError):
    """An archive that isn't read: too many or too large members, or unsafe or repeated paths."""


def members_of(data: bytes | None, most: int = 200, most_bytes: int = 500_000_000) -> list[tuple[str, int]]:
    """(path, size) of an archive's files, in its order."""
    if not data or not zipfile.is_zipfile(io.BytesIO(data)):
        return []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        files = [i for i in z.infolist() if not i.is_dir()]
    if len(files) > most or sum(i.file_size for i in files) > most_bytes:
        raise ArchiveError("the archive is too large")
    out, seen = [], set()
    for i in files:
        path = i.filename.replace("\\", "/")
        if path.startswith("/") or re.match(r"[A-Za-z]:", path) or ".." in path.split("/"):
            raise ArchiveError(f"unsafe path {path!r}")
        if path.casefold() in seen:
            raise ArchiveError(f"repeated path {path!r}")
        seen.add(path.casefold())
        out.append((path, i.file_size))
    return out


def members(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, member, size, error: an archive that isn't read is one row with its error."""
    def rows(data: bytes) -> Iterator[tuple]:
        try:
            yield from ((path, size, None) for path, size in members_of(data))
        except (ArchiveError, zipfile.BadZipFile) as e:
            yield None, None, str(e)

    return table_function(files, [content], key, [("member", pa.string(), "string"), ("size", pa.int64(), "bigint"), ("error", pa.string(), "string")], rows)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Za-z]*", ref)[0].upper():
        n = n * 26 + ord(c) - 64
    return n - 1


class Workbook:
    """Cell values (text, numbers as text, dates as ISO days) and external links of a workbook's sheets."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        names = set(self.zip.namelist())
        tree = lambda name: ElementTree.fromstring(self.zip.read(name)) if name in names else None
        shared = tree("xl/sharedStrings.xml")
        self.shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in shared] if shared is not None else []
        styles = tree("xl/styles.xml")
        codes, self.dated = {}, []
        if styles is not None:
            codes = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iter() if _local(f) == "numFmt"}
            for xfs in (x for x in styles if _local(x) == "cellXfs"):
                for xf in xfs:
                    n = int(xf.get("numFmtId") or 0)
                    bare = re.sub(r'"[^"]*"|\[[^\]]*\]', "", codes.get(n, ""))
                    self.dated.append(14 <= n <= 22 or bool(re.search("[dy]", bare, re.I)))
        self.links = {m.get("Id"): m.get("Target") for m in tree("xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in names else {}
        book = tree("xl/workbook.xml")
        self.sheets = {s.get("name"): self._path(self.links.get(_attribute(s, "id"), "")) for s in (book.iter() if book is not None else []) if _local(s) == "sheet"}
        self.names = names

    @staticmethod
    def _path(target: str) -> str:
        bare = target.lstrip("/")
        return bare if bare.startswith("xl/") else f"xl/{bare}"

    def _value(self, c: ElementTree.Element) -> str | None:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter() if _local(t) == "t")
        v = next((x.text for x in c if _local(x) == "v"), None)
        if v is None:
            return None
        if kind == "s":
            return self.shared[int(v)]
        style = int(c.get("s") or 0)
        if kind == "n" and style < len(self.dated) and self.dated[style]:
            return (dt.datetime(1899, 12, 30) + dt.timedelta(days=float(v))).isoformat(sep=" ").removesuffix(" 00:00:00")
        return v

    def rows(self, sheet: str | None = None) -> Iterator[tuple[int, dict[int, str]]]:
        """(row number from 1, column number from 0 -> text), of the first sheet unless one is named."""
        path = self.sheets.get(sheet) if sheet else next(iter(self.sheets.values()), None)
        if path not in self.names:
            return
        for r in ElementTree.fromstring(self.zip.read(path)).iter():
            if _local(r) == "row":
                cells = {_column(c.get("r") or ""): self._value(c) for c in r if _local(c) == "c"}
                yield int(r.get("r")), {k: v.strip() for k, v in cells.items() if v is not None and v.strip()}

    def hyperlinks(self, sheet: str | None = None) -> dict[tuple[int, int], str]:
        """(row, column) -> address of external links."""
        path = self.sheets.get(sheet) if sheet else next(iter(self.sheets.values()), None)
        rels = f"xl/worksheets/_rels/{(path or '').rsplit('/', 1)[-1]}.rels"
        if path not in self.names or rels not in self.names:
            return {}
        to = {x.get("Id"): x.get("Target") or "" for x in ElementTree.fromstring(self.zip.read(rels))}
        out = {}
        for h in ElementTree.fromstring(self.zip.read(path)).iter():
            target = to.get(_attribute(h, "id") or "", "") if _local(h) == "hyperlink" else ""
            ref = h.get("ref") or ""
            if target.startswith(("http://", "https://", "ftp://")) and re.fullmatch(r"[A-Za-z]+\d+", ref):
                out[int(re.search(r"\d+", ref)[0]), _column(ref)] = target
        return out


def _head(value: str | None) -> str:
    return re.sub(r"\s+", " ", (value or "").strip().lower())


def pick(heads: dict[str, int], options: list[str]) -> int | None:
    """The column of the first option that is a head, else of the first that is a part of one."""
    wanted = [_head(o) for o in options if _head(o)]
    return next((heads[o] for o in wanted if o in heads), None) if any(o in heads for o in wanted) else next((i for o in wanted for h, i in heads.items() if o in h), None)


#: Fields of a contribution list and the heads that their columns go by.
CONTRIBUTION_FIELDS = {
    "title": ["Title"], "source": ["Source"], "type": ["Type"], "status": ["Status", "TDoc Status"], "reservation_date": ["Reservation Date"], "uploaded_date": ["Uploaded Date", "Uploaded"],
    "cr_cat": ["CR Cat", "CR category", "Cat"], "is_revision_of": ["Is revision of"], "revised_to": ["Revised to"], "release": ["Release"], "spec": ["Spec"], "version": ["Version"],
    "related_wis": ["Related WIs", "Work item code"], "cr_num": ["CR"], "cr_pack": ["TSG CR Pack", "CR Pack"], "tdoc_for": ["For"], "abstract": ["Abstract"], "secretary_remarks": ["Secretary Remarks"],
    "ls_to": ["To"], "ls_cc": ["Cc"], "original_ls": ["Original LS"],
}
_HEAD_MARKS = ("title", "source", "type", "status", "spec", "version", "release")


def contributions_of(data: bytes | None) -> list[tuple]:
    """(number, address, fields in the order of CONTRIBUTION_FIELDS) of a contribution list; rows without a document number are left out."""
    book = Workbook(data or b"")
    links, out, heads, at = book.hyperlinks(), [], None, None
    for n, row in book.rows():
        if heads is None:
            names: dict[str, int] = {}
            for i, v in row.items():
                names[_head(v)] = i
            if any("tdoc" in h for h in names) and any(m in h for h in names for m in _HEAD_MARKS):
                heads, at = names, pick(names, ["TDoc"])
                columns = [pick(names, options) for options in CONTRIBUTION_FIELDS.values()]
            continue
        m = re.search(rf"{ID}(?:r\d)?", row.get(at, ""), re.I)
        if m:
            out.append((m[0], links.get((n, at)), *(row.get(c) if c is not None else None for c in columns)))
    if heads is None:
        raise ValueError("the workbook has no header row")
    return out


def contributions(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, number, address and a column for each field, days as dates."""
    from ..functions.text import parse_date

    kinds = [(n, pa.string(), "string") for n in ("number", "address", *CONTRIBUTION_FIELDS)]
    out = table_function(files, [content], key, kinds, contributions_of)
    day = lambda c: parse_date(F.regexp_extract(F.col(c), r"^(\S+)", 1))
    return out.withColumns({c: day(c) for c in ("reservation_date", "uploaded_date")})


#: Sheets of a test-case workbook, their groups, and the column pairs (from 0) of each path's two statuses.
SHEETS = {"5G_TC_Status": "5G", "LTE_TC_Status": "LTE", "IMS_TC_Status": "IMS", "UTRA_TC_Status": "UTRA", "Positioning_TC_Status": "POS", "MCX_TC_Status": "MCX"}
STATUS_PAIRS = {
    "5G": [(2, 3, "FR1"), (2, 15, "FR2"), (2, 22, "FR1+FR2")], "LTE": [(2, 3, "FDD"), (15, 16, "TDD")], "IMS": [(2, 3, "default")], "UTRA": [(2, 3, "default")], "POS": [(2, 3, "default")],
    "MCX": [(2, 3, "IPCAN-4G"), (17, 18, "EUTRA"), (26, 27, "IPCAN-5G"), (37, 38, "NR5GC")],
}
FIXED_SPECS = {"5G": "38.523-1", "LTE": "36.523-1"}


def testcases_of(data: bytes | None) -> list[tuple]:
    """Rows ("case", id, group, title, ats, feature, release, wis, spec, null, null, null) and ("status", id, group, null x 6, path, gcf, ttcn), and ("note", text, group, ...).

    The first row of an (id, group) counts; a path counts only where both its columns have the heads that they should.
    """
    book, out, seen = Workbook(data or b""), [], set()
    for sheet, group in SHEETS.items():
        rows = [r for _, r in book.rows(sheet)] if sheet in book.sheets else []
        if not rows:
            out.append(("note", f"sheet {sheet} is missing or has no header row", group, *[None] * 9))
            continue
        heads: dict[str, int] = {}
        for i, v in rows[0].items():
            heads.setdefault(_head(v), i)
        bare = {i: re.sub("[^a-z0-9]", "", v.lower()) for i, v in rows[0].items()}
        pairs = [p for p in STATUS_PAIRS[group] if "gcfptcrb" in bare.get(p[0], "") and "ttcnstatus" in bare.get(p[1], "")]
        for r in rows[1:]:
            get = lambda name: r.get(heads.get(name, -1))  # noqa: B023, E731
            case = get("tc")
            if case is None or (case, group) in seen:
                continue
            seen.add((case, group))
            out.append(("case", case, group, *(get(n) for n in ("title", "ats", "feature", "release", "ran wic")), FIXED_SPECS.get(group) or get("part of"), None, None, None))
            out += [("status", case, group, *[None] * 6, path, r.get(a), r.get(b)) for a, b, path in pairs if r.get(a) or r.get(b)]
    return out


def testcases(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    names = ("kind", "testcase_id", "test_group", "title", "ats", "feature", "release", "wis", "spec", "status_path", "gcf_ptcrb", "ttcn_status")
    return table_function(files, [content], key, [(n, pa.string(), "string") for n in names], testcases_of)


def _runs_text(p: ElementTree.Element) -> str:
    """A paragraph's text; inserted and deleted runs between <ins> and <del> marks."""
    out: list[str] = []

    def walk(e: ElementTree.Element, mark: str) -> None:
        for x in e:
            kind = _local(x)
            if kind in ("ins", "del"):
                out.append(f"<{kind}>")
                walk(x, kind)
                out.append(f"</{kind}>")
            elif kind in ("t", "delText"):
                out.append(x.text or "")
            elif kind in ("tab", "br", "cr"):
                out.append(" ")
            elif kind != "pPr":
                walk(x, mark)

    walk(p, "")
    return re.sub(r"<(ins|del)>(\s*)</\1>", r"\2", "".join(out)).strip()


def docx_blocks(data: bytes | None) -> list[Block]:
    """Headings, paragraphs and tables (as pipe tables) of a word-processor document, in order; a table is named by a caption just before it."""
    from ..operators.chunking import _CAPTION

    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))[0]
    out: list[Block] = []
    for e in body:
        if _local(e) == "p":
            text = _runs_text(e)
            style = next((_attribute(s, "val") or "" for s in e.iter() if _local(s) == "pStyle"), "")
            level = re.fullmatch(r"heading\s*(\d)", style, re.I)
            if level and text:
                m = re.match(r"((?:[A-Z]|\d+)(?:\.\d+[A-Z]*)*)\s+(.*)", text, re.S)
                out.append(Block("heading", f"{'#' * int(level[1])} {text}", m[1] if m else "", m[2] if m else text))
            elif text:
                out.append(Block("paragraph", text))
        elif _local(e) == "tbl":
            rows = [[" ".join(_runs_text(p) for p in c.iter() if _local(p) == "p").replace("|", "\\|").strip() for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            if rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                caption = _CAPTION.match(out[-1].text) if out and out[-1].kind == "paragraph" else None
                out.append(Block("table", "\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]]), *((caption[1], caption[2]) if caption else ())))
    return out


def toc_of(blocks: list[Block]) -> list[tuple[str, str]]:
    """(number, title) of a document's headings, in order."""
    return [(b.section, b.title) for b in blocks if b.kind == "heading"]


def documents(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, block_index, kind, section, title, text of each block."""
    kinds = [("block_index", pa.int32(), "int"), *((n, pa.string(), "string") for n in ("kind", "section", "title", "text"))]
    return table_function(files, [content], key, kinds, lambda d: [(i, b.kind, b.section, b.title, b.text) for i, b in enumerate(docx_blocks(d))])


def slides_of(data: bytes | None) -> list[tuple[int, str, str]]:
    """(slide number, text, notes): paragraphs of shapes and groups, tables as pipe tables."""
    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
        names = set(z.namelist())
        number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
        out = []
        for name in sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
            rels = f"ppt/slides/_rels/{name.rsplit('/', 1)[-1]}.rels"
            notes = ""
            if rels in names:
                target = next((r.get("Target") or "" for r in ElementTree.fromstring(z.read(rels)) if (r.get("Type") or "").endswith("/notesSlide")), "")
                path = "ppt/" + target.removeprefix("../")
                notes = "\n".join(_slide_parts(ElementTree.fromstring(z.read(path)))) if path in names else ""
            out.append((number(name), "\n\n".join(_slide_parts(ElementTree.fromstring(z.read(name)))), notes))
    return out


def _slide_parts(e: ElementTree.Element) -> list[str]:
    out = []
    for x in e:
        if _local(x) == "tbl":
            rows = [[" ".join(_runs_text(p) for p in c.iter() if _local(p) == "p").strip() for c in r if _local(c) == "tc"] for r in x if _local(r) == "tr"]
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            out.append("\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]]) if rows else "")
        elif _local(x) == "p":
            out.append(_runs_text(x))
        else:
            out += _slide_parts(x)
    return [t for t in out if t]


def slides(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    return table_function(files, [content], key, [("slide", pa.int32(), "int"), ("text", pa.string(), "string"), ("notes", pa.string(), "string")], slides_of)


def legacy_kind(name: Column) -> Column:
    """Which converter a legacy file would need (word, presentation); null for files that are read here. None is available offline."""
    return F.when(F.lower(name).endswith(".doc"), "word").when(F.lower(name).endswith(".ppt"), "presentation")


