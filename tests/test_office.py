"""Office archives, change requests and control rows on small built inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.operators import filters, freshness, records
from corvane.sources import changes, office


def archive(**files: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def workbook(sheets: dict[str, list[list[str]]], links: dict[str, str] | None = None) -> bytes:
    letters = [chr(65 + i) if i < 26 else chr(64 + i // 26) + chr(65 + i % 26) for i in range(60)]
    cell = lambda r, c, v: f'<c r="{letters[c]}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v is not None else ""
    files = {}
    for i, rows in enumerate(sheets.values(), 1):
        body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows, 1))
        marks = "".join(f'<hyperlink ref="{ref}" r:id="rId{k}"/>' for k, ref in enumerate(links or {}, 1))
        files[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns:r="r"><sheetData>{body}</sheetData><hyperlinks>{marks}</hyperlinks></worksheet>'
        files[f"xl/worksheets/_rels/sheet{i}.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="{t}"/>' for k, t in enumerate((links or {}).values(), 1)) + "</Relationships>"
    files["xl/workbook.xml"] = '<workbook xmlns:r="r"><sheets>' + "".join(f'<sheet name="{n}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>"
    files["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="/xl/worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>"
    return archive(**files)


def frame(spark, data: bytes):
    return spark.createDataFrame([("f", bytearray(data))], "path string, content binary")


def test_contributions(spark):
    rows = [["TDoc List RAN5"], ["TDoc", "Title", "Type of CR", "Type", "Uploaded"], ["R5-1234567", " A ", "x", "CR", "15/03/2024 10:00:00"], ["none", "B"], ["see RP-220045r1", None, None, None, "13/13/2024"]]
    got = office.contributions(frame(spark, workbook({"s": rows}, {"A3": "https://x/a.zip", "B3": "https://y"}))).orderBy("number").collect()
    assert [(r.number, r.address, r.title, r.type, str(r.uploaded_date)) for r in got] == [("R5-1234567", "https://x/a.zip", "A", "CR", "2024-03-15"), ("RP-220045r1", None, None, None, "None")]
    with pytest.raises(ValueError):
        office.contributions_of(workbook({"s": [["a", "b"]]}))


def test_testcases(spark):
    head = ["TC", "Title", "GCF/PTCRB", "TTCN-Status"]
    lte = [None] * 17
    lte[0], lte[2], lte[3], lte[15], lte[16] = "tc", "GCF / PTCRB", "other", "GCF/PTCRB x", "TTCN status"
    row = [None] * 17
    row[0], row[2], row[15] = "9.1", "no", "yes"
    got = office.testcases(frame(spark, workbook({"5G_TC_Status": [head, ["1.1", "T", "g", "t"], ["1.1", "again", "g", "t"], [None, "x"]], "LTE_TC_Status": [lte, row]}))).collect()
    assert [(r.testcase_id, r.test_group, r.title, r.spec) for r in got if r.kind == "case"] == [("1.1", "5G", "T", "38.523-1"), ("9.1", "LTE", None, "36.523-1")]
    assert [(r.testcase_id, r.status_path, r.gcf_ptcrb, r.ttcn_status) for r in got if r.kind == "status"] == [("1.1", "FR1", "g", "t"), ("9.1", "TDD", "yes", None)]
    assert sum(r.kind == "note" for r in got) == 4


def test_members(spark):
    assert office.members_of(archive(a__b="x", c="yy")) == [("a/b", 1), ("c", 2)] and office.members_of(b"x") == []
    got = office.members(frame(spark, archive(**{"../x": "1"}))).collect()
    assert got[0].member is None and "unsafe" in got[0].error
    with pytest.raises(office.ArchiveError):
        office.members_of(archive(a="1", A="2"))


def test_documents_and_slides(spark):
    w = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr>{w("5.1 Scope")}</w:p><w:p>{w("one ")}<w:ins>{w("two")}</w:ins><w:del><w:r><w:delText>three</w:delText></w:r></w:del></w:p><w:p>{w("Table 5.1-1: Values")}</w:p>'
        f"<w:tbl><w:tr><w:tc><w:p>{w('a')}</w:p></w:tc><w:tc><w:p>{w('b|c')}</w:p></w:tc></w:tr><w:tr><w:tc><w:p>{w('1')}</w:p></w:tc><w:tc><w:p>{w('2')}</w:p></w:tc></w:tr></w:tbl>"
    )
    got = office.documents(frame(spark, archive(**{"word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'}))).orderBy("block_index").collect()
    assert [(r.kind, r.section, r.text) for r in got] == [
        ("heading", "5.1", "## 5.1 Scope"), ("paragraph", "", "one <ins>two</ins><del>three</del>"), ("paragraph", "", "Table 5.1-1: Values"), ("table", "5.1-1", "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |"),
    ]
    p = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    s = lambda x: f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld>{x}</p:cSld></p:sld>'
    deck = archive(**{"ppt/slides/slide10.xml": s(p("last")), "ppt/slides/slide2.xml": s(f"<p:grpSp><p:sp>{p('in')}</p:sp></p:grpSp>{p('out')}"), "ppt/slides/_rels/slide2.xml.rels": '<R><r Type="x/notesSlide" Target="../notesSlides/n1.xml"/></R>', "ppt/notesSlides/n1.xml": s(p("note"))})
    assert office.slides_of(deck) == [(2, "in\n\nout", "note"), (10, "last", "")]


def test_change_blocks():
    text = "# 5.1 Scope\na\nb <ins>x</ins>\nc\nd\ne <del>y</del>\nf\ng\nh\ni <ins>z</ins>\n# 6 Next\nTable 6-1: V\n<ins>q</ins>"
    got = changes.change_blocks(text)
    assert [c for c, _ in got] == [["5.1"], ["5.1"], ["6", "Table 6-1"]]
    assert got[0][1].split("\n")[0] == "# 5.1 Scope" and got[0][1].endswith("g") and got[1][1].startswith("g\nh\ni")
    assert changes.change_blocks("<ins># 7.2 New</ins>", 0, 0)[0][0] == ["7.2 (new)"] and changes.change_blocks(None) == []
    with pytest.raises(ValueError):
        changes.change_blocks("", -1)


def test_cover_page(spark):
    text = "| 38.523-1 | CR | x1 | rev | 2 | Current version: | 17.1.0 |\n| Title: | A |\n| Reason for change: | | long reason |\n| Work item code: | W |  | Date: | 2024-01-02 |"
    r = spark.range(1).select(changes.cover_page(F.lit(text), 4).alias("c")).first().c
    assert (r.spec, r.cr_num, r.rev, r.version, r.title, r.reason_for_change, r.related_wis, r.date, r.release) == ("38.523-1", None, "2", "17.1.0", "A", "long", "W", "2024-01-02", None)


def test_control(spark):
    assert freshness.maintenance(text=True, resume=True)["what"] == "text" and freshness.maintenance()["what"] == "status"
    for bad in ({"text": True, "both": True}, {"resume": True}, {"text": True, "resume": True, "stale_only": True}):
        with pytest.raises(ValueError):
            freshness.maintenance(**bad)
    rows = spark.range(5)
    cursor = spark.createDataFrame([(2, "s1")], "last_key int, snapshot string")
    assert [r.id for r in freshness.resumed(rows, "id", cursor, F.lit("s1")).orderBy("id").collect()] == [3, 4]
    assert freshness.resumed(rows, "id", cursor, F.lit("s2")).count() == 5 == freshness.resumed(rows, "id", cursor.limit(0), F.lit("s1")).count()


def test_validators(spark):
    assert filters.limited(0, 5) == 0 and filters.id_filter("r5-1234567") == ("R5-", 1234567) and filters.spec_filter("38.3%") and filters.spec_filter("not-null") and filters.release_filter("Rel-17")
    for f, bad in ((filters.id_filter, "x"), (filters.spec_filter, "a.b"), (filters.release_filter, "x" * 33), (lambda n: filters.limited(n, 5), 6)):
        with pytest.raises(ValueError):
            f(bad)
    with pytest.raises(ValueError):
        filters.fold({"x": "1"}, {"y": "y"})
    with pytest.raises(ValueError):
        records.show_fields(spark.range(1), "id,nope")
    records_ = records.as_lines(spark.createDataFrame([("a\tb", None)], "x string, y string"), "table").first().value
    assert records_ == "a b\t"


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a,"b"', "x", 2)], "k int, s string, t string, n int")
    records.write_csv(rows, f"{tmp_path}/c", ["k", "s", "t", "n"])
    assert [tuple(r) for r in spark.read.option("header", True).schema(rows.schema).option("escape", '\\').csv(f"{tmp_path}/c").collect()] == [tuple(rows.first())]
