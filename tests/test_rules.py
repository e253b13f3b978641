"""Expected values of text rules: links, Markdown, module names, numbers, cover pages, quotes."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.sources import changes, web


def _of(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", f(F.col("v")).alias("r")).collect()
    return [r.r for r in sorted(rows, key=lambda r: r.i)]


@pytest.mark.parametrize(("rule", "cases"), [
    (tx.strip_urls, {
        "see [x](http://a)\n\n www.a.org/b  and\tmore": "see x\nand more", "a [b](http://c) <http://d> https://e f": "a b f", "[[x](http://y)](https://z) ok": "x ok", "mail <mailto:a@b.c> now": "mail now",
        "[local](/doc) [part](#a) [odd](nothing)": "local part [odd](nothing)", "(https://a.b/c) end": "( end", "&lt;ftp://a/b&gt; x": "x", "ashttps://x": "ashttps://x", "www.x": "www.x", None: None, "": "", "one\r\ntwo": "one\ntwo",
    }),
    (tx.strip_markdown, {
        "# A **b** _c_ `d` [e](f)\n> g": "A b c d e\ng", "**bold** and *italic* text": "bold and italic text", "# Heading\n\nbody text": "Heading\n\nbody text", "> blockquote": "blockquote",
        "see [the spec](https://example.com) and `code` here": "see the spec and code here", r"a \*b\* \_c\_": "a *b* _c_", "x\n---\ny\n=====": "x\n\ny", "**a *b* c**": "a b c", "2 * 3 * 4": "2 * 3 * 4", None: None, "": "",
    }),
    (tx.module_name, {"ttcn\\a\\Foo.ttcn": "Foo", "POS/NR5GC_Functions": "NR5GC_Functions", "!!!": None, "a/B.TTCN<br>": "B", "x y": "y", "": None, None: None, "a/": None}),
])
def test_text_rules(spark, rule, cases):
    assert dict(zip(cases, _of(spark, rule, list(cases)), strict=True)) == cases


def test_numbers_in_texts(spark):
    assert _of(spark, tx.ids_in, ["r5-1234567R2 and S9-123456, RP-2601234 C6-250028 R5s260009", "R5%2D227476 R5-227476", None]) == [["R5-1234567", "RP-2601234", "C6-250028", "R5S260009"], ["R5-227476"], []]


def test_cover_pages(spark):
    page = "| CHANGE REQUEST |\n|  | 38.523-1 |  | CR |  | 0171 | rev | - | Current version: |  | 17.1.0 |\n| Title: | A | b |\n| Work item code: |  | | Date: | 2024-01-02 |\n| Category: | F | | Release: | | Rel-17 |\n| Reason for change: | | why |\n| Title: | later |\n| Clauses affected: | |\n| Source to WG: | me |"
    bare = "| 38.523-1 | CR | x1 | rev |  | Current version: |  |\n| Summary of change: | | Other comments: | |"
    a, b, c = _of(spark, changes.cover_page, [page, bare, None])
    assert (a.spec, a.cr_num, a.rev, a.version, a.title, a.related_wis, a.date, a.cr_cat, a.release, a.reason_for_change, a.clauses_affected, a.source) == ("38.523-1", "0171", "0", "17.1.0", "A", None, "2024-01-02", "F", "Rel-17", "why", None, "me")
    assert (b.spec, b.cr_num, b.rev, b.version, b.summary_of_change) == ("38.523-1", None, None, None, None)
    assert c is None or all(x is None for x in c)


@pytest.mark.parametrize(("body", "left"), [
    ("hi\n> old\nnew", "hi\nnew"), ("gain &gt; 3\n&gt; old", "gain &gt; 3"), ("a\nOn 2024-01-02 10:00, B wrote:\n> x", "a"), ("a\nOn January 5, 2024, B C wrote:\n\n> x", "a"), ("a\nOn 5 Jan 2024 B wrote:", "a"),
    ("a\nOn Mon, B wrote:\nplain", "a\nOn Mon, B wrote:\nplain"), ("a\n___ Forwarded Message ___\nold", "a"), ("a\n- original message -\nstays", "a\n- original message -\nstays"), ("From: a\nonly that", "From: a\nonly that"),
    ("x\nFrom: a\nTo: b\ntext", "x\nFrom: a\nTo: b\ntext"), ("x\nFrom: a\nDate: b\nCc: d\nSubject: c\nold", "x"), ("", ""),
])
def test_quotes(body, left):
    assert web.unquoted(body) == left
