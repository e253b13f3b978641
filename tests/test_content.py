"""Messages, stored contents and packed JSON on small tables."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from corvane.functions.packed import pack_json, unpack_json
from corvane.operators import content, messages
from corvane.operators.filters import DateSet


@pytest.fixture(scope="module")
def mail(spark):
    t = lambda d: dt.datetime(2024, 1, d, 12)
    m = [
        ("u/a", "RAN1", "beam report", "Ann <http://x.org/ann>", t(1), t(1), None),
        ("u/b", "RAN1", "agenda", "Bob", t(9), t(9), "R1-2400001"),
        ("u/c", "RAN2", "agenda", "Cyd", t(9), t(9), ""),
        ("u/d", "RAN2", "agenda", "Dee", t(2), None, None),
        ("u/d", "RAN2", "agenda", "Dee", t(2), None, None),
        ("u/e", None, None, None, None, None, None),
    ]
    d = [
        ("u/a", "", [], "nothing"),
        ("u/b", "r1-2400002", [("beam.zip", "http://x.org/R1-2400003.zip"), (None, None)], "see http://x.org/beam/plan now"),
        ("u/c", None, None, "the beam plan"),
        ("u/d", None, None, "the beam plan"),
    ]
    messages_ = spark.createDataFrame(m, "url string, list_id string, subject string, sender string, date timestamp, sort_timestamp timestamp, subject_tdocs string")
    return messages_, spark.createDataFrame(d, "url string, tdocs string, attachments array<struct<name:string,url:string>>, content string")


def test_indexed_texts(mail):
    got = {r.url: r for r in messages.indexable(messages.with_details(*mail)).collect()}
    b = got["u/b"]
    assert (b.tdocs, b.attachments, b.content, b.date, b.week) == ("R1-2400001 R1-2400002 R1-2400003", "beam.zip", "see now", "2024-01-09", "2024-01-W2")
    assert got["u/a"].sender == "Ann" and got["u/a"].tdocs == ""
    assert all(got["u/e"][c] == "" for c in messages.COLUMNS)


def test_search_order_and_source(mail):
    found = messages.search(*mail, "beam").collect()
    assert {r.url: r.matched_source for r in found} == {"u/a": "subject", "u/b": "attachments", "u/c": "content", "u/d": "content"}
    assert [r["rank"] for r in found] == [0, 1, 2, 3] and len({r.url for r in found}) == 4
    by = {r.url: r for r in found}
    assert by["u/c"].score == by["u/d"].score and by["u/c"]["rank"] < by["u/d"]["rank"], "without a timestamp last"
    assert by["u/a"].snippet == "<<beam>> report"
    assert [r.url for r in messages.search(*mail, "beam", offset=1, limit=2).collect()] == [r.url for r in found[1:3]]
    assert [r.url for r in messages.search(*mail, "plan").collect()] == ["u/c", "u/d"], "addresses aren't searched"
    assert [r.url for r in messages.search(*mail, "R1-2400003").collect()] == ["u/b"]
    assert messages.search(*mail, "beam", limit=0).count() == 0
    with pytest.raises(ValueError):
        messages.search(*mail, "beam", limit=501)


def test_filters(mail):
    rows = messages.with_details(*mail)
    of = lambda **f: sorted({r.url for r in rows.where(messages.passing(f)).collect()})
    assert of(list_id="ran1") == ["u/a", "u/b"] and of(list_id="!ran1") == ["u/c", "u/d"] and of(list_id="null") == ["u/e"]
    assert of(tdocs="null") == ["u/a", "u/c", "u/d", "u/e"] and of(tdocs="%2400002") == ["u/b"] and of(tdocs="!r1%") == ["u/a", "u/c", "u/d", "u/e"]
    assert of(dates=DateSet([(dt.date(2024, 1, 2), dt.date(2024, 1, 9))])) == ["u/b", "u/c", "u/d"]
    assert len(of()) == 5
    with pytest.raises(ValueError):
        messages.passing({"colour": "x"})
    assert [r.url for r in messages.search(*mail, "beam", {"list_id": "ran2", "sender": "!dee"}).collect()] == ["u/c"]


def _states(spark):
    e = [
        (1, "a", "m", 2, None, 2), (2, "b", "m", 2, "[]", 2), (3, "c", "m", 2, '["x"]', 1), (4, "d", "m", 1, None, 1),
        (5, "e", "m", 2, None, 0), (6, "f", "m", 2, None, 0), (7, "g", "m", 2, None, 1), (9, "h", None, 2, None, 1),
    ]
    c = [("ls", "a", "m"), ("ls", "a", "n"), ("text", "b", "m"), ("ls", "b", "n"), ("ls", "c", "m"), ("ls", "d", "m"), ("cr", "g", "m"), ("ls", "h", "m"), ("other", "a", "z")]
    e = spark.createDataFrame(e, "tdoc_id bigint, ftp_url string, doc_filename string, extraction_version int, skipped_sources string, document_count int")
    c = spark.createDataFrame(c, "family string, ftp_url string, doc_filename string")
    covers = spark.createDataFrame([("e",), ("e",), ("g",)], "ftp_url string")
    return content.completeness(e, covers, c, ["cr", "ls", "text"]), c


def test_completeness(spark):
    states, _ = _states(spark)
    # b: two files of two families; c: skipped; d: old; f: no cover page; g: the main file among the annexes; h: no main file
    assert {r.ftp_url: r.complete for r in states.collect()} == dict(a=True, b=False, c=False, d=False, e=True, f=False, g=False, h=False)
    tdocs = spark.createDataFrame([(1, "a"), (2, "b"), (5, "e"), (1, "b"), (8, None), (None, "a")], "tdoc_id bigint, ftp_url string")
    got = sorted((str(r.tdoc_id), r.parsed, r.document_count) for r in content.parse_state(tdocs, states).collect())
    assert got == sorted([("1", True, 2), ("2", False, None), ("5", True, 0), ("1", False, None), ("8", False, None), ("None", False, None)], key=lambda x: (x[0], x[1]))


def test_stored_contents(spark):
    states, c = _states(spark)
    kinds = {1: "LS", 2: "LS", 4: "LS", 5: "CR", 7: "agenda", 8: "LS", 10: "LS"}
    urls = {1: "a", 2: "b", 4: "d", 5: "e", 7: "g", 8: "nowhere", 10: "a"}
    t = spark.createDataFrame([(i, urls[i], k) for i, k in kinds.items()], "tdoc_id bigint, ftp_url string, type string")
    asks = [(1, 1, None, None), (2, None, "a", "n"), (3, 1, None, "zz"), (4, 2, None, None), (5, 4, None, None), (6, 5, None, None), (7, 7, None, None), (8, 8, None, None), (9, 99, None, None), (10, 1, "a", None), (11, None, None, None), (12, 10, None, None)]
    q = spark.createDataFrame(asks, "request bigint, tdoc_id bigint, ftp_url string, source_file string")
    got = content.stored(q, t, states, c, {"LS": "ls", "CR": "cr"}).collect()
    of = {}
    for r in sorted(got, key=lambda r: (r.request, not r.is_main, r.doc_filename or "")):
        of.setdefault(r.request, []).append((r.status, r.complete, r.doc_filename))
    assert of == {
        1: [("ok", True, "m"), ("ok", True, "n")], 2: [("ok", True, "n")], 3: [("source_missing", False, None)], 4: [("incomplete", False, None)],
        5: [("incomplete", False, None)], 6: [("ok", True, None)], 7: [("ineligible", False, None)], 8: [("extraction_missing", False, None)],
        9: [("unknown", False, None)], 10: [("bad_request", False, None)], 11: [("bad_request", False, None)], 12: [("incomplete", False, None)],
    }


def test_packed_json(spark):
    texts = ['{"a": "é"}', "[]", None]
    packed = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pack_json("t").alias("z"))
    assert all(r.t == r.back for r in packed.select("t", unpack_json("z").alias("back")).collect())
    whole = gzip.compress(b'{"a": 1}')
    odd = [b"", None, whole[:-9], whole[:12] + b"zzzz" + whole[16:], b"{", b"\xff\xfe", b'{"b": 2}', gzip.compress(b"no json")]
    got = [r.x for r in spark.createDataFrame([(o,) for o in odd], "z binary").select(unpack_json(F.col("z")).alias("x")).collect()]
    assert got == [None] * 6 + ['{"b": 2}', None]
