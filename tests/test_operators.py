"""Operators on literals: grammar matrices, and a differential test against SQLite's full-text index."""

import datetime as dt
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import chunking, filters, tables, textsearch, vector
from corvane.sources import web


@pytest.mark.parametrize(
    "value, passed",
    [(None, {None, "", "abc", "ABC", "a\\b", "a%b"}), ("null", {None}), ("Not-Null", {"", "abc", "ABC", "a\\b", "a%b"}), ("abc", {"abc", "ABC"}), ("!abc", {"", "a\\b", "a%b"}), ("a_c", {"abc", "ABC"}), ("a\\b", {"a\\b"}), ("%b", {"a\\b", "a%b"})],
)
def test_rich(spark, value, passed):
    rows = spark.createDataFrame([(x,) for x in (None, "", "abc", "ABC", "a\\b", "a%b")], "s string")
    assert {r.s for r in rows.where(filters.rich(F.col("s"), value)).collect()} == passed


def test_date_filters():
    with pytest.raises(ValueError):
        filters.date_filter(F.lit(None), "about 2024")
    days = filters.DateSet.parse([">= 2024-01-01", "!= 2024-02-01"])
    assert dt.date(2024, 2, 1) not in days and dt.date(2024, 2, 2) in days and dt.date(2023, 12, 31) not in days
    assert filters.DateSet([(dt.date(2024, 1, 1), dt.date(2024, 1, 5)), (dt.date(2024, 1, 6), None)]).ranges == ((dt.date(2024, 1, 1), None),)
    assert not (days & filters.DateSet.parse(["< 2024-01-01"])).ranges
    assert filters.DateSet.last_year(dt.date(2024, 2, 29)).ranges == ((dt.date(2023, 2, 28), dt.date(2024, 2, 29)),)


@pytest.mark.parametrize("bad", ["", "  ", '"open', "a AND OR b", "(a OR b", "the", "the OR not", "'the'"])
def test_bad_queries(bad):
    with pytest.raises(textsearch.QueryError):
        textsearch.parse(bad)


@pytest.mark.parametrize("query, fts", [("ab cd", '"ab cd"'), ("ab AND cd", None), ("ab OR (cd NOT ef)", None), ('"ab cd" OR ef', None), ("e* AND cd", None), ("NEAR(ab ef, 2)", None)])
def test_bm25_as_sqlite(spark, query, fts):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["ab", "cd", "ef", "eg", "hi"], k=rng.randint(1, 12))), " ".join(rng.choices(["ab", "cd", "xx"], k=rng.randint(0, 5)))) for i in range(40)]
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, a, b)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    want = c.execute("SELECT id, round(bm25(t, 1, 2, 5), 6) FROM t WHERE t MATCH ?", [fts or query]).fetchall()
    got = textsearch.search(spark.createDataFrame(rows, "id int, a string, b string"), query, "id", {"a": 2.0, "b": 5.0}, limit=100).collect()
    if "*" in query:  # the prefix's expansion is one phrase there as here
        assert {r.id for r in got} == {w[0] for w in want}
    else:
        assert dict((r.id, r.score) for r in got) == pytest.approx(dict(want), abs=2e-6)


def test_scalars(spark):
    r = spark.range(1).select(
        tx.normalize_ids(F.lit("x r5-1234567R2, r5-1234567 in 38.300-1")).alias("a"), tx.release_name(F.lit("Release 20")).alias("b"), tx.release_name(F.lit("1999")).alias("c"),
        tx.week_bucket(F.lit("2024-03-15").cast("date")).alias("d"), tx.strip_urls(F.lit("a [b](http://c) <http://d> https://e f")).alias("e"),
        tx.ids_in(F.lit("R5%2D1234567 and r5-7654321")).alias("f"), tx.newest(F.lit([1, 2, 3]), 2).alias("g"), tx.version_key(F.lit("17.x.2")).alias("h"),
    ).first()
    assert r.a == "x R5-1234567 R5-1234567r2, R5-1234567 R5-1234567 in 38_300-1"
    assert (r.b, r.c, r.d, r.e) == ("Rel-20", "1999", "2024-03-W3", "a b f")
    assert sorted(r.f) == ["R5-1234567", "R5-7654321"] and r.g == [2, 3] and r.h == [17, 0, 2]


#: Expected values of the normaliser's rule, as published with it.
NORMALIZED = [
    ("R5-1234567r2", "R5-1234567 R5-1234567r2"), ("R5-123456r1", "R5-123456 R5-123456r1"), ("RP-2200456r10", "RP-2200456 RP-2200456r10"), ("R5-1234567", "R5-1234567 R5-1234567"),
    ("SP-2100123", "SP-2100123 SP-2100123"), ("r5-1234567R2", "R5-1234567 R5-1234567r2"), ("38.300", "38_300"), ("38.300-1", "38_300-1"), ("NB-IoT", "NB-IoT"), ("eNB/gNB", "eNB/gNB"), ("", ""),
    ("abc123.45xyz", "abc123_45xyz"), ("1.2.3.4", "1_2.3_4"), ("38.300.42.1", "38_300.42_1"), ("1.2x3.4", "1_2x3_4"), ("1.2-3.4", "1_2-3.4"), ("1.² ٣.٤", "1.² ٣_٤"), ("١٢.٣٤-٥", "١٢_٣٤-٥"), ("123.x 456.", "123.x 456."),
    ("0" * 50_000 + ".x 38.300-1 " + "0" * 50_000 + ".1", "0" * 50_000 + ".x 38_300-1 " + "0" * 50_000 + "_1"),
]


def test_normalize_ids(spark):
    rows = spark.createDataFrame(NORMALIZED, "raw string, want string").select("want", tx.normalize_ids(F.col("raw")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert all(textsearch.normalize_query(raw) == want for raw, want in NORMALIZED)


def test_queries_are_normalized():
    assert textsearch.parse("R5-1234567r2") == textsearch.Phrase(("r5", "1234567", "r5", "1234567r2"))
    assert textsearch.parse("'power saving' OR nb-iot") == textsearch.Op("OR", textsearch.Phrase(("power", "saving")), textsearch.Phrase(("nb", "iot")))
    assert textsearch.parse("the quick") == textsearch.Phrase(("the", "quick")) and textsearch.parse("Ré") == textsearch.Phrase(("re",))


def test_index_answers_as_the_scan(spark, tmp_path):
    rng = random.Random(8)
    rows = spark.createDataFrame([(i, " ".join(rng.choices(["ab", "cd", "ef", "efg", "R5-1234567r2"], k=rng.randint(0, 12))), rng.choice(["ab", "cd x", None])) for i in range(40)], "id int, a string, b string")
    index = textsearch.Index.build(rows, "id", ["a", "b"])
    index.write(f"{tmp_path}/i")
    index = textsearch.Index.read(spark, f"{tmp_path}/i", "id", ["a", "b"])
    for query in ("ab cd", "ab AND cd", "ab OR (cd NOT ef)", "e* AND b:cd", "NEAR(ab ef, 2)", "^ab OR x*", "R5-1234567r2"):
        want = textsearch.search(rows, query, "id", {"a": 2.0, "b": 5.0}, limit=100).collect()
        assert index.search(query, {"a": 2.0, "b": 5.0}, limit=100).collect() == want, query
    with pytest.raises(textsearch.IndexUnavailableError):
        textsearch.Index.read(spark, f"{tmp_path}/none", "id", ["a"])


def test_more_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    of = lambda f, *values: [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v")).alias("x")).collect()]
    assert of(tx.cover_release, "Release 17", "rel9", "Rel-17", "R99", None) == ["Rel-17", "Rel-9", "Rel-17", "R99", None]
    assert of(tx.id_year, "R5-1234567", "RP-220045r1", "x") == [12, 22, None]
    assert of(tx.group_code, "RAN WG1", "ct 3", "RP", "RAN AH1", "") == ["R1", "C3", "RP", None, None]
    assert of(tx.list_group, "3gpp_tsg_ran_wg5_x", "3GPP_TSG_SA", "3GPP_TSG_CT_IETF", "OTHER") == ["R5", "SP", "CP", None]
    assert of(tx.technology, "38.523-1", "36.579", "1.2", "") == ["5G", "MCX", "", ""]
    assert of(tx.module_name, "ttcn\\a\\Foo.ttcn", "POS/NR5GC_Functions", "!!!") == ["Foo", "NR5GC_Functions", None]
    assert of(tx.function_name, "f_NR_Do (NR)", "My_Type", "Random_Identifier") == ["f_NR_Do", "My_Type", None]
    assert of(lambda c: tx.file_class(c, F.lit("R5-1234567"), F.lit("Inbox")), "draft R5-1234567 v2.docx", "R5-1234567r1.zip", "R5-1234567.zip", "R5-12345678.zip", "R5-1234567.pdf") == ["draft", "revision", None, None, None]
    assert one(tx.file_class(F.lit("R5-1234567_MCC160Comment.doc"), F.lit("r5-1234567"), F.lit("Review"))) == "review"
    keys = of(tx.section_key, "10", "9.2", "9.10", "A.1", "9.2a", "x y")
    assert keys[-1] is None and sorted(keys[:5], key=lambda k: [tuple(x) for x in k]) == [keys[1], keys[4], keys[2], keys[0], keys[3]]
    assert of(lambda c: tx.status_archive_key(c), "TTCN CR Agreement Status 2024-wk07_rev2.zip", "x.zip")[0] == (2024, 7, 2)
    assert [tx.duration_seconds(x) for x in ("24h", "30m", "P1D", "PT1H30M", "1.5s")] == [86400, 1800, 86400, 5400, 1.5]
    with pytest.raises(ValueError):
        tx.duration_seconds("soon")
    assert [one(tx.duration_text(F.lit(n))) for n in (42, 300, 9000, 7200, 108000, 259200)] == ["42s", "5m", "2h 30m", "2h", "1d 6h", "3d"]
    dates = of(tx.mail_date, "Mon, 15 Jan 2024 10:30:00 +0100", "2024-01-15T10:30:00Z", "15 January 2024", "January 15, 2024", "2024-01-15", "15 Jan 2024 10:30", "nonsense")
    assert [(d.local.isoformat(), d.utc.isoformat(), d.offset_seconds, d.precision) for d in dates[:2]] == [("2024-01-15T10:30:00", "2024-01-15T09:30:00", 3600, "datetime"), ("2024-01-15T10:30:00", "2024-01-15T10:30:00", 0, "datetime")]
    assert [d.precision for d in dates[2:6]] == ["date", "date", "date", "datetime"] and all(d.local.day == 15 and d.offset_seconds is None for d in dates[2:6]) and dates[6] is None
    changes = F.from_json(F.lit('[{"ttcn_module": "a/M.ttcn", "function_name": "f_x"}, {"ttcn_module": "B"}, {"function_name": "!"}]'), "array<struct<ttcn_module:string,function_name:string>>")
    assert one(tx.changed_functions(changes)) == ["B.", "M.f_x"]
    assert one(tx.strip_markdown(F.lit("# A **b** _c_ `d` [e](f)\n> g"))) == "A b c d e\ng"
    assert one(tx.strip_urls(F.lit("see [x](http://a)\n\n www.a.org/b  and\tmore"))) == "see x\nand more"


@pytest.mark.parametrize("n, size, overlap", [(0, 4, 1), (3, 4, 1), (4, 4, 1), (5, 4, 1), (7, 4, 1), (9, 3, 0)])
def test_chunk_counts(spark, n, size, overlap):
    text = " ".join(f"w{i}" for i in range(n))
    r = spark.range(1).select(chunking.chunks(F.lit(text), size, overlap).alias("c"), chunking.chunk_count(F.lit(n), size, overlap).alias("n")).first()
    assert len(r.c) == r.n
    want, at = [], 0
    while at < n:
        want.append(" ".join(text.split()[at : at + size]))
        if at + size >= n:
            break
        at += size - overlap
    assert r.c == want
    with pytest.raises(ValueError):
        chunking.chunks(F.lit(text), 4, 4)


def test_structural_chunks():
    md = "# 5 Power\n\nOne two three. Four five six. Seven.\n\nTable 5-1: Values\n\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"
    c = chunking.structural_chunks(chunking.blocks_of(md), most_words=7, overlap=1)
    assert c[0]["text"] == "# 5 Power\n\nOne two three." and c[0]["sections"] == ["5 Power"]
    assert c[1]["text"] == "three.\n\nFour five six.\n\nSeven.\n\nTable 5-1: Values" and c[1]["tables"] == ["5-1 Values"]
    assert c[2]["text"].endswith("| 3 | 4 |") and c[2]["tables"] == ["5-1 Values"]  # whole, although it has more words
    small = chunking.structural_chunks(chunking.blocks_of(md), most_words=50, most_chars=36, overlap=0)
    parts = [x["text"] for x in small if x["table"]]
    assert parts == ["| a | b |\n|---|---|\n| 1 | 2 |", "| a | b |\n|---|---|\n| 3 | 4 |"]
    blocks = chunking.Block
    got = chunking.structural_chunks([blocks("heading", "# 1 Scope", "1", "Scope"), blocks("paragraph", "body")], 3, 1500, 0)
    assert [x["text"] for x in got] == ["# 1 Scope", "body"]
    got = chunking.structural_chunks([blocks("heading", "# 7.2A.3 Scope", "7.2A.3", "Scope"), blocks("paragraph", "alpha beta"), blocks("heading", "## 7.2A.3A Details", "7.2A.3A", "Details"), blocks("paragraph", "gamma")], 20, 1500, 0)
    assert got[0]["sections"] == ["7.2A.3 Scope", "7.2A.3A Details"] and len(got) == 1
    # a sentence over the ceilings is split between words, and joined to its overlap by a blank
    long = chunking.structural_chunks([blocks("paragraph", " ".join(f"w{i}" for i in range(3000)))])
    assert max(len(x["text"].split()) for x in long) <= 512 + 24 and max(len(x["text"]) for x in long) <= 1500 + 24 * 6
    assert long[1]["text"].split()[:24] == long[0]["text"].split()[-24:] and "\n" not in long[1]["text"]
    assert [w for i, x in enumerate(long) for w in x["text"].split()[24 if i else 0 :]] == [f"w{i}" for i in range(3000)]
    with pytest.raises(ValueError):
        chunking.structural_chunks([], 4, 10, 4)


def test_quotes():
    strip = web.unquoted
    assert strip("hi\n> old\nOn Mon, Jan 1, 2024 at 10:00 A <a@b> wrote:\n> more") == "hi"
    assert strip("hi\nOn Monday we wrote:\nprose stays") == "hi\nOn Monday we wrote:\nprose stays"
    assert strip("hi\nfrom: here on it is prose\nend") == "hi\nfrom: here on it is prose\nend"
    assert strip("hi\n\n\n\nFrom: a\nSent: b\nTo: c\nold") == "hi"
    assert strip("hi\n**From:** a\n\n**Date:** b\n\n**Subject:** c\nold") == "hi"
    assert strip("hi\n-----Original Message-----\nold") == strip("hi\nBegin forwarded message:\nold") == "hi"
    assert strip("On Tue, 2 Jan 2024, A B\nC wrote:\n\n> x\nrest") == ""
    assert strip(None) == ""


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [2.0, 0.0])], "id int, v array<double>")
    assert [(r.id, r.distance) for r in vector.knn(rows, [1.0, 0.0], "id", "v", 3).collect()] == [(1, 0.0), (5, 0.0), (3, 0.29289)]
    a = spark.createDataFrame([(1, 0), (2, 1)], "id int, rank int")
    b = spark.createDataFrame([(2, 0), (3, 1)], "id int, rank int")
    got = [(r.id, r.score) for r in vector.fuse(a, b, "id").collect()]
    assert got[0][0] == 2 and got[0][1] == pytest.approx(0.5 / 61 + 0.5 / 60, abs=1e-8)
    assert vector.fuse(a.limit(0), b, "id").count() == 2


def test_snapshots(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None, None), (3, "c", "z")], "k int, v string, w string")
    once = tables.upsert(old, new, ["k"], keep=["w"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", "x"), (2, None, "y"), (3, "c", "z")]
    assert sorted(map(tuple, tables.upsert(once, new, ["k"], keep=["w"]).collect())) == sorted(map(tuple, once.collect()))


def test_web():
    html = '<table><tr><th>Meeting</th><th>Title</th><th>Town</th><th>Start</th><th>End</th></tr><tr><td><a href="/m">R5-1</a></td><td>T</td><td>Rome</td><td>2024-01-02</td><td>2024-01-05</td></tr><tr><td>R5-2</td><td>Cancelled</td><td></td><td>2024-01-02</td><td>2024-01-05</td></tr></table>'
    assert web.meetings_of(html) == [("R5-1", "T", "Rome", "2024-01-02", "2024-01-05")]
    assert web.markdown_of('<h2>A</h2><p>x <b>y</b> <a href="javascript:z()">q</a> <a href="/u">v</a></p>') == "## A\n\nx **y** q [v](/u)"
    assert web.directory_of("http://h/a", '<a href="b/">b</a><a href="/a/c.zip">c</a><a href="/x">x</a><a href="http://o/a/d">d</a>') == [("b", "http://h/a/b/", True), ("c.zip", "http://h/a/c.zip", False)]


def test_stream(spark, tmp_path):
    from corvane.streaming import sessions

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    seen = []
    sessions.maintain(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/c", lambda df, n: seen.append(df.count()))
    assert sum(seen) == events.count()


def test_bracket_join(spark):
    rows = [("R1-", n) for n in (0, 99, 100, 599, 600, 1300, 1301, 5_000_000)] + [("R2-", 700), (None, 700), ("R1-", None)]
    brackets = [(1, "R1-0000100", "R1-0001300"), (2, "R1-0000600", None), (3, "R1-0000599", "R1-0000599"), (4, "R1-0000900", "R1-0000100"), (5, "R1-x", None), (6, None, None), (7, "R1-0000000", "R2-0009999"), (8, "R2-0000100", "R2-0000700")]
    t = spark.createDataFrame(rows, "prefix string, num bigint")
    m = spark.createDataFrame(brackets, "meeting int, start_doc string, end_doc string")
    got = sorted((r.meeting, r.prefix, r.num) for r in tables.bracket_join(t, m, "prefix", "num", "start_doc", "end_doc", 3).collect())
    want = {1: (100, 599, 600, 1300), 2: (600, 1300, 1301, 5_000_000), 3: (599,)}
    assert got == sorted([(k, "R1-", n) for k, v in want.items() for n in v] + [(8, "R2-", 700)])


def test_range_bracket_join_is_whole(spark):
    from corvane.plans import registry

    sf = "/root/testdata/sf0.01"
    nations = [r.n_nationkey for r in spark.read.parquet(f"{sf}/nation.parquet").collect()]
    orders = [(r.o_orderkey, r.o_custkey % 3) for r in spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey").collect()]
    want = sorted((o, n) for n in nations for o, prefix in orders if prefix == n % 3 and o >= n * 600 and (n % 5 == 4 or o <= n * 600 + 450))
    assert sorted(map(tuple, registry.queries()["range_bracket_join"](spark, sf).collect())) == want


def test_delimited_containment_join_is_whole(spark, tmp_path):
    from corvane.plans import registry

    parts = [(i, "red small") for i in range(1, 50)] + [(50, "blue red"), (51, "small blue")]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(tuple, registry.queries()["delimited_containment_join"](spark, str(tmp_path)).collect()))
    assert got == sorted({(k, w) for k, name in parts for w in name.split()})


def _against_sql(spark, name, table, path):
    """Sorted rows of the query over a folder with one table, and those of its SQL."""
    import duckdb

    from corvane.plans import registry

    c = duckdb.connect(config={"threads": 1})
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    return sorted(map(repr, map(tuple, registry.queries()[name](spark, str(path)).select(*want.columns).collect()))), sorted(map(repr, want.fetchall()))


def test_coverage_islands_with_nulls(spark, tmp_path):
    # absent times, absent ids (no end), both before the first end and after it; a user of absent times alone
    days = [(1, 1, 3), (None, 1, 20), (2, 1, None), (4, 2, None), (7, 2, 9), (8, 2, 21), (10, 3, None), (13, 3, None), (16, None, 1), (17, None, 9), (18, None, None)]
    rows = [(i, None if day is None else dt.datetime(2024, 1, day), user) for i, user, day in days] + [(None, dt.datetime(2024, 1, 3), 4), (6, dt.datetime(2024, 1, 12), 4), (None, dt.datetime(2024, 1, 30), 4)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    got, want = _against_sql(spark, "coverage_islands", "events", tmp_path)
    assert got == want and len(got) == 9


def test_gap_bridged_runs_with_nulls(spark, tmp_path):
    rows = [(k, n, 50.0, "N") for k, n in [(1, 1), (1, 4), (1, 8), (1, None), (1, None), (2, None), (3, 5), (None, 1), (None, None)]] + [(3, 6, 1.0, "R"), (3, 11, 40.0, "N"), (3, 12, 1.0, "R")]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = _against_sql(spark, "gap_bridged_runs", "lineitem", tmp_path)
    assert got == want and len(got) == 9


@pytest.mark.parametrize("kind, top", [("int", 2**31 - 1), ("bigint", 2**63 - 1)])
def test_gap_bridged_runs_up_to_the_greatest_number(spark, tmp_path, kind, top):
    rows = [(k, n, 50.0, "N") for k, n in [(1, top), (1, top - 1), (1, top - 3), (1, top - 7), (2, top - 3), (2, top), (3, -top - 1), (3, 3 - top), (3, 2 - top), (4, top)]]
    spark.createDataFrame(rows, f"l_orderkey bigint, l_linenumber {kind}, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got, want = _against_sql(spark, "gap_bridged_runs", "lineitem", tmp_path)
    assert got == want and len(got) == 5


@pytest.mark.parametrize("gap", [0, 2])
def test_islands_whatever_the_order_of_equal_rows(spark, gap):
    chance = random.Random(5)
    rows = [(k, a, a + chance.randrange(3)) for k in range(40) for a in (chance.randrange(40) for _ in range(12))] * 3
    want = []
    for k in range(40):
        met = {n for x, a, z in rows if x == k for n in range(a, z + 1)}
        met |= {n for n in range(40) if any(n - i in met and n + j in met for i in range(1, gap + 1) for j in range(1, gap + 2 - i))}
        want += [(k, n, next(m for m in range(n, 99) if m + 1 not in met)) for n in met if n - 1 not in met]
    for _ in range(2):
        chance.shuffle(rows)
        assert sorted(map(tuple, tables.islands(spark.createDataFrame(rows, "k int, a int, z int"), ["k"], "a", "z", gap).collect())) == sorted(want)
