"""Composed search, widening windows, sweeps, derived tables, encoders, SQL names and stateful streams."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from corvane.functions import sql_names
from corvane.functions import text as tx
from corvane.operators import encoding, filters, freshness, request, sweep, tables, textsearch, vector
from corvane.operators.segments import SegmentedIndex
from corvane.operators.snapshots import Bundle
from corvane.streaming import sessions, state


@pytest.mark.parametrize(("fanout", "name", "rows"), [(1, "none", 45), (1, "pushed", 3), (1, "pattern", 178), (4, "none", 36), (4, "pushed", 5), (4, "pattern", 169), (8, "none", 24), (8, "pushed", 5), (8, "pattern", 157)])
def test_windows_widen_as_far_as_they_must(spark, fanout, name, rows):
    """Ten records of eight near pieces crowd out five records of one piece each; rows read are known values."""
    pieces = [(f"C{i:02}", i * 8 + j, 0.1 + i / 1000, 100) for i in range(10) for j in range(8)] + [(f"M{i}", 80 + i, 0.5 + i / 100, 200) for i in range(5)]
    df = spark.createDataFrame(pieces, "record string, piece int, distance double, meeting int")
    passes = None if name == "none" else F.col("meeting") == 200
    found, sizes = vector.widening(df.where("meeting = 200") if name == "pushed" else df, "record", "piece", 3, passes if name == "pattern" else None, fanout)
    assert sum(sizes) == rows
    best = [r.record for r in vector.grouped(found, "record", "piece").orderBy("rank").limit(3).collect()]
    assert best == (["C00", "C01", "C02"] if name == "none" else ["M0", "M1", "M2"])


def test_windows_end(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "record string, piece int, distance double")
    assert vector.widening(df.where("false"), "record", "piece", 3)[1] == [0]
    rows, sizes = vector.widening(df, "record", "piece", 3, F.lit(False), 1)
    assert rows.count() == 0 and sizes == [2]
    assert vector.widening(df, "record", "piece", 5, None, 1, most=2)[1] == [2]


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(i, 1, " ".join(rng.choices(["power", "radio", "cell", "beam"], k=rng.randint(1, 9)))) for i in range(40)]
    index = SegmentedIndex(Bundle(spark, str(tmp_path_factory.mktemp("ix"))), "id", ("body",))
    index.apply(spark.createDataFrame(rows, "id bigint, revision bigint, body string"))
    facts = spark.createDataFrame([(i, "RAN5" if i % 2 else "SA2", f"Rel-{15 + i % 4}", f"2024-01-{1 + i % 28:02}") for i in range(40)], "id bigint, grp string, release string, day string")
    chunks = spark.createDataFrame([(c, c // 3, [float(c % 7), float(c % 11), 1.0]) for c in range(120)], "chunk bigint, id bigint, embedding array<double>")
    return request.Sources("id", facts, index, {"body": 1.0}, chunks, encode=lambda said: [1.0, 2.0, float(len(said))])


def test_each_mode(sources):
    asked = {"equal": {"grp": "RAN5"}, "since": {"day": "2024-01-05"}, "like": {"release": "!rel-17"}}
    allowed = {r.id for r in sources.facts.where("grp = 'RAN5' and day >= '2024-01-05' and release <> 'Rel-17'").collect()}
    got = {}
    for mode, said in (("filter", {}), ("text", {"text": " radio "}), ("semantic", {"semantic": "abc"}), ("hybrid", {"text": "radio", "semantic": "abc"})):
        rows = request.search(request.Request(**said, **asked, limit=4), sources).collect()
        assert len(rows) == 4 and {r.mode for r in rows} == {mode} and {r.id for r in rows} <= allowed and all(r.grp == "RAN5" for r in rows)
        got[mode] = rows
    assert [r.id for r in got["filter"]] == sorted(allowed)[:4]
    assert [r.rank_text for r in got["text"]] == [0, 1, 2, 3] and [r.rank_vector for r in got["semantic"]] == [0, 1, 2, 3]
    for r in got["hybrid"]:
        part = lambda rank: 0.5 / (60 + rank) if rank is not None else 0.0
        assert r.score == pytest.approx(part(r.rank_text) + part(r.rank_vector), abs=1e-8)
        assert (r.best_chunk is None) == (r.rank_vector is None)
    assert request.search(request.Request(text="radio", limit=0), sources).count() == 0


def test_a_side_that_is_absent(sources):
    from dataclasses import replace

    with pytest.raises(textsearch.IndexUnavailableError):
        request.search(request.Request(text="radio"), replace(sources, index=None))
    with pytest.raises(textsearch.IndexUnavailableError):
        request.search(request.Request(semantic="radio"), replace(sources, encode=None))
    assert request.search(request.Request(like={"release": "Rel-15"}), replace(sources, index=None, encode=None)).count() == 10


def test_sweeps_against_days(spark):
    rng = random.Random(4)
    spans = lambda n: [("hot" if rng.random() < 0.5 else rng.choice("abc"), x := rng.randint(0, 90), x + rng.choice([-1, 0, 0, 3, 9])) for _ in range(n)]
    a, b = spans(60), spans(30)
    a += a[:4] + [("a", None, 5), (None, 1, 4)]
    frame = lambda rows: spark.createDataFrame(rows, "k string, a bigint, z bigint")
    days = lambda rows: {(k, d) for k, x, z in rows if x is not None for d in range(x, z + 1)}

    def runs(found):
        out = []
        for k, d in sorted(found, key=lambda p: (p[0] or "", p[1])):
            if out and out[-1][0] == k and out[-1][2] == d - 1:
                out[-1] = (k, out[-1][1], d)
            else:
                out.append((k, d, d))
        return set(out)

    rows = lambda df: {(r.k, r.a, r.z) for r in df.collect()}
    named = [r for r in a if r[0]]
    assert rows(sweep.missing(frame(named), frame(b), ["k"], "a", "z")) == runs(days(named) - days(b))
    assert rows(sweep.committed(frame(named), frame(b), ["k"], "a", "z")) == runs(days(named) | days(b))
    inner = {(k, d) for k in {k for k, _ in days(b)} for d in range(min(x for j, x in days(b) if j == k), max(x for j, x in days(b) if j == k))} - days(b)
    assert rows(sweep.gaps(frame(b), ["k"], "a", "z")) == runs(inner)
    assert sweep.missing(frame(b), frame(b), ["k"], "a", "z").count() == 0 and sweep.committed(frame([]), frame([]), ["k"], "a", "z").count() == 0


def test_running_sums_spread_a_hot_key(spark):
    rows = spark.range(2000).select(F.lit("hot").alias("k"), F.col("id").alias("o"), (F.col("id") % 5).alias("v"), F.lit(1).alias("other"))
    got = sweep.running_sums(rows, ["k"], "o", ["v"])
    assert [r.v for r in got.orderBy("o").collect()] == [sum(i % 5 for i in range(n + 1)) for n in range(2000)] and got.columns == ["k", "o", "other", "v"]


def test_staleness_goes_down_the_levels(spark):
    t = lambda rows: spark.createDataFrame(rows, "key string, fingerprint string")
    up = spark.createDataFrame([("a", "a0"), ("a", "a1"), ("b", "b0"), ("c", "c0")], "parent_key string, key string")
    one = freshness.Derived("one", t([("a", "1"), ("b", "1"), ("c", "1")]), t([("a", "0"), ("c", "1"), ("d", "1")]))
    two = freshness.Derived("two", t([(k, "1") for k in ("a0", "a1", "b0", "c0")]), t([("a0", "1"), ("a1", "0"), ("b0", "1"), ("c0", "1")]), (("one", up),))
    last = freshness.Derived("last", t([("x", "1"), ("y", "1")]), t([("x", "1"), ("y", "1")]), (("two", spark.createDataFrame([("b0", "x"), ("c0", "y")], "parent_key string, key string")),))
    got = {(r.table, r.key): (r.reason, r.level) for r in freshness.freshness_graph([one, two, last]).collect()}
    assert got == {("one", "a"): ("changed", 0), ("one", "b"): ("missing", 0), ("one", "d"): ("orphan", 0), ("two", "a0"): ("upstream", 1), ("two", "a1"): ("changed", 1), ("two", "b0"): ("upstream", 1), ("last", "x"): ("upstream", 2)}
    with pytest.raises(ValueError, match="one"):
        freshness.freshness_graph([two, one])


def test_batches_are_filled_across_edges():
    calls = []

    def encode(texts):
        calls.append(len(texts))
        if len(calls) == 2:
            raise encoding.EncoderUnavailable("busy")
        return [[float(len(t)), 1.0] for t in texts]

    got = list(encoding.encode_rows(((i, "x" * i) for i in range(70)), encode, 2, wait=0))
    assert calls == [32, 32, 32, 6] and got == [(i, [float(i), 1.0]) for i in range(70)]
    with pytest.raises(encoding.EncoderUnavailable):
        list(encoding.encode_rows(iter([(1, "a"), (2, "b")]), lambda t: [[1.0]], 1, wait=0))
    with pytest.raises(encoding.IncompatibleVectors):
        list(encoding.encode_rows(iter([(1, "a")]), lambda t: [[1.0, 2.0]], 3, wait=0))


def test_encoded_rows(spark):
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else " " if i % 10 == 1 else "y" * i, 1) for i in range(100)], "k int, t string, model int").coalesce(1)

    def encoder():
        return lambda texts: [[float(len(t)), float(len(texts))] for t in texts]

    got = encoding.encoded(rows, "k", "t", encoder, "m", 2).collect()
    assert len(got) == 80 and all(r.embedding[0] == r.k and r.model == "m" for r in got)
    assert sorted({r.embedding[1] for r in got}) == [16.0, 32.0], "80 texts in one task: 32, 32, 16"
    found = encoding.encoded(rows, "k", "t", encoder, "m", 2)
    encoding.check_compatible(found, "m", 2)
    for model, dims in (("other", 2), ("m", 3)):
        with pytest.raises(encoding.IncompatibleVectors):
            encoding.check_compatible(found, model, dims)
    assert encoding.encoded(rows.where("false"), "k", "t", encoder, "m", 2).count() == 0


def test_functions_by_name(spark):
    sql_names.register(spark, "cv_")
    texts = ["Étude r5-1234567R2 and 38.300-1  x", None, "a%b\\c", "R5-1234567 tab\tb", "", "x S2-123456 y C1-1234567r12."]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    patterns = [None, "", "null", "not-null", "!%AND%", "a\\%b%", "%1234567%", "a%\\c"]
    columns = [tx.tokens(F.col("v")), tx.normalize_ids(F.col("v")), tx.collapse(F.col("v")), tx.week_bucket(F.lit(dt.date(2024, 2, 29))), *[filters.rich(F.col("v"), p) for p in patterns]]
    names = [F.expr(x) for x in ("cv_tokens(v)", "cv_normalize_ids(v)", "cv_collapse_spaces(v)", "cv_week_bucket(DATE '2024-02-29')")] + [F.call_function("cv_rich", F.col("v"), F.lit(p)) for p in patterns]
    same = df.select(*[c.alias(f"a{i}") for i, c in enumerate(columns)], *[c.alias(f"b{i}") for i, c in enumerate(names)]).collect()
    assert all(r[f"a{i}"] == r[f"b{i}"] for r in same for i in range(len(columns)))


def test_lists_meet_patterns_by_their_letters(spark):
    lists = ["alpha,beta,gamma", "be_a,x", "", None, "a", "alpha beta,x%", "gam,ma", "ALPHA"]
    patterns = ["alpha", "BETA", "b__a", "%", "a", "gam%", "x\\", "", None, "_"]
    rows = spark.createDataFrame(list(enumerate(lists)), "k int, l string")
    asked = spark.createDataFrame([(p,) for p in patterns], "p string")
    found = tables.like_members(rows, "k", "l", asked, "p")
    want = rows.crossJoin(asked).where(F.expr("concat(',', l, ',') ilike concat('%,', replace(p, '\\\\', '\\\\\\\\'), ',%')"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((r.k, r.p) for r in want.collect())
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_stream_with_restarts_gives_the_batch_result(spark, tmp_path):
    """Shuffled micro-batches, a stop after a batch was merged but before it was noted, and two restarts."""
    rng = random.Random(8)
    base = dt.datetime(2024, 5, 1)
    rows = [(rng.choice([1, 2, 3, None]), base + dt.timedelta(minutes=rng.choice([0, 5, 29, 30, 31, 200, 1000, 4000]) + rng.randint(0, 400))) for _ in range(240)]
    events = spark.createDataFrame([(u, t, f"{i}") for i, (u, t) in enumerate(rows)], "user bigint, ts timestamp_ntz, note string")
    folder = tmp_path / "in"
    for i in range(6):
        events.where(F.col("note").cast("int") % 6 == i).coalesce(1).write.mode("append").parquet(str(folder))
    spark.createDataFrame([(-1, base + dt.timedelta(days=400), "end")], events.schema).coalesce(1).write.mode("append").parquet(str(folder))
    bundle = Bundle(spark, str(tmp_path / "out"))
    merge = state.merging(bundle, "sessions", ["user", "started"])
    stops = {2, 6}

    def failing(frame, batch):
        merge(frame, batch)
        if batch in stops:
            stops.discard(batch)
            raise RuntimeError("stopped after the merge")

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        sessions.maintain(state.stateful_sessions(stream, "user", "ts", late="300 days"), str(tmp_path / "check"), failing)

    left = 0
    for _ in range(4):
        try:
            run()
            break
        except Exception:  # noqa: BLE001 - the stop above
            left += 1
    assert left == 2
    want = sessions.batch_sessions(events, "user", "ts")
    pick = lambda df: sorted((r.user is None, r.user or 0, r.started, r.n) for r in df.collect())
    assert pick(bundle.read("sessions").where("user IS NULL OR user > 0")) == pick(want)


def test_spans_merge_in_any_order():
    rng = random.Random(1)
    for _ in range(50):
        times = [rng.randint(0, 60) for _ in range(12)]
        spans = []
        for t in times:
            spans = state.merged([*spans, (t, t, 1)], 5)
        assert spans == state.merged([(t, t, 1) for t in times], 5) and sum(s[2] for s in spans) == 12
        assert all(b[0] - a[1] > 5 for a, b in zip(spans, spans[1:], strict=False))


def test_session_stream_of_spark_gives_the_same(spark, tmp_path):
    base = dt.datetime(2024, 5, 1)
    rows = [(u, base + dt.timedelta(minutes=m)) for u in (1, 2) for m in (0, 10, 45, 74, 200)]
    events = spark.createDataFrame(rows, "user bigint, ts timestamp_ntz")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, base + dt.timedelta(days=30))], events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"s{uuid.uuid4().hex}"
    q = sessions.stream_sessions(stream, "user", "ts").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table(name).where("user < 9").select("user", F.col("started").cast("timestamp_ntz").alias("started"), "n")
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in sessions.batch_sessions(events, "user", "ts").collect())
