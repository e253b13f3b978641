"""Bundles of tables and the segmented index: updates, versions, compaction, and what is read."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import segments, snapshots, textsearch
from corvane.operators.segments import SegmentedIndex
from corvane.operators.snapshots import Bundle

W = {"title": 3.0, "body": 1.0}
QUERIES = ["ab OR ef OR gh", "ab AND cd", '"ab cd"', "e*", "title:ab NOT cd"]


def _row(rng, key, revision):
    words = lambda n: " ".join(rng.choices(["ab", "cd", "ef", "gh", "Ábc", "R5-1234567r2", "x.y"], k=rng.randint(0, n)))
    return key, revision, rng.choice([words(3), None]), rng.choice([words(12), words(40), ""])


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id string, revision bigint, title string, body string")


def _answers(f):
    return [tuple(r) for r in f.collect()]


def test_updates_equal_a_new_index(spark, tmp_path):
    rng = random.Random(9)
    index = SegmentedIndex(Bundle(spark, str(tmp_path / "ix")), "id", ("title", "body"), block=4)
    with pytest.raises(textsearch.IndexUnavailableError):
        index.rows()
    now = {f"k{i}": _row(rng, f"k{i}", 1) for i in range(60)}
    assert index.apply(_frame(spark, list(now.values()))) == 1
    assert index.apply(_frame(spark, list(now.values()))) == 1, "nothing is new"
    for step in range(2):
        changed = [_row(rng, k, 2 + step) for k in rng.sample(sorted(now), 9)] + [_row(rng, f"n{step}{i}", 1) for i in range(5)]
        removed = rng.sample(sorted(set(now) - {c[0] for c in changed}), 4)
        index.apply(_frame(spark, changed), spark.createDataFrame([(k,) for k in [*removed, "never there"]], "id string"))
        now = {k: v for k, v in now.items() if k not in removed} | {c[0]: c for c in changed}
    before = index.at(index.bundle.current())
    assert len(before._tables("rows")) == 3
    index.compact(2)
    assert len(index._tables("rows")) < 5 and len(before._tables("rows")) == 3
    rows = _frame(spark, list(now.values()))
    assert sorted((r.id, r.revision) for r in index.revisions().collect()) == sorted((k, v[1]) for k, v in now.items())
    for found in (before, index):
        status = found.status().first()
        whole = textsearch.Index.build(rows, "id", ["title", "body"]).status().first()
        assert (status.n_rows, status.n_terms) == (whole.n_rows, whole.n_terms)
    for q in QUERIES:
        want = _answers(textsearch.search(rows, q, "id", W))
        assert _answers(index.search(q, W)) == want, q
        if q in QUERIES[:2]:
            assert _answers(before.search(q, W)) == want and _answers(index.top_k(q, W)) == want, q
            assert _answers(index.top_k(q, W, limit=3)) == want[:3]


def test_a_row_is_searched_alone(spark, tmp_path):
    """A record's fields and its documents are rows of their own: AND finds no words of two of them together."""
    index = SegmentedIndex(Bundle(spark, str(tmp_path / "ix")), "id", ("title", "body"))
    index.apply(_frame(spark, [("t1/metadata", 1, "alpha", ""), ("t1/document/1", 1, "", "beta"), ("t2/document/1", 1, "", "alpha and beta")]))
    assert [r.id for r in index.search("alpha AND beta", W).collect()] == ["t2/document/1"]
    hits = index.search("alpha OR beta", W, limit=None).withColumn("parent", F.substring_index("id", "/", 1))
    assert {r.parent: len(r.hits) for r in textsearch.parents(hits, "parent", "id").collect()} == {"t1": 2, "t2": 1}


def test_only_folders_of_the_terms_are_read(spark, tmp_path):
    index = SegmentedIndex(Bundle(spark, str(tmp_path / "ix")), "id", ("title", "body"))
    index.apply(_frame(spark, [(f"k{i}", 1, "", " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(60)]))
    one = index._asked([("w41", False)])
    assert one.count() and len(index._some("postings").inputFiles()) == segments.BUCKETS
    read = one.select("term", "n")
    read.collect()
    assert read._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,w41)" in plan and "all_positions" not in index._exploded(one)._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_pruned_search_ranks_fewer_postings(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"k{i:04}", 1, "", " ".join(["hit"] * (i % 97 // 16 if i % 5 == 0 else 0) + ["pad"] * rng.randint(5, 40) + (["rare"] if i % 50 == 0 else []))) for i in range(1500)]
    index = SegmentedIndex(Bundle(spark, str(tmp_path / "ix")), "id", ("title", "body"), block=8)
    index.apply(_frame(spark, rows))
    for q, most in (("hit", 0.35), ("rare AND hit", 0.35), ("rare OR hit", 0.6)):
        told = {}
        assert _answers(index.top_k(q, W, 5, counters=told)) == _answers(index.search(q, W, limit=5)), q
        assert 0 < told["ranked"] < most * told["postings"] and told["blocks_above"] <= told["blocks"], (q, told)
        assert q != "hit" or told["blocks_above"] < told["blocks"] / 2


def test_snippets_read_the_winners_only(spark, tmp_path):
    index = SegmentedIndex(Bundle(spark, str(tmp_path / "ix")), "id", ("title", "body"))
    rows = [("a", 1, "Ab here", "x y z ab, q cd w ef ab tail more words at the end"), ("b", 1, None, "nothing"), ("c", 1, "", "cd")]
    index.apply(_frame(spark, rows))
    texts = _frame(spark, rows)
    texts.write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    found = index.snippets(index.search("ab OR cd", W), texts, "ab OR cd", ["title", "body"], width=4)
    assert {(r.id, r.col, r.snippet) for r in found.collect()} == {("a", "title", "<<Ab>> here"), ("a", "body", "…<<ab>> q <<cd>> w…"), ("c", "body", "<<cd>>")}
    assert "In(id, [" in found._jdf.queryExecution().executedPlan().toString()
    assert index.snippets(index.search("nowhere", W), texts, "nowhere", ["body"]).count() == 0


def test_a_bundle_appears_whole(spark, tmp_path):
    b = Bundle(spark, str(tmp_path / "b"))
    assert b.current() == 0 and b.pinned() == {}
    one, two = spark.range(3), spark.range(5)
    assert b.commit({"child": one, "parent": one}) == 1
    pinned = b.pinned()
    # a run that stops between the two writes
    b.stage("child", two)
    assert b.current() == 1 and b.read("child").count() == 3
    base = b.current()
    first = {"child": b.stage("child", two)}
    assert b.commit({"other": one}) == 2
    with pytest.raises(snapshots.StaleVersion):
        b.publish(first, base)
    assert b.publish(first, 2) == 3
    assert {n: t.count() for n, t in b.pinned().items()} == {"child": 5, "parent": 3, "other": 3}
    assert {n: t.count() for n, t in pinned.items()} == {"child": 3, "parent": 3}
    assert {n: t.count() for n, t in b.pinned(2).items()} == {"child": 3, "parent": 3, "other": 3}
    assert b.commit({"child": two.where("false"), "other": None}) == 4
    assert {n: t.count() for n, t in b.pinned().items()} == {"child": 0, "parent": 3}


def test_bundle_children_are_replaced_by_parent(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "p int, v string")
    new = spark.createDataFrame([(1, "z"), (3, "unasked")], "p int, v string")
    assert sorted(tuple(r) for r in snapshots.replaced(old, new, spark.createDataFrame([(1,), (4,)], "p int"), "p").collect()) == [(1, "z"), (2, "c")]


def test_a_failed_batch_goes_item_by_item():
    done, calls = [], []

    def act(items):
        calls.append(len(items))
        if any(i % 7 == 3 for i in items):
            raise ValueError("no good")
        done.extend(items)

    bad = snapshots.each_that_fits(list(range(20)), act)
    assert set(bad) == {3, 10, 17} and "ValueError: no good" in bad[3] and sorted([*done, *bad]) == list(range(20)) and len(calls) < 40
    assert snapshots.each_that_fits([], act) == {}


def test_an_unknown_column_is_an_error(spark, tmp_path):
    rows = _frame(spark, [("a", 1, "ab", "cd")])
    index = SegmentedIndex(Bundle(spark, str(tmp_path / "ix")), "id", ("title", "body"))
    index.apply(rows)
    for ask in (lambda q: textsearch.search(rows, q, "id", W), lambda q: index.search(q, W), lambda q: index.top_k(q, W)):
        with pytest.raises(textsearch.QueryError):
            ask("ab AND nowhere:cd")
