"""The prefix trie, the repetition rules and the source divergence against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from corvane.llm import divergence, queries, repetition, trie

SF = "/root/testdata/sf0.001"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_by_brute_force(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((float("-inf") if t is None else t, r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in conv.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members, children, out = defaultdict(list), defaultdict(set), {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                children[tuple(v[: d - 1])].add(tuple(v[:d]))
    for k in sorted(members, key=len, reverse=True):
        m = sorted(members[k])
        saved = (len(m) - 1) * (len(k[-1][1]) if k else 0) + sum(out[x][6] for x in children[k])
        ends = ",".join(str(c) for c in m if len(full[c]) == len(k))
        out[k] = (m[0], len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), sum(out[x][5] for x in children[k]) or 1, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def nodes_of(df):
    return sorted((tuple(r[c] for c in NODE) for r in df.collect()), key=repr)


def conversations(seed):
    """Null turns, roles, texts and ids; ties and repeated rows; a very long conversation; a first turn that a third share."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 130), 300, 777, None]:
        for t in range(rng.choice([1, 2, 6, 8, 40])):
            text = rng.choice(["x", "yy", None]) if t < 4 else rng.choice(["a", "b", "", "é"])
            rows.append((c, None if rng.random() < 0.05 else t, "user" if c is not None and c % 3 == 0 else rng.choice(["user", None]), text, 1))
    rows += [(900, t, "user", "long " * (t % 3), 1) for t in range(700)]
    rows += [(901, t, "user", "long " * (t % 3), 1) for t in range(700)]
    rows += rows[:5]
    return rows


@pytest.mark.parametrize("local", [200, 1 << 20])
def test_trie(spark, local):
    rows = conversations(3)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, digest int").repartition(4)
    assert nodes_of(trie.rebuilt_trie(df, local)) == trie_by_brute_force([r[:4] for r in rows])


def test_trie_of_nothing_and_of_turnless(spark):
    df = spark.createDataFrame([(5, 0, "user", "a")], "conv_id bigint, turn bigint, role string, text string")
    assert trie.rebuilt_trie(df.where("false")).count() == 0
    # crc32("5") % 6 first turns would come from conversation 0, which isn't there
    want = trie_by_brute_force([(5, 0, "user", "a")])
    assert nodes_of(trie.rebuilt_trie(df)) == want
    assert [n[1] for n in nodes_of(trie.trie(df))] == [0, 1]


def test_quicksort_emits_parents_first():
    rng = random.Random(1)
    rows = {tuple(rng.choices(range(4), k=rng.randint(0, 6))) for _ in range(200)}
    rows = [(i, 1, list(r), [1] * len(r)) for i, r in enumerate(sorted(rows))]
    found = trie.quicksort_nodes(rows, 0, 0)
    want = {(tuple(r[2][: d + 1])) for r in rows for d in range(len(r[2]))}
    assert len(found) == len(want)
    assert {(n[0], n[1]) for n in found} == {(min(r[0] for r in rows if tuple(r[2][: len(w)]) == w), len(w)) for w in want}


def texts(rng):
    k = rng.choice([1, 2, 3, 30])
    t = "".join(rng.choice([" ", "\n", "  ", "\t", " "]) + "".join(rng.choices("aé#", k=rng.randint(1, 2)) if k < 30 else rng.choices("abcdefgh", k=3)) for _ in range(rng.choice([0, 1, 5, 60])))
    return rng.choice([t, t + "\n" + t, None, "", t])


def test_repetition_counts():
    rng = random.Random(1)
    for _ in range(120):
        rows = [texts(rng) for _ in range(rng.randint(0, 6))]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.string())], ["doc_id", "text"])
        for least in (1, 3, 8):
            for got, text in zip(repetition.measured(batch, least).to_pylist(), rows, strict=True):
                want = repetition.brute_force(text, least)
                assert {k: got[k] for k in want} == want
                assert sum(s["end"] - s["start"] for s in got["spans"]) == want["covered_words"]
                assert all(a["end"] < b["start"] for a, b in zip(got["spans"], got["spans"][1:], strict=False))


def test_maximal_repeats_are_those_of_brute_force():
    """(text, length, occurrences) of every repeat that neither neighbour extends."""
    rng = random.Random(2)
    import numpy as np

    for _ in range(60):
        w = rng.choices(range(3), k=rng.randint(1, 25))
        words, row = np.array(w), np.zeros(len(w), np.int64)
        order, levels = repetition.suffix_array(words, row)
        assert [w[i:] for i in order] == sorted(w[i:] for i in range(len(w)))
        before = np.r_[-1, words[:-1]]
        left, right, length = repetition.maximal_repeats(order, repetition.common_prefixes(order, row, levels), before, 1)
        got = sorted((tuple(w[order[a] : order[a] + n]), b - a + 1) for a, b, n in zip(left, right, length, strict=True))
        at = defaultdict(list)
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                at[tuple(w[i:j])].append(i)
        want = sorted(
            (s, len(p))
            for s, p in at.items()
            if len(p) > 1 and len({w[i - 1] if i else ("start",) for i in p}) > 1 and len({w[i + len(s)] if i + len(s) < len(w) else ("end", i) for i in p}) > 1
        )
        assert got == want


def test_repetition_rules(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    clean = " ".join(word() for _ in range(400))
    part = " ".join(word() for _ in range(70))
    rest = " ".join(word() for _ in range(1500))
    rows = [(1, clean, 1), (2, "too short", 1), (3, None, 1), (4, f"{part} {rest} {part}", 1), (5, " ".join(clean.split()[:40] * 3), 1), (6, clean, 1), (6, clean, 1), (None, clean, 1), (7, "ab " * 100_000, 1), (8, f"{clean} {' '.join(clean.split()[:12])}", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int")
    got = repetition.judged(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert {k: (r.base_failed, r.kept) for k, r in by.items()} == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (True, False), 6: (False, True), None: (False, True), 7: (True, False), 8: (False, True)}
    assert by[4].longest_repeat == 70 and by[4].covered_words == 140 and [(s.start, s.end) for s in by[4].spans] == [(0, 70), (1570, 1640)]
    assert repetition.judged(df.where("false")).count() == 0


def divergence_by_brute_force(rows, least, top=10):
    count, docs, groups = defaultdict(int), defaultdict(int), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        for t in terms:
            count[lang, source, t] += 1
        for t in set(terms):
            docs[lang, t] += 1
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        size = {s: sum(count[lang, s, t] for t in kept) for s in sources}
        p = {(s, t): 1 + 10**9 * (count[lang, s, t] + 2) // (size[s] + 2 * len(kept)) for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(count[lang, s, t] for s in sources) + 2) // (sum(size.values()) + 2 * len(kept)) for t in kept}
        for s in sources:
            pairs = sorted((-sum(divergence.distance(p[s, t], p[o, t]) for t in kept), o.encode()) for o in sources if o != s)
            above = sorted((-divergence.distance(p[s, t], q[t]), t.encode()) for t in kept if count[lang, s, t] and p[s, t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k) for part, found in (("pair", pairs), ("term", above)) for k, (v, i) in enumerate(found, 1)]
    return sorted(out)


WORDS = ["The", "the", "ÉA", "éa", "x_y", "a1b", "zz", "Q", "ß"]


def test_scans_pass_on_what_they_hold(monkeypatch):
    """Whatever a task may hold, its counts add up, and runs that lie in several batches are whole."""
    rng = random.Random(4)
    rows = [(rng.choice("xy"), rng.choice("ab"), " ".join(rng.choices(WORDS, k=9))) for _ in range(40)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r, strict=True)) for r in rows[i : i + 7]]) for i in range(0, 40, 7)]
    found = []
    for held in (1 << 20, 3):
        monkeypatch.setattr(divergence, "HELD", held)
        parts = pa.Table.from_batches(divergence._count(iter(batches))).sort_by([("lang", "ascending"), ("term", "ascending"), ("source", "ascending")])
        for size in (1, 5, 1000):
            found.append(pa.Table.from_batches(divergence._scan(3)(iter(parts.to_batches(size)))).to_pylist())
    assert found[0] and all(f == found[0] for f in found)


def test_divergence(spark):
    rng = random.Random(3)
    words = WORDS
    for n in (0, 1, 60, 250):
        rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é"]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(0, 30)))])) for _ in range(n)]
        rows += rows[:3]
        df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, term int, count int").repartition(3)
        for least in (1, 10):
            assert sorted(tuple(r) for r in divergence.audit(df, least).collect()) == divergence_by_brute_force(rows, least)


def test_shares_are_exact_beyond_a_long(spark):
    """10^9 times a count of 10^12 doesn't fit in 64 bits."""
    got = spark.range(1).selectExpr("1000000000000L AS count", "3000000000001L AS n", "7L AS terms").selectExpr(divergence._share("count", "n") + " AS p").first().p
    assert got == 1 + 10**9 * (10**12 + 2) // (3 * 10**12 + 1 + 14)


def test_queries(spark):
    for name in ("op11_prefix_trie", "op12_repetition_rules", "op13_source_divergence"):
        assert queries.queries()[name](spark, SF).count() > 0 and name in queries.oracle_sql()
