"""The training-data operators against brute force, round trips and held-out accuracy, with odd rows in every table."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import ann, chat, html, langid, mixing, neardup, ogg, packing, quality, queries, suffix

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, cell string, bucket int, part string, content string, rep int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and very long texts, ties, repeated rows, null keys, and columns named as the operators name theirs."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    base = [" ".join(word() for _ in range(120)) for _ in range(12)]
    texts = [None, "", "   ", "one two", *base, base[0], base[0].replace(" a", " zz", 1), base[1] + " tail " + base[2][:300], base[3][:200] + "é" + base[4][:200], "ab " * 30_000, "é" * 60, "\n".join(["same line here again"] * 40)]
    rows = [(i, t, "en" if i % 3 else None, [None, "b", "a"][i % 3], len(t or ""), "x", 1, "p", "c", 7) for i, t in enumerate(texts)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_chat(spark):
    said = [(1, 0, "user", "hi <|im_end|> <\\|x"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi <|im_end|> <\\|x"), (2, 1, "assistant", None), (3, 0, None, ""), (3, 0, "a\\nb\n", "z" * 5000), (None, 0, "user", "n"), (4, 0, "user", "<|im_start|>assistant\nx<")]
    c = spark.createDataFrame([(*r, 1) for r in said], "conv_id bigint, turn bigint, role string, text string, path int")
    packs = chat.build_packs(c)
    got = {r.conv_id: r for r in chat.read_back(packs).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        turns = sorted((t, r or "", x or "") for k, t, r, x in said if k == conv)
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars == sum(len(chat.format_turn(r, x)[0]) for _, r, x in turns)
    for p in packs.collect():
        for n in p.nodes:  # a node sees exactly its ancestors, and positions count along the path
            up, seen, length = n.parent, set(), 0
            while up >= 0:
                seen |= set(range(p.nodes[up].start, p.nodes[up].start + p.nodes[up].length))
                length, up = length + p.nodes[up].length, p.nodes[up].parent
            assert {i for a in n.attends for i in range(a.start, a.end)} == seen and n.position == length
    assert chat.read_back(chat.build_packs(c.where("false"))).count() == 0


def test_chat_shares(spark):
    c = spark.createDataFrame([(i, t, "user", "first turn" if t == 0 else f"{i}") for i in range(50) for t in range(2)], "conv_id bigint, turn bigint, role string, text string").coalesce(1)
    packs = chat.build_packs(c).collect()
    assert sum(len(p.nodes) for p in packs) <= 50 + len(packs)
    assert all(len(p.nodes) <= 4 for p in chat.build_packs(c, pack_chars=80).collect())


def test_ann(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    bad = spark.createDataFrame([(1000, None, 0), (1020, [0.0] * 64, 0), (1040, [float("nan")] * 64, 0), (1060, [None] * 64, 0)], "vec_id bigint, embedding array<float>, label int")
    r = ann.search(e.unionByName(bad).withColumn("v", F.lit(1)), F.col("vec_id") % 20 == 0).collect()
    rows = e.collect()
    ids, x = np.array([q.vec_id for q in rows]), np.array([q.embedding for q in rows], float)
    want = ann.brute_force(ids, x, ids[ids % 20 == 0])
    got = {}
    for q in sorted(r, key=lambda q: (q.query_id, q.rank)):
        got.setdefault(q.query_id, []).append(q.vec_id)
        assert q.score == float(ann.exact_scores(x[ids == q.vec_id], x[ids == q.query_id][0])[0])
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]) >= 0.9
    few = ann.search(e.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert [q.rank for q in sorted(few, key=lambda q: q.rank)] == [1, 2, 3, 4]
    assert ann.search(e.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_repeated_ids_and_ties(spark):
    """Rows of one id are candidates of each other, each query row has its own neighbours, and equal scores go by vec_id."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), *[(i, [1.0, 0.0]) for i in range(1, 40)], (41, [0.5, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0, k=3).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == sorted([(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)] * 2)


@pytest.mark.parametrize(("sf", "most"), [("sf0.01", 0.2), ("sf0.1", 0.1)])
def test_ann_recall_and_share(spark, sf, most):
    """Recall against all rows, and the share of a block that the collision count leaves to be verified (20 of 500 and 2000 rows are asked for)."""
    t = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, x = t.vec_id.to_numpy(), np.array(t.embedding.tolist(), float)
    asked, shares = np.flatnonzero(ids % 20 == 0), []
    got = ann.search_block(x, ids, x[asked], ids[asked], float(np.sqrt((x * x).sum(1).max())), shares=shares)
    want = ann.brute_force(ids, x, ids[asked])
    recall = np.mean([len(set(ids[found].tolist()) & set(want[int(ids[asked[q]])])) / ann.K for q, found, _ in got])
    print(f"{sf}: recall {recall:.3f}, verified {np.mean(shares):.3f}")
    assert len(got) == len(asked) and recall >= 0.9 and np.mean(shares) <= most


def test_ann_finds_all_of_few(spark):
    """Orthogonal and opposite vectors are found too where there are no others."""
    x = np.vstack([np.eye(6), -np.eye(6), 1000 * np.eye(6)])
    ids = np.arange(len(x))
    for q, found, _ in ann.search_block(x, ids, x[:6], ids[:6], 1000.0):
        assert sorted(found.tolist()) == [i for i in ids.tolist() if i != q]


def test_dart_minhash():
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
    w, v = rng.integers(1, 6, len(x)).astype(float), rng.integers(1, 6, len(x)).astype(float)
    want = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    got = np.mean([(neardup.signatures([(x, w)], 192, s) == neardup.signatures([(x, v)], 192, s)).mean() for s in range(20)])
    assert abs(got - want) < 0.03
    y = np.concatenate([x[:200], rng.integers(0, 2**63, 50, dtype=np.uint64)])
    got = np.mean([(neardup.signatures([(x, None)], 192, s) == neardup.signatures([(y, None)], 192, s)).mean() for s in range(20)])
    assert abs(got - neardup.jaccard(np.unique(x), np.unique(y))) < 0.03


def test_near_duplicates(spark, odd, empty):
    got = {r.doc_id: r.class_id for r in neardup.groups(odd).collect()}
    assert got == neardup.brute_force(rows_of(odd))
    assert neardup.groups(empty).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id: r.class_id for r in neardup.groups(docs).collect()} == neardup.brute_force(rows_of(docs))


def test_html():
    page = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href="/x">x</a></nav><div class="cookie-notice">ok?</div><article><h1>A &amp; B</h1><p>one\n two<p>th<b>re</b>e<br>four</p><div class="ad">buy</div><form>f</form><p>end &lt;</p><div id="comments"><p>me too</p></div></article><aside>s</aside><footer>f</footer>'
    want = "A & B\n\none two\n\nthree four\n\nend <"
    assert html.extract(page) == want
    assert html.extract(page.replace("article", "div")) == want
    assert html.extract(None) == html.extract("") == html.extract("<p>") == html.extract("<!-- x") == ""
    assert html.extract("a" * 200_000) == "a" * 200_000


def test_best_run():
    rng = random.Random(1)
    for _ in range(300):
        v = [rng.choice([-2, -1, -0.5, 0.5, 1, 3]) for _ in range(rng.randint(0, 12))]
        a, z = html.best_run(v)
        assert sum(v[a : z + 1]) == pytest.approx(max([sum(v[i : j + 1]) for i in range(len(v)) for j in range(i, len(v))] + [0]))


def test_html_learns():
    """A name that isn't known beforehand is learned as boilerplate, and the scan alone finds the content where nothing is marked."""
    page = "<html><body><div class='zq'>{junk}</div><article><p>{text}</p></article><ul><li><a href='/'>a b c</a></li></ul></body></html>"
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    pages = [page.format(junk=words(20), text=words(60 + k)) for k in range(20)]
    seen = sum((html.counts(p) for p in pages), start=html.Counter())
    weights = html.weights_of(seen)
    assert "name:zq" not in html.PRIOR and weights["name:zq"] < html.BAD < 0
    bare = pages[0].replace("article>", "div>")
    assert html.extract(bare, weights) == words(60) and words(20) in html.extract(bare)  # unlike without what was learned
    odd = "<p>" + words(30) + "</p>" + "<ul>" + "<li><a href='/'>menu</a></li>" * 20 + "</ul><p>x</p>"
    assert html.extract(odd) == words(30)


def test_html_without_marks(spark):
    """Pages whose <article> and class names are taken away: the words found against those of the article."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    weights = html.weights_of(sum((html.counts(p) for p in pages), start=html.Counter()))
    both = []
    for p in pages:
        want = html.Counter(html.extract(f"<article>{re.search('<article>(.*)</article>', p, re.S)[1]}</article>").split())
        assert html.Counter(html.extract(p, weights).split()) == want
        got = html.Counter(html.extract(re.sub(r' (class|id|role)="[^"]*"|</?article>', "", p), weights).split())
        both.append(2 * (got & want).total() / (got.total() + want.total()))
    print("F1 without marks", np.mean(both))
    assert np.mean(both) >= 0.95


def test_html_pages(spark):
    p = spark.read.parquet(f"{SF}/pages.parquet")
    more = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "u", "")], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html.extract_pages(p.unionByName(more).withColumn("text", F.lit(1))).collect()}
    assert got[10**6] == got[10**6 + 1] == "" and len(got) == p.count() + 2
    for r in p.collect():
        inside = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        for word in re.findall(r"[^\W\d_]+", re.sub(r"<[^>]*>|&\w+;", " ", inside)):
            assert word in got[r.page_id]
    assert html.extract_pages(p.where("false")).count() == 0


def test_mixing(odd, empty):
    rows = odd.collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    got = mixing.mix(odd, block_words=4).collect()
    per = {}
    for r, n in zip(rows, size, strict=True):
        per[r.source] = per.get(r.source, 0) + n
    assert sorted((r.doc_id, r.size, r.source_size) for r in got) == sorted((r.doc_id, n, per[r.source]) for r, n in zip(rows, size, strict=True))
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight, goal, left, open_ = dict(zip(names, (5, 2, 1), strict=True)), {}, sum(size), set(names)
    while True:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 3 * per[s]]
        for s in full:
            goal[s] = 3 * per[s]
        left -= sum(goal[s] for s in full)
        open_ -= set(full)
        if not full:
            goal |= {s: left * weight[s] / total for s in open_}
            break
    source = {r.doc_id: r.source for r in rows}
    for s in names:
        assert all(r.target == pytest.approx(goal[s]) for r in got if source[r.doc_id] == s)
        assert sum(r.taken for r in got if source[r.doc_id] == s) == pytest.approx(goal[s], rel=0.02, abs=8)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(tuple, mixing.mix(odd.repartition(3), block_words=4).collect())) == sorted(map(tuple, got))
    assert mixing.mix(empty).count() == 0


def test_mixing_draws(spark):
    """Counts per shard are multinomial draws; corrected, each source's slots are numbered 0..n_slots-1, each once; shards hold `shard_slots` each."""
    goal = mixing.numbered(spark.createDataFrame([("a", 6400, 7000, 5000), ("b", 640, 7000, 1900), (None, 64, 7000, 100)], "source string, source_size bigint, n_blocks bigint, n_slots bigint"))
    drawn = mixing.draws(goal, 7000, 512).groupBy("shard").pivot("source_no", [0, 1, 2]).sum("drawn").na.fill(0).collect()
    assert sorted(sum(r[1:]) for r in drawn) == [7000 % 512, *[512] * 13]
    whole = np.array([r[1:] for r in drawn if sum(r[1:]) == 512], float)
    p = np.array([5000, 1900, 100]) / 7000
    chi2 = ((whole - 512 * p) ** 2 / (512 * p)).sum()
    assert 8 < chi2 < 55 and len({tuple(x) for x in whole}) > 6  # 26 degrees of freedom; not the same counts everywhere
    runs = [r.asDict() for r in mixing.shard_counts(goal, 7000, 512).collect()]
    for no, n in enumerate((5000, 1900, 100)):
        assert sorted(k for r in runs if r["source_no"] == no for k in range(r["first"], r["first"] + r["n"])) == list(range(n))
    per = {}
    for r in runs:
        per[r["shard"]] = per.get(r["shard"], 0) + r["n"]
    assert per == {k: min(512, 7000 - 512 * k) for k in range(14)}


def test_mixed_texts(odd, empty):
    """What the mix takes, as texts: the same words as `taken` counts, under any column names."""
    clash = odd.withColumnRenamed("cell", "turn").withColumnRenamed("content", "pieces").withColumnRenamed("rep", "times").dropDuplicates()
    got = mixing.mixed_texts(clash, block_words=4)
    assert got.columns == clash.columns
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    words: dict = {}
    for r in got.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
        assert r.n_chars == len(r.text) and r.turn == "x"
    taken: dict = {}
    for r in mixing.mix(clash, block_words=4).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert sum(words.values()) == sum(taken.values()) and all(n <= 3 * max(size(r.text) for r in clash.where(f"doc_id = {i}").collect()) for i, n in list(words.items())[:4])
    assert sum(size(r.text) for r in mixing.mixed_texts(odd, block_words=4).collect()) == sum(words.values())  # a whole repeated row is one document
    assert mixing.mixed_texts(empty).count() == 0


def test_word_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = ["", " ", "\x01 a\x01b", "Don't 12 a<|endoftext|>b  \n\n--x", "é\u0301 \u0301 İstanbul ΣΑΣ 中文 \U0001f600", "a\tb\r\nc \x7f \x00", *["I'll've 3.5%&&& Ünï"] * 3]
    want = [e.ids + [2] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for tokenizer in (packing.WordTokenizer(path), packing.WordTokenizer(path, 1)):
        ids, ends = tokenizer.ids(pa.array(texts), 2)
        assert ids.tolist() == [i for w in want for i in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


@pytest.mark.parametrize("most", [48 << 20, 3000, 0])
def test_word_tokenizer_remembers(most):
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    chance = random.Random(3)
    latin = "".join(map(chr, range(0x21, 0x180))) + "\u0301\u03a3"
    words = ["".join(chance.choices(latin, k=chance.randrange(1, 9))) for _ in range(60)] + ["Don't", "ÜBER'S", "1²½", "ÀÉ×÷ß", "«¿Qué?»", "µ'd", "<|endoftext|>", ""]
    tokenizer, asked = packing.WordTokenizer(path, 7, most), []
    plain_words, model = tokenizer.words, Tokenizer.from_file(path)
    tokenizer.words = lambda xs: asked.extend(xs) or plain_words(xs)
    for _ in range(8):
        texts = [" ".join(chance.choices(words, k=12)) for _ in range(6)]
        want = [e.ids + [2] for e in model.encode_batch(texts, add_special_tokens=False)]
        ids, ends = tokenizer.ids(pa.array(texts), 2)
        assert ids.tolist() == [i for w in want for i in w] and ends.tolist() == np.cumsum([len(w) for w in want]).tolist()
        assert tokenizer.held <= most and len(tokenizer.known) == len(tokenizer.known_sizes) == len(tokenizer.again)
    assert (len(asked) == len(set(asked))) == (most > 3000) and set(asked) <= set(words)


def test_shortest_pack_first():
    rng = random.Random(5)
    for _ in range(60):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 40))]
        packs: list[list[int]] = []
        for n in sorted(lengths, reverse=True):
            shortest = min(packs, key=sum, default=None)
            if shortest is not None and sum(shortest) + n <= 20:
                shortest.append(n)
            else:
                packs.append([n])
        got = [x for times, x in packing.patterns({n: lengths.count(n) for n in set(lengths)}, 20) for _ in range(times)]
        assert sorted(map(sum, got)) == sorted(map(sum, packs)) and sorted(n for x in got for n in x) == sorted(lengths)


def test_near_blocks():
    """Links across components of two blocks, against all pairs."""
    rng = np.random.default_rng(2)
    base = np.sort(rng.integers(0, 2**63, 60, dtype=np.uint64))
    sets = [np.sort(np.concatenate([base[rng.random(60) < 0.93], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(40)]
    own = rng.integers(0, 5, 40)
    raw = [x.tobytes() for x in sets]
    got = list(neardup._crossing(raw[:15], raw[15:], own[:15], own[15:], 0.8, "set"))
    want = {(i, int(own[15 + j])) for i in range(15) for j in range(25) if own[i] != own[15 + j] and neardup.jaccard(sets[i], sets[15 + j]) >= 0.8}
    assert {(i, int(own[15 + j])) for i, j in got} == want and len(got) == len(want) > 0
    assert all(neardup.jaccard(sets[i], sets[15 + j]) >= 0.8 for i, j in got)


def test_near_duplicates_of_a_hot_group(spark, monkeypatch):
    """Copies of one text with ever more edits, in blocks of a few members; weights by count go another way and find the same."""
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base)), (1, " ".join(base))]
    for i in range(2, 40):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(120)] = f"x{i}_{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = neardup.brute_force(rows)
    assert {r.doc_id: r.class_id for r in neardup.groups(df).collect()} == want
    assert {r.doc_id: r.class_id for r in neardup.groups(df, weighting="count").collect()} == want


def test_recall_of_near_duplicates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = neardup.brute_force(rows_of(docs))
    got = {r.doc_id: r.class_id for r in neardup.groups(docs).collect()}
    linked = [i for i in want if want[i] != i]
    recall = sum(got[i] == want[i] for i in linked) / len(linked)
    print("near-duplicate recall", recall, "of", len(linked))
    assert recall >= 0.99 and all(got[i] == i for i in want if list(want.values()).count(want[i]) == 1)


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit("k"))).collect()]
        assert sorted(got) == list(range(n))


def test_packing(odd, empty):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    ids = {r.doc_id: np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in odd.collect()}
    got = packing.pack(odd, path, size=64).collect()
    sequences, docs = {}, {}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, set()).add((r.start, r.length))
    for spans in [*map(sorted, sequences.values()), *map(sorted, docs.values())]:
        at = 0
        for start, length in spans:
            assert start == at
            at += length
    assert all(sum(n for _, n in s) <= 64 for s in sequences.values()) and set(docs) == set(ids)
    assert packing.pack(empty, path).count() == 0


def test_patterns():
    rng = np.random.default_rng(0)
    n = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 65, 5000), return_counts=True), strict=True)}
    found = packing.patterns(n, 64)
    assert all(sum(x) <= 64 for _, x in found)
    assert {k: sum(t * x.count(k) for t, x in found) for k in n} == n
    assert sum(k * v for k, v in n.items()) / 64 / sum(t for t, _ in found) > 0.97


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 50, 700):
        for letters in (1, 2, 200):
            s = rng.integers(1, letters + 1, n)
            assert list(suffix.suffix_array(s, 10**9)) == sorted(range(n), key=lambda i: s[i:].tolist())
            short = [s[i : i + 20].tolist() for i in suffix.suffix_array(s, 20)]
            assert short == sorted(short)


@pytest.mark.parametrize("cell_bytes", [1 << 22, 3000])
def test_suffix_dedup(odd, empty, cell_bytes):
    got = {r.doc_id: r for r in suffix.dedup(odd, cell_bytes=cell_bytes, keep_text=True).collect()}
    texts = dict(rows_of(odd))
    for doc, spans in suffix.brute_force(rows_of(odd)).items():
        raw = (texts[doc] or "").encode()
        kept = b"".join(raw[a:z] for a, z in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)], strict=True))
        r = got[doc]
        assert [(s.start, s.end) for s in r.spans] == spans and bytes(r.kept) == kept
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert suffix.dedup(empty).count() == 0


def test_langid(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.95
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    assert all((r.lang_pred == "und") == (r.doc_id in (0, 1, 2)) for r in got)
    assert langid.identify(empty).count() == 0


def test_ogg(odd, empty):
    rng = random.Random(1)
    for n in (64, 765, 8192, 8192 * 9, 65025, 130000):
        payload = rng.randbytes(n)
        media = ogg.write(payload)
        assert ogg.payload_of(media)[0] == payload
        for broken in (media[:-1], media[: n // 2], media[:60] + bytes([media[60] ^ 1]) + media[61:]):
            with pytest.raises(ogg.OggError):
                ogg.payload_of(broken)
    texts = dict(rows_of(odd))
    for r in ogg.digests(odd).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert ogg.digests(empty).count() == 0


def test_quality(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in quality.scores(docs).collect()}
    kept = {q: np.mean([got[d].is_kept for d in good if good[d] == q]) for q in (0, 1)}
    assert kept[1] > 0.95 and kept[0] < 0.6
    assert quality.scores(odd).count() == odd.count()
    assert quality.scores(empty).count() == 0


def test_quality_variety():
    shingler = neardup.Shingler(1)
    varied, same = " ".join(f"w{i}x" for i in range(400)), "again " * 4000
    vote = lambda text: quality.votes(quality.measures(text, shingler)[0])[-1]
    assert vote(varied) == quality.GOOD and vote(same) == quality.BAD
    assert vote(varied + " " + same) == quality.BAD  # what follows the first 400 words counts
    assert vote("again " * 400 + " ".join(f"w{i}x" for i in range(4000))) == quality.GOOD
    value = lambda text: quality.measures(text, shingler)[0][-1]
    assert value(varied) == 1 and value(varied + " again" * 10) == pytest.approx((400 + 391) / 800)  # the last window ends with the text


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count()
        if name == "near_duplicates":
            rows = rows_of(docs)
            assert all(k == v for k, v in neardup.brute_force(rows).items())
        if name == "repeated_passages":
            kept = rows_of(docs)
            want = suffix.brute_force(rows)
            raw = {i: (t or "").encode() for i, t in rows}
            assert sum(len((t or "").encode()) for _, t in kept) == pytest.approx(sum(map(len, raw.values())) - sum(e - s for v in want.values() for s, e in v), abs=4 * len(rows))
    assert docs.count() and corpus_pipeline.run(spark, SF).count()


def test_pipeline_keeps_rows(spark):
    import corpus_pipeline

    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    a, b, c, d = (words(60) for _ in range(4))
    near = a.replace(a.split()[30], "zz")
    rows = [(1, a, "en", "x"), (2, b, "en", "x"), (2, c, "de", "y"), (3, near, "fr", "z"), (3, d, "en", None), (3, d, "en", None), (None, words(9), None, "x"), (None, None, "en", "x"), (4, c, "en", "x")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert {tuple(r)[:4] for r in got.collect()} == set(rows) - {rows[3], rows[8]}
    got = corpus_pipeline.repeated_passages(spark, got, SF).collect()
    want = sorted(map(repr, [rows[i] if rows[i][1] is not None else (None, "", *rows[i][2:]) for i in (0, 1, 2, 4, 6, 7)]))
    assert sorted(repr(tuple(r)[:4]) for r in got) == want and all(r.n_chars == len(r.text) for r in got)
    once = docs.where("doc_id = 1 or doc_id is null")  # no repeated id
    assert corpus_pipeline.near_duplicates(spark, once, SF).count() == 3


def test_ann_ties():
    rng = np.random.default_rng(0)
    for n in range(24, 104):  # equal vectors: the smaller vec_id wins, wherever the rows stand
        v = rng.normal(size=64)
        ids = rng.permutation(n).astype(np.int64)
        base = np.tile(v, (n, 1))
        [(_, found, scores)] = ann.search_block(base, ids, v[None, :], np.array([n]), float(np.sqrt(v @ v)), budget=1.0)
        assert ids[found].tolist() == list(range(ann.K))
        assert len(set(scores.tolist())) == 1


def test_langid_symbols_beyond_the_first_plane(spark):
    smile, gothic = "\U0001f600", "\U00010330"
    assert not len(langid.term_counts(smile * 3 + " !")[0]) and len(langid.term_counts(gothic)[0])
    assert [x.tolist() for x in langid.term_counts(f"one{smile}two")] == [x.tolist() for x in langid.term_counts("one two")]
    docs = spark.createDataFrame([(i, "some english words here", "en") for i in range(1, 30)] + [(0, smile, None)], "doc_id bigint, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(docs).where("doc_id = 0").collect()] == [("und", 0.0)]


def test_html_learns_from_labelled_pages(spark):
    page = "<nav><a>x</a></nav><article><p>one two three</p></article><footer>f</footer>"
    rows = [(i, page if i == 77 else page.replace("article", "div")) for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id bigint, html string")
    assert html.learn(pages, sample=3) == html.weights_of(html.counts(page)) != html.PRIOR


def test_pipeline_keeps_replacement_characters(spark):
    import corpus_pipeline

    assert suffix.whole_characters(["a\ufffdé".encode()[:-1], "é€".encode()[1:-1], "😀b".encode()[2:], b"\xa9"]).decode() == "a\ufffdb"
    shared = "é" + "xyz " * 15 + "é"  # the cut goes through ꩩ and è, which share bytes with é
    docs = [(1, "A" + shared + "B"), (2, "own \ufffd text ꩩ" + shared[1:-1] + "è tail \ufffd")]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, SF).collect()}
    assert got[2] == "own \ufffd text  tail \ufffd"
