"""Text, vector and hybrid searches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, textsearch, vector
from ..session import table
from .registry import register
from .stored import stored_index

_TOK = r"list_filter(string_split_regex(strip_accents(lower(coalesce({c}, ''))), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _toks(c: str = "text") -> str:
    return _TOK.format(c=c)


def _bm25(terms: list[str], source: str = "documents", key: str = "doc_id", columns: dict[str, float] | None = None, where: str = "true", k: int = 20) -> str:
    columns = columns or {"text": 1.0}
    toks = ", ".join(f"{_toks(c)} AS t_{c}" for c in columns)
    length = " + ".join(f"len(t_{c})" for c in columns)
    f = lambda t, w: " + ".join(f"len(list_filter(t_{c}, lambda x: x = '{t}')){f' * {float(v)}' if w else ''}" for c, v in columns.items())
    tf = ", ".join(f"{f(t, True)} AS f{i}, {f(t, False)} AS a{i}" for i, t in enumerate(terms))
    parts = " + ".join(
        f"CASE WHEN f{i} > 0 THEN greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len_ / avg_)) ELSE 0 END" for i in range(len(terms))
    )
    stats = ", ".join(f"count(*) FILTER (a{i} > 0) AS df{i}" for i in range(len(terms)))
    every = " AND ".join(f"a{i} > 0" for i in range(len(terms)))
    return f"""WITH d AS (SELECT {key}, ({where}) AS pass, {toks} FROM {source}),
c AS (SELECT {key}, pass, {length} AS len_, {tf} FROM d), s AS (SELECT count(*) AS n, avg(len_) AS avg_, {stats} FROM c)
SELECT {key}, round(-({parts}), 6) AS score FROM c, s WHERE {every} AND pass ORDER BY 2, 1 LIMIT {k}"""


@register("text_bm25_topk", _bm25(["the", "from"]))
def text_bm25_topk(spark, sf_dir):
    return textsearch.search(table(spark, sf_dir, "documents"), "the AND from", "doc_id", {"text": 1.0})


@register("text_index_topk", _bm25(["the", "from"]))
def text_index_topk(spark, sf_dir):
    """The same search on the stored index of this state of the table: only the folders of the query's terms are read."""
    return stored_index(spark, sf_dir).search("the AND from", {"text": 1.0})


def _messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "conv_id", "turn", "role", "text")


@register("text_parents", f"""WITH h AS ({_bm25(["the", "from"], "(SELECT conv_id * 1000 + turn AS msg_id, text FROM conversations)", "msg_id", {"text": 1.0}, k=1000000000)}),
p AS (SELECT msg_id // 1000 AS conv_id, min(score) AS score, count(*) AS n_hits, min_by(msg_id, (score, msg_id)) AS best FROM h GROUP BY 1 ORDER BY 2, 1 LIMIT 20)
SELECT CAST(conv_id AS BIGINT) AS conv_id, score, CAST(row_number() OVER (ORDER BY score, conv_id) - 1 AS INT) AS rank, CAST(n_hits AS INT) AS n_hits, CAST(best AS BIGINT) AS best FROM p""")
def text_parents(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    hits = textsearch.search(rows.select("msg_id", "text"), "the AND from", "msg_id", {"text": 1.0}, limit=None)
    p = textsearch.parents(hits.withColumn("conv_id", F.floor(F.col("msg_id") / 1000).cast("bigint")), "conv_id", "msg_id")
    return p.select("conv_id", "score", "rank", F.size("hits").alias("n_hits"), F.get("hits", F.lit(0))["msg_id"].alias("best"))


@register("text_matched_source", f"SELECT conv_id * 1000 + turn AS msg_id, CASE WHEN contains(' ' || array_to_string({_toks('role')}, ' ') || ' ', ' user ') THEN 'role' WHEN contains(' ' || array_to_string({_toks()}, ' ') || ' ', ' user ') THEN 'text' END AS matched_source FROM conversations")
def text_matched_source(spark, sf_dir):
    return _messages(spark, sf_dir).select("msg_id", textsearch.matched_source("user", ["role", "text"]).alias("matched_source"))


@register("text_index_status", f"SELECT count(*) AS n_rows, (SELECT count(DISTINCT t) FROM (SELECT unnest({_toks()}) AS t FROM documents)) AS n_terms, CAST(sum(len({_toks()})) AS BIGINT) AS n_positions FROM documents")
def text_index_status(spark, sf_dir):
    return textsearch.Index.build(table(spark, sf_dir, "documents"), "doc_id", ["text"]).status()


@register("text_bm25_filtered", _bm25(["der", "und"], where="lang = 'de'"))
def text_bm25_filtered(spark, sf_dir):
    return textsearch.search(table(spark, sf_dir, "documents"), "der AND und", "doc_id", {"text": 1.0}, F.col("lang") == "de")


@register("text_multi_column_weighted", _bm25(["user", "the"], "(SELECT conv_id * 1000 + turn AS msg_id, role, text FROM conversations)", "msg_id", {"role": 5.0, "text": 1.0}))
def text_multi_column_weighted(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "role", "text")
    return textsearch.search(rows, "user AND the", "msg_id", {"role": 5.0, "text": 1.0})


@register("text_corpus_stats", f"SELECT count(*) AS n_docs, CAST(sum(len({_toks()})) AS BIGINT) AS n_tokens, round(avg(len({_toks()})), 6) AS avg_len FROM documents")
def text_corpus_stats(spark, sf_dir):
    n = F.size(tx.tokens(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"), F.sum(n).alias("n_tokens"), F.round(F.avg(n), 6).alias("avg_len"))


@register("text_term_df", f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_toks()})) AS term FROM documents) GROUP BY term ORDER BY df DESC, term LIMIT 100")
def text_term_df(spark, sf_dir):
    return textsearch.term_statistics(table(spark, sf_dir, "documents"), "doc_id", "text").orderBy(F.desc("df"), "term").limit(100)


def _matching(spark, sf_dir, query):
    rows = table(spark, sf_dir, "documents")
    return rows.where(textsearch.matches(textsearch.parse(query), {"text": tx.tokens(F.coalesce("text", F.lit("")))})).select("doc_id")


_PAD = f"' ' || array_to_string({_toks()}, ' ') || ' '"


@register("text_phrase", f"SELECT doc_id FROM documents WHERE contains({_PAD}, ' from the ')")
def text_phrase(spark, sf_dir):
    return _matching(spark, sf_dir, "from the")


@register("text_prefix", f"SELECT doc_id FROM documents WHERE contains({_PAD}, ' tiona')")
def text_prefix(spark, sf_dir):
    return _matching(spark, sf_dir, "tiona*")


@register("text_bool_not", f"SELECT doc_id FROM documents WHERE contains({_PAD}, ' the ') AND (contains({_PAD}, ' and ') OR contains({_PAD}, ' from ')) AND NOT contains({_PAD}, ' that ')")
def text_bool_not(spark, sf_dir):
    return _matching(spark, sf_dir, "the AND (and OR from) NOT that")


@register("text_near", f"""WITH p AS (SELECT doc_id, generate_subscripts({_toks()}, 1) AS i, unnest({_toks()}) AS t FROM documents)
SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.t = 'was' AND b.t = 'with' AND abs(a.i - b.i) <= 4""")
def text_near(spark, sf_dir):
    return _matching(spark, sf_dir, "NEAR(was with, 3)")


@register("text_postings", f"""SELECT term, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_positions, CAST(sum(s) AS BIGINT) AS position_sum FROM (
SELECT doc_id, t AS term, count(*) AS n, sum(i) AS s FROM (SELECT doc_id, generate_subscripts({_toks()}, 1) AS i, unnest({_toks()}) AS t FROM documents) GROUP BY ALL) GROUP BY term""")
def text_postings(spark, sf_dir):
    p = textsearch.postings(table(spark, sf_dir, "documents"), "doc_id", ["text"])
    return p.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum(F.size("positions")).alias("n_positions"), F.sum(F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("position_sum"))


@register("text_snippet")
def text_snippet(spark, sf_dir):
    top = textsearch.search(table(spark, sf_dir, "documents"), "the AND from", "doc_id", {"text": 1.0})
    # snippets for the winners only: the second scan is reduced to them first
    return table(spark, sf_dir, "documents").join(F.broadcast(top), "doc_id").select("doc_id", "score", textsearch.snippet(F.col("text"), "the AND from").alias("snippet"))


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\s\x1c-\x1f]+'), lambda x: x <> '')"


@register("chunk_whitespace", f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 ELSE 1 + CAST(ceil(greatest(len(w) - 512, 0) / 488.0) AS INT) END AS n FROM w)
SELECT doc_id, CAST(i AS INT) AS chunk_index, array_to_string(w[i * 488 + 1 : i * 488 + 512], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM c)""")
def chunk_whitespace(spark, sf_dir):
    return chunking.chunk_table(table(spark, sf_dir, "documents"), "doc_id", "text")


@register("chunk_count_closed_form", f"SELECT doc_id, CAST(CASE WHEN len({_WORDS}) = 0 THEN 0 ELSE 1 + ceil(greatest(len({_WORDS}) - 512, 0) / 488.0) END AS INT) AS n_chunks FROM documents")
def chunk_count_closed_form(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunking.chunk_count(F.size(chunking.words(F.coalesce("text", F.lit(""))))).alias("n_chunks"))


@register("chunk_cap_running", """WITH c AS (SELECT source, lang, doc_id, CAST(1 + n_chars // 500 AS INT) AS n FROM documents),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source, lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT source || lang AS parent, doc_id, n, CAST(greatest(0, least(n, 16 - before)) AS INT) AS kept FROM b""")
def chunk_cap_running(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.concat("source", "lang").alias("parent"), "doc_id", (1 + F.floor(F.col("n_chars") / 500)).cast("int").alias("n"))
    return chunking.capped(c, "parent", ["doc_id"], "n", 16)


@register("chunk_structural")
def chunk_structural(spark, sf_dir):
    return chunking.structural_table(table(spark, sf_dir, "documents"), "doc_id", "text")


def _query_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_DIST = f"round(list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[])), 5)"


@register("knn_cosine", f"SELECT vec_id, {_DIST} AS distance FROM embeddings ORDER BY 2, 1 LIMIT 20")
def knn_cosine(spark, sf_dir):
    return vector.knn(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), "vec_id", "embedding").select("vec_id", "distance")


@register("knn_filtered", f"SELECT vec_id, {_DIST} AS distance FROM embeddings WHERE label IN (1, 2) ORDER BY 2, 1 LIMIT 20")
def knn_filtered(spark, sf_dir):
    return vector.knn(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), "vec_id", "embedding", where=F.col("label").isin(1, 2)).select("vec_id", "distance")


def _scored(spark, sf_dir):
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf_dir)])
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(vector.cosine_distance(F.col("embedding"), q), 5).alias("distance"))


@register("knn_distinct_parent", f"SELECT label, vec_id, distance FROM (SELECT label, vec_id, {_DIST} AS distance, row_number() OVER (PARTITION BY label ORDER BY {_DIST}, vec_id) AS r FROM embeddings) WHERE r = 1 ORDER BY distance, label LIMIT 5")
def knn_distinct_parent(spark, sf_dir):
    return vector.best_per_parent(_scored(spark, sf_dir), "label", "vec_id", 5)


@register("knn_boundary_ties", f"""WITH b AS (SELECT label, min(round({_DIST}, 1)) AS distance, min_by(vec_id, (round({_DIST}, 1), vec_id)) AS vec_id FROM embeddings GROUP BY label)
SELECT label, vec_id, distance FROM b WHERE distance <= (SELECT max(distance) FROM (SELECT distance FROM b ORDER BY distance LIMIT 4))""")
def knn_boundary_ties(spark, sf_dir):
    return vector.best_per_parent(_scored(spark, sf_dir).withColumn("distance", F.round("distance", 1)), "label", "vec_id", 4, ties=True)


@register("min_distance_rerank", f"""WITH h AS (SELECT vec_id % 50 AS parent, min(vec_id) AS pos FROM embeddings GROUP BY 1), m AS (SELECT vec_id % 50 AS parent, min({_DIST}) AS distance FROM embeddings WHERE vec_id % 3 = 0 GROUP BY 1)
SELECT h.parent, h.pos, m.distance FROM h LEFT JOIN m ON h.parent = m.parent""")
def min_distance_rerank(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("parent", F.col("vec_id") % 50)
    hits = s.groupBy("parent").agg(F.min("vec_id").alias("pos"))
    return vector.rerank(hits, s.where("vec_id % 3 = 0"), "parent", "pos")


_RRF_A = "SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS ra FROM embeddings WHERE label < 8 GROUP BY label"
_RRF_B = f"SELECT label, row_number() OVER (ORDER BY min({_DIST}), label) - 1 AS rb FROM embeddings WHERE label > 1 GROUP BY label"


@register("rrf_hybrid", f"SELECT coalesce(a.label, b.label) AS label, round(coalesce(0.6 / (60.0 + ra), 0) + coalesce(0.4 / (60.0 + rb), 0), 8) AS score FROM ({_RRF_A}) a FULL JOIN ({_RRF_B}) b ON a.label = b.label")
def rrf_hybrid(spark, sf_dir):
    s = _scored(spark, sf_dir)
    a = vector.ranked(s.where("label < 8").groupBy("label").agg(F.count("*").alias("n")), [F.desc("n"), "label"])
    b = vector.ranked(s.where("label > 1").groupBy("label").agg(F.min("distance").alias("d")), ["d", "label"])
    return vector.fuse(a, b, "label", 0.6)


@register("hybrid_documents")
def hybrid_documents(spark, sf_dir):
    """Text and offline-embedding searches of one query, both windows cut before the fusion."""
    docs, query = table(spark, sf_dir, "documents"), "the AND from"
    text = textsearch.search(docs, query, "doc_id", {"text": 1.0}, limit=160)
    toks = F.array(F.lit("the"), F.lit("from"))
    q = vector.hashed_embedding(toks)
    e = docs.select("doc_id", F.round(vector.cosine_distance(vector.hashed_embedding(tx.tokens(F.coalesce("text", F.lit("")))), q), 5).alias("distance"))
    semantic = e.orderBy(F.asc_nulls_last("distance"), "doc_id").limit(20)
    return vector.fuse(vector.ranked(text, ["score", "doc_id"]), vector.ranked(semantic, ["distance", "doc_id"]), "doc_id").limit(20)
