"""Composed searches in each mode, widening windows, coverage sweeps, staleness over derived tables, hashed vectors, SQL functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import sql_names
from ..functions import text as tx
from ..operators import encoding, freshness, request, snapshots, sweep, vector
from ..session import shared_dir, table
from ..streaming import sessions, state
from .registry import register
from .search_queries import _bm25, _toks
from .stored import stored_index


def _sources(spark, sf_dir) -> request.Sources:
    """Documents with their index; a document's vectors are two rows of `embeddings`. A semantic query names the vector it stands for."""
    e = table(spark, sf_dir, "embeddings")
    vectors = e.select(F.col("vec_id").alias("chunk"), F.floor(F.col("vec_id") / 2).cast("bigint").alias("doc_id"), "embedding")
    facts = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return request.Sources("doc_id", facts, stored_index(spark, sf_dir), {"text": 1.0}, vectors, encode=lambda said: list(e.where(F.col("vec_id") == int(said)).select("embedding").first()[0]))


_PASS = "lang = 'en' AND n_chars >= 200 AND source ILIKE 'src1%'"
_FACTS = "d.lang, d.source, d.n_chars"
_DIST = "round(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 7) AS DOUBLE[])), 5)"


def _near(limit: int) -> str:
    """The window that widening ends with, and the documents in it by their first place."""
    return f"""p AS (SELECT e.vec_id, d.doc_id, {_DIST} AS distance, d.source ILIKE 'src1%' AS pass FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id // 2 WHERE d.lang = 'en' AND d.n_chars >= 200),
w AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS place FROM p QUALIFY place <= 4096),
reach AS (SELECT count(*) AS n, max(place) AS place FROM (SELECT min(place) AS place FROM w WHERE pass GROUP BY doc_id ORDER BY 1 LIMIT {limit})),
f AS (SELECT least(4096, {limit * 8} * (2 ** j)) AS f FROM (SELECT unnest(range(0, 13)) AS j)),
far AS (SELECT min(f) AS f FROM f, reach WHERE f = 4096 OR f > (SELECT count(*) FROM w) OR (reach.n >= {limit} AND reach.place <= f)),
g AS (SELECT doc_id, min(place) AS place, min_by(distance, place) AS distance, min_by(vec_id, place) AS chunk FROM w, far WHERE pass AND place <= far.f GROUP BY doc_id),
v AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY place) - 1 AS INT) AS rank, distance, chunk FROM g)"""


_ASKED = {"equal": {"lang": "en"}, "since": {"n_chars": 200}, "like": {"source": "src1%"}}


@register("search_filter", f"SELECT d.doc_id, CAST(NULL AS DOUBLE) AS score, 'filter' AS mode, CAST(NULL AS INT) AS rank_text, CAST(NULL AS INT) AS rank_vector, CAST(NULL AS DOUBLE) AS distance, CAST(NULL AS BIGINT) AS best_chunk, {_FACTS} FROM documents d WHERE {_PASS} ORDER BY doc_id LIMIT 20")
def search_filter(spark, sf_dir):
    return request.search(request.Request(**_ASKED), _sources(spark, sf_dir))


@register("search_text", f"WITH h AS ({_bm25(['the', 'from'], where=_PASS)}) SELECT h.doc_id, h.score, 'text' AS mode, CAST(row_number() OVER (ORDER BY h.score, h.doc_id) - 1 AS INT) AS rank_text, CAST(NULL AS INT) AS rank_vector, CAST(NULL AS DOUBLE) AS distance, CAST(NULL AS BIGINT) AS best_chunk, {_FACTS} FROM h JOIN documents d ON d.doc_id = h.doc_id")
def search_text(spark, sf_dir):
    return request.search(request.Request(text="the AND from", **_ASKED), _sources(spark, sf_dir))


@register("search_semantic", f"WITH {_near(5)} SELECT v.doc_id, -v.distance AS score, 'semantic' AS mode, CAST(NULL AS INT) AS rank_text, v.rank AS rank_vector, v.distance, v.chunk AS best_chunk, {_FACTS} FROM v JOIN documents d ON d.doc_id = v.doc_id WHERE v.rank < 5")
def search_semantic(spark, sf_dir):
    return request.search(request.Request(semantic="7", limit=5, **_ASKED), _sources(spark, sf_dir))


@register("search_hybrid", f"""WITH {_near(5)}, h AS ({_bm25(['the', 'from'], where=_PASS, k=40)}), t AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY score, doc_id) - 1 AS INT) AS rank FROM h),
u AS (SELECT coalesce(t.doc_id, v.doc_id) AS doc_id, round(coalesce(0.5 / (60.0 + t.rank), 0) + coalesce(0.5 / (60.0 + v.rank), 0), 8) AS score, t.rank AS rank_text, v.rank AS rank_vector, v.distance, v.chunk AS best_chunk FROM t FULL JOIN v ON t.doc_id = v.doc_id ORDER BY 2 DESC, 1 LIMIT 5)
SELECT u.doc_id, u.score, 'hybrid' AS mode, u.rank_text, u.rank_vector, u.distance, u.best_chunk, {_FACTS} FROM u JOIN documents d ON d.doc_id = u.doc_id""")
def search_hybrid(spark, sf_dir):
    """Text hits of five times eight, and the nearest of a window that widens until five documents pass the pattern."""
    return request.search(request.Request(text="the AND from", semantic="7", limit=5, **_ASKED), _sources(spark, sf_dir))


@register("knn_widening", """WITH w AS (SELECT vec_id, vec_id % 50 AS parent, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 5) AS distance FROM embeddings)
SELECT parent, distance, vec_id, CAST(row_number() OVER (ORDER BY distance, vec_id) - 1 AS INT) AS rank FROM (SELECT parent, min(distance) AS distance, min_by(vec_id, (distance, vec_id)) AS vec_id FROM w WHERE parent % 7 = 3 GROUP BY parent) QUALIFY rank < 3""")
def knn_widening(spark, sf_dir):
    """The nearest parents that pass a filter which can't go before the limit, from windows that widen: the exact answer."""
    e = table(spark, sf_dir, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").select("embedding").first()[0]])
    scored = e.select("vec_id", (F.col("vec_id") % 50).alias("parent"), F.round(vector.cosine_distance(F.col("embedding"), q), 5).alias("distance"))
    rows, _ = vector.widening(scored, "parent", "vec_id", 3, F.expr("parent % 7 = 3"), fanout=1)
    return vector.grouped(rows, "parent", "vec_id").where("rank < 3")


_DAYS = "SELECT user_id, CAST(ts AS DATE) AS a, CAST(ts AS DATE) + CAST(event_id % 3 AS INT) AS z, event_id FROM events"
_RUNS = "SELECT user_id, min(day) AS a, max(day) AS z FROM (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS run FROM {days}) GROUP BY user_id, run"


def _spans(spark, sf_dir):
    ts = F.col("ts").cast("date")
    return table(spark, sf_dir, "events").select("user_id", ts.alias("a"), F.date_add(ts, (F.col("event_id") % 3).cast("int")).alias("z"), "event_id")


@register("coverage_missing", f"""WITH e AS ({_DAYS}), want AS (SELECT user_id, unnest(range(min(a), max(z) + 3, INTERVAL 1 DAY))::DATE AS day FROM e GROUP BY user_id),
have AS (SELECT DISTINCT user_id, unnest(range(a, z + 1, INTERVAL 1 DAY))::DATE AS day FROM e WHERE event_id % 5 = 0),
left_ AS (SELECT user_id, day FROM want EXCEPT SELECT user_id, day FROM have) {_RUNS.format(days='left_')}""")
def coverage_missing(spark, sf_dir):
    """Days of each user's period, and two after it, that a fifth of the intervals doesn't cover."""
    e = _spans(spark, sf_dir)
    wanted = e.groupBy("user_id").agg(F.min("a").alias("a"), F.date_add(F.max("z"), 2).alias("z"))
    return sweep.missing(wanted, e.where("event_id % 5 = 0"), ["user_id"], "a", "z")


@register("coverage_commit", f"WITH e AS ({_DAYS}), have AS (SELECT DISTINCT user_id, unnest(range(a, z + 1, INTERVAL 1 DAY))::DATE AS day FROM e WHERE event_id % 5 IN (0, 1, 3)) {_RUNS.format(days='have')}")
def coverage_commit(spark, sf_dir):
    e = _spans(spark, sf_dir)
    return sweep.committed(e.where("event_id % 5 = 0"), e.where("event_id % 5 IN (1, 3)"), ["user_id"], "a", "z")


@register("coverage_gaps", f"""WITH e AS ({_DAYS}), have AS (SELECT DISTINCT user_id, unnest(range(a, z + 1, INTERVAL 1 DAY))::DATE AS day FROM e WHERE event_id % 5 = 0),
want AS (SELECT user_id, unnest(range(min(day), max(day) + 1, INTERVAL 1 DAY))::DATE AS day FROM have GROUP BY user_id), left_ AS (SELECT * FROM want EXCEPT SELECT * FROM have) {_RUNS.format(days='left_')}""")
def coverage_gaps(spark, sf_dir):
    return sweep.gaps(_spans(spark, sf_dir).where("event_id % 5 = 0"), ["user_id"], "a", "z")


def _graph(spark, sf_dir):
    """Texts made from documents, pieces from texts, and vectors from pieces. What the derived tables hold lags behind the documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("fp"), F.concat_ws("/", "lang", "source").alias("meta"), (1 + F.floor(F.col("n_chars") / 1500)).cast("int").alias("n"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int")), "yyyy-MM-dd").alias("day"))
    piece = lambda n: F.explode(F.sequence(F.lit(0), n - 1)).alias("i")
    texts = d.select(F.col("doc_id").alias("key"), F.col("fp").alias("fingerprint"), F.col("meta").alias("metadata"), "day")
    held = texts.where("key % 11 <> 0").select("key", F.when(F.col("key") % 13 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.when(F.col("key") % 17 == 0, "moved").otherwise(F.col("metadata")).alias("metadata"))
    pieces = d.select("doc_id", "fp", "n", piece(F.col("n"))).select(F.concat_ws("#", "doc_id", "i").alias("key"), F.col("fp").alias("fingerprint"), F.col("doc_id").alias("parent_key"))
    had = d.select("doc_id", "fp", piece(F.col("n") + (F.col("doc_id") % 19 == 0).cast("int"))).select(F.concat_ws("#", "doc_id", "i").alias("key"), F.col("fp").alias("fingerprint"))
    return [
        freshness.Derived("texts", texts, held, snapshot="2024-10-25"),
        freshness.Derived("pieces", pieces.select("key", "fingerprint"), had, (("texts", pieces.select("parent_key", "key")),)),
        freshness.Derived("vectors", pieces.select("key", "fingerprint"), pieces.select("key", "fingerprint").where("NOT key LIKE '%7#0'"), (("pieces", pieces.select(F.col("key").alias("parent_key"), "key")),)),
    ]


_GRAPH = """d AS (SELECT doc_id, CAST(1 + n_chars // 1500 AS INT) AS n, strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INT), '%Y-%m-%d') AS day FROM documents),
t AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'changed' WHEN doc_id % 17 = 0 THEN 'metadata' WHEN day >= '2024-10-25' THEN 'same day' END AS reason FROM d),
p AS (SELECT d.doc_id, d.doc_id || '#' || i AS key, CASE WHEN i = n THEN 'orphan' WHEN t.reason IS NOT NULL THEN 'upstream' END AS reason, i < n AS planned
      FROM (SELECT doc_id, n, unnest(range(0, n + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END)) AS i FROM d) d JOIN t ON t.doc_id = d.doc_id),
g AS (SELECT 'texts' AS "table", CAST(doc_id AS VARCHAR) AS key, reason, 0 AS level FROM t UNION ALL SELECT 'pieces', key, reason, 1 FROM p
      UNION ALL SELECT 'vectors', key, CASE WHEN key LIKE '%7#0' THEN 'missing' WHEN reason IS NOT NULL THEN 'upstream' END, 2 FROM p WHERE planned)"""


@register("freshness_graph", f"WITH {_GRAPH} SELECT * FROM g WHERE reason IS NOT NULL")
def freshness_graph(spark, sf_dir):
    return freshness.freshness_graph(_graph(spark, sf_dir))


@register("freshness_hint", f"""WITH {_GRAPH}, n AS (SELECT "table", count(*) FILTER (reason IS NOT NULL) AS n_stale FROM g GROUP BY 1)
SELECT "table", n_stale, CASE WHEN n_stale > 0 THEN "table" || ': ' || n_stale || ' stale rows' END AS hint FROM n""")
def freshness_hint(spark, sf_dir):
    return freshness.stale_hint(freshness.freshness_graph(_graph(spark, sf_dir)), ["texts", "pieces", "vectors"])


_HASHED = f"""WITH t AS (SELECT doc_id, unnest({_toks()}) AS x FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 262144 AS dim, 1 - 2 * (CAST('0x' || substr(md5(x), 9, 1) AS BIGINT) % 2) AS s FROM t),
c AS (SELECT doc_id, dim, CAST(sum(s) AS DOUBLE) AS n FROM h GROUP BY ALL HAVING sum(s) <> 0), v AS (SELECT doc_id, dim, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS value FROM c)
SELECT a.doc_id, round(sum(a.value * b.value), 6) AS score FROM v a JOIN v b ON a.dim = b.dim AND b.doc_id = 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""


@register("hashed_nearest", _HASHED)
def hashed_nearest(spark, sf_dir):
    """Documents nearest to one of them by signed hashed term counts, kept as (document, dimension, value) rows."""
    d = table(spark, sf_dir, "documents")
    v = encoding.sparse_vectors(d, "doc_id", tx.tokens(F.coalesce("text", F.lit(""))))
    return encoding.sparse_nearest(v, v.where("doc_id = 3"), "doc_id")


@register("encoded_documents", "SELECT doc_id, 'lengths' AS model, CAST([length(text), length(text) - length(replace(text, ' ', '')), ascii(text)] AS FLOAT[]) AS embedding FROM documents WHERE trim(coalesce(text, '')) <> ''")
def encoded_documents(spark, sf_dir):
    """Vectors of all documents by an encoder that is called with 32 texts at a time."""

    def encoder():
        return lambda texts: [[float(len(t)), float(t.count(" ")), float(ord(t[0]))] for t in texts]

    return encoding.encoded(table(spark, sf_dir, "documents"), "doc_id", "text", encoder, "lengths", 3)


@register("sql_functions", f"SELECT doc_id, CAST(len({_toks()}) AS INT) AS n_tokens, coalesce(source ILIKE 'src1%', false) AS is_one, NOT (lang ILIKE 'e%') AS not_e, strftime(DATE '2024-01-01' + CAST(doc_id % 366 AS INT), '%Y-%m') || '-W' || ((CAST(strftime(DATE '2024-01-01' + CAST(doc_id % 366 AS INT), '%d') AS INT) - 1) // 7 + 1) AS week FROM documents")
def sql_functions(spark, sf_dir):
    """The functions by name, through SQL alone."""
    sql_names.register(spark, "corvane_")
    table(spark, sf_dir, "documents").createOrReplaceTempView("corvane_documents")
    return spark.sql("""SELECT doc_id, size(corvane_tokens(coalesce(text, ''))) AS n_tokens, coalesce(corvane_rich(source, 'src1%'), false) AS is_one, corvane_rich(lang, '!e%') AS not_e,
        corvane_week_bucket(date_add(DATE '2024-01-01', CAST(doc_id % 366 AS INT))) AS week FROM corvane_documents""")


@register("sessions_maintained", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, min(ts) AS started, count(*) AS n FROM r GROUP BY user_id, run""")
def sessions_maintained(spark, sf_dir):
    """Sessions of all events, streamed in shuffled batches through state per user and merged batch by batch into a table."""
    folder = f"{shared_dir(spark)}/sessions-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    events.repartition(3).write.parquet(f"{folder}/in")
    # an event of nobody, long after the others, moves the watermark past them
    last = events.agg(F.lit(None).cast("bigint").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 10 YEARS")).alias("ts"))
    last.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    bundle = snapshots.Bundle(spark, f"{folder}/out")
    sessions.maintain(state.stateful_sessions(stream, "user_id", "ts", late="3650 days"), f"{folder}/checkpoint", state.merging(bundle, "sessions", ["user_id", "started"]))
    return bundle.read("sessions").where("user_id IS NOT NULL")
