"""Freshness of indexes, control rows, checks of bundles and hybrid search over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking, filters, freshness, records, textsearch, vector
from ..session import table
from .registry import register


@register("vector_freshness", "SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'missing' ELSE 'orphan' END AS reason FROM documents WHERE doc_id % 5 IN (1, 2)")
def vector_freshness(spark, sf_dir):
    """Planned chunk ids against indexed ones, both ways."""
    n = (1 + F.floor(F.col("n_chars") / 2000)).cast("int")
    d = table(spark, sf_dir, "documents")
    planned = freshness.planned_chunks(d.select("doc_id", n.alias("n")), "doc_id", "n")
    had = freshness.planned_chunks(d.select("doc_id", (n + F.when(F.col("doc_id") % 5 == 1, -1).when(F.col("doc_id") % 5 == 2, 1).otherwise(0)).alias("n")), "doc_id", "n")
    return freshness.stale_parents(planned, had, "doc_id", "chunk_id")


@register("closed_window", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND DATE '1998-01-01' - CAST(o_orderdate AS DATE) > 90")
def closed_window(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("last", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")))
    return o.where(freshness.closed(o, "o_orderdate", "last", F.lit("1998-01-01").cast("date"), 90)).select("o_orderkey")


@register("unseen_files", "SELECT page_id FROM pages WHERE page_id % 4 = 0")
def unseen_files(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    return freshness.unseen(p, p.where("page_id % 4 <> 0"), ["page_id", "url", "digest"]).select("page_id")


@register("watermark_advance", "SELECT user_id, greatest(max(ts) FILTER (event_id % 2 = 0), max(ts) FILTER (event_id % 2 = 1)) AS ts FROM events GROUP BY 1")
def watermark_advance(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    control = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("ts").alias("ts"))
    return freshness.advanced(control, e.where("event_id % 2 = 1"), "user_id", "ts")


@register("failed_first", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS attempt FROM orders WHERE o_orderkey % 10 = 0 OR o_orderkey % 4 = 0")
def failed_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return freshness.retry_first(o.where("o_orderkey % 4 = 0"), o.where("o_orderkey % 10 = 0"), ["o_orderkey"])


@register("resume_cursor", "SELECT doc_id FROM documents WHERE doc_id > (SELECT count(*) // 2 FROM documents)")
def resume_cursor(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    cursor = d.agg(F.floor(F.count("*") / 2).alias("last_key")).withColumn("snapshot", F.lit("s1"))
    return freshness.resumed(d, "doc_id", cursor, F.lit("s1"))


@register("changed_revisions", "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def changed_revisions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit(2).alias("revision"), F.md5("c_name").alias("fingerprint"))
    had = c.where("c_custkey % 3 <> 0").withColumn("revision", F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(2))
    return freshness.changed_revisions(c, had, "c_custkey", ["revision", "fingerprint"]).select("c_custkey")


@register("row_errors", "SELECT p_partkey, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_size AS INT) END AS value, CASE WHEN p_partkey % 6 = 0 THEN 'invalid' END AS error FROM part")
def row_errors(spark, sf_dir):
    said = F.when(F.col("p_partkey") % 6 == 0, "x").otherwise(F.col("p_size").cast("string"))
    p = table(spark, sf_dir, "part").select("p_partkey", said.alias("said"))
    return freshness.each_or_error(p, F.col("said").try_cast("int"), F.col("said").try_cast("int").isNotNull()).select("p_partkey", "value", "error")


@register("identity_conflicts", "SELECT n_nationkey, n_name FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN n_name || '!' ELSE n_name END AS n_name FROM nation) WHERE n_nationkey % 6 = 0")
def identity_conflicts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return records.conflicts(n, n.withColumn("n_name", F.when(F.col("n_nationkey") % 6 == 0, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name"))), "n_nationkey", "n_name")


@register("bundle_faults", """SELECT l_orderkey, CASE WHEN count(DISTINCT l_partkey % 7) < count(*) THEN 'repeated source' WHEN count(DISTINCT l_linenumber) < count(*) THEN 'repeated document' WHEN count(*) <> 3 THEN 'wrong count' WHEN NOT bool_or(l_partkey % 7 = 0) THEN 'no main source' END AS fault
FROM lineitem GROUP BY 1 HAVING fault IS NOT NULL""")
def bundle_faults(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 7).alias("source"), "l_linenumber", F.lit(3).alias("said"), F.lit(0).alias("main"))
    return records.bundle_faults(li, "l_orderkey", "source", "l_linenumber", "said", "main")


@register("main_member", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'a/R5-1234567 x.docx' WHEN 1 THEN 'R5-1234567.DOC' END AS main FROM part")
def main_member(spark, sf_dir):
    k = F.col("p_partkey") % 3
    members = F.when(k == 0, F.array(F.lit("a/R5-1234567 x.docx"), F.lit("R5-12345678.docx"))).when(k == 1, F.array(F.lit("R5-1234567 y.docx"), F.lit("R5-1234567.DOC"))).otherwise(F.array(F.lit("R5-1234567.docx"), F.lit("R5-1234567.doc")))
    return table(spark, sf_dir, "part").select("p_partkey", records.main_member(members, F.lit("r5-1234567")).alias("main"))


@register("caps_by_kind", """WITH c AS (SELECT conv_id, turn, role, CAST(1 + length(coalesce(text, '')) // 40 AS INT) AS n, CASE WHEN role = 'user' THEN 8 ELSE 16 END AS cap FROM conversations),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id, role ORDER BY turn, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT conv_id, role, CAST(sum(greatest(0, least(n, cap - before))) AS BIGINT) AS kept FROM b GROUP BY ALL""")
def caps_by_kind(spark, sf_dir):
    """Eight chunks of one kind and sixteen of the other for each parent, children in order."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (1 + F.floor(F.length(F.coalesce("text", F.lit(""))) / 40)).cast("int").alias("n"))
    c = c.withColumn("parent", F.struct("conv_id", "role"))
    kept = chunking.capped(c.where("role = 'user'"), "parent", ["turn", "n"], "n", 8).unionByName(chunking.capped(c.where("role <> 'user'"), "parent", ["turn", "n"], "n", 16))
    return kept.groupBy("conv_id", "role").agg(F.sum("kept").alias("kept"))


@register("embed_text", "SELECT doc_id, concat_ws(' :: ', nullif(lang, ''), nullif(source, ''), nullif(left(coalesce(text, ''), 2000), '')) AS text FROM documents")
def embed_text(spark, sf_dir):
    part = lambda c: F.nullif(c, F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" :: ", part(F.col("lang")), part(F.col("source")), part(F.left(F.coalesce("text", F.lit("")), F.lit(2000)))).alias("text"))


def _distances(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 0").select("embedding").first()[0]])
    return e.select("vec_id", "label", F.round(vector.cosine_distance(F.col("embedding"), q), 5).alias("distance"))


_DIST = "round(list_cosine_distance(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])), 5)"


@register("knn_window_compat", f"SELECT vec_id, distance FROM (SELECT vec_id, label, {_DIST} AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 40) WHERE label < 5")
def knn_window_compat(spark, sf_dir):
    """Filters after a fixed window, as engines without pushed filters do; `knn_filtered` is the exact form."""
    return _distances(spark, sf_dir).orderBy(F.asc_nulls_last("distance"), "vec_id").limit(40).where("label < 5").select("vec_id", "distance")


@register("knn_chunks", f"SELECT vec_id, {_DIST} AS distance FROM embeddings WHERE label IN (3, 4) AND vec_id % 2 = 0 ORDER BY distance, vec_id LIMIT 15")
def knn_chunks(spark, sf_dir):
    return _distances(spark, sf_dir).where("label in (3, 4) and vec_id % 2 = 0").orderBy(F.asc_nulls_last("distance"), "vec_id").limit(15).select("vec_id", "distance")


@register("knn_dims", "SELECT len(embedding) AS dims, count(*) AS n FROM embeddings GROUP BY 1")
def knn_dims(spark, sf_dir):
    """What an index has to agree on before it is asked."""
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").cast("bigint").alias("dims")).agg(F.count("*").alias("n"))


@register("verified_chunks", "SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 AND label % 2 = 0")
def verified_chunks(spark, sf_dir):
    """Matched chunks whose identity, fingerprint and snapshot all agree with the stored text's."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    stored = e.select("vec_id", F.md5(F.col("vec_id").cast("string")).alias("fingerprint"), (F.col("label") % 2).alias("snapshot"))
    hits = e.select("vec_id", "label", F.md5(F.when(F.col("vec_id") % 3 == 0, "old").otherwise(F.col("vec_id").cast("string"))).alias("fingerprint"), F.lit(0).cast("bigint").alias("snapshot"))
    return hits.join(stored.withColumn("snapshot", F.col("snapshot").cast("bigint")), ["vec_id", "fingerprint", "snapshot"], "left_semi").select("vec_id", "label")


@register("fuse_messages", f"""WITH t AS (SELECT label, count(*) AS n FROM embeddings WHERE label < 8 GROUP BY 1), a AS (SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS r FROM t),
s AS (SELECT label, min({_DIST}) AS d FROM embeddings WHERE label > 1 GROUP BY 1), b AS (SELECT label, row_number() OVER (ORDER BY d, label) - 1 AS r FROM s)
SELECT * FROM (SELECT coalesce(a.label, b.label) AS label, round(coalesce(0.5 / (60.0 + a.r), 0) + coalesce(0.5 / (60.0 + b.r), 0), 8) AS score FROM a FULL JOIN b ON a.label = b.label) ORDER BY score DESC, label % 3 DESC, label LIMIT 6""")
def fuse_messages(spark, sf_dir):
    """Fusion of messages: ties by a time, newest first, then by key."""
    d = _distances(spark, sf_dir)
    a = vector.ranked(d.where("label < 8").groupBy("label").agg(F.count("*").alias("n")), [F.desc("n"), "label"])
    b = vector.ranked(d.where("label > 1").groupBy("label").agg(F.min("distance").alias("d")), ["d", "label"])
    return vector.fuse(a, b, "label").orderBy(F.desc("score"), F.desc(F.col("label") % 3), "label").limit(6)


@register("merge_matched", "SELECT label, string_agg(vec_id, ',' ORDER BY kind, vec_id) AS members FROM (SELECT label, vec_id, 0 AS kind FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT label, vec_id, 1 FROM embeddings WHERE vec_id % 20 = 0 AND vec_id % 50 <> 0) GROUP BY label")
def merge_matched(spark, sf_dir):
    """Each parent's matched documents: those of the vector side in order, then those that only the text side has."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id")
    side = lambda n, name: e.where(F.col("vec_id") % n == 0).groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias(name))
    both = side(50, "a").join(side(20, "b"), "label", "full_outer")
    none = F.array().cast("array<bigint>")
    return both.select("label", F.array_join(F.array_union(F.coalesce("a", none), F.coalesce("b", none)).cast("array<string>"), ",").alias("members"))


@register("search_modes", "SELECT 'a' AS asked, 'hybrid' AS mode UNION ALL SELECT 'b', 'text' UNION ALL SELECT 'c', 'semantic' UNION ALL SELECT 'd', 'filter'")
def search_modes(spark, sf_dir):
    asked = {"a": ("x", "y"), "b": (" x ", " "), "c": (None, "y"), "d": ("", None)}
    return spark.createDataFrame([(k, textsearch.mode_of(*v)) for k, v in asked.items()], "asked string, mode string")


@register("content_family", "SELECT n_nationkey, ['ls', 'discussion', 'wid', NULL][CAST(n_nationkey % 4 + 1 AS INT)] AS family FROM nation")
def content_family(spark, sf_dir):
    from ..sources import office

    k = F.col("n_nationkey") % 4
    said = F.when(k == 0, "# Reply\n\nTitle:  Reply LS on power").when(k == 1, "x\n\n Title:  Discussion on x").when(k == 2, "a\n3GPP™ Work Item Description").otherwise("plain\ntext")
    return table(spark, sf_dir, "nation").select("n_nationkey", office.content_family(said).alias("family"))


@register("structural_detector", "SELECT n_nationkey, n_nationkey % 2 = 0 AS is_cr FROM nation")
def structural_detector(spark, sf_dir):
    from ..sources import changes

    row = F.lit("| | 38.523-1 | CR | | 0012 | rev | - | Current version: | 17.1.0 |")
    said = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("| CHANGE  REQUEST |\n"), row)).otherwise(row)
    return table(spark, sf_dir, "nation").select("n_nationkey", changes.is_change_request(said).alias("is_cr"))


@register("cover_page", "SELECT p_partkey, '38.523-1' AS spec, lpad(CAST(p_partkey AS VARCHAR), 4, '0') AS cr_num, CASE WHEN p_partkey % 2 = 0 THEN '0' ELSE '3' END AS rev, 'Rel-' || (p_partkey % 20) AS release, 'Fix ' || p_partkey AS title, CAST(NULL AS VARCHAR) AS summary_of_change FROM part")
def cover_page(spark, sf_dir):
    from ..sources import changes

    k = F.col("p_partkey")
    n = k.cast("string")
    said = F.concat(
        F.lit("| 38.523-1 | CR | "), F.lpad(n, 4, "0"), F.lit(" | rev | "), F.when(k % 2 == 0, "-").otherwise("3"), F.lit(" | Current version: | 17.1.0 |\n| Title: | Fix "), n,
        F.lit(" |\n| Category: | F | | Release: | | Release "), (k % 20).cast("string"), F.lit(" |\n| Summary of change: | | |\n| Title: | later |"),
    )
    found = changes.cover_page(said)
    return table(spark, sf_dir, "part").select("p_partkey", *[found[c].alias(c) for c in ("spec", "cr_num", "rev", "release", "title", "summary_of_change")])


@register("filter_words_absent", "SELECT count(*) AS n FROM customer")
def filter_words_absent(spark, sf_dir):
    """An empty filter is an absent one."""
    return table(spark, sf_dir, "customer").where(filters.rich(F.col("c_name"), "") & filters.date_filter(F.col("c_name"), "") & filters.upper_exact(F.col("c_name"), None)).agg(F.count("*").alias("n"))


@register("effective_ids", "SELECT o_orderkey, 'R5-' || right('000000' || o_orderkey, 7) || ',S2-1234567' || CASE WHEN o_orderkey % 2 = 0 THEN ',R5-7654321' ELSE '' END AS ids FROM orders")
def effective_ids(spark, sf_dir):
    """Numbers of subject, detail and attachment addresses, first seen first; revisions and groups that don't exist don't count."""
    n = F.right(F.concat(F.lit("000000"), F.col("o_orderkey").cast("string")), F.lit(7))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_join(tx.ids_in(F.concat(F.lit("Re: r5-"), n, F.lit("r2")), F.lit("see S2-1234567, not S9-1234567"), F.concat(F.lit("http://x/"), F.when(F.col("o_orderkey") % 2 == 0, "R5%2D7654321").otherwise("s2-1234567"), F.lit(".zip"))), ",").alias("ids")
    )
