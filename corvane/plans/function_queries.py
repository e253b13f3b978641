"""Scalar functions, identifiers and parsers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import table
from ..sources import web
from ..streaming import sessions
from .registry import register


_NUMBER = "'R5-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0')"


@register("norm_ids", f"""SELECT o_orderkey, 'see ' || {_NUMBER} || ' ' || {_NUMBER} || CASE WHEN o_orderkey % 2 = 0 THEN 'r2' ELSE '' END || ' of 38_300-1 and 1_2.3_4' AS text FROM orders""")
def norm_ids(spark, sf_dir):
    said = F.concat(F.lit("see r5-"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.when(F.col("o_orderkey") % 2 == 0, "R2").otherwise(""), F.lit(" of 38.300-1 and 1.2.3.4"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.normalize_ids(said).alias("text"))


@register("norm_path", "SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(trim(url), '^(?i:https?|ftp)://[^/]*', ''), '/+', '/', 'g'), '^/', '')) AS path FROM pages")
def norm_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.normalize_path(F.col("url")).alias("path"))


@register("norm_release", "SELECT n_nationkey, 'Rel-' || n_nationkey AS a, CASE WHEN n_nationkey % 10 = 9 THEN 'R99' ELSE 'Rel-199' || (n_nationkey % 10) END AS b, CASE WHEN n_nationkey = 0 THEN 'draft' WHEN n_nationkey < 4 THEN 'pre-release' ELSE 'Rel-' || n_nationkey END AS c FROM nation")
def norm_release(spark, sf_dir):
    n = F.col("n_nationkey").cast("string")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", tx.release_name(F.concat(F.lit("Release "), n)).alias("a"), tx.release_name(F.concat(F.lit("release  199"), (F.col("n_nationkey") % 10).cast("string"))).alias("b"), tx.release_of_version(F.concat(n, F.lit(".1.0"))).alias("c")
    )


@register("week_bucket", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') || '-W' || CAST((day(o_orderdate) - 1) // 7 + 1 AS VARCHAR) AS bucket, CAST(year(o_orderdate) * 1200 + month(o_orderdate) * 100 + (day(o_orderdate) - 1) // 7 + 1 AS INT) AS sort_key FROM orders")
def week_bucket(spark, sf_dir):
    b = tx.week_bucket(F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").select("o_orderkey", b.alias("bucket"), tx.period_key(b).cast("int").alias("sort_key"))


@register("sha_identity", """SELECT page_id, sha256('["' || url || '","m' || page_id || '.docx"]') AS id FROM pages""")
def sha_identity(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.document_id(F.col("url"), F.concat(F.lit("m"), F.col("page_id").cast("string"), F.lit(".docx"))).alias("id"))


@register("version_sort", "SELECT p_partkey, p_size || '.' || (p_partkey % 20) || '.x' AS version FROM part ORDER BY p_size DESC, p_partkey % 20 DESC, p_partkey LIMIT 100")
def version_sort(spark, sf_dir):
    v = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 20).cast("string"), F.lit("x"))
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("version")).orderBy(F.desc(tx.version_key(F.col("version"))), "p_partkey").limit(100)


@register("preview_truncate", "SELECT doc_id, left(text, 200) AS content_preview, length(text) > 200 AS preview_truncated FROM documents")
def preview_truncate(spark, sf_dir):
    a, b = tx.preview(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", a.alias("content_preview"), b.alias("preview_truncated"))


@register("url_strip", r"SELECT page_id, 'See' || chr(10) || 'and p' || page_id || ' at x' AS text FROM pages")
def url_strip(spark, sf_dir):
    said = F.concat(F.lit("See "), F.col("url"), F.lit("\n\n and  [p"), F.col("page_id").cast("string"), F.lit("]("), F.col("url"), F.lit(") at <"), F.col("url"), F.lit("> x www.a-b.org/"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_urls(said).alias("text"))


@register("collapse_space", r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def collapse_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.collapse(F.col("text")).alias("text"))


@register("date_parse_chain", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def date_parse_chain(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyy/MM/dd")).otherwise(F.date_format(d, "d/M/yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.parse_date(said).alias("day"))


@register("ids_in_text", "SELECT o_orderkey, 'R5-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS ids FROM orders")
def ids_in_text(spark, sf_dir):
    n = F.lpad(F.col("o_orderkey").cast("string"), 7, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(tx.ids_in(F.concat(F.lit("http://x/r5%2D"), n, F.lit(".zip?q=r5-"), n)), ",").alias("ids"))


@register("html_links")
def html_links(spark, sf_dir):
    return web.links(table(spark, sf_dir, "pages"), "page_id", "url", "html")


@register("html_markdown")
def html_markdown(spark, sf_dir):
    return web.markdown(table(spark, sf_dir, "pages"), "page_id", "html")


@register("quote_strip")
def quote_strip(spark, sf_dir):
    return web.without_quotes(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text"), "msg_id", "text")


@register("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, n DESC ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    return sessions.batch_sessions(table(spark, sf_dir, "events"), "user_id", "ts")
