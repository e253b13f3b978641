"""Messages, and what is stored of documents, over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.packed import pack_json, unpack_json
from ..operators import content, messages
from ..operators.filters import DateSet
from ..session import table
from .registry import register
from .search_queries import _bm25, _toks

_MESSAGES = """m AS (SELECT 'm/' || conv_id || '/' || turn AS url, role AS list_id, array_to_string(list_slice(string_split_regex(coalesce(text, ''), '\\s+'), 1, 4), ' ') AS subject,
'P' || (conv_id % 50) AS sender, strftime(DATE '2024-01-01' + CAST((conv_id * 7 + turn) % 365 AS INT), '%Y-%m-%d') AS date, CASE WHEN turn % 3 <> 2 THEN text END AS content,
CASE WHEN conv_id % 3 = 0 THEN 'R5-' || (1000000 + conv_id) END AS subject_tdocs, CASE WHEN turn % 3 = 0 THEN 'S2-' || (200000 + turn) END AS detail_tdocs FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
i AS (SELECT url, list_id, subject, sender, date, date[:8] || 'W' || CAST((CAST(date[9:10] AS INT) - 1) // 7 + 1 AS INT) AS week, content,
concat_ws(' ', replace(subject_tdocs, 'R5-', 'R5-') || ' ' || subject_tdocs, CASE WHEN content IS NOT NULL OR detail_tdocs IS NOT NULL THEN detail_tdocs || ' ' || detail_tdocs END) AS tdocs, {where} AS passes FROM m)"""
_WEIGHTS = dict.fromkeys(("list_id", "subject", "sender", "date", "week", "tdocs", "content"), 1.0)


def _messages(spark, sf_dir):
    """Turns as messages: two of three have a detail, of which one in three turns names numbers."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").withColumn("url", F.concat_ws("/", F.lit("m"), "conv_id", "turn"))
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(365)).cast("int"))
    head = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), r"\s+"), 1, 4), " ")
    number = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("R5-"), (F.col("conv_id") + 1000000).cast("string")))
    m = c.select("url", F.col("role").alias("list_id"), head.alias("subject"), F.concat(F.lit("P"), (F.col("conv_id") % 50).cast("string")).alias("sender"), day.alias("date"), day.cast("timestamp").alias("sort_timestamp"), number.alias("subject_tdocs"))
    d = c.where("turn % 3 <> 2").select("url", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("S2-"), (F.col("turn") + 200000).cast("string"))).alias("tdocs"), F.lit(None).cast("array<struct<name:string,url:string>>").alias("attachments"), F.col("text").alias("content"))
    return m, d


def _held(c: str) -> str:
    return f"list_has_any({_toks(c)}, ['the', 'from'])"


def _found(where: str, offset: int, limit: int) -> str:
    hits = _bm25(["the", "from"], "i", "url", _WEIGHTS, where="passes", k=1_000_000_000)
    return f"""WITH {_MESSAGES.format(where=where)}, h AS ({hits})
SELECT url, score, CAST(row_number() OVER (ORDER BY score, date DESC, url) - 1 AS INT) AS rank, CASE WHEN {_held('subject')} THEN 'subject' WHEN {_held('content')} THEN 'content' END AS matched_source
FROM (SELECT h.url, h.score, i.date, i.subject, i.content FROM h JOIN i USING (url) ORDER BY h.score, i.date DESC, h.url LIMIT {limit} OFFSET {offset}) ORDER BY rank"""


@register("message_search", _found("true", 5, 30))
def message_search(spark, sf_dir):
    return messages.search(*_messages(spark, sf_dir), "the AND from", offset=5, limit=30).drop("snippet")


@register("message_search_filtered", _found("(list_id ILIKE 'us%' AND NOT (sender ILIKE 'p1') AND (upper(coalesce(subject_tdocs, '')) LIKE 'R5%' OR upper(coalesce(detail_tdocs, '')) LIKE 'R5%') AND date >= '2024-03-01')", 0, 40))
def message_search_filtered(spark, sf_dir):
    """Filters by list, sender, numbers of subject or detail, and days; statistics stay those of all messages."""
    asked = {"list_id": "us%", "sender": "!p1", "tdocs": "r5%", "dates": DateSet([(dt.date(2024, 3, 1), None)])}
    return messages.search(*_messages(spark, sf_dir), "the AND from", asked, limit=40).drop("snippet")


_TDOC_FILTER = "upper(coalesce(subject_tdocs, '')) {0} OR upper(coalesce(detail_tdocs, '')) {0}"


@register("message_list", f"""WITH {_MESSAGES.format(where='true')} SELECT url, date FROM m WHERE NOT ({_TDOC_FILTER.format("LIKE '%1%'")}) AND list_id IS NOT NULL AND subject ILIKE '%the%'
AND (date <= '2024-02-10' OR date BETWEEN '2024-05-01' AND '2024-06-30') ORDER BY date DESC, url LIMIT 100 OFFSET 10""")
def message_list(spark, sf_dir):
    """The list without a text query: newest first, then url."""
    days = DateSet([(None, dt.date(2024, 2, 10)), (dt.date(2024, 5, 1), dt.date(2024, 6, 30))])
    rows = messages.with_details(*_messages(spark, sf_dir)).where(messages.passing({"list_id": "not-null", "subject": "%the%", "tdocs": "!%1%", "dates": days}))
    return rows.orderBy(F.desc("sort_timestamp"), "url").offset(10).limit(100).select("url", F.date_format("date", "yyyy-MM-dd").alias("date"))


#: Orders as documents with an extraction each (one in thirteen has none), their lines as stored files of three families.
_STORED = """t AS (SELECT o_orderkey AS tdoc_id, 'u' || o_orderkey AS ftp_url, CASE o_orderpriority[1:1] WHEN '1' THEN 'CR' WHEN '2' THEN 'draftCR' WHEN '3' THEN 'LS in' WHEN '4' THEN 'discussion' ELSE 'agenda' END AS type FROM orders),
e AS (SELECT o_orderkey AS tdoc_id, 'u' || o_orderkey AS ftp_url, 'f' || (1 + o_orderkey % 3) AS doc_filename, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 2 END AS version, CASE WHEN o_custkey % 11 = 0 THEN '["x"]' WHEN o_custkey % 2 = 0 THEN '[]' END AS skipped,
o_orderkey % 3 AS n_docs, o_orderstatus = 'F' AS cover FROM orders WHERE o_orderkey % 13 <> 0),
c AS (SELECT CASE l_returnflag WHEN 'R' THEN 'cr' WHEN 'A' THEN 'ls' ELSE 'text' END AS family, 'u' || l_orderkey AS ftp_url, 'f' || l_linenumber AS doc_filename, l_quantity AS size FROM lineitem),
k AS (SELECT ftp_url, count(*) FILTER (family = 'cr') AS n_cr, count(*) FILTER (family = 'ls') AS n_ls, count(*) FILTER (family = 'text') AS n_text FROM c GROUP BY 1),
a AS (SELECT e.*, coalesce(n_cr, 0) AS n_cr, coalesce(n_ls, 0) AS n_ls, coalesce(n_text, 0) AS n_text, EXISTS (SELECT 1 FROM c WHERE c.ftp_url = e.ftp_url AND c.doc_filename = e.doc_filename AND family = 'cr') AS m_cr,
EXISTS (SELECT 1 FROM c WHERE c.ftp_url = e.ftp_url AND c.doc_filename = e.doc_filename AND family = 'ls') AS m_ls, EXISTS (SELECT 1 FROM c WHERE c.ftp_url = e.ftp_url AND c.doc_filename = e.doc_filename AND family = 'text') AS m_text FROM e LEFT JOIN k USING (ftp_url)),
s AS (SELECT *, n_cr + n_ls + n_text AS n_stored, version = 2 AND coalesce(skipped, '[]') = '[]' AND ((cover AND n_cr = n_docs AND NOT m_cr) OR (n_docs > 0 AND ((n_ls = n_docs AND m_ls) OR (n_text = n_docs AND m_text)))) AS complete FROM a)"""
_FAMILIES = {"CR": "cr", "draftCR": "cr", "LS in": "ls", "discussion": "text"}


def _stored(spark, sf_dir):
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    url, first = F.concat(F.lit("u"), key.cast("string")).alias("ftp_url"), F.left("o_orderpriority", F.lit(1))
    kind = F.when(first == "1", "CR").when(first == "2", "draftCR").when(first == "3", "LS in").when(first == "4", "discussion").otherwise("agenda")
    t = o.select(key.alias("tdoc_id"), url, kind.alias("type"))
    kept = o.where(key % 13 != 0)
    skipped = F.when(F.col("o_custkey") % 11 == 0, '["x"]').when(F.col("o_custkey") % 2 == 0, "[]")
    e = kept.select(key.alias("tdoc_id"), url, F.concat(F.lit("f"), (key % 3 + 1).cast("string")).alias("doc_filename"), F.when(key % 10 == 0, 1).otherwise(2).alias("extraction_version"), skipped.alias("skipped_sources"), (key % 3).alias("document_count"))
    flag = F.col("l_returnflag")
    c = table(spark, sf_dir, "lineitem").select(
        F.when(flag == "R", "cr").when(flag == "A", "ls").otherwise("text").alias("family"), F.concat(F.lit("u"), F.col("l_orderkey").cast("string")).alias("ftp_url"),
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("doc_filename"), F.col("l_quantity").alias("size"),
    )
    return t, content.completeness(e, kept.where("o_orderstatus = 'F'").select(url), c, ["cr", "ls", "text"]), c


@register("completeness_families", f"WITH {_STORED} SELECT t.tdoc_id, coalesce(complete, false) AS parsed, CASE WHEN complete THEN CAST(n_stored AS BIGINT) END AS document_count FROM t LEFT JOIN s ON s.tdoc_id = t.tdoc_id AND s.ftp_url = t.ftp_url")
def completeness_families(spark, sf_dir):
    t, s, _ = _stored(spark, sf_dir)
    return content.parse_state(t, s)


@register("content_by_request", f"""WITH {_STORED}, q AS (SELECT o_orderkey AS request, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey * 10 END AS tdoc_id, CASE WHEN o_orderkey % 2 = 1 OR o_orderkey % 50 = 0 THEN 'u' || o_orderkey END AS ftp_url, CASE WHEN o_orderkey % 5 = 0 THEN 'f1' END AS source_file FROM orders),
p AS (SELECT q.*, t.tdoc_id AS id, t.ftp_url AS url, CASE WHEN type IN ('CR', 'draftCR') THEN 'cr' WHEN type = 'LS in' THEN 'ls' WHEN type = 'discussion' THEN 'text' END AS family FROM q LEFT JOIN t ON (q.tdoc_id IS NULL) <> (q.ftp_url IS NULL) AND (t.tdoc_id = q.tdoc_id OR t.ftp_url = q.ftp_url)),
r AS (SELECT p.*, s.doc_filename AS main, coalesce(s.complete, false) AS whole, CASE WHEN (p.tdoc_id IS NULL) = (p.ftp_url IS NULL) THEN 'bad_request' WHEN id IS NULL THEN 'unknown' WHEN family IS NULL THEN 'ineligible' WHEN s.ftp_url IS NULL THEN 'extraction_missing'
WHEN version <> 2 OR n_docs <> CASE family WHEN 'cr' THEN n_cr WHEN 'ls' THEN n_ls ELSE n_text END THEN 'incomplete' END AS st FROM p LEFT JOIN s ON s.ftp_url = p.url),
f AS (SELECT r.*, c.doc_filename, c.size FROM r LEFT JOIN c ON st IS NULL AND c.ftp_url = r.url AND c.family = r.family AND (source_file IS NULL OR source_file = c.doc_filename))
SELECT request, coalesce(st, CASE WHEN source_file IS NOT NULL AND doc_filename IS NULL THEN 'source_missing' END, 'ok') AS status, st IS NULL AND whole AND NOT (source_file IS NOT NULL AND doc_filename IS NULL) AS complete, doc_filename, coalesce(doc_filename = main, false) AS is_main, size FROM f""")
def content_by_request(spark, sf_dir):
    t, s, c = _stored(spark, sf_dir)
    key = F.col("o_orderkey")
    q = table(spark, sf_dir, "orders").select(
        key.alias("request"), F.when(key % 2 == 0, F.col("o_custkey") * 10).alias("tdoc_id"),
        F.when((key % 2 == 1) | (key % 50 == 0), F.concat(F.lit("u"), key.cast("string"))).alias("ftp_url"), F.when(key % 5 == 0, "f1").alias("source_file"),
    )
    return content.stored(q, t, s, c, _FAMILIES)


@register("json_columns", "SELECT doc_id, CASE WHEN doc_id % 7 IN (1, 2) THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 7 NOT IN (1, 2) THEN CAST(length(text) AS INT) END AS n_chars FROM documents")
def json_columns(spark, sf_dir):
    """Whole texts through the compressed column and back; broken data and absent ones are null, plain JSON is read as it is."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("lang", "text")).alias("j"))
    packed = d.select("doc_id", "j", pack_json("j").alias("z"))
    part = F.col("doc_id") % 7
    blob = F.when(part == 1, F.substring("z", 1, 12)).when(part == 2, F.lit(None)).when(part == 3, F.encode("j", "UTF-8")).otherwise(F.col("z"))
    back = packed.select("doc_id", unpack_json(blob).alias("j")).select("doc_id", F.from_json("j", "lang string, text string").alias("x"))
    return back.select("doc_id", "x.lang", F.length("x.text").alias("n_chars"))
