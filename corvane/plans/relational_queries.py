"""Filters, joins, aggregates, freshness and upserts over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import filters as fl
from ..operators import tables as tb
from ..session import table
from .registry import register

_O = "o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


@register("filter_rich_like", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment ILIKE 'bu%' AND c_name IS NOT NULL AND NOT (c_name ILIKE '%7')")
def filter_rich_like(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.where(fl.rich(F.col("c_mktsegment"), "bu%") & fl.rich(F.col("c_name"), "not-null") & fl.rich(F.col("c_name"), "!%7")).select("c_custkey", "c_name")


@register("filter_not_like_null", "SELECT d.doc_id, CAST(quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (CAST(quality AS VARCHAR) ILIKE '1')")
def filter_not_like_null(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("quality", F.col("quality").cast("string"))
    return d.where(fl.rich(F.col("quality"), "!1")).select("doc_id", "quality")


@register("filter_null", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL")
def filter_null(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.where(fl.rich(F.col("quality"), " NULL ")).select("doc_id")


@register("filter_or_negated_group", "SELECT p_partkey FROM part WHERE NOT (p_name ILIKE '%y%' OR p_type ILIKE '%y%' OR p_brand ILIKE '%1')")
def filter_or_negated_group(spark, sf_dir):
    return table(spark, sf_dir, "part").where(fl.rich_any([F.col("p_name"), F.col("p_type")], "!%y%") & fl.rich_any([F.col("p_brand")], "!%1")).select("p_partkey")


@register("filter_date_ops", f"SELECT {_O} FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-01' AND CAST(o_orderdate AS DATE) <> DATE '1995-06-17' AND CAST(o_orderdate AS DATE) <= DATE '1996-12-31'")
def filter_date_ops(spark, sf_dir):
    d = F.col("o_orderdate")
    o = _orders(spark, sf_dir).where(fl.date_filter(d, ">= '1995-01-01'") & fl.date_filter(d, "!= '1995-06-17'") & fl.since_until(d, until="1996-12-31"))
    return o.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@register("filter_dateset_or", f"SELECT {_O} FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1993-03-01' AND DATE '1993-05-31' OR CAST(o_orderdate AS DATE) >= DATE '1998-01-01'")
def filter_dateset_or(spark, sf_dir):
    days = fl.DateSet([(dt.date(1993, 3, 1), dt.date(1993, 4, 30)), (dt.date(1993, 5, 1), dt.date(1993, 5, 31)), (dt.date(1998, 1, 1), None)])
    return _orders(spark, sf_dir).where(days.predicate(F.col("o_orderdate"))).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@register("list_offset_limit", f"SELECT {_O} FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey DESC LIMIT 50 OFFSET 100")
def list_offset_limit(spark, sf_dir):
    o = _orders(spark, sf_dir).where(fl.upper_exact(F.col("o_orderstatus"), "o")).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return tb.page(o, [F.desc("o_orderkey")], 100, 50)


@register("list_year", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 200")
def list_year(spark, sf_dir):
    return _orders(spark, sf_dir).where(F.year("o_orderdate") == 1995).orderBy(F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).limit(200).select("o_orderkey")


@register("list_keyset", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def list_keyset(spark, sf_dir):
    return tb.after(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 100)


@register("list_eligible", "SELECT p_partkey FROM part WHERE lower(trim(p_brand)) IN ('brand#1', 'brand#11', 'brand#12')")
def list_eligible(spark, sf_dir):
    return table(spark, sf_dir, "part").where(fl.eligible(F.col("p_brand"), ["Brand#1", "Brand#11", "BRAND#12"])).select("p_partkey")


@register("lookup_bulk", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def lookup_bulk(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return tb.by_ids(table(spark, sf_dir, "orders"), "o_custkey", ids).select("o_orderkey", "o_totalprice")


@register("join_inner_outer", """SELECT n_name, r_name, count(c_custkey) AS n_customers, count(*) FILTER (c_acctbal > 5000) AS n_rich
FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def join_inner_outer(spark, sf_dir):
    n, c, r = (table(spark, sf_dir, t) for t in ("nation", "customer", "region"))
    # counted per key before the join: a few rows per nation are shuffled, not one per customer
    per = c.groupBy("c_nationkey").agg(F.count("c_custkey").alias("n_customers"), F.count_if(F.col("c_acctbal") > 5000).alias("n_rich"))
    j = n.join(per, n.n_nationkey == per.c_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey)
    return j.select("n_name", "r_name", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), F.coalesce("n_rich", F.lit(0)).alias("n_rich"))


_RANGE = """WITH m AS (SELECT n_nationkey AS meeting, 'R' || (n_nationkey % 3) AS prefix, n_nationkey * 600 AS low, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE n_nationkey * 600 + 450 END AS high FROM nation),
t AS (SELECT o_orderkey, 'R' || (o_custkey % 3) AS prefix, o_orderkey AS num FROM orders)
SELECT t.o_orderkey, m.meeting FROM t JOIN m ON t.prefix = m.prefix AND num >= low AND (high IS NULL OR num <= high)"""


@register("range_bracket_join", _RANGE)
def range_bracket_join(spark, sf_dir):
    m = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("meeting"),
        F.format_string("R%d-%07d", F.col("n_nationkey") % 3, F.col("n_nationkey") * 600).alias("start_doc"),
        F.when(F.col("n_nationkey") % 5 != 4, F.format_string("R%d-%07d", F.col("n_nationkey") % 3, F.col("n_nationkey") * 600 + 450)).alias("end_doc"),
    )
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("R"), (F.col("o_custkey") % 3).cast("string"), F.lit("-")).alias("prefix"), F.col("o_orderkey").alias("num"))
    return tb.bracket_join(t, m, "prefix", "num", "start_doc", "end_doc", 3).select("o_orderkey", "meeting")


@register("delimited_containment_join", """SELECT p_partkey, word AS member FROM (SELECT p_partkey, unnest(list_distinct(list_transform(string_split(p_name, ' '), lambda x: lower(trim(x))))) AS word FROM part)
JOIN (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS w FROM part) ON word = w WHERE word <> ''""")
def delimited_containment_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    wanted = p.select(F.lower(F.substring_index("p_name", " ", 1)).alias("member")).distinct()
    return tb.list_members(p, "p_partkey", "p_name", " ").join(wanted, "member").select("p_partkey", "member")


@register("exists_two_predicates", """SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag ILIKE 'r%')
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus ILIKE 'f') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)""")
def exists_two_predicates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    # three EXISTS on one key: one partial aggregate of flags instead of three joins
    flags = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.bool_or(fl.rich(F.col("l_returnflag"), "r%")).alias("a"), F.bool_or(fl.rich(F.col("l_linestatus"), "f")).alias("b"), F.bool_or(F.col("l_quantity") > 45).alias("c")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey").join(flags.where("a and b and not coalesce(c, false)"), "o_orderkey", "left_semi")


@register("anti_orphans", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def anti_orphans(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@register("union_stale", """WITH src AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 7 <> 0), idx AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 5 <> 0)
SELECT k, 'missing' AS reason FROM src WHERE k NOT IN (SELECT k FROM idx) UNION SELECT src.k, 'changed' FROM src JOIN idx ON src.k = idx.k WHERE src.s <> idx.s UNION SELECT k, 'orphan' FROM idx WHERE k NOT IN (SELECT k FROM src)""")
def union_stale(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return tb.stale(o.where("k % 7 <> 0"), o.where("k % 5 <> 0").withColumn("s", F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("s"))), ["k"], ["s"])


@register("cross_checkpoint_stale", "SELECT event_id FROM events, (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events) WHERE ts >= mark")
def cross_checkpoint_stale(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mark = e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("mark"))  # one row
    return e.crossJoin(F.broadcast(mark)).where("ts >= mark").select("event_id")


@register("completeness_state", """WITH n AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS f, max(l_linenumber) AS m FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(n.n = n.m AND n.f = n.n, false) AS parsed, CASE WHEN n.n = n.m AND n.f = n.n THEN n.n END AS document_count FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""")
def completeness_state(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("f"), F.max("l_linenumber").alias("m"))
    done = F.coalesce((F.col("n") == F.col("m")) & (F.col("f") == F.col("n")), F.lit(False))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", done.alias("parsed"), F.when(done, F.col("n")).alias("document_count"))


@register("contiguity_check", "SELECT conv_id, count(*) AS n, count(DISTINCT turn) = count(*) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS complete FROM conversations GROUP BY 1")
def contiguity_check(spark, sf_dir):
    return tb.contiguous(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@register("pivot_kv_max", "SELECT user_id, coalesce(max(CASE WHEN event_type = 'click' THEN event_id END), -1) AS click, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END), -1) AS purchase, count(*) AS n FROM events GROUP BY 1")
def pivot_kv_max(spark, sf_dir):
    last = lambda k: F.coalesce(F.max(F.when(F.col("event_type") == k, F.col("event_id"))), F.lit(-1)).alias(k)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last("click"), last("purchase"), F.count("*").alias("n"))


@register("dedup_latest", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def dedup_latest(spark, sf_dir):
    return tb.newest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@register("dedup_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedup_first(spark, sf_dir):
    return tb.oldest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@register("min_by_group", "SELECT l_orderkey, min(l_extendedprice) AS price, min_by(l_linenumber, (l_extendedprice, l_linenumber)) AS line FROM lineitem GROUP BY 1")
def min_by_group(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("price"), F.min_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).alias("line"))


@register("sorted_distinct_concat", "SELECT l_suppkey, string_agg(f, ',' ORDER BY f) AS flags FROM (SELECT DISTINCT l_suppkey, l_returnflag || l_linestatus AS f FROM lineitem) GROUP BY 1")
def sorted_distinct_concat(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), ",").alias("flags"))


@register("distinct_sorted_keys", "SELECT DISTINCT source, lang FROM documents ORDER BY 1, 2")
def distinct_sorted_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "lang").distinct().orderBy("source", "lang")


@register("count_filtered", "SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS n_en, max(n_chars) AS longest FROM documents WHERE n_chars > 100")
def count_filtered(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("n_chars > 100").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("n_en"), F.max("n_chars").alias("longest"))


@register("upsert_merge", """SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 AND c_custkey % 20 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
CASE WHEN c_custkey % 10 = 0 AND c_custkey % 20 <> 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 100 = 7""")
def upsert_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    odd = F.col("c_custkey") % 20 != 0
    new = c.where("c_custkey % 10 = 0").select("c_custkey", "c_name", F.when(odd, F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(odd, "NEW").alias("c_mktsegment"))
    new = new.unionByName(c.where("c_custkey % 100 = 7").withColumn("c_custkey", -F.col("c_custkey")))
    return tb.upsert(c, new, ["c_custkey"], keep=["c_mktsegment"])


@register("insert_ignore", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'NEW' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0")
def insert_ignore(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return tb.insert_new(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 2 = 0").withColumn("c_mktsegment", F.lit("NEW")), ["c_custkey"])


@register("replace_bundle", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber = 1) UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linenumber = 1")
def replace_bundle(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return tb.replace_parents(li, li.where("l_orderkey % 4 = 0 and l_linenumber = 1"), "l_orderkey")


@register("revision_bump", "SELECT c_custkey, CAST(CASE WHEN c_custkey % 6 = 0 THEN 1 WHEN c_custkey % 4 = 0 THEN 4 ELSE 3 END AS INT) AS revision, c_custkey % 6 = 0 OR c_custkey % 4 = 0 AS changed FROM customer")
def revision_bump(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    old = c.where("c_custkey % 6 <> 0").withColumn("revision", F.lit(3))
    new = c.withColumn("c_name", F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")))
    return tb.bump_revisions(old, new, "c_custkey", ["c_name", "c_acctbal"])


@register("coverage_islands", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS a, CAST(ts AS DATE) + CAST(event_id % 3 AS INT) AS z FROM events),
m AS (SELECT *, CASE WHEN a > max(z) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS n FROM e),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(a) AS a, max(z) AS z FROM r GROUP BY user_id, g""")
def coverage_islands(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("a"), F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 3).cast("int")).alias("z"))
    return tb.islands(e, ["user_id"], "a", "z")


@register("interval_gate", "SELECT user_id FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) WHERE last IS NULL OR epoch(TIMESTAMP '2025-01-01') - epoch(last) >= 86400")
def interval_gate(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return tb.due(last, "last", F.lit("2025-01-01").cast("timestamp_ntz"), 86400).select("user_id")


@register("retention_delete", "SELECT count(*) AS n, min(event_id) AS low FROM events WHERE NOT (event_type IN ('error', 'logout') AND ts < (SELECT max(ts) - INTERVAL 7 DAY FROM events))")
def retention_delete(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mark = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("mark"))
    return e.crossJoin(F.broadcast(mark)).where(~(F.col("event_type").isin("error", "logout") & (F.col("ts") < F.col("mark")))).agg(F.count("*").alias("n"), F.min("event_id").alias("low"))


@register("carry_forward_label", "SELECT event_id, last_value(CASE WHEN event_id % 9 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS label FROM events")
def carry_forward_label(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.last(F.when(F.col("event_id") % 9 == 0, F.col("event_type")), ignorenulls=True).over(w).alias("label"))


@register("order_with_lines", "SELECT o_orderkey, count(l_linenumber) AS n_lines, round(coalesce(sum(l_quantity), 0), 2) AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def order_with_lines(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("n_lines"), F.sum("l_quantity").alias("q"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.round(F.coalesce("q", F.lit(0.0)), 2).alias("quantity"))
