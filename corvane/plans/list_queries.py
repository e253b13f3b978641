"""Lists, lookups, orders and scalar functions over the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import filters as fl
from ..operators import records as rc
from ..operators import tables as tb
from ..session import table
from .registry import register


@register("lookup_key", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7 LIMIT 1")
def lookup_key(spark, sf_dir):
    return tb.keyed(table(spark, sf_dir, "orders"), "o_orderkey", 7).select("o_orderkey", "o_totalprice")


@register("lookup_path", "SELECT page_id FROM pages WHERE lower(regexp_replace(url, '^https?://[^/]*/+', '')) = (SELECT min(lower(regexp_replace(url, '^https?://[^/]*/+', ''))) FROM pages) ORDER BY page_id LIMIT 1")
def lookup_path(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", tx.normalize_path(F.col("url")).alias("path"))
    asked = p.agg(F.min("path").alias("asked"))  # one row: a path that is there
    return p.join(F.broadcast(asked), F.col("path") == F.col("asked")).orderBy("page_id").limit(1).select("page_id")


_STORES = {"nation": "n", "region": "r", "supplier": "s", "customer": "c"}


@register("union_stores", " UNION ALL ".join(f"SELECT '{t}' AS store, {x}_name AS name FROM {t}" for t, x in _STORES.items()))
def union_stores(spark, sf_dir):
    """Four stores as one, with the store as a column to filter by."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("store"), F.col(f"{x}_name").alias("name")) for t, x in _STORES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("lookup_sources", "SELECT l.doc_id, d.source, d.lang FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality = 1")
def lookup_sources(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")


@register("latest_archive", """SELECT o_custkey, max_by(name, (y, w, r)) AS name FROM (SELECT o_custkey, 2020 + o_orderkey % 4 AS y, 1 + o_orderkey % 52 AS w, o_orderkey % 3 AS r,
'TTCN CR Agreement Status ' || (2020 + o_orderkey % 4) || '-wk' || lpad(CAST(1 + o_orderkey % 52 AS VARCHAR), 2, '0') || CASE WHEN o_orderkey % 3 > 0 THEN '_r' || (o_orderkey % 3) ELSE '' END || '.zip' AS name FROM orders) GROUP BY 1""")
def latest_archive(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    name = F.concat(F.format_string("TTCN CR Agreement Status %d-wk%02d", 2020 + k % 4, 1 + k % 52), F.when(k % 3 > 0, F.concat(F.lit("_r"), (k % 3).cast("string"))).otherwise(""), F.lit(".zip"))
    return o.select("o_custkey", name.alias("name")).where(tx.status_archive_key(F.col("name")).isNotNull()).groupBy("o_custkey").agg(F.max_by("name", tx.status_archive_key(F.col("name"))).alias("name"))


@register("resolve_version", """WITH v AS (SELECT p_size AS spec, (p_partkey % 19) || '.' || (p_partkey % 7) || '.0' AS version, p_partkey % 19 AS a, p_partkey % 7 AS b, p_partkey % 5 <> 0 AS zip FROM part)
SELECT spec, max_by(version, (a, b)) AS version, CASE max(a) WHEN 0 THEN 'draft' WHEN 1 THEN 'pre-release' WHEN 2 THEN 'pre-release' WHEN 3 THEN 'pre-release' ELSE 'Rel-' || max(a) END AS release FROM v WHERE zip GROUP BY spec""")
def resolve_version(spark, sf_dir):
    """The newest version of each specification that can be downloaded, and the release that it belongs to."""
    k = F.col("p_partkey")
    v = table(spark, sf_dir, "part").select(F.col("p_size").alias("spec"), F.concat_ws(".", (k % 19).cast("string"), (k % 7).cast("string"), F.lit("0")).alias("version"), F.when(k % 5 != 0, "http://x/a.ZIP?q=1").otherwise("").alias("url"))
    v = v.where(F.lower(F.substring_index(F.substring_index(F.trim("url"), "?", 1), "#", 1)).endswith(".zip"))
    best = v.groupBy("spec").agg(F.max_by("version", tx.version_key(F.col("version"))).alias("version"))
    return best.select("spec", "version", tx.release_of_version(F.col("version")).alias("release"))


@register("parse_selection", "SELECT d.doc_id, left(coalesce(text, ''), 1000) AS body, length(coalesce(text, '')) > 1000 AS truncated FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def parse_selection(spark, sf_dir):
    """What has no detail yet, with its text cut to the limit."""
    todo = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    body, more = tx.preview(F.coalesce("text", F.lit("")), 1000)
    return todo.select("doc_id", body.alias("body"), more.alias("truncated"))


#: A key's last seven digits, as a document number has seven.
_SEVEN = "right('000000' || o_orderkey, 7)"


@register("candidate_groups", f"SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'R5-' WHEN 1 THEN 'RP-' WHEN 2 THEN 'S2-' END AS prefix, CASE WHEN o_orderkey % 4 < 3 THEN CAST({_SEVEN} AS BIGINT) END AS number, CASE WHEN o_orderkey % 4 < 3 THEN CAST(left({_SEVEN}, 2) AS INT) END AS year FROM orders")
def candidate_groups(spark, sf_dir):
    """The group and number that a document number names; nothing for other labels."""
    k = F.col("o_orderkey")
    label = F.concat(F.element_at(F.array(*map(F.lit, ("R5-", "RP-", "S2-", "xx-x"))), (k % 4 + 1).cast("int")), F.right(F.concat(F.lit("000000"), k.cast("string")), F.lit(7)))
    o = table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))
    prefix, number = tx.id_parts(F.col("label"))
    known = F.col("label").rlike(f"(?i)^{tx.ID}$")
    return o.select("o_orderkey", F.when(known, prefix).alias("prefix"), F.when(known, number).alias("number"), tx.id_year(F.col("label")).alias("year"))


_LIST = {"status": "o_orderstatus", "priority": "o_orderpriority", "clerk": "o_clerk", "date": "o_orderdate", "comment": "o_comment", "total": "o_totalprice"}


@register("list_filter_map", "SELECT o_orderkey FROM orders WHERE o_orderstatus ILIKE 'o%' AND NOT (CAST(o_totalprice AS VARCHAR) ILIKE '1%') AND CAST(o_orderdate AS DATE) >= DATE '1996-01-01' AND CAST(o_custkey AS VARCHAR) IS NOT NULL ORDER BY o_orderkey DESC LIMIT 100 OFFSET 5")
def list_filter_map(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("string"))
    asked = {"status": "o%", "total": "!1%", "date": ">= '1996-01-01'", "key": "not-null", "customer": "", "none": None}
    known = {"status": "o_orderstatus", "total": "o_totalprice", "date": "o_orderdate", "key": "o_custkey", "customer": "o_custkey", "none": "o_custkey"}
    return tb.page(o.withColumn("o_custkey", F.col("o_custkey").cast("string")).where(fl.fold(asked, known, dates=("date",))), [F.desc("o_orderkey")], 5, fl.limited(100, 500)).select("o_orderkey")


@register("filter_upper_rich", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'BU%' AND NOT (c_mktsegment ILIKE '%X')")
def filter_upper_rich(spark, sf_dir):
    c = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").where(fl.upper_rich(c, "bu%") & fl.upper_rich(c, "!%x") & fl.upper_rich(c, "Not-Null")).select("c_custkey")


@register("filter_two_lists", "SELECT doc_id FROM documents WHERE NOT (upper(coalesce(lang, '')) LIKE 'D%' OR upper(coalesce(source, '')) LIKE 'D%') AND NOT (coalesce(lang, '') = '' AND coalesce(source, '') = '')")
def filter_two_lists(spark, sf_dir):
    both = [F.col("lang"), F.col("source")]
    return table(spark, sf_dir, "documents").where(fl.any_list(both, "!d%") & fl.any_list(both, "not-null")).select("doc_id")


@register("filter_normalized_like", "SELECT p_partkey FROM part WHERE ((p_size + 10) || '_' || (300 + p_partkey % 10)) ILIKE '3%_305'")
def filter_normalized_like(spark, sf_dir):
    """LIKE on what is indexed, where the dot of a number is an underscore (here also a wildcard)."""
    spec = F.concat((F.col("p_size") + 10).cast("string"), F.lit("."), (300 + F.col("p_partkey") % 10).cast("string"))
    return table(spark, sf_dir, "part").where(fl.rich(tx.normalize_ids(spec), "3%_305")).select("p_partkey")


@register("filter_exact_or_rich", "SELECT 'exact' AS mode, count(*) AS n FROM documents WHERE lang = 'e%' UNION ALL SELECT 'rich', count(*) FROM documents WHERE lang ILIKE 'e%'")
def filter_exact_or_rich(spark, sf_dir):
    """Semantic mode compares filters exactly, text mode as patterns."""
    d = table(spark, sf_dir, "documents")
    count = lambda mode, where: d.where(where).agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "n")
    return count("exact", F.col("lang") == "e%").unionByName(count("rich", fl.rich(F.col("lang"), "e%")))


@register("filter_parsed_then_limit", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 10 OFFSET 3")
def filter_parsed_then_limit(spark, sf_dir):
    parsed = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return tb.page(parsed, ["doc_id"], 3, 10)


@register("filter_contains", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '#00000001')")
def filter_contains(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(fl.contains(F.col("c_name"), "#00000001")).select("c_custkey")


@register("filter_date_algebra", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1994-01-01' AND CAST(o_orderdate AS DATE) < DATE '1995-01-01' AND CAST(o_orderdate AS DATE) <> DATE '1994-06-01' OR CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1997-03-01'")
def filter_date_algebra(spark, sf_dir):
    days = fl.DateSet.parse([">= 1994-01-01", "< '1995-01-01'", "!= 1994-06-01"]) | fl.DateSet.last_year(dt.date(1997, 3, 1))
    return table(spark, sf_dir, "orders").where(days.predicate(F.col("o_orderdate"))).select("o_orderkey")


@register("show_record", """SELECT n_nationkey, n_name, r_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers, coalesce((SELECT string_agg(s_suppkey, ',' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS suppliers,
(SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers FROM nation LEFT JOIN region ON r_regionkey = n_regionkey""")
def show_record(spark, sf_dir):
    """A record with its children nested."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey", "left")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    r = rc.with_children(n, "n_nationkey", suppliers=(s, ["s_suppkey", "s_name"]), customers=(c, ["c_custkey"]))
    return r.select("n_nationkey", "n_name", "r_name", F.size("suppliers").cast("bigint").alias("n_suppliers"), F.array_join(F.transform("suppliers", lambda x: x["s_suppkey"].cast("string")), ",").alias("suppliers"), F.size("customers").cast("bigint").alias("n_customers"))


@register("schema_listing", "SELECT table_name, CAST(ordinal_position - 1 AS INT) AS position, column_name FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'labels') ")
def schema_listing(spark, sf_dir):
    return rc.schema_listing(spark, **{t: table(spark, sf_dir, t) for t in ("nation", "region", "labels")}).drop("type")


@register("json_rows", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation""")
def json_rows(spark, sf_dir):
    return rc.as_json(rc.show_fields(table(spark, sf_dir, "nation"), "n_nationkey, n_name"))


@register("table_rows", "SELECT r_regionkey || chr(9) || r_name AS value FROM region UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
def table_rows(spark, sf_dir):
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return rc.as_lines(r).unionByName(rc.as_lines(r, "markdown"))


@register("csv_round_trip", "SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer")
def csv_round_trip(spark, sf_dir):
    """The four exported columns as CSV text, and read from it again."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema.fields)
    return c.select(F.to_csv(F.struct(*c.columns)).alias("line")).select(F.from_csv("line", kinds).alias("r")).select("r.*")


@register("join_by_name", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name ILIKE '%1%'")
def join_by_name(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where(fl.rich(F.col("n_name"), "%1%"))
    return table(spark, sf_dir, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi").select("c_custkey")


@register("anti_five_keys", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 3 = 0")
def anti_five_keys(spark, sf_dir):
    """Rows without a twin on five keys."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    li = table(spark, sf_dir, "lineitem").select(*keys)
    return li.join(li.where("l_linenumber % 3 <> 0"), keys, "left_anti").select("l_orderkey", "l_linenumber")


@register("containment_like", "SELECT p_partkey, w AS pattern FROM part JOIN (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS w FROM part) ON ',' || replace(p_type, ' ', ',') || ',' ILIKE '%,' || w || ',%'")
def containment_like(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("list", F.replace("p_type", F.lit(" "), F.lit(",")))
    return tb.like_members(p, "p_partkey", "list", p.select(F.lower(F.substring_index("p_type", " ", 1)).alias("pattern")), "pattern")


@register("ranked_parents_join", "WITH p AS (SELECT o_custkey, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey) - 1 AS parent_rank FROM orders GROUP BY 1 ORDER BY 2 LIMIT 10) SELECT CAST(parent_rank AS INT) AS parent_rank, o_orderkey FROM orders JOIN p USING (o_custkey)")
def ranked_parents_join(spark, sf_dir):
    from ..operators.vector import ranked

    o = table(spark, sf_dir, "orders")
    top = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).orderBy(F.desc("s"), "o_custkey").limit(10)
    return o.join(F.broadcast(ranked(top, [F.desc("s"), "o_custkey"], "parent_rank").select("o_custkey", "parent_rank")), "o_custkey").select("parent_rank", "o_orderkey")


@register("concat_key_semi_anti", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey || '@' || l_linenumber = o_orderkey || '@2') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey || '@' || l_linenumber = o_orderkey || '@6')")
def concat_key_semi_anti(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.concat_ws("@", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", *[F.concat(F.col("o_orderkey").cast("string"), F.lit(f"@{n}")).alias(f"k{n}") for n in (2, 6)])
    return o.join(li.withColumnRenamed("key", "k2"), "k2", "left_semi").join(li.withColumnRenamed("key", "k6"), "k6", "left_anti").select("o_orderkey")


@register("list_join", "SELECT o_orderkey, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag), '') AS flags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def list_join(spark, sf_dir):
    flags = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(flags, "o_orderkey", "left").select("o_orderkey", F.coalesce("flags", F.lit("")).alias("flags"))


@register("max_of_counts", "SELECT max(n) AS most FROM (SELECT o_custkey, count(*) + (SELECT count(*) FROM customer WHERE c_custkey = o_custkey) AS n FROM orders GROUP BY o_custkey)")
def max_of_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_custkey").alias("o_custkey")).agg(F.count("*").alias("m"))
    return o.join(c, "o_custkey", "left").agg(F.max(F.col("n") + F.coalesce("m", F.lit(0))).alias("most"))


@register("gap_bridged_runs", """WITH m AS (SELECT l_orderkey, l_linenumber AS a, CASE WHEN l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 3 THEN 0 ELSE 1 END AS n FROM lineitem WHERE l_returnflag = 'R' OR l_quantity > 40),
r AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT l_orderkey, min(a) AS a, max(a) AS z FROM r GROUP BY l_orderkey, g""")
def gap_bridged_runs(spark, sf_dir):
    """Runs of marked lines that at most two plain ones part."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' or l_quantity > 40")
    li = li.select("l_orderkey", F.col("l_linenumber").alias("a"), F.col("l_linenumber").alias("z"))
    # a line without a number is a run of its own
    return tb.islands(li.where("a is not null"), ["l_orderkey"], "a", "z", gap=2).unionByName(li.where("a is null"))


@register("message_order", "SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 50")
def message_order(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc_nulls_last("ts"), "event_id").limit(50).select("event_id")


@register("fixed_order", "SELECT doc_id, CAST(CASE lang WHEN 'fr' THEN 0 WHEN 'en' THEN 1 ELSE 2 END AS INT) AS place FROM documents ORDER BY place, doc_id LIMIT 50")
def fixed_order(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rc.place_in(F.col("lang"), ["fr", "en"]).alias("place")).orderBy("place", "doc_id").limit(50)


@register("section_order", "SELECT p_partkey, p_size || '.' || (p_partkey % 30) AS section FROM part ORDER BY p_size, p_partkey % 30, p_partkey LIMIT 100")
def section_order(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 30).cast("string")).alias("section"))
    return p.orderBy(tx.section_key(F.col("section")), "p_partkey").limit(100)


@register("main_first_order", "SELECT c_custkey FROM customer ORDER BY c_custkey <> 17, lower(c_name), c_name LIMIT 30")
def main_first_order(spark, sf_dir):
    main = F.lit(None).cast("string")
    c = table(spark, sf_dir, "customer").withColumn("main", F.when(F.col("c_custkey") == 17, F.col("c_name")).otherwise(main))
    return c.orderBy(*rc.main_first(F.col("c_name"), F.col("main"))).limit(30).select("c_custkey")


def _k():
    return F.col("o_orderkey")


@register("codes", """SELECT o_orderkey, 'Rel-' || (o_orderkey % 20) AS release, ['R', 'C', 'S'][CAST(o_orderkey % 3 + 1 AS INT)] || (o_orderkey % 9) AS grp, ['5G', 'LTE', ''][CAST(o_orderkey % 3 + 1 AS INT)] AS tech, 'Mod_' || o_orderkey AS module, 'f_x' || o_orderkey AS fn FROM orders""")
def codes(spark, sf_dir):
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (_k() % 3 + 1).cast("int"))
    n = _k().cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", tx.cover_release(F.concat(pick("Rel", "Release ", "rel"), (_k() % 20).cast("string"))).alias("release"), tx.group_code(F.concat(pick("RAN WG", "ct  ", "sa wg "), (_k() % 9).cast("string"))).alias("grp"),
        tx.technology(pick("38.523-1", "36.523", "1.2")).alias("tech"), tx.module_name(F.concat(F.lit("a\\b/Mod_"), n, F.lit(".ttcn"))).alias("module"), tx.function_name(F.concat(F.lit("see f_x"), n, F.lit(" (NR)"))).alias("fn"),
    )


@register("mail_dates", "SELECT event_id, date_trunc('second', ts) AS local, date_trunc('second', ts) - to_minutes(CAST((event_id % 3 - 1) * 90 AS BIGINT)) AS utc, CAST((event_id % 3 - 1) * 5400 AS INT) AS offset_seconds FROM events")
def mail_dates(spark, sf_dir):
    zone = F.element_at(F.array(F.lit(" -0130"), F.lit(" +00:00"), F.lit(" +0130")), (F.col("event_id") % 3 + 1).cast("int"))
    said = F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), zone)
    d = table(spark, sf_dir, "events").select("event_id", tx.mail_date(said).alias("d"))
    return d.select("event_id", "d.local", "d.utc", "d.offset_seconds")


@register("month_window", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) * 12 + month(o_orderdate) BETWEEN 1995 * 12 + 2 AND 1995 * 12 + 7")
def month_window(spark, sf_dir):
    bucket = tx.week_bucket(F.col("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").where(tx.period_near(bucket, dt.date(1995, 3, 10), dt.date(1995, 6, 1))).select("o_orderkey")


@register("json_lists", """SELECT o_custkey, '["' || string_agg(DISTINCT o_orderstatus, '","' ORDER BY o_orderstatus) || '"]' AS encoded, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1""")
def json_lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_set("o_orderstatus"))).alias("encoded"))
    return o.select("o_custkey", "encoded", F.size(F.from_json("encoded", "array<string>")).cast("bigint").alias("n"))


@register("durations", "SELECT o_orderkey, CASE WHEN o_orderkey < 60 THEN o_orderkey || 's' WHEN o_orderkey < 3600 THEN (o_orderkey // 60) || 'm' WHEN o_orderkey < 86400 THEN (o_orderkey // 3600) || 'h' || CASE WHEN o_orderkey % 3600 >= 60 THEN ' ' || (o_orderkey % 3600 // 60) || 'm' ELSE '' END ELSE (o_orderkey // 86400) || 'd' || CASE WHEN o_orderkey % 86400 >= 3600 THEN ' ' || (o_orderkey % 86400 // 3600) || 'h' ELSE '' END END AS text FROM orders")
def durations(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.duration_text(_k()).alias("text"))


@register("newest_fifty", "SELECT l_suppkey, CAST(least(count(*), 50) AS INT) AS n, CASE WHEN count(*) > 50 THEN (list(l_orderkey * 10 + l_linenumber ORDER BY l_orderkey, l_linenumber))[-50] ELSE min(l_orderkey * 10 + l_linenumber) END AS first FROM lineitem GROUP BY 1")
def newest_fifty(spark, sf_dir):
    """The last fifty of each log: each task passes on fifty of a log at most, and a log's list is made of those that are left."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    last = lines.withColumn("k", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("line")))).where("k <= 50")
    logs = last.groupBy("l_suppkey").agg(F.array_sort(F.collect_list("line")).alias("log"))
    return logs.select("l_suppkey", tx.newest(F.col("log")).alias("log")).select("l_suppkey", F.size("log").alias("n"), F.get("log", F.lit(0)).alias("first"))


@register("file_classes", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'revision' WHEN 2 THEN 'review' WHEN 3 THEN 'support' END AS kind FROM orders")
def file_classes(spark, sf_dir):
    number = F.concat(F.lit("R5-"), F.lpad(_k().cast("string"), 7, "0"))
    name = F.when(_k() % 5 == 0, F.concat(F.lit("Draft "), number, F.lit(".docx"))).when(_k() % 5 == 1, F.concat(number, F.lit("r1.zip"))).when(_k() % 5 == 2, F.concat(number, F.lit("_mcc160Comment.doc"))).when(_k() % 5 == 3, F.concat(number, F.lit(" notes.pptx"))).otherwise(F.concat(number, F.lit("9.zip")))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.file_class(name, F.lower(number), F.when(_k() % 5 >= 2, "Review").otherwise("inbox")).alias("kind"))


@register("sentence_split", "SELECT o_orderkey, CAST(2 + o_orderkey % 3 AS INT) AS n FROM orders")
def sentence_split(spark, sf_dir):
    said = F.concat(F.lit("One is 1.5 here.  Two! "), F.repeat(F.lit("And more? "), (_k() % 3).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(tx.sentences(said)).alias("n"))


@register("markdown_strip", "SELECT n_nationkey, 'Head ' || n_name || chr(10) || 'bold link code' AS text FROM nation")
def markdown_strip(spark, sf_dir):
    said = F.concat(F.lit("## Head "), F.col("n_name"), F.lit("\n> **bold** [link](http://x) `code`"))
    return table(spark, sf_dir, "nation").select("n_nationkey", tx.strip_markdown(said).alias("text"))
