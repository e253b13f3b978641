"""Messages of mailing lists: the texts that are searched, the list's filters, and the order and source of hits.

`messages` has url, list_id, subject, sender, date (local), sort_timestamp and subject_tdocs (delimited); `details`, of some
of them, has url, tdocs (delimited), attachments (array of name and url) and content. Defined results: absent texts are empty;
of rows that repeat a url the best hit counts; hits without a timestamp come after all others of their score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut
from . import filters as fl
from . import textsearch

#: The texts that are searched, and the order in which one of them is named as a hit's source.
COLUMNS = ("list_id", "subject", "sender", "date", "week", "tdocs", "attachments", "content")
PRIORITY = ("subject", "content", "attachments", "tdocs", "sender", "list_id", "date", "week")
#: Fixed value: the filters that a request may have.
FILTERS = ("list_id", "sender", "subject", "tdocs", "dates")
#: Most hits of a page.
MOST = 500


def with_details(messages: DataFrame, details: DataFrame) -> DataFrame:
    """Messages with the columns of their details, which may be absent. The details' lists are `detail_tdocs` and `attachments`."""
    found = details.select("url", F.col("tdocs").alias("detail_tdocs"), "attachments", "content", F.lit(True).alias("has_detail"))
    return messages.select("url", "list_id", "subject", "sender", "date", "sort_timestamp", "subject_tdocs").join(found, "url", "left")


def effective_tdocs(has_detail: Column, subject: Column, detail: Column, addresses: Column) -> Column:
    """The numbers of the subject; with a detail also its own and those that attachments' addresses name. First seen first."""
    lists = lambda c: tx.upper_list(F.coalesce(c, F.lit("")))
    more = F.concat(lists(detail), tx.ids_in(F.array_join(addresses, " ")))
    return F.array_distinct(F.concat(lists(subject), F.when(F.coalesce(has_detail, F.lit(False)), more).otherwise(F.array().cast("array<string>"))))


def indexable(rows: DataFrame) -> DataFrame:
    """url, sort_timestamp and the eight texts, without addresses, of `with_details`' rows; other columns stay."""
    plain = lambda c: F.coalesce(tx.strip_urls(c), F.lit(""))
    attached = F.coalesce(F.col("attachments"), F.expr("array()").cast("array<struct<name:string,url:string>>"))
    names = F.filter(F.transform(attached, lambda a: plain(a["name"])), lambda n: n != "")
    addresses = F.filter(F.transform(attached, lambda a: a["url"]), lambda u: u.isNotNull())
    day = F.col("date").cast("date")
    return rows.withColumns(
        {
            "list_id": F.coalesce("list_id", F.lit("")),
            "subject": plain(F.col("subject")),
            "sender": plain(F.col("sender")),
            "date": F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("")),
            "week": F.coalesce(tx.week_bucket(day), F.lit("")),
            "tdocs": F.array_join(effective_tdocs(F.col("has_detail"), F.col("subject_tdocs"), F.col("detail_tdocs"), addresses), " "),
            "attachments": F.array_join(names, " "),
            "content": plain(F.col("content")),
        }
    )


def passing(asked: dict[str, object]) -> Column:
    """All filters of a request over `with_details`' columns: patterns for list (in upper case), sender, subject and both lists of numbers, a DateSet for dates."""
    unknown = sorted(set(asked) - set(FILTERS))
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(unknown)}")
    dates = asked.get("dates")
    return tx.all_of(
        [
            fl.upper_rich(F.col("list_id"), asked.get("list_id")),
            fl.rich(F.col("sender"), asked.get("sender")),
            fl.rich(F.col("subject"), asked.get("subject")),
            fl.any_list([F.col("subject_tdocs"), F.col("detail_tdocs")], asked.get("tdocs")),
            dates.predicate(F.col("date")) if dates is not None else F.lit(True),
        ]
    )


def search(messages: DataFrame, details: DataFrame, query: str, asked: dict[str, object] | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """url, score, rank (from 0), matched_source, snippet: hits by BM25 over the eight texts, then newest, then url.

    Statistics are those of all messages. Source and snippet are found for the page's rows alone.
    """
    fl.limited(limit, MOST)
    # filters see the stored values, the search sees what is indexed
    last = F.lit((1 << 63) - 1)
    place = F.struct(F.coalesce(-F.unix_micros(F.col("sort_timestamp").cast("timestamp")), last).alias("age"), "url")
    rows = indexable(with_details(messages, details).withColumn("passes", F.coalesce(passing(asked or {}), F.lit(False))))
    # texts without addresses are written once: scores, sources and snippets read them
    searched = cut(rows.select(place.alias("place"), "passes", *COLUMNS))
    hits = textsearch.search(searched, query, "place", dict.fromkeys(COLUMNS, 1.0), F.col("passes"), limit=None)
    once = hits.groupBy(F.col("place.url").alias("url")).agg(F.min(F.struct("score", "place")).alias("best"))
    page = once.orderBy("best.score", "best.place").offset(offset).limit(limit)
    ranked = page.agg(F.array_sort(F.collect_list("best")).alias("all")).select(F.posexplode("all").alias("rank", "best"))  # at most MOST rows
    shown = searched.join(F.broadcast(ranked), F.col("place") == F.col("best.place")).dropDuplicates(["rank"]).withColumn("url", F.col("place.url"))
    source = textsearch.matched_source(query, list(PRIORITY))
    pick = F.coalesce(*[F.when(F.col("matched_source") == c, F.col(c)) for c in PRIORITY])
    shown = shown.withColumn("matched_source", source)
    return shown.select("url", "best.score", "rank", "matched_source", textsearch.collapse_marks(textsearch.snippet(pick, query)).alias("snippet")).orderBy("rank")
