"""Stored contents of documents: which extractions are complete, and their texts by id or address.

`extracts` has one row per address: ftp_url, tdoc_id, doc_filename (its main file), extraction_version, skipped_sources (a JSON
list), document_count. `contents` holds the stored files of all families: family, ftp_url, doc_filename and what else is stored.
`covers` lists the addresses (ftp_url) that have a cover page. Family `cr` keeps annexes only, the others their main file, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of

#: The family whose main file isn't stored, and the version that completeness asks for.
ANNEXED, CURRENT = "cr", 2


def completeness(extracts: DataFrame, covers: DataFrame, contents: DataFrame, families: list[str]) -> DataFrame:
    """`extracts` with n_{family} and main_{family} of each family, n_stored and complete (never null).

    Files are counted per address and name before they meet the extracts, so that no join sees all files of one address.
    """
    each = contents.where(F.col("family").isin(*families)).groupBy("ftp_url", "doc_filename").agg(*[F.count_if(F.col("family") == f).alias(f"n_{f}") for f in families])
    main = extracts.where("doc_filename is not null").select("ftp_url", "doc_filename").distinct().withColumn("is_main", F.lit(True))
    marked = each.join(main, ["ftp_url", "doc_filename"], "left")
    per = marked.groupBy("ftp_url").agg(
        *[F.sum(f"n_{f}").alias(f"n_{f}") for f in families],
        *[F.coalesce(F.bool_or(F.col("is_main") & (F.col(f"n_{f}") > 0)), F.lit(False)).alias(f"main_{f}") for f in families],
    )
    covered = covers.select("ftp_url").distinct().withColumn("has_cover", F.lit(True))
    nil = {f"n_{f}": 0 for f in families} | {f"main_{f}": False for f in families} | {"has_cover": False}
    rows = extracts.join(per, "ftp_url", "left").join(covered, "ftp_url", "left").fillna(nil)
    count = F.col("document_count")

    def done(f: str):
        if f == ANNEXED:
            return F.col("has_cover") & (F.col(f"n_{f}") == count) & ~F.col(f"main_{f}")
        return (count > 0) & (F.col(f"n_{f}") == count) & F.col(f"main_{f}")

    whole = (F.col("extraction_version") == CURRENT) & (F.coalesce(F.col("skipped_sources"), F.lit("[]")) == "[]")
    stored = sum((F.col(f"n_{f}") for f in families[1:]), F.col(f"n_{families[0]}"))
    return rows.withColumns({"n_stored": stored, "complete": F.coalesce(whole & any_of([done(f) for f in families]), F.lit(False))})


def parse_state(tdocs: DataFrame, states: DataFrame) -> DataFrame:
    """tdoc_id, parsed, document_count of every row of `tdocs` (tdoc_id, ftp_url): what the extraction at its current address says; null without a complete one."""
    done = states.where("complete").groupBy("tdoc_id", "ftp_url").agg(F.max("n_stored").alias("document_count"))
    return tdocs.select("tdoc_id", "ftp_url").join(done, ["tdoc_id", "ftp_url"], "left").select("tdoc_id", F.col("document_count").isNotNull().alias("parsed"), "document_count")


def stored(requests: DataFrame, tdocs: DataFrame, states: DataFrame, contents: DataFrame, families: dict[str, str]) -> DataFrame:
    """What is stored for each request (request, tdoc_id or ftp_url, source_file or null), with the reason where nothing is given.

    `tdocs` has tdoc_id, ftp_url and type; `families` names the family of each eligible type. Columns: request, status, complete,
    doc_filename, is_main, and the other columns of `contents`. A request that is answered has one row a file (one without
    a file if there is none); any other has one row. Shown in order, the main file comes first, then the others by name. Status is the first that holds of `bad_request` (not exactly one
    of id and address), `unknown`, `ineligible`, `extraction_missing`, `incomplete` (another document's extraction, an unknown
    version, or not as many files as declared), `source_missing`; else `ok`.
    """
    by_id, by_url = F.col("tdoc_id").isNotNull(), F.col("ftp_url").isNotNull()
    asked = requests.select("request", "tdoc_id", "ftp_url", "source_file")
    parent = tdocs.select(F.col("tdoc_id").alias("id"), F.col("ftp_url").alias("url"), "type")
    first = asked.where(by_id & ~by_url).join(parent, F.col("tdoc_id") == F.col("id"), "left")
    second = asked.where(~by_id & by_url).join(parent, F.col("ftp_url") == F.col("url"), "left")
    # an address that several documents name stands for the one with the least id
    second = second.groupBy("request", "tdoc_id", "ftp_url", "source_file").agg(F.min(F.struct("id", "url", "type")).alias("p")).select("request", "tdoc_id", "ftp_url", "source_file", "p.*")
    wrong = asked.where(by_id == by_url).select("*", *[F.lit(None).cast(t).alias(c) for c, t in parent.dtypes])
    family = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])[F.col("type")]
    rows = first.unionByName(second).unionByName(wrong).withColumn("family", family)
    names = sorted(set(families.values()))
    held = states.select(
        F.col("ftp_url").alias("url"), F.col("tdoc_id").alias("of"), F.col("doc_filename").alias("main"), "extraction_version", "document_count", "complete",
        F.create_map(*[x for f in names for x in (F.lit(f), F.col(f"n_{f}"))]).alias("n"), F.lit(True).alias("known"),
    )
    rows = rows.join(held, "url", "left")
    n = F.col("n")[F.col("family")]
    counted = (F.col("of") == F.col("id")) & (F.col("extraction_version") == CURRENT) & (n == F.col("document_count"))
    status = (
        F.when(by_id == by_url, "bad_request").when(F.col("id").isNull(), "unknown").when(F.col("family").isNull(), "ineligible")
        .when(F.col("known").isNull(), "extraction_missing").when(~F.coalesce(counted, F.lit(False)), "incomplete")
    )
    rows = rows.withColumn("status", status).select("request", "status", "complete", "url", "family", "main", "source_file")
    files = contents.withColumnsRenamed({"ftp_url": "file_url", "family": "file_family"})
    held_by = (F.col("url") == F.col("file_url")) & (F.col("family") == F.col("file_family"))
    chosen = F.col("source_file").isNull() | (F.col("source_file") == F.col("doc_filename"))
    found = rows.join(files, F.col("status").isNull() & held_by & chosen, "left")
    missing = F.when(F.col("source_file").isNotNull() & F.col("doc_filename").isNull(), "source_missing")
    more = [c for c in contents.columns if c not in ("family", "ftp_url", "doc_filename")]
    found = found.withColumn("status", F.coalesce("status", missing, F.lit("ok")))
    complete = (F.col("status") == "ok") & F.coalesce(F.col("complete"), F.lit(False))
    return found.select("request", "status", complete.alias("complete"), "doc_filename", F.coalesce(F.col("doc_filename") == F.col("main"), F.lit(False)).alias("is_main"), *more)
