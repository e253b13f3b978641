"""Queries on the segmented index: after updates, by upper bounds, and snippets from positions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import segments, snapshots
from ..session import shared_dir, table
from .registry import register
from .search_queries import _bm25, _toks
from .stored import revised, stored_index

_LATER = "(SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'from the newer ' || text ELSE text END AS text, lang FROM documents WHERE doc_id % 7 <> 3)"


def _updated(spark, sf_dir):
    """An index that was built from two thirds of the table, and then updated by rows that are new, changed and gone, and compacted."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    index = segments.SegmentedIndex(snapshots.Bundle(spark, f"{shared_dir(spark)}/index-updated-{uuid.uuid4().hex}"), "doc_id", ("text", "lang"))
    index.apply(revised(d.where("doc_id % 3 <> 0"), "text", "lang"))
    later = d.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("from the newer "), "text")).otherwise(F.col("text"))).where("doc_id % 7 <> 3")
    index.apply(revised(later.where("doc_id % 2 = 0"), "text", "lang"), d.where("doc_id % 7 = 3"))
    index.apply(revised(later, "text", "lang"))
    index.compact(2)
    return index


@register("index_incremental", _bm25(["newer", "der"], _LATER, columns={"text": 1.0, "lang": 3.0}))
def index_incremental(spark, sf_dir):
    """A search of the updated index gives what one of a new index of the same rows gives; both terms have to be in one row."""
    return _updated(spark, sf_dir).search("newer AND der", {"text": 1.0, "lang": 3.0})


@register("index_incremental_status", f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(len({_toks()}) + len({_toks('lang')})) AS BIGINT) AS n_tokens, (SELECT count(DISTINCT t) FROM (SELECT unnest({_toks()}) AS t FROM {_LATER} UNION ALL SELECT unnest({_toks('lang')}) FROM {_LATER})) AS n_terms FROM {_LATER}")
def index_incremental_status(spark, sf_dir):
    """Added-up statistics after updates and compaction."""
    return _updated(spark, sf_dir).status().select("n_rows", "n_tokens", "n_terms")


@register("text_topk_pruned", _bm25(["the", "from"]))
def text_topk_pruned(spark, sf_dir):
    """The rows of text_index_topk, from the blocks whose bound reaches the threshold."""
    return stored_index(spark, sf_dir).top_k("the AND from", {"text": 1.0})


def _either(a: str, b: str, k: int) -> str:
    return _bm25([a, b], k=k).replace(f"WHERE a0 > 0 AND a1 > 0", "WHERE (a0 > 0 OR a1 > 0)")


@register("text_topk_either", _either("der", "from", 10))
def text_topk_either(spark, sf_dir):
    return stored_index(spark, sf_dir).top_k("der OR from", {"text": 1.0}, limit=10)


_WINDOWS = f"""WITH h AS ({_bm25(["the", "from"])}), t AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w, {_toks()} AS x FROM documents WHERE doc_id IN (SELECT doc_id FROM h)),
m AS (SELECT doc_id, w, x, unnest(range(1, len(x) + 1)) AS i FROM t),
c AS (SELECT doc_id, w, x, i, list_filter(x[i:i + 7], lambda y: y IN ('the', 'from')) AS inside FROM m WHERE x[i] IN ('the', 'from')),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(list_distinct(inside)) DESC, len(inside) DESC, i) AS r FROM c)
SELECT doc_id, 'text' AS col, (CASE WHEN i > 1 THEN '…' ELSE '' END) || array_to_string(list_transform(range(i, least(i + 7, len(x)) + 1), lambda j: CASE WHEN x[j] IN ('the', 'from') THEN '<<' || w[j] || '>>' ELSE w[j] END), ' ') || (CASE WHEN i + 7 < len(x) THEN '…' ELSE '' END) AS snippet
FROM b WHERE r = 1"""


@register("text_snippet_columns", _WINDOWS)
def text_snippet_columns(spark, sf_dir):
    """Snippets of the best rows: windows from positions, texts of these rows only."""
    index, d = stored_index(spark, sf_dir), table(spark, sf_dir, "documents")
    return index.snippets(index.search("the AND from", {"text": 1.0}), d, "the AND from", ["text"])
