"""How far the sources of each language are apart in their words, by sorted runs.

Each task that reads documents sorts its (lang, source, term, document) keys and scans the runs: a
document is one row, so its runs end there, and numbers of documents and of occurrences are all that
goes on. These partial counts are dealt by (lang, term) and sorted by (lang, term, source) within
each partition; a scan adds up the runs and keeps the terms of enough documents. A second scan over
the kept runs emits partial sums for pairs of sources, a task at a time, and terms with their values.

What a pair's sum takes from a term that only one source has depends on its count there alone. So it is
taken from the numbers of terms by count, and a run gives only the pairs of sources that both have the
term; terms that neither has give one value times their number.

Odd input: null lang, source and text are empty; each row is a document of its own, repeated rows and ids
too. A language without kept terms gives pairs of value 0 and no terms. Columns other than lang, source and text
are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices
from .runs import buffers, codes, runs

#: Documents of a language that must hold a term.
LEAST_DOCS = 10
#: Terms listed for a source.
TOP_TERMS = 10
#: Shares are whole numbers of this part.
SCALE = 1_000_000_000
#: A task adds up its partial counts when it holds so many, and passes them on when they remain more than half as many.
HELD = 400_000

_IN_TERM = np.arange(256) >= 0x80
_IN_TERM[0x41:0x5B] = _IN_TERM[0x61:0x7B] = True
_LOWER = np.arange(256).astype(np.uint8)
_LOWER[0x41:0x5B] += 0x20

_PART = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("count", pa.int64())])
_PART_DDL = "lang string, term string, source string, docs bigint, count bigint"
_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("count", pa.int64()), ("lang_count", pa.int64()), ("lead", pa.int64())])
_KEPT_DDL = "lang string, term string, source string, count bigint, lang_count bigint, lead bigint"
_PAIR = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("shared", pa.int64()), ("value", pa.int64())])
_PAIR_DDL = "lang string, a string, b string, shared bigint, value bigint"
_ROWS = 1 << 16


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def partial_counts(batch: pa.RecordBatch) -> pa.Table:
    """Numbers of documents and occurrences by (lang, term, source) in the rows of one batch (lang, source, text)."""
    lang, langs = codes(batch.column(0))
    source, sources = codes(batch.column(1))
    data, offsets = buffers(batch.column(2))
    data = _LOWER[data]
    row, values = runs(data, offsets, _IN_TERM[data])
    term, terms = codes(values)
    group = lang * max(1, len(sources)) + source
    key = group[row] * max(1, len(terms)) + term
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    doc = _starts(key, row)  # a document's occurrences of a term
    first = _starts(key[doc])  # all documents of a group with the term
    at = doc[first]
    k = key[at]
    g = k // max(1, len(terms))
    return pa.Table.from_arrays(
        [
            langs.take(pa.array(g // max(1, len(sources)))), terms.take(pa.array(k % max(1, len(terms)))).cast(pa.binary()).cast(pa.string()), sources.take(pa.array(g % max(1, len(sources)))),
            pa.array(np.diff(np.r_[first, len(doc)])), pa.array(np.diff(np.r_[at, len(key)])),
        ],
        schema=_PART,
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    n = 0
    for batch in (small for batch in batches for small in slices([batch])):
        held.append(partial_counts(batch))
        n += held[-1].num_rows
        if n >= HELD:
            held = [_added(held)]
            n = held[0].num_rows
            if n >= HELD // 2:
                yield from held[0].to_batches(_ROWS)
                held, n = [], 0
    if held:
        yield from _added(held).to_batches(_ROWS)


def _added(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(["lang", "term", "source"]).aggregate([("docs", "sum"), ("count", "sum")])
    return pa.Table.from_arrays([t[c] for c in ("lang", "term", "source", "docs_sum", "count_sum")], schema=_PART)


def _whole_runs(batches: Iterator[pa.RecordBatch], add: bool = False) -> Iterator[pa.Table]:
    """The rows of sorted batches in tables that hold all rows of each (lang, term) they have. With `add`, a run of many partial counts is added up by source as it is read."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        lang, term = t["lang"].combine_chunks(), t["term"].combine_chunks()
        end = (lang[-1], term[-1])
        mine = pc.and_(pc.equal(lang, end[0]), pc.equal(term, end[1]))
        from_ = pc.index(mine, True).as_py()
        if from_ == 0 and last == end:
            held.append(t)
            if add and sum(x.num_rows for x in held) > HELD:
                held = [_added(held).sort_by("source")]
            continue
        yield pa.concat_tables([*held, t.slice(0, from_)])
        held, last = [t.slice(from_)], end
    if held:
        yield pa.concat_tables(held)


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks()
    new = np.ones(len(c), bool)
    if len(c):
        new[1:] = pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return new


def _scan(least_docs: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_runs(batches, add=True):
            if not t.num_rows:
                continue
            new_term = _changes(t["lang"]) | _changes(t["term"])
            at = np.flatnonzero(new_term | _changes(t["source"]))
            docs, count = (np.add.reduceat(t[c].to_numpy(), at) for c in ("docs", "count"))
            lead = new_term[at]
            first = np.flatnonzero(lead)
            run = np.cumsum(lead) - 1
            kept = (np.add.reduceat(docs, first) >= least_docs)[run]
            total = np.add.reduceat(count, first)[run]
            rows = pa.array(at[kept])
            out = pa.Table.from_arrays([*(t[c].take(rows) for c in ("lang", "term", "source")), pa.array(count[kept]), pa.array(total[kept]), pa.array(lead[kept].astype(np.int64))], schema=_KEPT)
            yield from out.to_batches(_ROWS)

    return scan


def distance(p, q):
    """floor((p - q)^2 / (p + q)) of whole numbers."""
    d = p - q
    return d * d // (p + q)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of sources a < b in a language: how many terms both have here, and what these add to the sum beyond what each alone would."""
    held: list[pa.Table] = []
    n = 0
    for t in _whole_runs(batches):
        if not t.num_rows:
            continue
        run = np.cumsum(_changes(t["lang"]) | _changes(t["term"]))
        lang, langs = codes(t["lang"].combine_chunks())
        source, sources = codes(t["source"].combine_chunks())
        p, z = t["p"].to_numpy(), t["zero"].to_numpy()
        step = 1
        while True:
            a = np.flatnonzero(run[step:] == run[:-step])
            if not len(a):
                break
            b = a + step
            more = distance(p[a], p[b]) - distance(p[a], z[b]) - distance(z[a], p[b])
            key = (lang[a] * len(sources) + source[a]) * len(sources) + source[b]
            order = np.argsort(key, kind="stable")
            first = _starts(key[order])
            k = key[order][first]
            pair = k // len(sources)
            held.append(pa.Table.from_arrays([
                langs.take(pa.array(pair // len(sources))), sources.take(pa.array(pair % len(sources))), sources.take(pa.array(k % len(sources))),
                pa.array(np.diff(np.r_[first, len(key)])), pa.array(np.add.reduceat(more[order], first)),
            ], schema=_PAIR))
            n += len(k)
            step += 1
        if n >= HELD:
            held = [_added_pairs(held)]
            n = held[0].num_rows
            if n >= HELD // 2:
                yield from held[0].to_batches(_ROWS)
                held, n = [], 0
    if held:
        yield from _added_pairs(held).to_batches(_ROWS)


def _added_pairs(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by(["lang", "a", "b"]).aggregate([("shared", "sum"), ("value", "sum")])
    return pa.Table.from_arrays([t[c] for c in ("lang", "a", "b", "shared_sum", "value_sum")], schema=_PAIR)


def _distance(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def _share(count: str, n: str) -> str:
    """Exact also where the product is beyond a long; 0 where there are no kept terms."""
    return f"CASE WHEN terms > 0 THEN 1 + (CAST({count} + 2 AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(10, 0))) div CAST({n} + 2 * terms AS DECIMAL(20, 0)) ELSE 0 END"


def kept_counts(documents: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Occurrences of each kept term by (lang, term, source), zero counts left out; `lead` is 1 in one row of each (lang, term)."""
    named = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), "text")
    parts = named.mapInArrow(_count, _PART_DDL)
    return parts.repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(_scan(least_docs), _KEPT_DDL)


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): other sources by distance, and the terms in which a source exceeds its language most."""
    kept = cut(kept_counts(documents, least_docs))
    groups = documents.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("own"))
    langs = kept.groupBy("lang").agg(F.sum("lead").alias("terms"), F.sum("count").alias("lang_n"))
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = cut(groups.withColumn("zero", F.expr(_share("0", "n"))))

    rows = kept.join(groups, ["lang", "source"]).withColumn("p", F.expr(_share("count", "n")))
    above = rows.withColumn("q", F.expr(_share("lang_count", "lang_n"))).where("p > q")
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_distance("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    runs_ = rows.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    shared = runs_.mapInArrow(_pairs, _PAIR_DDL).groupBy("lang", "a", "b").agg(F.sum("shared").alias("shared"), F.sum("value").alias("more"))
    # terms of a, by their count there, against a source that lacks them
    by_count = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("b_zero"))
    alone = by_count.withColumnRenamed("source", "a").join(other, "lang").where("a <> b")
    alone = alone.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.expr(f"sum(times * ({_distance('p', 'b_zero')}))").alias("alone"))
    one = groups.select("lang", F.col("source").alias("a"), "terms", F.col("own").alias("a_own"), F.col("zero").alias("a_zero"))
    two = groups.select("lang", F.col("source").alias("b"), F.col("own").alias("b_own"), F.col("zero").alias("b_zero"))
    pairs = one.join(two, "lang").where("a < b").join(shared, ["lang", "a", "b"], "left").join(alone, ["lang", "a", "b"], "left").na.fill(0, ["shared", "more", "alone"])
    value = F.expr(f"CASE WHEN terms > 0 THEN alone + more + (terms - a_own - b_own + shared) * ({_distance('a_zero', 'b_zero')}) ELSE 0 END")
    pairs = pairs.select("lang", "a", "b", value.cast("bigint").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    both = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(ranked))
    return both.unionByName(terms)
