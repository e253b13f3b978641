"""A positional text index in segments that are never changed, updated by adding segments.

An update reads what it must index, writes one segment of postings, rows and statistics, and tombstones for
the keys that it replaces or removes; all of it appears as one version of a bundle (snapshots.py). Readers take
rows that no later tombstone names. Numbers of rows and of rows per term are added up over segments, an update
subtracts those of the rows it replaces, so they're exact without reading postings. Compaction puts segments of
like size together and leaves out dead rows.

Postings are stored in blocks of one term, greatest impact first, with the greatest frequency and least length of each
block, in folders by a hash of the term. A search reads the folders of its terms. `top_k` takes its threshold from the
first blocks, and then leaves out all blocks that can't reach it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, let, tokens
from ..session import cut
from .snapshots import Bundle, Stored
from .textsearch import B, K1, Index, IndexUnavailableError, Op, Phrase, _all_phrases, _hit, collapse_marks, indexed, known_columns, parse, phrases

#: Postings in a block, folders of terms, segments of a size before they're merged, and the nominal length for the order by impact.
BLOCK, BUCKETS, FANOUT, NOMINAL = 128, 16, 4, 200.0
#: Scores closer than this may round to one.
_EDGE = 2e-6


def _entries(n_columns: int):
    """(key, seq, toks) to one row per (term, key): frequencies and positions by column."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                yield entries_of(whole.slice(start, 512), n_columns)

    return work


def entries_of(batch: pa.RecordBatch, n_columns: int) -> pa.RecordBatch:
    by_column = batch.column("toks").flatten()  # row after row, each with one list a column
    size = np.diff(np.asarray(by_column.offsets))
    words = by_column.flatten().dictionary_encode()
    term = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cell = np.repeat(np.arange(len(size)), size)
    row, column = cell // n_columns, cell % n_columns
    position = np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size) + 1
    order = np.lexsort((position, column, term, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (term[order][1:] != term[order][:-1])
    at = np.flatnonzero(new)
    entry = np.cumsum(new) - 1
    tf = np.bincount(entry * n_columns + column[order], minlength=len(at) * n_columns)
    length = size.reshape(-1, n_columns).sum(axis=1)[row[order][at]]
    total = np.add.reduceat(tf, np.arange(0, len(tf), n_columns)) if len(at) else tf
    impact = (32 * total / (total + K1 * (1 - B + B * length / NOMINAL))).astype(np.int32)
    lists = lambda values, each: pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, each), pa.int32()), values)
    positions = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tf)], pa.int32()), pa.array(position[order], pa.int32()))
    rows = pa.array(row[order][at])
    return pa.RecordBatch.from_arrays(
        [
            words.dictionary.take(pa.array(term[order][at])), batch.column("key").take(rows), batch.column("seq").take(rows), pa.array(length, pa.int32()),
            lists(pa.array(tf, pa.int32()), n_columns), lists(positions, n_columns), pa.array(impact),
        ],
        names=["term", "key", "seq", "len", "tfs", "positions", "impact"],
    )


def _blocked(size: int):
    """Sorted entries (bucket, term, key, seq, len, tfs, positions) to blocks of at most `size`."""
    return lambda batches: (blocks_of(batch, size) for batch in batches if batch.num_rows)


def blocks_of(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    n = batch.num_rows
    term = batch.column("term").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    new = np.r_[True, term[1:] != term[:-1]]
    run = np.flatnonzero(new)[np.cumsum(new) - 1]
    starts = np.flatnonzero((np.arange(n) - run) % size == 0)
    offsets = pa.array(np.r_[starts, n], pa.int32())
    tfs = batch.column("tfs").flatten().to_numpy().reshape(n, -1)
    top = np.maximum.reduceat(tfs, starts, axis=0)
    first = pa.array(starts)
    listed = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("key", "seq", "len", "tfs", "positions")]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("bucket").take(first), batch.column("term").take(first), pa.array(np.diff(np.r_[starts, n]), pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, top.shape[1]), pa.int32()), pa.array(top.ravel(), pa.int32())),
            pa.array(np.minimum.reduceat(batch.column("len").to_numpy(), starts), pa.int32()), *listed,
        ],
        names=["bucket", "term", "n", "top_tfs", "min_len", "keys", "seqs", "lens", "all_tfs", "all_positions"],
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


@dataclass(frozen=True)
class SegmentedIndex:
    """The index of rows (key, revision, text columns) in a folder. A row is searched alone: AND never takes words from two rows."""

    bundle: Bundle
    key: str
    columns: tuple[str, ...]
    version: int | None = None
    block: int = BLOCK

    def at(self, version: int) -> SegmentedIndex:
        """The index as it was at a version."""
        return replace(self, version=version)

    # ---- what is there

    def _tables(self, kind: str) -> list[DataFrame]:
        found = {n: f for n, f in self.bundle.folders(self.version).items() if n.startswith(f"{kind}-")}
        return [self.bundle.open(f) for _, f in sorted(found.items())]

    def _some(self, kind: str) -> DataFrame:
        tables = self._tables(kind)
        if not tables:
            raise IndexUnavailableError(f"no index at {self.bundle.path}")
        return _union(tables)

    def _dead(self) -> DataFrame:
        """key, dead_seq: rows of the key in segments before that number are gone."""
        return self._some("dead").groupBy("key").agg(F.max("seq").alias("dead_seq"))

    def _alive(self, rows: DataFrame) -> DataFrame:
        dead = self._dead().withColumnRenamed("key", "dead_key")
        return rows.join(dead, (F.col("key") == F.col("dead_key")) & (F.col("seq") < F.col("dead_seq")), "left_anti")

    def rows(self) -> DataFrame:
        """Live rows: key, revision, seq, len_, toks (tokens by column)."""
        return self._alive(self._some("rows"))

    def revisions(self) -> DataFrame:
        """The indexed revision of each key."""
        return self.rows().select(F.col("key").alias(self.key), "revision")

    def totals(self) -> tuple[int, int]:
        """Live rows and their tokens, added up over the segments."""
        r = self._some("totals").agg(F.sum("n_rows").alias("n"), F.sum("n_tokens").alias("t")).first()
        return int(r.n or 0), int(r.t or 0)

    def document_frequencies(self, terms: list[str]) -> dict[str, int]:
        """How many live rows hold each of a query's terms."""
        s = self._some("stats").where(self._in_folders(terms) & F.col("term").isin(terms)).groupBy("term").agg(F.sum("df").alias("df"))
        return dict.fromkeys(terms, 0) | {r.term: int(r.df) for r in s.collect()}

    def status(self) -> DataFrame:
        """One row: version, segments, live rows, tokens, terms and tombstones."""
        n, t = self.totals()
        terms = self._some("stats").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0").agg(F.count("*").alias("n_terms"))
        dead = self._dead().agg(F.count("*").alias("n_tombstones"))
        lit = lambda v, name: F.lit(v).cast("bigint").alias(name)
        version = self.bundle.current() if self.version is None else self.version
        both = terms.withColumn("one", F.lit(1)).join(dead.withColumn("one", F.lit(1)), "one")
        return both.select(lit(version, "version"), lit(len(self._tables("rows")), "n_segments"), lit(n, "n_rows"), lit(t, "n_tokens"), "n_terms", "n_tombstones")

    # ---- updates

    @staticmethod
    def _bucket(term: Column) -> Column:
        return F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int")

    @staticmethod
    def _in_folders(terms: list[str]) -> Column:
        return F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms}))

    def _blocks(self, entries: DataFrame) -> DataFrame:
        key = next(f.dataType.simpleString() for f in entries.schema if f.name == "key")
        dealt = entries.withColumn("bucket", self._bucket(F.col("term"))).repartitionByRange("bucket", "term", F.desc("impact"), "key")
        ordered = dealt.sortWithinPartitions("bucket", "term", F.desc("impact"), "key").drop("impact")
        return ordered.mapInArrow(
            _blocked(self.block), f"bucket int, term string, n int, top_tfs array<int>, min_len int, keys array<{key}>, seqs array<bigint>, lens array<int>, all_tfs array<array<int>>, all_positions array<array<array<int>>>"
        )

    def _write(self, name: str, stored: Stored, removed_stats: DataFrame | None, totals: list[Column]) -> dict[str, Stored]:
        """The segment of a rows table: its blocks, statistics and totals."""
        rows = self.bundle.open(stored)
        key = next(f.dataType.simpleString() for f in rows.schema if f.name == "key")
        entries = rows.select("key", "seq", "toks").mapInArrow(_entries(len(self.columns)), f"term string, key {key}, seq bigint, len int, tfs array<int>, positions array<array<int>>, impact int")
        stats = rows.select(F.explode(F.array_distinct(F.flatten("toks"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        if removed_stats is not None:
            stats = stats.unionByName(removed_stats).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
        stats = stats.withColumn("bucket", self._bucket(F.col("term"))).repartition("bucket")
        return {
            f"postings-{name}": self.bundle.stage("postings", self._blocks(entries), ["bucket"]), f"rows-{name}": stored,
            f"stats-{name}": self.bundle.stage("stats", stats, ["bucket"]), f"totals-{name}": self.bundle.stage("totals", rows.agg(*totals)),
        }

    def apply(self, rows: DataFrame, removed: DataFrame | None = None) -> int:
        """Indexes the rows whose (key, revision) the index lacks, in place of the rows it has of these keys, and drops the keys of `removed`.

        `rows` has one row a key. The new version's number is returned; if nothing changed, the old one.
        """
        base = self.bundle.current()
        seq = base + 1
        fresh = rows.select(F.col(self.key).alias("key"), F.col("revision").cast("bigint").alias("revision"), *self.columns)
        old = self.rows() if base else None
        if old is not None:
            fresh = fresh.join(old.select("key", "revision"), ["key", "revision"], "left_anti")
        toks = F.array(*[tokens(indexed(F.col(c))) for c in self.columns])
        fresh = fresh.select("key", "revision", F.lit(seq).cast("bigint").alias("seq"), toks.alias("toks")).withColumn("len_", F.size(F.flatten("toks")))
        folder = self.bundle.stage("rows", fresh)
        new = self.bundle.open(folder)
        gone = new.select("key")
        if removed is not None:
            gone = gone.unionByName(removed.select(F.col(self.key).alias("key")))
        if old is None:
            gone, lost, minus = new.select("key").where("false"), None, (0, 0)
        else:
            lost = cut(old.join(gone.distinct(), "key", "left_semi"))
            gone = lost.select("key")
            r = lost.agg(F.count("*").alias("n"), F.coalesce(F.sum("len_"), F.lit(0)).alias("t")).first()
            minus = (r.n, r.t)
            if not minus[0] and new.isEmpty():
                return base
        less = None if lost is None else lost.select(F.explode(F.array_distinct(F.flatten("toks"))).alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
        totals = [F.count("*").alias("n_new"), (F.count("*") - minus[0]).alias("n_rows"), (F.coalesce(F.sum("len_"), F.lit(0)) - minus[1]).alias("n_tokens")]
        written = self._write(str(seq), folder, less, totals)
        written[f"dead-{seq}"] = self.bundle.stage("dead", gone.select("key", F.lit(seq).cast("bigint").alias("seq")))
        return self.bundle.publish(written, base)

    def compact(self, fanout: int = FANOUT) -> int:
        """Merges segments of one size class (powers of `fanout`) once there are `fanout` of them; dead rows and needless tombstones go."""
        base = self.bundle.current()
        folders = self.bundle.folders(base)
        read = self.bundle.open
        names = [n.removeprefix("rows-") for n in folders if n.startswith("rows-")]
        classes: dict[int, list[str]] = {}
        for n in names:  # one number a segment
            size = read(folders[f"totals-{n}"]).first().n_new
            classes.setdefault(int(math.log(max(1, size), fanout)), []).append(n)
        merged = [n for group in classes.values() if len(group) >= fanout for n in group]
        if not merged:
            return base
        rows = self._alive(_union([read(folders[f"rows-{n}"]) for n in merged]))
        folder = self.bundle.stage("rows", rows)
        name = f"{base + 1}"
        t = _union([read(folders[f"totals-{n}"]) for n in merged]).agg(F.sum("n_rows").alias("n"), F.sum("n_tokens").alias("t")).first()
        written = self._write(name, folder, None, [F.count("*").alias("n_new"), F.lit(t.n).cast("bigint").alias("n_rows"), F.lit(t.t).cast("bigint").alias("n_tokens")])
        # what the merged segments had added and subtracted, in all
        stats = _union([read(folders[f"stats-{n}"]) for n in merged]).groupBy("term", "bucket").agg(F.sum("df").alias("df")).where("df <> 0")
        written[f"stats-{name}"] = self.bundle.stage("stats", stats.repartition("bucket"), ["bucket"])
        others = [n for n in names if n not in merged]
        dead = self._dead().select("key", F.col("dead_seq").alias("seq"))
        if others:
            left = _union([read(folders[f"rows-{n}"]) for n in others]).select(F.col("key").alias("row_key"), F.col("seq").alias("row_seq"))
            dead = dead.join(left, (F.col("key") == F.col("row_key")) & (F.col("row_seq") < F.col("seq")), "left_semi")
        else:
            dead = dead.where("false")
        out: dict[str, Stored | None] = {f"{kind}-{n}": None for n in merged for kind in ("postings", "rows", "stats", "totals")}
        out |= {n: None for n in folders if n.startswith("dead-")}
        return self.bundle.publish(out | written | {f"dead-{name}": self.bundle.stage("dead", dead)}, base)

    # ---- searches

    def _asked(self, wanted: list[tuple[str, bool]]) -> DataFrame:
        """The blocks of the terms (prefixes where so said)."""
        blocks = self._some("postings")
        exact = [t for t, prefix in wanted if not prefix]
        if len(exact) == len(wanted):
            blocks = blocks.where(self._in_folders(exact))
        return blocks.where(any_of([_hit(F.col("term"), t, prefix) for t, prefix in wanted]))

    @staticmethod
    def _exploded(blocks: DataFrame, *more: str) -> DataFrame:
        zipped = F.arrays_zip(F.col("keys").alias("key"), F.col("seqs").alias("seq"), F.col("lens").alias("len"), F.col("all_tfs").alias("tfs"), *[F.col(c) for c in more])
        return blocks.select("term", F.inline(zipped))

    def search(self, query: str, weights: dict[str, float], passing: DataFrame | None = None, limit: int | None = 20, digits: int = 6) -> DataFrame:
        """key, score: what `textsearch.search` gives on the texts of the live rows."""
        if self.version is None:
            return self.at(self.bundle.current()).search(query, weights, passing, limit, digits)
        wanted = sorted({(t, p.prefix and k == len(p.terms) - 1) for p in _all_phrases(known_columns(parse(query), weights)) for k, t in enumerate(p.terms)})
        hits = self._alive(self._exploded(self._asked(wanted), "all_positions"))
        each = hits.select("term", "key", F.posexplode("all_positions").alias("i", "positions")).where(F.size("positions") > 0)
        names = F.array(*[F.lit(c) for c in self.columns])
        postings = each.select("term", F.col("key").alias(self.key), F.get(names, F.col("i")).alias("col"), "positions")
        lengths = self.rows().select(F.col("key").alias(self.key), "len_")
        return Index(postings, lengths, self.key, self.columns).search(query, weights, passing, limit, digits)

    def top_k(self, query: str, weights: dict[str, float], limit: int = 20, digits: int = 6, counters: dict | None = None) -> DataFrame:
        """The same rows as `search` for one term, or terms that AND or OR joins, from the blocks that can hold a hit.

        `counters`, if given, is told how many postings there are and how many were read to rank. Other queries go to `search`:
        the weight of a phrase needs all of its hits.
        """
        if self.version is None:
            return self.at(self.bundle.current()).top_k(query, weights, limit, digits, counters)
        found = _flat(parse(query))
        if found is None:
            return self.search(query, weights, None, limit, digits)
        every, terms = found
        n, t = self.totals()
        df = self.document_frequencies(terms)
        average = t / n if n else 1.0
        idf = {x: max(math.log((n - df[x] + 0.5) / (df[x] + 0.5)), 1e-6) for x in terms}
        blocks = self._asked([(x, False) for x in terms])
        weigh = lambda tfs: reduce(lambda a, b: a + b, [F.get(tfs, F.lit(i)) * F.lit(float(weights.get(c, 0.0))) for i, c in enumerate(self.columns)])
        by_term = lambda values: F.coalesce(*[F.when(F.col("term") == x, F.lit(float(v))) for x, v in values.items()])

        def part(f: Column, length: Column) -> Column:
            return by_term(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))

        bounded = blocks.withColumn("bound", F.coalesce(part(weigh(F.col("top_tfs")), F.col("min_len").cast("double")), F.lit(0.0)))
        # of each term: its greatest bound, and that of the block after as many as could hold the result
        first = -(-limit // BLOCK) + 1
        w = Window.partitionBy("term").orderBy(F.desc("bound"))
        heads = bounded.select("term", "bound", "n").withColumn("k", F.row_number().over(w)).where(F.col("k") <= first)
        heads = {r.term: (r.most, r.least) for r in heads.groupBy("term").agg(F.max("bound").alias("most"), F.min("bound").alias("least")).collect()}  # a row a term
        most = {x: heads.get(x, (0.0, 0.0))[0] for x in terms}

        # the terms whose postings name the candidates: with AND that of the greatest bound, else all that the rest can't do without
        by_bound = sorted(terms, key=lambda x: most[x])
        lead = [by_bound[-1]] if every else terms
        start = any_of([(F.col("term") == x) & (F.col("bound") >= heads.get(x, (0, 0.0))[1]) for x in lead])
        some = self._exploded(bounded.where(start))
        if every and len(terms) > 1:
            some = some.unionByName(self._of_keys(bounded.where(~start), some))
        low = self._ranked(self._alive(some), weigh, part, terms if every else None, limit, None).agg(F.count("*").alias("n"), F.max("score").alias("worst")).first()
        threshold = -low.worst - _EDGE if low.n == limit and low.worst is not None else 0.0
        if not every:
            spare, total = set(), 0.0
            for x in by_bound:
                total += most[x]
                if total >= threshold:
                    break
                spare.add(x)
            lead = [x for x in terms if x not in spare]
        rest = {x: sum(most.values()) - most[x] for x in terms}
        able = F.col("term").isin(lead) & (F.col("bound") + by_term(rest) >= threshold)
        read = self._exploded(bounded.where(able))
        if len(terms) > 1:
            read = read.unionByName(self._of_keys(bounded.where(~able), read))
        if counters is not None:
            counters["postings"] = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            counters["ranked"] = read.count()
            counters["blocks"], counters["blocks_above"] = blocks.where(F.col("term").isin(lead)).count(), bounded.where(able).count()
        return self._ranked(self._alive(read), weigh, part, terms if every else None, limit, digits).withColumnRenamed("key", self.key)

    def snippets(self, hits: DataFrame, texts: DataFrame, query: str, columns: list[str], width: int = 8, left: str = "<<", right: str = ">>", more: str = "…", collapse: bool = False) -> DataFrame:
        """key, col, snippet of a limited result: of each column the window of `width` words with the most of the query's terms, then the most hits, then the first.

        Windows are chosen on positions. `texts` is read for the result's keys only, by a filter that reaches the scan.
        With `collapse`, hits that repeat each other (a number and its base) show once.
        """
        wanted = sorted({(t, p.prefix and k == len(p.terms) - 1) for p in phrases(parse(query)) for k, t in enumerate(p.terms)})
        found = self._exploded(self._asked(wanted), "all_positions").join(hits.select(F.col(self.key).alias("key")), "key", "left_semi")
        which = F.coalesce(*[F.when(_hit(F.col("term"), t, prefix), F.lit(i)) for i, (t, prefix) in enumerate(wanted)])
        each = self._alive(found).select("key", which.alias("t"), F.posexplode("all_positions").alias("i", "positions")).where(F.get(F.array(*[F.lit(c in columns) for c in self.columns]), F.col("i")))
        marks = each.select("key", "i", F.explode("positions").alias("at"), "t").groupBy("key", "i").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("marks"))

        def value(m: Column) -> Column:
            return lambda s: let(F.filter(m, lambda x: (x["at"] >= s["at"]) & (x["at"] < s["at"] + width)), lambda inside: F.struct(F.size(F.array_distinct(F.transform(inside, lambda x: x["t"]))).alias("terms"), F.size(inside).alias("n"), (-s["at"]).alias("start")))  # noqa: E501

        best = marks.withColumn("start", -F.array_max(F.transform("marks", value(F.col("marks"))))["start"]).withColumn("hit", F.transform("marks", lambda x: x["at"]))
        keys = [r[0] for r in hits.select(self.key).collect()]  # as many as the result's limit
        read = texts.where(F.col(self.key).isin(keys)) if keys else texts.where("false")
        shown = F.array(*[F.regexp_extract_all(indexed(F.col(c)), F.lit(r"([\p{L}\p{N}\p{Co}\p{Mn}]+)"), F.lit(1)) for c in self.columns])
        both = best.join(read.select(F.col(self.key).alias("key"), shown.alias("words")), "key").withColumn("w", F.get("words", F.col("i")))
        part = F.transform(F.slice("w", F.col("start"), width), lambda x, k: F.when(F.array_contains("hit", F.col("start") + k), F.concat(F.lit(left), x, F.lit(right))).otherwise(x))
        text = F.concat(F.when(F.col("start") > 1, more).otherwise(""), F.array_join(part, " "), F.when(F.col("start") + width - 1 < F.size("w"), more).otherwise(""))
        return both.select(F.col("key").alias(self.key), F.get(F.array(*[F.lit(c) for c in self.columns]), F.col("i")).alias("col"), (collapse_marks(text, left, right) if collapse else text).alias("snippet"))

    def _of_keys(self, blocks: DataFrame, found: DataFrame) -> DataFrame:
        """The postings in `blocks` of keys that `found` has."""
        return self._exploded(blocks).join(found.select("key").distinct(), "key", "left_semi")

    @staticmethod
    def _ranked(entries: DataFrame, weigh, part, all_of_terms: list[str] | None, limit: int, digits: int | None) -> DataFrame:
        e = entries.withColumn("f", weigh(F.col("tfs")))
        e = e.withColumn("s", F.when(F.col("f") > 0, part(F.col("f"), F.col("len").cast("double"))).otherwise(0.0))
        g = e.groupBy("key").agg((-F.sum("s")).alias("score"), F.count("*").alias("terms"))
        if all_of_terms is not None:
            g = g.where(F.col("terms") == len(all_of_terms))
        g = g if digits is None else g.withColumn("score", F.round("score", digits))
        return g.select("key", "score").orderBy("score", "key").limit(limit)


def _flat(tree) -> tuple[bool, list[str]] | None:
    """(whether all must be there, the terms) of one term, or of terms that only AND or only OR joins; else None."""
    def leaves(node, name: str) -> list[str] | None:
        if isinstance(node, Phrase):
            return [node.terms[0]] if len(node.terms) == 1 and not (node.prefix or node.column or node.first) else None
        if not isinstance(node, Op) or node.name != name:
            return None
        a, b = leaves(node.left, name), leaves(node.right, name)
        return a + b if a is not None and b is not None else None

    for name in ("AND", "OR"):
        found = leaves(tree, name)
        if found and len(set(found)) == len(found):
            return name == "AND", found
    return None
