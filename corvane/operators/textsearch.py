"""Full-text search: query language, matching, weighted BM25, snippets and a positional index.

A query is parsed once into a tree on the driver. Matching and term frequencies are expressions on a
row's token arrays, so a search is a scan without a shuffle; corpus statistics are one partial
aggregate whose single row is joined back, and the top k is a TakeOrderedAndProject.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ID, SEPARATORS, all_of, any_of, fold_text, let, normalize_ids, tokens
from ..session import cut

K1, B = 1.2, 0.75
#: Words of which a query may not consist alone, and marks that make a text a query expression.
STOP_WORDS = frozenset("a and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
_MARKERS = (" AND ", " OR ", " NOT ", '"', "*", "NEAR")


class SearchError(ValueError):
    """A search that can't be answered; `exit_code` tells what kind of fault it is."""

    exit_code = 1


class QueryError(SearchError):
    """The query can't be read."""

    exit_code = 2


class IndexCorruptError(SearchError):
    """The index contradicts itself and has to be built anew."""

    exit_code = 3


class IndexUnavailableError(SearchError):
    """There is no index (yet)."""

    exit_code = 1


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]
    prefix: bool = False
    column: str | None = None
    first: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    name: str  # AND, OR, NOT
    left: object
    right: object


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([()+:^*,{}])|([^\s"()+:^*,{}]+))')


def _terms(text: str) -> tuple[str, ...]:
    return tuple(t for t in re.split(r"[^\w]|_", fold_text(text.lower())) if t)


def normalize_query(text: str) -> str:
    """The rule of `normalize_ids` for a query on the driver, token by token."""
    def number(m: re.Match) -> str:
        base = m[1][:2].upper() + m[1][2:].lower()
        return f"{base} {base}{m[2].lower()}"

    each = (re.sub(rf"({ID})((?:r\d+)?)", number, t, flags=re.I) for t in text.split())
    return " ".join(re.sub(r"(^|\D)(\d+)\.(\d+(?:-\d+)?)", r"\1\2_\3", t) for t in each)


def indexed(text: Column) -> Column:
    """What of a text is searched: document numbers also by their base. (An underscore parts tokens as a dot does, so only these change them.)"""
    return F.when(F.coalesce(text, F.lit("")).rlike(rf"(?i){ID}"), normalize_ids(text)).otherwise(F.coalesce(text, F.lit("")))


class _Parser:
    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise QueryError(f"unbalanced quote in {text!r}")
            at = m.end()
            self.items.append(("str", m[1].replace('""', '"')) if m[1] is not None else ("mark", m[2]) if m[2] else ("word", m[3]))
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.peek(-1)

    def binary(self, name: str, below):
        left = below()
        while self.peek() == ("word", name):
            self.take()
            left = Op(name, left, below())
        return left

    def query(self):
        return self.binary("OR", lambda: self.binary("AND", lambda: self.binary("NOT", self.run)))

    def run(self):
        """Neighbours without an operator are joined by AND."""
        left = self.item()
        while self.peek()[0] in ("str", "word") and self.peek()[1] not in ("AND", "OR", "NOT") or self.peek() == ("mark", "("):
            left = Op("AND", left, self.item())
        return left

    def item(self, column: str | None = None):
        kind, value = self.take()
        if (kind, value) == ("mark", "("):
            inner = self.query()
            if self.take() != ("mark", ")"):
                raise QueryError("unbalanced parenthesis")
            return inner
        first = (kind, value) == ("mark", "^")
        if first:
            kind, value = self.take()
        if kind not in ("word", "str") or kind == "word" and value in ("AND", "OR", "NOT"):
            raise QueryError(f"a term is missing before {value or 'the end'!r}")
        if kind == "word" and value == "NEAR" and self.peek() == ("mark", "("):
            return self.near(column)
        if kind == "word" and self.peek() == ("mark", ":"):
            self.take()
            return self.item(value)
        words = _terms(value)
        while self.peek() == ("mark", "+"):
            self.take()
            words += _terms(self.take()[1])
        prefix = self.peek() == ("mark", "*")
        if prefix:
            self.take()
        return Phrase(words, prefix, column, first)

    def near(self, column):
        self.take()
        phrases, distance = [], 10
        while self.peek()[0] in ("word", "str"):
            phrases.append(self.item(column))
        if self.peek() == ("mark", ","):
            self.take()
            distance = int(self.take()[1])
        if self.take() != ("mark", ")") or not phrases:
            raise QueryError("NEAR( ) isn't closed")
        return Near(tuple(phrases), distance)


def parse(text: str):
    """User text to a tree. Text without an operator mark is one phrase; in others, 'single quotes' are phrases as well."""
    text = text.strip()
    if not text:
        raise QueryError("the query is empty")
    words = re.findall(r"\w+", text.lower())
    if words and all(w in STOP_WORDS for w in words):
        raise QueryError("the query has only stop words")
    if not any(m in text for m in _MARKERS):
        terms = _terms(normalize_query(text))
        if not terms:
            raise QueryError("the query has no words")
        return Phrase(terms)
    p = _Parser(normalize_query(re.sub(r"'([^']*)'", r'"\1"', text)))
    tree = p.query()
    if p.peek()[0] != "end":
        raise QueryError(f"can't read {p.peek()[1]!r}")
    return tree


def _hit(token: Column, term: str, prefix: bool) -> Column:
    return token.startswith(term) if prefix else token == term


def positions(toks: Column, p: Phrase) -> Column:
    """Starts (from 1) of a phrase in a token array, or as an index tells them (`toks` is then a function of the phrase)."""
    if callable(toks) and not isinstance(toks, Column):
        return toks(p)
    n = len(p.terms)
    if n == 0:
        return F.array().cast("array<int>")

    def found(t: Column) -> Column:
        def rest(i: Column) -> Column:
            return all_of([F.coalesce(_hit(F.get(t, i - 1 + k), x, p.prefix and k == n - 1), F.lit(False)) for k, x in enumerate(p.terms) if k])

        here = F.filter(F.transform(t, lambda x, i: F.when(_hit(x, p.terms[0], p.prefix and n == 1), i + 1)), lambda i: i.isNotNull())
        here = F.filter(here, rest) if n > 1 else here
        return F.filter(here, lambda i: i == 1) if p.first else here

    return let(toks, found)


def _near_in(toks: Column, node: Near) -> Column:
    """Whether one column holds all phrases with at most `distance` tokens from the end of the first to the start of the last."""
    def holds(at: Column) -> Column:
        def from_(i: int) -> Column:
            reach = len(node.phrases[i].terms) + node.distance

            def near(s: Column) -> Column:
                return all_of([F.exists(F.get(at, F.lit(j)), lambda q: (q >= s) & (q <= s + reach)) for j in range(len(node.phrases)) if j != i])

            return F.exists(F.get(at, F.lit(i)), near)

        return any_of([from_(i) for i in range(len(node.phrases))])

    return let(F.array(*[positions(toks, p) for p in node.phrases]), holds)


def matches(node, columns: dict[str, Column]) -> Column:
    """The tree as a predicate on token arrays; AND may span columns, a phrase may not."""
    if isinstance(node, Op):
        left, right = matches(node.left, columns), matches(node.right, columns)
        return left & right if node.name == "AND" else left | right if node.name == "OR" else left & ~right
    if isinstance(node, Near):
        return any_of([_near_in(c, node) for name, c in columns.items() if node.phrases[0].column in (None, name)])
    return any_of([F.size(positions(c, node)) > 0 for name, c in columns.items() if node.column in (None, name)])


def gated(node, gates: tuple = ()) -> list[tuple[Phrase, tuple]]:
    """What is scored: all phrases but those under NOT, each with the alternatives of OR that must hold for it to count."""
    if isinstance(node, Op):
        if node.name == "OR":
            return gated(node.left, (*gates, node.left)) + gated(node.right, (*gates, node.right))
        return gated(node.left, gates) + (gated(node.right, gates) if node.name != "NOT" else [])
    return [(p, gates) for p in (node.phrases if isinstance(node, Near) else [node])]


def phrases(node) -> list[Phrase]:
    return [p for p, _ in gated(node)]


def search(
    rows: DataFrame, query: str, key: str, columns: dict[str, float], where: Column | None = None, limit: int = 20, digits: int = 6,
) -> DataFrame:
    """key, score, rank: the best `limit` rows by BM25 with a weight per column; lower is better.

    Statistics are those of the whole table, whatever `where` lets pass. Ties go to the smaller key.
    """
    tree = known_columns(parse(query), columns)
    with_tokens = rows.select("*", *[tokens(indexed(F.col(c))).alias(f"toks_{c}") for c in columns])
    toks = {c: F.col(f"toks_{c}") for c in columns}
    length = reduce(lambda a, b: a + b, [F.size(t) for t in toks.values()])
    counted = with_tokens.select(F.col(key), length.alias("len_"), (where if where is not None else F.lit(True)).alias("pass_"), *_counts(tree, toks, columns))
    # a few numbers a row: both readers take them from here, and texts are read once
    counted = cut(counted)
    stats = counted.agg(F.count("*").alias("n_"), F.avg("len_").alias("avg_"), *_frequencies(tree))
    return _best(counted.crossJoin(F.broadcast(stats)), tree, key, limit, digits)  # one row


def _counts(tree, toks: dict, columns: dict[str, float]) -> list[Column]:
    """match_, and for each scored phrase its weighted frequency f{i} and its plain one any{i}."""
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    out = [matches(tree, toks).alias("match_")]
    for i, (p, gates) in enumerate(gated(tree)):
        tf = {c: F.size(positions(toks[c], p)) if p.column in (None, c) else F.lit(0) for c in columns}
        weighted = add([tf[c] * F.lit(float(w)) for c, w in columns.items()])
        held = all_of([matches(g, toks) for g in gates if isinstance(g, Op)])
        out += [F.when(held, weighted).otherwise(0.0).alias(f"f{i}"), add(list(tf.values())).alias(f"any{i}")]
    return out


def _frequencies(tree) -> list[Column]:
    return [F.count_if(F.col(f"any{i}") > 0).alias(f"df{i}") for i in range(len(gated(tree)))]


def _best(counted: DataFrame, tree, key: str, limit: int | None, digits: int) -> DataFrame:
    def part(i: int) -> Column:
        n, df, f = F.col("n_"), F.col(f"df{i}"), F.col(f"f{i}")
        idf = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len_") / F.col("avg_")))

    parts = [F.coalesce(F.when(F.col(f"f{i}") > 0, part(i)), F.lit(0.0)) for i in range(len(gated(tree)))]
    top = counted.where("match_ and pass_").select(key, F.round(-reduce(lambda a, b: a + b, parts), digits).alias("score"))
    return top if limit is None else top.orderBy("score", key).limit(limit)


@dataclass(frozen=True)
class Index:
    """A positional index as two tables: postings (term, key, col, positions) and lengths (key, len_)."""

    postings: DataFrame
    lengths: DataFrame
    key: str
    columns: tuple[str, ...]

    @classmethod
    def build(cls, rows: DataFrame, key: str, columns: list[str]) -> Index:
        lengths = rows.select(key, reduce(lambda a, b: a + b, [F.size(tokens(indexed(F.col(c)))) for c in columns]).alias("len_"))
        return cls(postings(rows, key, columns), lengths, key, tuple(columns))

    def write(self, path: str) -> None:
        """Postings sorted by term, so that a query's filter on terms prunes row groups."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", self.key).write.mode("overwrite").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")

    @classmethod
    def read(cls, spark, path: str, key: str, columns: list[str]) -> Index:
        try:
            p, n = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
        except Exception as e:
            raise IndexUnavailableError(f"no index at {path}") from e
        if {"term", key, "col", "positions"} - set(p.columns) or {key, "len_"} - set(n.columns):
            raise IndexCorruptError(f"the index at {path} lacks columns")
        return cls(p, n, key, tuple(columns))

    def status(self) -> DataFrame:
        """One row: n_rows, n_terms, n_positions."""
        p = self.postings.agg(F.countDistinct("term").alias("n_terms"), F.coalesce(F.sum(F.size("positions")), F.lit(0)).alias("n_positions"))
        return self.lengths.agg(F.count("*").alias("n_rows")).crossJoin(F.broadcast(p))  # one row each

    def search(self, query: str, weights: dict[str, float], passing: DataFrame | None = None, limit: int | None = 20, digits: int = 6) -> DataFrame:
        """key, score: the same rows as `search` gives on the texts. Only the postings of the query's terms are read; `passing` lists keys that may be hits."""
        tree, key = known_columns(parse(query), weights), self.key
        asked = sorted({(t, p.prefix and k == len(p.terms) - 1) for p in _all_phrases(tree) for k, t in enumerate(p.terms)})
        name = {a: i for i, a in enumerate(asked)}
        here = any_of([_hit(F.col("term"), t, prefix) for t, prefix in asked])
        found = self.postings.where(here & F.col("col").isin(*weights)).groupBy(key).agg(
            *[
                F.array_sort(F.flatten(F.collect_list(F.when(_hit(F.col("term"), t, prefix) & (F.col("col") == c), F.col("positions"))))).alias(f"p{i}_{c}")
                for (t, prefix), i in name.items()
                for c in weights
            ]
        )

        def starts(c: str):
            def of(p: Phrase) -> Column:
                at = lambda k: F.col(f"p{name[(p.terms[k], p.prefix and k == len(p.terms) - 1)]}_{c}")
                if not p.terms:
                    return F.array().cast("array<int>")
                out = F.filter(at(0), lambda x: all_of([F.array_contains(at(k), x + k) for k in range(1, len(p.terms))])) if len(p.terms) > 1 else at(0)
                return F.filter(out, lambda x: x == 1) if p.first else out

            return of

        toks = {c: starts(c) for c in weights}
        counted = cut(found.select(key, *_counts(tree, toks, weights)))
        stats = self.lengths.agg(F.count("*").alias("n_"), F.avg("len_").alias("avg_")).crossJoin(F.broadcast(counted.agg(*_frequencies(tree))))  # one row each
        hits = counted.where("match_").join(self.lengths, key).withColumn("pass_", F.lit(True))
        if passing is not None:
            hits = hits.join(passing.select(key), key, "left_semi")
        return _best(hits.crossJoin(F.broadcast(stats)), tree, key, limit, digits)


def known_columns(tree, columns):
    """The tree; QueryError if it names a column that isn't searched."""
    for p in _all_phrases(tree):
        if p.column is not None and p.column not in columns:
            raise QueryError(f"there is no column {p.column}")
    return tree


def _all_phrases(node) -> list[Phrase]:
    """Every phrase of the tree, those under NOT included."""
    if isinstance(node, Op):
        return _all_phrases(node.left) + _all_phrases(node.right)
    return list(node.phrases) if isinstance(node, Near) else [node]


def parents(hits: DataFrame, parent: str, key: str, limit: int = 20) -> DataFrame:
    """parent, score (its best hit's), rank (from 0), hits (array of key and score, best first): the best `limit` parents of scored rows."""
    best = hits.groupBy(parent).agg(F.min("score").alias("score"), F.array_sort(F.collect_list(F.struct("score", key))).alias("hits"))
    top = best.orderBy("score", parent).limit(limit)
    return top.select(parent, "score", (F.row_number().over(Window.orderBy("score", parent)) - 1).alias("rank"), "hits")  # `limit` rows


def matched_source(query: str, columns: list[str]) -> Column:
    """The first of the columns (in order of priority) in which a phrase of the query is found; null if there is none."""
    wanted = phrases(parse(query))
    return F.coalesce(*[F.when(any_of([F.size(positions(tokens(indexed(F.col(c))), p)) > 0 for p in wanted if p.column in (None, c)]), F.lit(c)) for c in columns])


def search_text(*parts: Column) -> Column:
    """The text that is indexed for a record: its fields, absent ones left out, parted by blanks."""
    return F.concat_ws(" ", *parts)


def mode_of(text: str | None, semantic: str | None) -> str:
    """Which search is meant: hybrid, text, semantic or filter. Blank is absent."""
    t, s = bool((text or "").strip()), bool((semantic or "").strip())
    return "hybrid" if t and s else "text" if t else "semantic" if s else "filter"


def snippet(text: Column, query: str, width: int = 8, left: str = "<<", right: str = ">>", more: str = "…") -> Column:
    """The densest window of `width` words, hits marked; null without a hit."""
    terms = [(p.terms, p.prefix) for p in phrases(parse(query))]
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def is_hit(w: Column) -> Column:
        bare = F.regexp_replace(F.lower(w), SEPARATORS, "")
        return any_of([bare.startswith(t) if pre and k == len(ts) - 1 else bare == t for ts, pre in terms for k, t in enumerate(ts)])

    def show(w: Column) -> Column:
        def best_of(hits: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(hits) - width + 1))
            return F.array_max(F.transform(starts, lambda i: F.struct(F.aggregate(F.slice(hits, i, width), F.lit(0), lambda a, x: a + x).alias("n"), (-i).alias("i"))))

        def cutout(best: Column) -> Column:
            at = -best["i"]
            marked = F.transform(F.slice(w, at, width), lambda x: F.when(is_hit(x), F.concat(F.lit(left), x, F.lit(right))).otherwise(x))
            out = F.concat(F.when(at > 1, more).otherwise(""), F.array_join(marked, " "), F.when(at + width - 1 < F.size(w), more).otherwise(""))
            return F.when(best["n"] > 0, out)

        return let(let(F.transform(w, lambda x: is_hit(x).cast("int")), best_of), cutout)

    return let(words, show)


def postings(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The positional index: term, key, col, positions (from 1). Terms are combined per document before the shuffle."""
    per = [rows.select(F.col(key), F.lit(c).alias("col"), F.posexplode(tokens(indexed(F.col(c)))).alias("pos", "term")) for c in columns]
    return reduce(DataFrame.unionByName, per).groupBy("term", key, "col").agg(F.array_sort(F.collect_list(F.col("pos") + 1)).alias("positions"))


def term_statistics(rows: DataFrame, key: str, column: str) -> DataFrame:
    """term, df, cf, distinct terms per document counted before the shuffle."""
    each = rows.select(F.explode(F.transform(F.array_distinct(tokens(F.col(column))), lambda t: t)).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"))


def collapse_marks(text: Column, left: str = "<<", right: str = ">>") -> Column:
    """A term that was indexed twice in a row shows once in a snippet."""
    return F.regexp_replace(text, rf"({re.escape(left)}[^<>]+{re.escape(right)})(\s+\1)+", "$1")
