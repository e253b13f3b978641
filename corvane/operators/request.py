"""One search over records: filters, text, vectors, or text and vectors fused, as one DataFrame.

A request is made of parts (facts, text, nearness, fusion), each a DataFrame; which of them there are follows from
what is asked. Filters on equality and ranges go before both limits. Patterns go before the text's limit, and on the vector
side after a window that widens until enough records pass, as the rows of a window decide the ranks that are fused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import all_of
from . import filters as fl
from . import vector
from .segments import SegmentedIndex
from .textsearch import IndexUnavailableError, mode_of

#: Text hits that are fused: so many times the limit, and no more than this.
FANOUT, MOST_HITS = 8, vector.MOST_ROWS


@dataclass(frozen=True)
class Sources:
    """What can be searched: facts (a row a record), an index of the records' texts, and vectors (several a record)."""

    key: str
    facts: DataFrame
    index: SegmentedIndex | None = None
    weights: dict[str, float] = field(default_factory=dict)
    vectors: DataFrame | None = None
    chunk: str = "chunk"
    embedding: str = "embedding"
    encode: Callable[[str], list[float]] | None = None


@dataclass(frozen=True)
class Request:
    text: str | None = None
    semantic: str | None = None
    equal: dict[str, object] = field(default_factory=dict)
    since: dict[str, str] = field(default_factory=dict)
    until: dict[str, str] = field(default_factory=dict)
    like: dict[str, str] = field(default_factory=dict)
    limit: int = 20
    text_weight: float = 0.5
    fanout: int = FANOUT

    @property
    def mode(self) -> str:
        return mode_of(self.text, self.semantic)

    def pushed(self) -> Column:
        """Filters that any side can apply before its limit."""
        conditions = [F.col(c) == F.lit(v) for c, v in self.equal.items()]
        conditions += [F.col(c) >= F.lit(v) for c, v in self.since.items()] + [F.col(c) <= F.lit(v) for c, v in self.until.items()]
        return all_of([F.lit(True), *conditions])

    def patterns(self) -> Column:
        return all_of([F.lit(True), *[fl.rich(F.col(c), v) for c, v in self.like.items()]])


#: Columns of every answer, before those of the facts.
ANSWER = "score double, mode string, rank_text int, rank_vector int, distance double, best_chunk bigint"


def _text(request: Request, sources: Sources, limit: int) -> DataFrame:
    """key, score, rank of the best records by text among those that pass all filters."""
    if sources.index is None:
        raise IndexUnavailableError("text search is not available")
    some = bool(request.equal or request.since or request.until or request.like)
    passing = sources.facts.where(request.pushed() & request.patterns()).select(sources.key) if some else None
    hits = sources.index.search(request.text.strip(), sources.weights, passing, limit)
    return vector.ranked(hits, ["score", sources.key])


def _near(request: Request, sources: Sources) -> DataFrame:
    """key, rank, distance, chunk of the records in the window that holds enough of those that pass."""
    if sources.vectors is None or sources.encode is None:
        raise IndexUnavailableError("semantic search is not available")
    facts = sources.facts.where(request.pushed()).select(sources.key, F.coalesce(request.patterns(), F.lit(False)).alias("pass_"))
    q = F.array(*[F.lit(float(x)) for x in sources.encode(request.semantic.strip())])
    scored = sources.vectors.withColumn("distance", F.round(vector.cosine_distance(F.col(sources.embedding), q), 5)).join(facts, sources.key)
    rows, _ = vector.widening(scored, sources.key, sources.chunk, request.limit, F.col("pass_"), request.fanout)
    return vector.grouped(rows, sources.key, sources.chunk)


def search(request: Request, sources: Sources) -> DataFrame:
    """The best records of a request, best first, with the columns of ANSWER and of the facts."""
    key, mode, limit = sources.key, request.mode, max(request.limit, 0)
    none = lambda kind: F.lit(None).cast(kind)
    if mode == "filter":
        rows = sources.facts.where(request.pushed() & request.patterns()).orderBy(key).limit(limit).select(key)
        found = rows.select(key, none("double").alias("score"), none("int").alias("rank_text"), none("int").alias("rank_vector"), none("double").alias("distance"), none("bigint").alias("best_chunk"))
        order = [F.col(key)]
    elif mode == "text":
        hits = _text(request, sources, limit)
        found = hits.select(key, "score", F.col("rank").alias("rank_text"), none("int").alias("rank_vector"), none("double").alias("distance"), none("bigint").alias("best_chunk"))
        order = [F.col("rank_text")]
    elif mode == "semantic":
        near = _near(request, sources).orderBy("rank").limit(limit)
        found = near.select(key, (-F.col("distance")).alias("score"), none("int").alias("rank_text"), F.col("rank").alias("rank_vector"), "distance", F.col(sources.chunk).cast("bigint").alias("best_chunk"))
        order = [F.col("rank_vector")]
    else:
        text = _text(request, sources, min(limit * request.fanout, MOST_HITS))
        near = _near(request, sources)
        fused = vector.fuse(text, near, key, request.text_weight).limit(limit)
        found = fused.join(text.select(key, F.col("rank").alias("rank_text")), key, "left")
        found = found.join(near.select(key, F.col("rank").alias("rank_vector"), "distance", F.col(sources.chunk).cast("bigint").alias("best_chunk")), key, "left")
        order = [F.desc("score"), F.col(key)]
    place = F.row_number().over(Window.orderBy(*order))  # of a limited result
    answer = found.withColumn("mode", F.lit(mode)).withColumn("place_", place)
    names = [c.split(" ")[0] for c in ANSWER.split(", ")]
    facts = sources.facts.select(key, *[c for c in sources.facts.columns if c not in (key, *names)])
    # the facts of a record that went in the meantime are null
    return answer.join(facts, key, "left").orderBy("place_").select(key, *names, *[c for c in facts.columns if c != key])
