"""Quality rules on repetition within a text, from a suffix array of its words.

The suffixes of all texts of a batch are sorted together, text by text, by prefix doubling over
word numbers. Intervals of the longest-common-prefix array are the substrings that occur more than
once and can't be extended to the right; those whose occurrences aren't all preceded by the same
word can't be extended to the left either. The words that these maximal repeats cover, and the
length of the longest, decide.

Odd input: a null text is an empty one, without words; it fails. Repeated rows and ids are judged one by
one, equal texts alike; a null doc_id stays null. A text is never cut; one text is one record.
Columns other than doc_id and text are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .runs import INNER, SPACE, buffers, codes, runs, totals

#: A maximal repeat counts from so many words on.
LEAST_WORDS = 8
#: The greatest share of a text's words that such repeats may cover, in percent.
MOST_COVERED = 45
#: The greatest length of one repeat, in words.
MOST_LENGTH = 60
#: The base rules: words at least, and percent of words in repeated windows of three.
BASE_WORDS, BASE_REPEAT, WINDOW = 50, 50, 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def suffix_array(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of (row, words from there to the row's end), and the ranks by the first 1, 2, 4, ... words.

    Two positions have one rank in a level only if that many words agree within the row. Ranks are
    places in the order, so that only positions which still share theirs are sorted again.
    """
    n = len(words)
    size = np.bincount(row) if n else np.empty(0, np.int64)
    end = np.repeat(np.cumsum(size), size)
    key = row * (int(words.max(initial=0)) + 1) + words
    order = np.argsort(key, kind="stable")
    levels, width = [], 1
    rank = np.empty(n, np.int64)
    k = key[order]
    start = np.r_[True, k[1:] != k[:-1]] if n else np.empty(0, bool)
    rank[order] = np.flatnonzero(start)[np.cumsum(start) - 1] + 1
    levels.append(rank)
    while True:
        size = np.diff(np.r_[np.flatnonzero(start), n])
        tied = np.flatnonzero(np.repeat(size > 1, size))  # places in the order
        if not len(tied):
            return order, levels
        p = order[tied]
        further = np.zeros(len(p), np.int64)
        has = p + width < end[p]
        further[has] = rank[p[has] + width]
        again = np.lexsort((further, rank[p]))
        p, further, group = p[again], further[again], rank[p[again]]
        order[tied] = p
        new = np.r_[True, (further[1:] != further[:-1]) | (group[1:] != group[:-1])]
        start = start.copy()
        start[tied] = new
        rank = rank.copy()
        rank[p] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]] + 1
        levels.append(rank)
        width *= 2


def common_prefixes(order: np.ndarray, row: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """For each place of the order after the first, how many words its suffix shares with the one before it, within their row."""
    a, b = order[:-1], order[1:]
    n = len(order)
    shared = np.zeros(len(a), np.int64)
    near = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b, length = a[near], b[near], np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank = levels[level]
        p, q = a + length, b + length
        fits = np.flatnonzero(np.maximum(p, q) < n)
        same = fits[rank[p[fits]] == rank[q[fits]]]
        length[same] += 1 << level
    shared[near] = length
    return shared


def maximal_repeats(order: np.ndarray, shared: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of at least `least` words: first and last place in the order, and length, of each interval.

    `before` names the word before each position; a position at the start of a row has a name of its own.
    """
    lefts: list[int] = []
    rights: list[int] = []
    lengths: list[int] = []
    high = np.flatnonzero(shared >= least)
    groups = np.split(high, np.flatnonzero(np.diff(high) > 1) + 1) if len(high) else []
    for places in groups:
        stack: list[tuple[int, int]] = []  # (first place, length), lengths rising
        for at, value in zip([*places.tolist(), int(places[-1]) + 1], [*shared[places].tolist(), 0], strict=True):
            left = at
            while stack and stack[-1][1] > value:
                left, length = stack.pop()
                lefts.append(left)
                rights.append(at)
                lengths.append(length)
            if value and (not stack or stack[-1][1] < value):
                stack.append((left, value))
    left, right, length = (np.array(x, np.int64) for x in (lefts, rights, lengths))
    name = before[order]
    changes = np.r_[0, np.cumsum(name[1:] != name[:-1])] if len(name) else np.zeros(1, np.int64)
    open_left = changes[right] > changes[left] if len(left) else np.empty(0, bool)
    return left[open_left], right[open_left], length[open_left]


def cover(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of n positions the spans cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("covered_words", pa.int64()), ("longest_repeat", pa.int64()), ("n_repeats", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
_DDL = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, covered_words bigint, longest_repeat bigint, n_repeats bigint, spans array<struct<start:bigint,end:bigint>>"


def measured(batch: pa.RecordBatch, least: int = LEAST_WORDS) -> pa.RecordBatch:
    """The counts and spans of each row's text. Spans are in words, ascending, apart from each other."""
    data, offsets = buffers(batch.column(1))
    n = len(offsets) - 1
    word = ~SPACE[data]
    row, values = runs(data, offsets, word)
    words, _ = codes(values)
    n_words = np.bincount(row, minlength=n)
    first = np.r_[0, np.cumsum(n_words)]
    # lines that hold a word, and how many differ
    line_row, lines = runs(data, offsets, data != 10)
    full = np.zeros(len(line_row), bool)
    if len(lines):
        bounds = np.frombuffer(lines.buffers()[1], np.int64)
        seen = np.r_[0, np.cumsum(word[data != 10], dtype=np.int64)]
        full = seen[bounds[1:]] > seen[bounds[:-1]]
    name, _ = codes(lines)
    distinct = np.unique(line_row[full] * (len(lines) + 1) + name[full]) // (len(lines) + 1)
    dup = np.bincount(line_row[full], minlength=n) - np.bincount(distinct, minlength=n)

    order, levels = suffix_array(words, row)
    shared = common_prefixes(order, row, levels)
    neighbour = np.maximum(np.r_[0, shared], np.r_[shared, 0]) if len(order) else np.empty(0, np.int64)
    again = order[neighbour >= WINDOW]
    repeated = cover(len(words), again, np.full(len(again), WINDOW))
    before = np.r_[-1, words[:-1]] if len(words) else words
    at_start = first[:-1][n_words > 0]
    before[at_start] = -1 - np.arange(len(at_start))
    left, right, length = maximal_repeats(order, shared, before, least)
    # the longest repeat that starts somewhere has the longer of the prefixes shared with both neighbours; if it isn't maximal, a maximal one covers it
    counts = neighbour >= least
    covered = cover(len(words), order[counts], neighbour[counts])
    longest, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(left):
        of = row[order[left]]
        np.maximum.at(longest, of, length)
        repeats = np.bincount(of, minlength=n)

    inner = np.r_[False, covered, False]
    bound = np.zeros(len(covered) + 1, bool)
    bound[first[1:-1]] = True
    span_start = np.flatnonzero(inner[1:-1] & (~inner[:-2] | bound[:-1]))
    span_end = np.flatnonzero(inner[1:-1] & (~inner[2:] | bound[1:])) + 1
    of = row[span_start]
    spans = pa.StructArray.from_arrays([pa.array(span_start - first[of]), pa.array(span_end - first[of])], ["start", "end"])
    per_row = np.r_[0, np.cumsum(np.bincount(of, minlength=n))].astype(np.int32)
    out = [
        batch.column(0).cast(pa.int64()), n_words, totals(word & ~INNER[data], offsets), totals(_SYMBOL[data], offsets), dup,
        np.bincount(row[repeated], minlength=n), np.bincount(row[covered], minlength=n), longest, repeats, pa.ListArray.from_arrays(pa.array(per_row), spans),
    ]
    return pa.RecordBatch.from_arrays([pa.array(x, kind.type) if isinstance(x, np.ndarray) else x for x, kind in zip(out, _OUT, strict=True)], schema=_OUT)


def repetition(documents: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """What `measured` says of each row of `documents` (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield measured(batch, least)

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(work, _DDL)


def judged(documents: DataFrame, least: int = LEAST_WORDS, most_covered: int = MOST_COVERED, most_length: int = MOST_LENGTH) -> DataFrame:
    """One row per row of `documents`: the counts, spans of repeats, and whether the base rules and both limits let it stay."""
    found = repetition(documents, least)
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))
    fine = (100 * F.col("covered_words") <= most_covered * F.col("n_words")) & (F.col("longest_repeat") <= most_length)
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def brute_force(text: str | None, least: int = LEAST_WORDS) -> dict[str, int]:
    """The same counts of one text by looking at every window; for tests."""
    raw = (text or "").encode()
    w = raw.split()

    def covered(k: int) -> set[int]:
        seen: dict[tuple[bytes, ...], list[int]] = {}
        for i in range(len(w) - k + 1):
            seen.setdefault(tuple(w[i : i + k]), []).append(i)
        return {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)}

    lines = [x for x in raw.split(b"\n") if x.split()]
    longest = 0
    while covered(longest + 1):
        longest += 1
    return {
        "n_words": len(w), "word_chars": sum(len(x.decode()) for x in w), "n_symbols": sum(x in b"#*$%&|<>" for x in raw), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered(WINDOW)), "covered_words": len(covered(least)), "longest_repeat": longest if longest >= least else 0,
    }
