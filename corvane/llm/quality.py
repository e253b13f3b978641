"""Quality scores from weak labels.

Heuristic labellers vote good, bad or not at all on each document. Their accuracies, which nobody
knows, are estimated by expectation-maximisation on how often each pattern of votes occurs in the
whole corpus; the posterior of a pattern is the label of its documents. A hashed linear scorer
(logistic regression on hashed words and on the buckets of the measured values) is then trained on
posterior labels and scores every document.

How it scales: one pass counts vote patterns over all documents (at most 3^labellers rows, whatever
the data), the scorer is trained on at most `SAMPLE` documents, chosen by a hash of doc_id among all,
and scoring is a map. Only the weights (2^16 numbers) are sent out.

Every value is measured over the whole text. The share of distinct words falls with a text's length, so
it is the mean over consecutive windows of `WINDOW` words.

Defined results: null text counts as empty; a text without words is judged by the same votes (its
score is low); equal texts get equal scores; repeated rows are separate rows; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import Shingler, mix

FEATURES, SAMPLE, EPOCHS, KEEP = 1 << 16, 6000, 6, 0.3
WINDOW = 400
ABSTAIN, BAD, GOOD = 0, 1, 2


def variety(h: np.ndarray, distinct: int) -> float:
    """Distinct share of the words; over `WINDOW` words the mean share of all consecutive windows of so many, the last one flush with the end."""
    n = len(h)
    if n <= WINDOW:
        return distinct / max(1, n)
    windows = h[: n - n % WINDOW].reshape(-1, WINDOW)
    if n % WINDOW:
        windows = np.vstack([windows, h[-WINDOW:]])
    ordered = np.sort(windows, axis=1)
    return float((1 + (ordered[:, 1:] != ordered[:, :-1]).sum(1)).mean() / WINDOW)


def measures(text: str, shingler: Shingler) -> tuple[np.ndarray, np.ndarray]:
    """Measured values of a text (see LABELLERS for their order) and its word hashes."""
    h, with_letter, b = shingler.scan(text)
    n = len(h)
    chars = max(1, len(text))
    upper, lower, digits = int(b[65:91].sum()), int(b[97:123].sum()), int(b[48:58].sum())
    ends = int(b[[33, 46, 63]].sum())
    marks = int(b[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum())
    spaces = int(b[[9, 10, 11, 12, 13, 32]].sum())
    symbols = int(b[:128].sum()) - upper - lower - digits - marks - spaces
    ordered = np.sort(h)
    runs = np.diff(np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])) if n else np.array([0])
    change = np.flatnonzero(np.r_[True, h[1:] != h[:-1], True]) if n else np.array([0, 0])
    lines = [x for x in text.split("\n") if x.strip()]
    repeated = sum(c for c in Counter(lines).values() if c > 1)
    return np.array(
        [
            n,
            (chars - spaces) / max(1, n),
            symbols / max(1, n),
            with_letter / n if n else 0.0,
            runs.max() / n if n else 1.0,
            np.diff(change).max() if n else 0,
            repeated / len(lines) if lines else 1.0,
            upper / max(1, upper + lower),
            ends / max(1, n),
            digits / chars,
            variety(h, len(runs)),
        ],
        float,
    ), h


#: For each measured value: name, bounds of good, bounds beyond which it is bad.
LABELLERS = (
    ("words", (20, np.inf), (5, np.inf)),
    ("word_length", (3.0, 9.0), (2.0, 14.0)),
    ("symbols_per_word", (0.0, 0.02), (0.0, 0.1)),
    ("words_with_letters", (0.9, 1.0), (0.8, 1.0)),
    ("top_word", (0.0, 0.12), (0.0, 0.3)),
    ("word_run", (0, 3), (0, 8)),
    ("repeated_lines", (0.0, 0.1), (0.0, 0.4)),
    ("capitals", (0.005, 0.15), (0.0, 0.4)),
    ("sentence_ends", (0.01, 0.3), (0.002, 0.7)),
    ("digits", (0.0, 0.05), (0.0, 0.2)),
    ("variety", (0.35, 1.0), (0.15, 1.0)),
)


def votes(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(LABELLERS), np.int64)
    for j, (_, good, fair) in enumerate(LABELLERS):
        out[j] = GOOD if good[0] <= values[j] <= good[1] else ABSTAIN if fair[0] <= values[j] <= fair[1] else BAD
    return out


_BASE = 3 ** np.arange(len(LABELLERS))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """EM for labellers that are independent given the class: share of good, P(vote | class) of each labeller, posterior of each pattern.

    Starts from the majority vote, which also fixes which class is the good one.
    """
    v = (patterns[:, None] // _BASE) % 3
    post = ((v == GOOD).sum(1) + 0.5) / ((v != ABSTAIN).sum(1) + 1.0)
    share, tables = 0.5, np.full((len(LABELLERS), 3, 2), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([counts * (1 - post), counts * post], 1)
        share = (weight[:, 1].sum() + 1) / (weight.sum() + 2)
        tables = np.stack([np.stack([weight[v[:, j] == k].sum(0) for k in range(3)]) for j in range(len(LABELLERS))]) + 0.1
        tables /= tables.sum(1, keepdims=True)
        log = np.log(np.array([1 - share, share]))[None, :] + sum(np.log(tables[j])[v[:, j]] for j in range(len(LABELLERS)))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return float(share), tables, post


def features(values: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: distinct words (together of norm 1) and the bucket of each measured value."""
    ordered = np.sort((hashes & np.uint64(FEATURES - 1)).astype(np.uint16))
    start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    words, counts = ordered[start].astype(np.int64), np.diff(np.r_[start, len(ordered)])
    x = np.log1p(counts)
    norm = np.sqrt((x * x).sum())
    bucket = np.floor(np.log2(np.maximum(values, 1e-6)) * 2).astype(np.int64)
    named = mix(((np.arange(len(values)) << 32) + bucket + 1000).astype(np.uint64)) & np.uint64(FEATURES - 1)
    return np.concatenate([words, named.astype(np.int64)]), np.concatenate([x / norm if norm else x, np.full(len(values), 0.7)])


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS, rate: float = 0.5, l2: float = 1e-6, seed: int = 5) -> np.ndarray:
    """Weights (and, last, the bias) of a logistic regression on soft labels, by adaptive gradient steps."""
    w, g2 = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x, -30, 30)))
            g = (p - y) * x + l2 * w[at]
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w


def score(w: np.ndarray, at: np.ndarray, x: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(w[at] @ x + w[FEATURES], -30, 30))))


def pattern_of(values: np.ndarray) -> int:
    return int((votes(values) * _BASE).sum())


def label_model(documents: DataFrame) -> tuple[dict[int, float], float, np.ndarray]:
    """Posterior of every vote pattern that occurs, share of good, P(vote | class); over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(1), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen[pattern_of(measures(text or "", shingler)[0])] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    rows = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "pattern bigint, n bigint")
    found = rows.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not found:
        return {}, 0.5, np.empty(0)
    patterns = np.array([r["pattern"] for r in found])
    share, tables, post = estimate(patterns, np.array([r["n"] for r in found], float))
    return dict(zip(patterns.tolist(), post.tolist(), strict=True)), share, tables


def scores(documents: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """doc_id, weak_label (posterior of its votes), quality (the scorer's), is_kept, for every document."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    posterior, share, _ = label_model(docs)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(1)
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                values, h = measures(text or "", shingler)
                out.append((*features(values, h), posterior.get(pattern_of(values), share)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([o[0].astype(np.int32) for o in out], pa.list_(pa.int32())), pa.array([o[1].astype(np.float32) for o in out], pa.list_(pa.float32())), pa.array([o[2] for o in out], pa.float64())],
                ["doc_id", "at", "x", "y"],
            )

    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    got = docs.join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(examples, "doc_id bigint, at array<int>, x array<float>, y double").dropDuplicates(["doc_id"]).toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    rows = []
    for i in order:
        rows.append((got.column("at")[i].values.to_numpy().astype(np.int64), got.column("x")[i].values.to_numpy().astype(float), got.column("y")[i].as_py()))
    w = docs.sparkSession.sparkContext.broadcast(fit(rows).astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(1)
        for batch in batches:
            weak, found = [], []
            for text in batch.column("text").to_pylist():
                values, h = measures(text or "", shingler)
                weak.append(posterior.get(pattern_of(values), share))
                found.append(round(score(w.value, *features(values, h)), 6))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(weak, pa.float64()), pa.array(found, pa.float64()), pa.array([s >= keep for s in found], pa.bool_())], ["doc_id", "weak_label", "quality", "is_kept"]
            )

    return docs.mapInArrow(run, "doc_id bigint, weak_label double, quality double, is_kept boolean")
