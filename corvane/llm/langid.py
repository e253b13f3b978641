"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the whole lower-cased text (anything but letters counts as one space), with
idf from all learning documents and L2-normed rows. The weights are fitted by follow-the-regularised-
leader with elastic-net penalties (which leaves most of them zero), on at most `PER_LANG` documents of
each language, chosen by a hash of doc_id among all; the sample also holds back a part on which one
temperature is fitted, so that scores are calibrated.

How it scales: document frequencies are one pass whose result is one number per feature; the fit works
on a sample bounded by PER_LANG x languages; prediction is a map. Only the weight table (features x
languages, at most 2^15 rows) is sent out.

Defined results: `und` with score 0 if the text is null or has no letters, or if there was nothing to
learn from; equal texts get equal results; rows with a null lang are predicted but not learned from;
repeated rows are separate rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

FEATURES, PER_LANG, EPOCHS = 1 << 15, 500, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-4
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2

_SIZES = (1, 2, 3)
_MUL = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


_LETTER = None


def _letters() -> np.ndarray:
    """For code points below 65536: the point itself if it is a letter, else a space."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([c if chr(c).isalpha() else 32 for c in range(1 << 16)], np.uint32)
    return _LETTER


def term_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and how often each occurs, over the whole text; empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < (1 << 16)
    points = np.where(low, _letters()[np.where(low, points, 32)], points)
    if not low.all():
        high, at = np.unique(points[~low], return_inverse=True)
        points[~low] = np.array([c if chr(c).isalpha() else 32 for c in high.tolist()], np.uint32)[at]
    if not (points != 32).any():
        return np.empty(0, np.int64), np.empty(0)
    keep = np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]
    points = np.concatenate([np.array([32], np.uint32), points[keep], np.array([32], np.uint32)])
    parts = []
    with np.errstate(over="ignore"):
        for n in _SIZES:
            h = np.full(max(0, len(points) - n + 1), n, np.uint32)
            for i in range(n):
                h = (h ^ points[i : i + len(h)]) * _MUL[i]
                h ^= h >> np.uint32(15)
            parts.append(h & np.uint32(FEATURES - 1))
    total = np.bincount(np.concatenate(parts), minlength=FEATURES)
    at = np.flatnonzero(total != 0)
    return at, total[at].astype(float)


def _tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


class Model:
    """Languages, idf, weights (features x languages), bias and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = term_counts(text or "")
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        z = self.logits(at, _tfidf(at, n, self.idf)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """FTRL-proximal with elastic net on (features, counts, language); every tenth row is held back for the temperature."""
    langs = sorted({lang for *_, lang in rows})
    k = len(langs)
    number = {lang: i for i, lang in enumerate(langs)}
    data = [(at, _tfidf(at, n, idf), number[lang]) for at, n, lang in rows if len(at)]
    fitted, back = [d for i, d in enumerate(data) if i % 10], [d for i, d in enumerate(data) if not i % 10]
    z, g2 = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights_at(at):
        zz = z[at]
        return np.where(np.abs(zz) <= L1 * scale, 0.0, -(zz - np.sign(zz) * L1 * scale) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2 * scale))

    scale = max(1, len(fitted))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(fitted)):
            at, x, y = fitted[i]
            at, x = np.append(at, FEATURES), np.append(x, 1.0)
            w = weights_at(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA
            z[at] += g - sigma * w
            g2[at] += g * g
    w = weights_at(np.arange(FEATURES + 1))
    model = Model(langs, idf, w[:-1].astype(np.float32), w[-1])
    back = back or fitted
    if back and k > 1:
        s = np.array([model.logits(at, x) for at, x, _ in back])
        y = np.array([d[2] for d in back])

        def loss(t):
            v = s / t
            v = v - v.max(1, keepdims=True)
            return float((np.log(np.exp(v).sum(1)) - v[np.arange(len(y)), y]).mean())

        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        model.temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    return model


def learn(documents: DataFrame, may_learn: Column, per_lang: int = PER_LANG) -> Model:
    """A model from the rows with a non-null lang for which `may_learn` (a Column on doc_id) holds; uses doc_id only to choose the sample."""
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES + 1, np.int64), 0
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                df[term_counts(text)[0]] += 1
                df[FEATURES] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["feature", "df"])

    df = np.zeros(FEATURES + 1)
    for r in docs.select("text").mapInArrow(frequencies, "feature int, df bigint").groupBy("feature").agg(F.sum("df").alias("df")).toArrow().to_batches():
        df[r.column("feature").to_numpy()] = r.column("df").to_numpy()
    idf = np.log((1 + df[FEATURES]) / (1 + df[:FEATURES])) + 1

    # the least hashes of each language; a threshold from its count leaves about four times as many as are taken, so that no task sees a whole language
    counts = docs.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("ids"))
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    near = docs.select("doc_id", "lang").join(F.broadcast(counts), "lang").where(place < 4.0 * per_lang / F.col("ids")).select("doc_id", "lang").distinct()
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_lang).select("doc_id").distinct()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = [term_counts(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([a.astype(np.int32) for a, _ in both], pa.list_(pa.int32())), pa.array([n for _, n in both], pa.list_(pa.float64()))],
                ["doc_id", "lang", "at", "n"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    sample = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "lang", "text")
    got = sample.mapInArrow(features, f"doc_id {kind}, lang string, at array<int>, n array<double>").dropDuplicates(["doc_id", "lang"]).toArrow()
    # slices of the columns' own buffers: lists of Python numbers would take ten times the memory
    got = got.combine_chunks()
    ids, langs = got.column("doc_id").to_pylist(), got.column("lang").to_pylist()
    if not ids:
        return fit([], idf)
    parts = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (got.column("at"), got.column("n"))]
    bounds = parts[0].offsets.to_numpy()
    at, n = (x.values.to_numpy() for x in parts)
    order = sorted(range(len(ids)), key=lambda i: (langs[i], ids[i]))
    return fit([(at[bounds[i] : bounds[i + 1]].astype(np.int64), n[bounds[i] : bounds[i + 1]], langs[i]) for i in order], idf)


def predict(documents: DataFrame, model: Model, text_col: str = "text", **names: str) -> DataFrame:
    """`documents` with two more columns: the language and its calibrated probability (named `lang_pred` and `score` unless given)."""
    pred, score = names.get("pred", "lang_pred"), names.get("score", "score")
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [shared.value.predict(text) for text in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], [*batch.schema.names, pred, score]
            )

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*documents.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])
    return documents.mapInArrow(run, schema)


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from those that aren't held out."""
    model = learn(documents, ~held_out(F.col("doc_id")))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
