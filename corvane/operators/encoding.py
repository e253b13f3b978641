"""Vectors of texts: an encoder that is called in batches, refusals of what doesn't fit, and hashed vectors in sparse form."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An encoder takes texts and gives a vector for each.
Encode = Callable[[list[str]], list[list[float]]]


class EncoderUnavailable(RuntimeError):
    """The encoder can't be reached, or gives no vectors; another try may help."""


class IncompatibleVectors(ValueError):
    """Vectors of another model or length."""


def encode_rows(texts: Iterator[tuple[object, str]], encode: Encode, dims: int, batch: int = 32, tries: int = 3, wait: float = 0.1) -> Iterator[tuple[object, list[float]]]:
    """(key, vector) of each (key, text); the encoder is called with `batch` texts at a time, the last time with the rest."""
    held: list[tuple[object, str]] = []

    def vectors() -> list[tuple[object, list[float]]]:
        for left in range(tries - 1, -1, -1):
            try:
                found = encode([t for _, t in held])
                if len(found) != len(held):
                    raise EncoderUnavailable(f"{len(found)} vectors for {len(held)} texts")
                break
            except EncoderUnavailable:
                if not left:
                    raise
                time.sleep(wait * 2 ** (tries - 1 - left))
        if wrong := {len(v) for v in found} - {dims}:
            raise IncompatibleVectors(f"vectors of {wrong.pop()} numbers where {dims} are stored")
        return [(k, [float(x) for x in v]) for (k, _), v in zip(held, found, strict=True)]

    for item in texts:
        held.append(item)
        if len(held) == batch:
            yield from vectors()
            held.clear()
    if held:
        yield from vectors()


def encoded(rows: DataFrame, key: str, text: str, encoder: Callable[[], Encode], model: str, dims: int, batch: int = 32, tries: int = 3) -> DataFrame:
    """key, model, embedding. Each task makes its own encoder and fills batches across the edges of Arrow's; null and blank texts have no vector."""
    kind = dict(rows.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode: Encode | None = None
        types: list[pa.DataType] = []

        def items() -> Iterator[tuple[object, str]]:
            for b in batches:
                types.append(b.schema.types[0])
                for i in range(0, b.num_rows, 256):
                    part = b.slice(i, 256)
                    yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)

        def call(texts: list[str]) -> list[list[float]]:
            nonlocal encode
            encode = encode or encoder()
            return encode(texts)

        out: list[tuple[object, list[float]]] = []

        def done() -> pa.RecordBatch:
            keys, found = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, types[-1]), pa.array([model] * len(out)), pa.array(found, pa.list_(pa.float32()))], names=[key, "model", "embedding"])

        for pair in encode_rows(items(), call, dims, batch, tries):
            out.append(pair)
            if len(out) == 1024:
                yield done()
                out.clear()
        if out:
            yield done()

    wanted = rows.select(key, text).where(F.trim(F.coalesce(text, F.lit(""))) != "")
    return wanted.mapInArrow(work, f"{key} {kind}, model string, embedding array<float>")


def check_compatible(stored: DataFrame, model: str, dims: int) -> None:
    """IncompatibleVectors unless all stored vectors are of this model and length. One row is read."""
    seen = stored.agg(F.count_if(F.col("model") != F.lit(model)).alias("other"), F.count_if(F.size("embedding") != F.lit(dims)).alias("wrong")).first()
    if seen.other or seen.wrong:
        raise IncompatibleVectors(f"{seen.other} vectors of another model than {model}, {seen.wrong} not of {dims} numbers")


def _hash(token: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(F.md5(token), first, digits), 16, 10).cast("bigint")


def sparse_vectors(rows: DataFrame, key: str, tokens: Column, dims: int = 1 << 18) -> DataFrame:
    """key, dim, value: signed hashed counts of tokens with length 1, only those that aren't 0. A token counts up or down by its hash, so collisions cancel rather than pile up."""
    each = rows.select(key, F.explode(tokens).alias("token"))
    hashed = each.select(key, F.pmod(_hash(F.col("token"), 1, 8), F.lit(dims)).cast("int").alias("dim"), (1 - 2 * (_hash(F.col("token"), 9, 1) % 2)).alias("sign"))
    counted = hashed.groupBy(key, "dim").agg(F.sum("sign").cast("double").alias("n")).where("n <> 0")
    norm = counted.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counted.join(norm, key).select(key, "dim", (F.col("n") / F.col("norm")).alias("value"))


def sparse_nearest(vectors: DataFrame, query: DataFrame, key: str, k: int = 20, digits: int = 6) -> DataFrame:
    """key, score: the k greatest inner products with one query vector (dim, value), by equality on dims; ties to the smaller key."""
    q = query.select("dim", F.col("value").alias("q_"))
    return vectors.join(q, "dim").groupBy(key).agg(F.round(F.sum(F.col("value") * F.col("q_")), digits).alias("score")).orderBy(F.desc("score"), key).limit(k)
