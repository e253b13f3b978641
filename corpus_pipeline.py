"""A corpus pipeline: language, near duplicates, repeated passages, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import langid, mixing, neardup, packing, suffix
from corvane.llm.common import checkpoint_dir, table
from corvane.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose language the model gives less than this probability is rejected.
LEAST_SCORE = 0.3

#: Stages hash, learn, and follow pointers; SQL can't express them.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(c) for c in COLUMNS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters and those of no language the model is fairly sure of."""
    docs = _columns(docs)
    model = langid.learn(docs, ~langid.held_out(F.col("doc_id")))
    found = langid.predict(docs, model)
    return _columns(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)))


def _row_key():
    """A number for a row's content; only repeats of the whole row share it. (Hashing skips nulls, so that they are hashed as flags.)"""
    return F.xxhash64(*COLUMNS, *(F.isnull(c) for c in COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the least doc_id. Different rows of one doc_id are documents of their own; rows without one pass."""
    docs = _columns(docs)
    nameless, docs = docs.where("doc_id is null"), docs.where("doc_id is not null").withColumn("key", _row_key())
    if docs.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z").isEmpty():
        kept = docs.join(neardup.groups(docs).where("is_kept").select("doc_id").distinct(), "doc_id", "left_semi")
    else:
        found = neardup.groups(docs, id_col="key").select(F.col("doc_id").alias("key"), "class_id")
        least = docs.select("key", "doc_id").join(found, "key").groupBy("class_id").agg(F.min(F.struct("doc_id", "key")).alias("x"))
        kept = docs.join(least.select("x.key"), "key", "left_semi")
    return _columns(kept).unionByName(nameless)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes and more that a document with a smaller doc_id has; documents of which nothing remains go.

    Of repeats of a whole row one stays; rows without a doc_id pass as they are.
    """
    docs = _columns(docs).withColumn("key", _row_key())
    rest = suffix.dedup(docs, keep_text=True, carry=("lang", "source", "key")).where((F.octet_length("kept") > 0) | (F.col("n_bytes") == 0))
    # a cut may fall inside a character; what is left of such a character goes too
    rest = rest.select("doc_id", F.coalesce("cut_text", F.col("kept").cast("string")).alias("text"), "lang", "source", "key")
    rest = rest.where("doc_id is not null").dropDuplicates(["key"]).unionByName(rest.where("doc_id is null"))
    return _columns(rest.withColumn("n_chars", F.length("text").cast("bigint")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often, and with those of its words, as its blocks were drawn; one row for each time a document is gone through."""
    return _columns(mixing.mixed_texts(_columns(docs)))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(_columns(docs), tokenizer_path())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
