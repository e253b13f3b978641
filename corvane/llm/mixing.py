"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, document after document, are packed into blocks of `block_words`. The mix is a
row of output slots, each filled by one block; `shard_slots` consecutive slots make an output shard.
How many slots of a shard fall to each source is a multinomial draw by the targets: every slot draws a
number, which lies in one source's interval. Summed over all shards, a free draw misses the targets by
its standard deviation and could take a document more often than the limit allows, so the totals are
corrected: a source's slots are numbered by running sums of its counts over the shards; slots beyond
the number that the target asks for are freed, and sources that were drawn too seldom take the freed
slots, the g-th missing one the g-th freed one. A source's r-th slot is mapped through a pseudorandom
permutation of the source's block numbers, another one for each time the source is gone through;
blocks are then joined by (source, number).

The permutations are swap-or-not shuffles: for any domain size, computed row by row, so no slot or
block is ever ranked or sorted over a whole source. Intervals are joined by cells of numbers, not by
comparing each slot with each source. Positions of documents, and numbers of slots, are running sums in
two steps, within chunks and over chunks, so a source that holds a third of all rows isn't one task.
The only single-task steps order one row per source.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating; they share the sum of all sizes;
a source stops at `limit` times its size and the excess is shared anew by weight.

Defined results: null text has size 0, is kept, and takes nothing; a null source is one source; rows
with equal doc_id are separate documents if any other column used (source, text) differs, and the same
otherwise repeated row still is a row of its own; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import let

from .common import cut, parts_for

BLOCK_WORDS, SHARD_SLOTS, LIMIT, SEED, ROUNDS = 64, 4096, 3, 11, 24
WEIGHTS = (5, 2, 1)
CHUNK_DOCS = 10_000
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint")


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """The place of `i` in a pseudorandom permutation of 0..n-1 that `key` names (swap-or-not)."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) - x, n)
        return F.when((F.xxhash64(F.greatest(x, other), r, *key).bitwiseAND(F.lit(1))) == 1, other).otherwise(x)

    rounds = F.array(*[F.lit(r).cast("bigint") for r in range(ROUNDS)])
    return F.aggregate(rounds, i.cast("bigint"), step)


def targets(sizes: DataFrame, limit: int = LIMIT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source, source_size, weight, target, n_blocks, n_slots, from (source, source_size): one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    t = sizes.select("source", "source_size", w.alias("weight"))
    # who is full first, is who has the least limit per weight; the fill level goes up through them in that order
    filling = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        (F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * limit).over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weights_left"),
    )
    t = t.select("*", (F.col("left") / F.col("weights_left")).alias("level"), (F.col("source_size") * limit / F.col("weight")).alias("full_at"))
    # the level at the first source that doesn't fill up holds for it and all after it
    open_level = F.min(F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "level"))).over(every)["level"]
    t = t.select("source", "source_size", "weight", F.when(F.col("full_at") > F.col("level"), open_level * F.col("weight")).otherwise(F.col("source_size") * limit).cast("double").alias("target"))
    blocks = F.ceil(F.col("source_size") / block_words)
    t = t.select("*", blocks.cast("bigint").alias("n_blocks"))
    per_block = F.col("source_size") / F.col("n_blocks")
    return t.select("*", F.when(F.col("n_blocks") > 0, F.least(F.round(F.col("target") / per_block), F.col("n_blocks") * limit)).otherwise(0).cast("bigint").alias("n_slots"))


def placed(sized_docs: DataFrame) -> DataFrame:
    """`sized_docs` (source, size, chunk, part and further columns) with `at`, the words of the source before the document."""
    within = Window.partitionBy("source", "chunk").orderBy("doc_id", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized_docs.groupBy("source", "chunk").agg(F.sum("size").alias("s"))
    over = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("source_"), F.col("chunk").alias("chunk_"), F.coalesce(F.sum("s").over(over), F.lit(0)).alias("chunk_at"))
    local = sized_docs.withColumn("local_at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return (
        local.join(starts, F.col("source").eqNullSafe(F.col("source_")) & (F.col("chunk") == F.col("chunk_")))
        .withColumn("at", F.col("chunk_at") + F.col("local_at"))
        .drop("source_", "chunk_", "chunk_at", "local_at")
    )


def _starts(counts: DataFrame, *key: str) -> DataFrame:
    """`counts` (key, big, small, n: one row per key and small, big = small div a constant) with `before`, the sum of n over lesser `small` of the key."""
    over = Window.partitionBy(*key).orderBy("big").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy(*key, "big").agg(F.sum("n").alias("s")).select(*(F.col(k).alias(f"{k}_") for k in key), F.col("big").alias("big_"), F.coalesce(F.sum("s").over(over), F.lit(0)).alias("big_before"))
    within = Window.partitionBy(*key, "big").orderBy("small").rowsBetween(Window.unboundedPreceding, -1)
    local = counts.withColumn("small_before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    same = F.col("big") == F.col("big_")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    return local.join(sums, same).withColumn("before", F.col("big_before") + F.col("small_before")).drop("big_", "big_before", "small_before", *(f"{k}_" for k in key))


def draws(goal: DataFrame, all_slots: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, source_no, drawn: the multinomial counts of each shard, before any correction. `goal` has `source_no` and `base` too (see `numbered`)."""
    spark = goal.sparkSession
    step = 1 << 14
    shards = spark.range(0, parts_for(all_slots, shard_slots), 1, parts_for(all_slots, step, 8)).withColumnRenamed("id", "shard")
    last = F.least((F.col("shard") + 1) * shard_slots, F.lit(all_slots).cast("bigint")) - 1
    each = shards.select("shard", F.explode(F.sequence(F.col("shard") * shard_slots, last)).alias("slot"))
    # 53 random bits scaled to the number of slots
    number = F.floor(F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit("draw"), F.col("slot")), 11).cast("double") * (all_slots / 2.0**53)).cast("bigint")
    drawn = each.select("shard", F.least(number, F.lit(all_slots - 1)).alias("v")).withColumn("cell", F.floor(F.col("v") / step).cast("bigint"))
    own = goal.where("n_slots > 0").select("source_no", "base", (F.col("base") + F.col("n_slots")).alias("top"))
    own = own.select("*", F.explode(F.sequence(F.floor(F.col("base") / step).cast("bigint"), F.floor((F.col("top") - 1) / step).cast("bigint"))).alias("cell_"))
    # (the planner takes what a range explodes to for small and would broadcast it; a merge join leaves both sides where they are)
    hit = drawn.join(own.hint("merge"), (F.col("cell") == F.col("cell_")) & (F.col("base") <= F.col("v")) & (F.col("v") < F.col("top")))
    return hit.groupBy("shard", "source_no").agg(F.count("*").alias("drawn"))


def numbered(goal: DataFrame) -> DataFrame:
    """`goal` with `source_no` (from 0) and `base` (slots of the sources before it): one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return goal.select("*", (F.row_number().over(order) - 1).cast("bigint").alias("source_no"), (F.sum("n_slots").over(order) - F.col("n_slots")).alias("base"))


def shard_counts(goal: DataFrame, all_slots: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, source_no, first, n, seq: runs of slots after the correction; a source's numbers first..first+n-1 over all its runs are 0..n_slots-1, each once."""
    counts = cut(draws(goal, all_slots, shard_slots).select("source_no", "shard", (F.col("shard") / 1024).cast("bigint").alias("big"), F.col("shard").alias("small"), F.col("drawn").alias("n")))
    sums = cut(counts.groupBy("source_no").agg(F.sum("n").alias("drawn")))
    by_no = Window.orderBy("source_no")
    need = goal.select("source_no", "n_slots").join(sums, "source_no", "left").select("source_no", "n_slots", F.coalesce("drawn", F.lit(0)).alias("drawn"))
    need = cut(
        need.select(
            "*",
            (F.sum(F.greatest(F.col("drawn") - F.col("n_slots"), F.lit(0))).over(by_no) - F.greatest(F.col("drawn") - F.col("n_slots"), F.lit(0))).alias("freed_before"),
            (F.sum(F.greatest(F.col("n_slots") - F.col("drawn"), F.lit(0))).over(by_no) - F.greatest(F.col("n_slots") - F.col("drawn"), F.lit(0))).alias("lack_before"),
        )
    )
    runs = _starts(counts, "source_no").join(need.select(F.col("source_no").alias("no"), "n_slots", "freed_before"), F.col("source_no") == F.col("no"))
    keeps = F.greatest(F.least(F.col("n"), F.col("n_slots") - F.col("before")), F.lit(0))
    kept = runs.select("shard", "source_no", F.col("before").alias("first"), keeps.alias("n")).where("n > 0")
    over = runs.where(keeps < F.col("n")).select("shard", (F.col("freed_before") + F.greatest(F.col("before") - F.col("n_slots"), F.lit(0))).alias("g0"), (F.col("n") - keeps).alias("n"))
    freed = over.select("shard", F.explode(F.sequence(F.col("g0"), F.col("g0") + F.col("n") - 1)).alias("g"))
    lack = need.where("n_slots > drawn").select("source_no", F.col("drawn").alias("r0"), "lack_before", F.explode(F.sequence(F.col("lack_before"), F.col("lack_before") + F.col("n_slots") - F.col("drawn") - 1)).alias("g_"))
    given = freed.join(lack.hint("merge"), F.col("g") == F.col("g_")).select("shard", "source_no", (F.col("r0") + F.col("g") - F.col("lack_before")).alias("first"), F.lit(1).cast("bigint").alias("n"))
    return kept.unionByName(given)


def slots(goal: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mixture: shard, source, epoch, block; one row per output slot. `goal` is what targets() gives."""
    goal = cut(numbered(goal))
    all_slots = goal.agg(F.sum("n_slots")).first()[0] or 0
    if not all_slots:
        return goal.where("false").select(F.lit(0).cast("bigint").alias("shard"), "source", F.lit(0).cast("bigint").alias("epoch"), F.lit(0).cast("bigint").alias("block"))
    runs = shard_counts(goal, all_slots, shard_slots).repartition(parts_for(all_slots, 1 << 14, 8), "shard", "source_no", "first")
    named = runs.join(goal.select(F.col("source_no").alias("no"), "source", "n_blocks"), F.col("source_no") == F.col("no"))
    each = named.select("shard", "source", "n_blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("r"))
    epoch = F.floor(F.col("r") / F.col("n_blocks")).cast("bigint")
    return each.select(
        "shard", "source", epoch.alias("epoch"), permuted(F.pmod(F.col("r"), F.col("n_blocks")), F.col("n_blocks"), F.coalesce(F.col("source"), F.lit("\0null")), epoch).alias("block")
    )


def block_pieces(placed_docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document and block that it has words in: block, first (word of the document, from 0), words; all other columns of `placed_docs` stay."""
    b = placed_docs.where("size > 0").select(
        "*",
        F.explode(F.sequence(F.floor(F.col("at") / block_words).cast("bigint"), F.floor((F.col("at") + F.col("size") - 1) / block_words).cast("bigint"))).alias("block"),
    )
    first = F.greatest(F.col("block") * block_words - F.col("at"), F.lit(0))
    end = F.least((F.col("block") + 1) * block_words - F.col("at"), F.col("size"))
    return b.select("*", first.alias("first"), (end - first).alias("words"))


def _parts(sized: DataFrame, block_words: int, limit: int):
    """`sized` (doc_id, source, size, part) with the chunk of each row, and what each source is to give."""
    docs = cut(sized)
    per_source = cut(docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")))
    chunks = parts_for(per_source.agg(F.max("n")).first()[0] or 0, CHUNK_DOCS)
    goal = cut(targets(per_source.select("source", "source_size"), limit, block_words))
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks))), goal


def _drawn(goal: DataFrame, shard_slots: int) -> DataFrame:
    return slots(goal, shard_slots).groupBy(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("no_name"), F.col("block").alias("drawn")).agg(F.count("*").alias("times"))


def _with_times(pieces: DataFrame, drawn: DataFrame) -> DataFrame:
    """Blocks joined by source and number; those not drawn go. (A merge join: drawn blocks grow with the data, however small they look when compressed.)"""
    return pieces.join(drawn.hint("merge"), (F.coalesce("source", F.lit("")) == F.col("name")) & (F.col("source").isNull() == F.col("no_name")) & (F.col("block") == F.col("drawn")))


def mix(documents: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, limit: int = LIMIT) -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken (words of it in the mix, repeats counted): one row per row of `documents`."""
    sized = documents.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("part"))
    docs, goal = _parts(sized, block_words, limit)
    pieces = block_pieces(placed(docs), block_words).select("part", "source", "block", "words")
    taken = _with_times(pieces, _drawn(goal, shard_slots)).groupBy("part").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    g = goal.select(F.col("source").alias("source_"), "source_size", "target")
    return (
        docs.join(taken, "part", "left")
        .join(g, F.col("source").eqNullSafe(F.col("source_")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
    )


def mixed_texts(documents: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, limit: int = LIMIT) -> DataFrame:
    """The mix as documents: all columns of `documents` (which has doc_id, text, source and n_chars), text being the drawn words, parted by single spaces.

    A document has one row for each time its blocks were drawn once more; a row holds the blocks drawn
    that often, in their order. Rows that agree in all columns are one document here. Columns may have
    any names.
    """
    # the operator's own columns never meet those of `documents`: these travel in one struct
    whole = documents.select(F.struct(*(F.col(c) for c in documents.columns)).alias("row"))
    values = [x for c in documents.columns for x in (F.col("row")[c], F.isnull(F.col("row")[c]))]
    keyed = whole.withColumn("part", F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(SEED), *values).alias("b")))
    numbers = keyed.select("part", "row.doc_id", F.col("row.source").cast("string").alias("source"), n_words(F.col("row.text")).alias("size"))
    counted = cut(numbers.groupBy("part").agg(*(F.first(c).alias(c) for c in ("doc_id", "source", "size")), F.count("*").alias("rows")))
    again = counted.where("rows > 1").select("part")
    one = keyed
    if not again.isEmpty():
        one = keyed.join(again, "part", "left_anti").unionByName(keyed.join(again, "part", "left_semi").groupBy("part").agg(F.first("row").alias("row")).select("row", "part"))
    sizes, goal = _parts(counted.drop("rows"), block_words, limit)
    pieces = block_pieces(placed(sizes), block_words).select("part", "source", "block", "first", "words")
    drawn = _drawn(goal, shard_slots)
    joined = _with_times(pieces, drawn).select("part", "first", "words", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("turn"))
    parts = joined.groupBy("part", "turn").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("pieces"))
    took = one.join(parts, "part")
    # bound once: a text is parted once, not once for each piece
    text = let(
        F.regexp_extract_all("row.text", F.lit(_WORD), F.lit(0)),
        lambda every: F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(every, (p["first"] + 1).cast("int"), p["words"].cast("int")))), " "),
    )
    return took.withColumn("mixed", text).select(
        *(F.col("mixed").alias(c) if c == "text" else F.length("mixed").cast("bigint").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in documents.columns)
    )
