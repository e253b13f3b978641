"""The prefix trie of conversations, by distributed MSD radix partitioning.

Turns become numbers of a dictionary that is sorted by (role, text). Conversations of equal turns are
one sequence. All sequences start in one bucket; while a bucket holds more turns than one task
should, its sequences are dealt by the next turn, which gives smaller buckets. A bucket's common
prefix is passed in one step, found from its least and greatest sequence. Buckets that are small enough are
finished by a multikey quicksort, each in one task, whose recursion emits the nodes. What large buckets
have in all their subtrees is then added up from the last round to the first.

Odd input: a null role or text is empty; a null turn goes first; rows of one turn go by role, then text,
and repeated rows are turns of their own. Rows without a conv_id take no part. The sequence of one
conversation is one record (16 bytes a turn). Columns other than conv_id, turn, role and text are left out. An empty table gives
no node, not even a root, which would have no member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A bucket of at most so many turns that are still to be sorted is finished in one task.
LOCAL_TURNS = 1 << 13
#: Conversation ids joined in one row before they are hashed.
BLOCK = 4096

_NODE = pa.schema([(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_rep", "top_conv", "top_depth")])
_NODE_DDL = ", ".join(f"{c} bigint" for c in _NODE.names)


def sequences(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, ids, lens): each conversation's turns as dictionary numbers, with the code points of their texts."""
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    # role and text, told apart by the role's length
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length("role"), "role", "text"), 256))
    distinct = turns.groupBy("role", "text").agg(F.count("*").alias("times")).repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    dictionary = cut(distinct.select(F.monotonically_increasing_id().alias("id"), digest.alias("digest"), F.length("text").cast("bigint").alias("len")))
    coded = turns.select("conv_id", "turn", digest.alias("digest")).join(dictionary, "digest")
    own = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "len"))).alias("t"))
    return own.select("conv_id", F.col("t.id").alias("ids"), F.col("t.len").alias("lens"))


def rebuilt(own: DataFrame, shared: Column, source: Column) -> DataFrame:
    """Each conversation with its first `shared` turns taken from conversation `source` instead."""
    base = own.select(F.col("conv_id").alias("base"), F.col("ids").alias("base_ids"), F.col("lens").alias("base_lens"))
    wanted = own.select("*", source.alias("base"), shared.cast("int").alias("h"))
    base = base.join(wanted.select("base").distinct(), "base", "left_semi")
    j = wanted.join(base, "base", "left")

    def spliced(a: str, b: str) -> Column:
        return F.expr(f"concat(coalesce(slice({a}, 1, h), CAST(array() AS array<bigint>)), slice({b}, h + 1, size({b})))")

    return j.select("conv_id", spliced("base_ids", "ids").alias("ids"), spliced("base_lens", "lens").alias("lens"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (seq, block, least, joined) rows, one hash a sequence, fed block by block."""
    seq, least, h, out = None, None, hashlib.sha256(), []

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, pa.schema([("ends_rep", pa.int64()), ("ends_sha256", pa.string())]))

    for batch in batches:
        for s, first, joined in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if s != seq:
                if seq is not None:
                    out.append({"ends_rep": least, "ends_sha256": h.hexdigest()})
                seq, least, h = s, first, hashlib.sha256(joined.as_py().encode())
            else:
                h.update(b"," + joined.as_py().encode())
        if len(out) >= 4096:
            yield done()
            out.clear()
    if seq is not None:
        out.append({"ends_rep": least, "ends_sha256": h.hexdigest()})
    yield done()


def end_digests(convs: DataFrame) -> DataFrame:
    """SHA-256 of the ids, in order, of all conversations of one sequence, by the least of them."""
    seq = F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256)
    blocks = convs.select(seq.alias("seq"), F.floor(F.col("conv_id") / BLOCK).alias("block"), "conv_id").groupBy("seq", "block")
    blocks = blocks.agg(F.min("conv_id").alias("least"), F.sort_array(F.collect_list("conv_id")).alias("convs"))
    joined = blocks.select("seq", "block", "least", F.array_join(F.transform("convs", lambda c: c.cast("string")), ",").alias("joined"))
    return joined.repartition("seq").sortWithinPartitions("seq", "block").mapInArrow(_digests, "ends_rep bigint, ends_sha256 string")


def quicksort_nodes(rows: list[tuple[int, int, list[int], list[int]]], start: int, parent: int) -> list[list]:
    """The nodes below depth `start` of distinct sequences (least conv, copies, ids, lens) that agree up to there; children come after their parents.

    Bentley and Sedgewick's ternary partition by the turn at one depth. The part that has the pivot's turn is
    a node, and is sorted by the next turn. A node is [conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_rep].
    """
    nodes: list[list] = []
    above: list[int] = []  # each node's parent among them
    todo = [([r for r in rows if len(r[2]) > start], start, parent, -1)]
    while todo:
        part, depth, over, at = todo.pop()
        while part:
            pivot = part[len(part) // 2][2][depth]
            if len(part) > 1:
                less = [r for r in part if r[2][depth] < pivot]
                more = [r for r in part if r[2][depth] > pivot]
                if less:
                    todo.append((less, depth, over, at))
                if more:
                    todo.append((more, depth, over, at))
                if less or more:
                    part = [r for r in part if r[2][depth] == pivot]
            conv, copies = min(r[0] for r in part), sum(r[1] for r in part)
            depth += 1
            ends = next((r[0] for r in part if len(r[2]) == depth), None)
            nodes.append([conv, depth, over, copies, 0, 0, (copies - 1) * part[0][3][depth - 1], ends])
            above.append(at)
            over, at = conv, len(nodes) - 1
            part = [r for r in part if len(r[2]) > depth]
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        node[5] = node[5] or 1
        if above[i] >= 0:
            up = nodes[above[i]]
            up[4] += 1
            up[5] += node[5]
            up[6] += node[6]
    return nodes


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each bucket in rows (bucket, top_conv, top_depth, conv, copies, ids, lens) sorted by bucket; a bucket's rows agree in one turn more than top_depth."""
    bucket, rows, out = None, [], []

    def close() -> None:
        conv, depth, _ = bucket
        for n in quicksort_nodes(rows, depth, conv):
            out.append((*n, conv if n[1] == depth + 1 else None, depth if n[1] == depth + 1 else None))

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(_NODE))], schema=_NODE)

    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            for b, conv, depth, *row in zip(*(c.to_pylist() for c in batch.slice(i, 512).columns), strict=True):
                if (conv, depth, b) != bucket:
                    if bucket:
                        close()
                    bucket, rows = (conv, depth, b), []
                rows.append(tuple(row))
            if len(out) >= 8192:
                yield done()
                out.clear()
    if bucket:
        close()
    yield done()


def _buckets(rows: DataFrame) -> DataFrame:
    """Sizes, least and greatest sequence of the buckets to which `rows` go by their next turn."""
    more = rows.where("size(ids) > depth").withColumn("digit", F.expr("ids[depth]"))
    found = more.groupBy("top", "depth", "digit").agg(
        F.min("conv").alias("child"), F.sum("copies").alias("n_convs"), F.sum(F.expr("CAST(size(ids) - depth AS BIGINT)")).alias("turns"), F.min("ids").alias("lo"), F.max("ids").alias("hi"), F.min("lens").alias("any")
    )
    return found


def nodes(convs: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """One row per node of the trie of `convs` (conv_id, ids, lens), each with the hash of those that end there."""
    convs = cut(convs)
    rows = convs.groupBy("ids", "lens").agg(F.min("conv_id").alias("conv"), F.count("*").alias("copies"))
    # the root is a large bucket whatever its size: what stands above all buckets
    root = convs.agg(F.min("conv_id")).first()[0]
    rows = cut(rows.withColumn("top", F.lit(root).cast("bigint")).withColumn("depth", F.lit(0)))
    local: DataFrame | None = None
    edges = [cut(rows.groupBy("top", "depth").agg(F.sum("copies").alias("n_convs"), F.min(F.when(F.size("ids") == 0, F.col("conv"))).alias("ends_rep")).select(
        F.lit(None).cast("bigint").alias("over_conv"), F.lit(-1).alias("over_depth"), F.col("top").alias("conv"), F.col("depth").alias("last"), "n_convs", F.expr("CAST(array() AS array<bigint>)").alias("lens"), "ends_rep"
    ))]
    while True:
        buckets = cut(_buckets(rows).withColumn("large", F.col("turns") > local_turns))
        agree = F.expr("array_position(zip_with(lo, hi, (x, y) -> x <=> y), false)")
        large = buckets.where("large").withColumn("last", F.when(agree == 0, F.size("lo")).otherwise(agree - 1).cast("int"))
        dealt = rows.where("size(ids) > depth").withColumn("digit", F.expr("ids[depth]"))
        small = dealt.join(buckets.where("not large").select("top", "depth", "digit"), ["top", "depth", "digit"], "left_semi")
        small = small.select("digit", "top", F.col("depth").cast("bigint").alias("depth"), "conv", "copies", "ids", "lens")
        small = small.repartition("top", "depth", "digit").sortWithinPartitions("top", "depth", "digit").mapInArrow(_finished, _NODE_DDL)
        small = cut(small)
        local = small if local is None else local.unionByName(small)
        if large.isEmpty():
            break
        to = large.select("top", "depth", "digit", F.col("child").alias("next"), "last")
        rows = cut(dealt.join(to, ["top", "depth", "digit"]).select("ids", "lens", "conv", "copies", F.col("next").alias("top"), F.col("last").alias("depth")))
        ends = rows.where("size(ids) = depth").select(F.col("top").alias("child"), F.col("depth").alias("last"), F.col("conv").alias("ends_rep"))
        edge = large.join(ends, ["child", "last"], "left")
        edges.append(cut(edge.select(F.col("top").alias("over_conv"), F.col("depth").alias("over_depth"), F.col("child").alias("conv"), "last", "n_convs", F.expr("slice(any, depth + 1, last - depth)").alias("lens"), "ends_rep")))

    tops = local.where("top_conv is not null").select(F.col("top_conv").alias("conv"), F.col("top_depth").cast("int").alias("last"), "n_leaves", "saved_tokens")
    upper: DataFrame | None = None
    for edge in reversed(edges):
        below = tops.groupBy("conv", "last").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        whole = edge.join(below, ["conv", "last"], "left").na.fill(0, ["n_children", "leaves", "saved"]).withColumn("leaves", F.greatest("leaves", F.lit(1)))
        total = F.expr("saved + (n_convs - 1) * aggregate(lens, 0L, (s, x) -> s + x)")
        whole = cut(whole)
        tops = tops.unionByName(whole.select(F.col("over_conv").alias("conv"), F.col("over_depth").alias("last"), F.col("leaves").alias("n_leaves"), total.alias("saved_tokens")))
        # each node of the edge; those above the last have one child
        each = whole.select("*", F.explode(F.expr("sequence(0, greatest(size(lens), 1) - 1)")).alias("k")).withColumn("first", F.expr("over_depth + 1"))
        is_last = F.expr("k >= size(lens) - 1")
        each = each.select(
            F.col("conv").alias("conv_id"), (F.col("first") + F.col("k")).cast("bigint").alias("depth"), F.when(F.col("k") == 0, F.col("over_conv")).otherwise(F.col("conv")).alias("parent_conv_id"), "n_convs",
            F.when(is_last, F.col("n_children")).otherwise(1).cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"),
            F.expr("saved + (n_convs - 1) * aggregate(slice(lens, k + 1, size(lens)), 0L, (s, x) -> s + x)").alias("saved_tokens"), F.when(is_last, F.col("ends_rep")).alias("ends_rep"),
        )
        upper = each if upper is None else upper.unionByName(each)
    found = local.drop("top_conv", "top_depth").unionByName(upper)
    found = found.join(end_digests(convs), "ends_rep", "left").drop("ends_rep")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def trie(conversations: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The trie of all conversations as they stand."""
    return nodes(sequences(conversations), local_turns)


def rebuilt_trie(conversations: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The trie of conversations each of which begins with up to five turns of the first of its hundred."""
    c = F.col("conv_id")
    return nodes(rebuilt(cut(sequences(conversations)), F.crc32(c.cast("string")) % 6, c - c % 100), local_turns)
