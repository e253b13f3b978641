"""Chat formatting over a prefix tree.

Conversations that start with the same turns share tree nodes. A node is one formatted turn; it is
emitted once in a pack, depth first, with the position of its first token (counted along its own
conversation, so siblings start at the same position) and the intervals of the pack its tokens may
attend to (its ancestors; within the node attention is causal). Tokens are the code points of the
formatted text.

How it scales: turns are gathered per conversation (one shuffle), then conversations are sorted by
the chain of their turn hashes (one range shuffle), which puts sharers side by side and *is* the
depth-first order of the tree. A stack walks each partition and closes a pack at `pack_chars`, so a
first turn that a third of all conversations share is cut into many packs of bounded size, each of
which repeats only that path: a pack has to hold whatever its tokens attend to. The sort key ends in
the conversation id, so identical conversations are spread too. No group is held in memory but one
conversation and one pack.

Defined results: null text or role is an empty string; rows with a null conv_id are one conversation
with a null id; turns of equal number are ordered by role and text; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PACK_CHARS = 1 << 20

_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")

PACK_SCHEMA = (
    "pack_id string, text string, "
    "nodes array<struct<start:bigint,length:bigint,position:bigint,parent:int,loss_start:bigint,loss_length:bigint,attends:array<struct<start:bigint,end:bigint>>>>, "
    "members array<struct<conv_id:bigint,leaf:int>>"
)
_PACK_TYPE = pa.schema(
    [
        ("pack_id", pa.string()),
        ("text", pa.string()),
        (
            "nodes",
            pa.list_(
                pa.struct(
                    [
                        ("start", pa.int64()),
                        ("length", pa.int64()),
                        ("position", pa.int64()),
                        ("parent", pa.int32()),
                        ("loss_start", pa.int64()),
                        ("loss_length", pa.int64()),
                        ("attends", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ]
                )
            ),
        ),
        ("members", pa.list_(pa.struct([("conv_id", pa.int64()), ("leaf", pa.int32())]))),
    ]
)


def escape(text: str) -> str:
    """No control string is left in the result: `<|` becomes `<\\|`, `<\\|` becomes `<\\\\|`, and so on."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Also keeps the line break that ends the role apart from line breaks inside it."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where in it the loss mask lies (assistant texts only)."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(body) if role == "assistant" else 0


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, unescaped."""
    turns, at = [], 0
    while at < len(formatted):
        line, stop = formatted.index("\n", at), formatted.index(END, at)
        turns.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : stop])))
        at = stop + len(END) + 1
    return turns


class _Pack:
    """One pack being filled; `path` is the stack of (turn hash, node number)."""

    def __init__(self):
        self.texts, self.nodes, self.members, self.path, self.size = [], [], [], [], 0

    def add(self, conv_id, turns: list[tuple[str, str]], keys: list[bytes]) -> None:
        shared = 0
        while shared < min(len(self.path), len(keys)) and self.path[shared][0] == keys[shared]:
            shared += 1
        del self.path[shared:]
        for (role, text), key in zip(turns[shared:], keys[shared:], strict=True):
            out, loss_start, loss_length = format_turn(role, text)
            parent = self.path[-1][1] if self.path else -1
            above = self.nodes[parent] if self.path else None
            attends = []
            if above:
                attends = [dict(x) for x in above["attends"]]
                end = above["start"] + above["length"]
                if attends and attends[-1]["end"] == above["start"]:
                    attends[-1]["end"] = end
                else:
                    attends.append({"start": above["start"], "end": end})
            self.path.append((key, len(self.nodes)))
            self.nodes.append(
                {
                    "start": self.size,
                    "length": len(out),
                    "position": above["position"] + above["length"] if above else 0,
                    "parent": parent,
                    "loss_start": self.size + loss_start,
                    "loss_length": loss_length,
                    "attends": attends,
                }
            )
            self.texts.append(out)
            self.size += len(out)
        self.members.append({"conv_id": conv_id, "leaf": self.path[-1][1] if self.path else -1})

    def row(self) -> dict:
        text = "".join(self.texts)
        first = self.members[0]["conv_id"]
        name = hashlib.md5(f"{first}:{len(self.members)}:{self.size}:{text}".encode("utf-8", "surrogatepass")).hexdigest()
        return {"pack_id": name, "text": text, "nodes": self.nodes, "members": self.members}


def _keys(turns: list[tuple[str, str]]) -> list[bytes]:
    """One key per turn that names the turn and all before it."""
    chain, keys = hashlib.blake2b(digest_size=16), []
    for role, text in turns:
        for x in (role, text):
            x = x.encode("utf-8", "surrogatepass")
            chain.update(len(x).to_bytes(8, "little") + x)
        keys.append(chain.digest())
    return keys


def _with_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = []
        for turns in batch.column("turns").to_pylist():
            keys = _keys([(t["role"], t["text"]) for t in turns])
            paths.append(b"".join(k[:8] for k in keys))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.binary())], [*batch.schema.names, "path"])


def _packer(pack_chars: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = _Pack()
        for batch in batches:
            for conv_id, rows in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                if now.size >= pack_chars or len(now.members) >= 65536:
                    yield pa.RecordBatch.from_pylist([now.row()], _PACK_TYPE)
                    now = _Pack()
                turns = [(t["role"], t["text"]) for t in rows]
                now.add(conv_id, turns, _keys(turns))
        if now.members:
            yield pa.RecordBatch.from_pylist([now.row()], _PACK_TYPE)

    return pack


def build_packs(conversations: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """`conversations` (conv_id, turn, role, text) as packs of prefix trees (PACK_SCHEMA)."""
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(
            F.col("turn").cast("bigint").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    kind = "array<struct<turn:bigint,role:string,text:string>>"
    pathed = whole.mapInArrow(_with_path, f"conv_id bigint, turns {kind}, path binary")
    ordered = pathed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(_packer(pack_chars), PACK_SCHEMA)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            nodes, text, out = row["nodes"], row["text"], []
            parsed: dict[int, tuple] = {}
            for m in row["members"]:
                path, at = [], m["leaf"]
                while at >= 0:
                    path.append(at)
                    at = nodes[at]["parent"]
                turns_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                loss_chars = chars = 0
                for k in reversed(path):
                    if k not in parsed:
                        n = nodes[k]
                        (role, said), masked = (
                            parse(text[n["start"] : n["start"] + n["length"]])[0],
                            unescape(text[n["loss_start"] : n["loss_start"] + n["loss_length"]]),
                        )
                        parsed[k] = (f"{role}\n{said}\n".encode("utf-8", "surrogatepass"), masked.encode("utf-8", "surrogatepass"), len(masked), n["length"])
                    turn, loss, loss_n, n_chars = parsed[k]
                    turns_hash.update(turn)
                    loss_hash.update(loss)
                    loss_chars += loss_n
                    chars += n_chars
                out.append((m["conv_id"], len(path), turns_hash.hexdigest(), loss_chars, loss_hash.hexdigest(), chars))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )


def read_back(packs: DataFrame) -> DataFrame:
    """One row per conversation, from the packs alone: its turns and its text under the loss mask, unescaped, as digests."""
    return packs.mapInArrow(
        _read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
