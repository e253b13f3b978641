"""Chunkers: overlapping white-space windows, their closed-form count, caps, and structural blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES, let
from .sweep import running_sums


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _check(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap less than size")


def chunk_count(n_words: Column, size: int = 512, overlap: int = 24) -> Column:
    """How many chunks so many words make."""
    _check(size, overlap)
    return F.when(n_words <= 0, 0).otherwise(1 + F.ceil(F.greatest(n_words - size, F.lit(0)) / (size - overlap))).cast("int")


def chunks(text: Column, size: int = 512, overlap: int = 24) -> Column:
    """Array of chunks of `size` words that share `overlap` words with the one before."""
    def cutout(w: Column) -> Column:
        n = chunk_count(F.size(w), size, overlap)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * (size - overlap) + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    return let(words(text), cutout)


def chunk_table(rows: DataFrame, key: str, text: str, size: int = 512, overlap: int = 24) -> DataFrame:
    """key, chunk_index, chunk."""
    return rows.select(key, F.posexplode(chunks(F.coalesce(F.col(text), F.lit("")), size, overlap)).alias("chunk_index", "chunk"))


def capped(counts: DataFrame, parent: str, order: list[str], n: str, cap: int) -> DataFrame:
    """How many of each child's n chunks stay under the parent's cap, children in order. A parent's children may lie in many tasks."""
    summed = running_sums(counts.withColumn("upto_", F.col(n)).withColumn("order_", F.struct(*order)), [parent], "order_", ["upto_"])
    return summed.withColumn("kept", F.greatest(F.lit(0), F.least(F.col(n), F.lit(cap) - (F.col("upto_") - F.col(n)))).cast("int")).drop("upto_", "order_")


@dataclass
class Block:
    kind: str  # heading, paragraph, table
    text: str
    section: str = ""  # number of a heading or table
    title: str = ""

    @property
    def label(self) -> str:
        return " ".join(f"{self.section} {self.title}".split())


_CAPTION = re.compile(r"\s*Table\s+([0-9A-Za-z][0-9A-Za-z.-]*?)\s*[:.]?\s+(.*)", re.S)


def blocks_of(markdown: str) -> list[Block]:
    """Headings, paragraphs and pipe tables of Markdown text; a table is named by a caption just before it."""
    out: list[Block] = []
    for part in re.split(r"\n\s*\n", markdown or ""):
        lines = [x for x in part.strip().split("\n") if x.strip()]
        if not lines:
            continue
        m = re.match(r"(#{1,6})\s+(?:([0-9A-Z]+(?:\.\d+[A-Z]*)*)\s+)?(.*)", lines[0])
        if m:
            out.append(Block("heading", lines[0], m[2] or "", m[3]))
            lines = lines[1:]
        if lines and all(x.lstrip().startswith("|") for x in lines):
            caption = _CAPTION.match(out[-1].text) if out and out[-1].kind == "paragraph" else None
            out.append(Block("table", "\n".join(lines), *((caption[1], caption[2]) if caption else ())))
        elif lines:
            out.append(Block("paragraph", "\n".join(lines)))
    return out


@dataclass
class _Piece:
    """What is never split further: a heading, a sentence or a part of one, a table or a row of it."""

    text: str
    section: str
    tables: tuple[str, ...] = ()
    atomic: bool = False
    table: int | None = None  # of which split table a row is
    head: str = ""
    join: str = "\n\n"  # what parts it from an overlap

    def words(self) -> int:
        return len(self.text.split())


def _runs(sentence: str, most_words: int, most_chars: int) -> list[str]:
    """A sentence in runs of words under both ceilings; a word that is too long is a run of its own."""
    if len(sentence) <= most_chars and len(sentence.split()) <= most_words:
        return [sentence]
    out: list[list[str]] = [[]]
    for w in sentence.split():
        if out[-1] and (len(out[-1]) >= most_words or sum(map(len, out[-1])) + len(out[-1]) + len(w) > most_chars):
            out.append([])
        out[-1].append(w)
    return [" ".join(r) for r in out]


def _pieces(blocks: list[Block], most_words: int, most_chars: int) -> Iterator[_Piece]:
    section = ""
    for at, b in enumerate(blocks):
        if b.kind == "heading":
            section = b.label
            yield _Piece(b.text, section)
        elif b.kind == "paragraph":
            near = [x for x in (blocks[at - 1] if at else None, blocks[at + 1] if at + 1 < len(blocks) else None) if x and x.kind == "table"]
            tables = (near[0].label,) if near and _CAPTION.match(b.text) and near[0].label else ()
            for sentence in [x for x in re.split(r"(?<=[.!?])\s+", b.text.strip()) if x] or [b.text]:
                for k, run in enumerate(_runs(sentence, most_words, most_chars)):
                    yield _Piece(run, section, tables, join=" " if k else "\n\n")
        elif len(b.text) <= most_chars:
            yield _Piece(b.text, section, (b.label,), atomic=True)
        else:
            lines = b.text.split("\n")
            for row in lines[2:]:
                if row.strip():
                    yield _Piece(row, section, (b.label,), atomic=True, table=at, head="\n".join(lines[:2]))


def structural_chunks(blocks: list[Block], most_words: int = 512, most_chars: int = 1500, overlap: int = 24) -> list[dict]:
    """Chunks (text, sections, tables, table: it ends in one) of headings, sentences and table rows under both ceilings.

    A sentence over a ceiling is split between words, a table over the ceiling of characters by rows, its
    header repeated in each chunk; a row is never split, so that one over a ceiling is a chunk alone. A
    chunk starts with the last words of the one before and takes their sections and tables over, unless
    these words are a table's or it starts with them already.
    """
    if most_words < 1 or not 0 <= overlap < most_words:
        raise ValueError("most_words must be positive and overlap less than most_words")
    groups: list[list[tuple[str, _Piece]]] = [[]]

    def shown(p: _Piece) -> str:
        return f"{p.head}\n{p.text}" if p.head and all(q.table != p.table for _, q in groups[-1]) else p.text

    for p in _pieces(blocks, most_words, most_chars):
        text, group = shown(p), groups[-1]
        now = "\n\n".join(x for x, _ in group)
        if group and (len(now.split()) + len(text.split()) > most_words or len(now) + len(text) + (0 if p.atomic else 2) > most_chars):
            groups.append([])
            text = shown(p)
        groups[-1].append((text, p))
        if p.atomic and (len(text.split()) > most_words or len(text) > most_chars):
            groups.append([])
    out: list[dict] = []
    tail: list[tuple[str, _Piece]] = []
    before = ""
    for group in groups:
        text = "\n\n".join(x for x, _ in group).strip()
        if not text:
            continue
        words = [(w, p) for x, p in group for w in x.split()]
        own = list(group)
        # the words before, exactly as they stand there
        if tail and text.split()[: len(tail)] != [w for w, _ in tail] and not any(p.atomic for _, p in tail):
            text = before[list(re.finditer(r"\S+", before))[-len(tail)].start() :] + group[0][1].join + text
            own, words = tail + own, tail + words
        each = lambda names: list(dict.fromkeys(n for n in names if n))
        out.append({"text": text, "sections": each(p.section for _, p in own), "tables": each(t for _, p in own for t in p.tables), "table": group[-1][1].atomic})
        before, tail = text, words[-overlap:] if overlap else []
    return out


def structural_table(rows: DataFrame, key: str, text: str, **limits) -> DataFrame:
    """key, chunk_index, chunk, sections, tables, is_table for each row's Markdown."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(k, i, c["text"], c["sections"], c["tables"], c["table"]) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, c in enumerate(structural_chunks(blocks_of(t), **limits))]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [key, "chunk_index", "chunk", "sections", "tables", "is_table"])

    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, chunk_index int, chunk string, sections array<string>, tables array<string>, is_table boolean")
