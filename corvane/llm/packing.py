"""Packing documents into sequences by their length histogram, shortest pack first.

Documents are tokenized once; what is longer than a sequence is cut into whole sequences and a rest.
The rests' lengths make a histogram (one count per length, so at most `size` numbers), and packing is
done on it: lengths go longest first, each document into a pack with the most room left, which changes
counts of packing patterns and never touches a document. Patterns are then joined back to documents: the r-th piece of a length takes the r-th place that the patterns hold for
that length.

How it scales: text is read once and leaves the tokenizing task as one small row per piece; the
histogram and the patterns are bounded by the sequence length, not by the data; ranks within a length
are running counts in two steps (within chunks of documents, over chunks), so a length that a third of
all documents share isn't one task.

Defined results: null or empty text is the end id alone; repeated rows are packed as separate
documents; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import collections
import functools
import heapq
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts_for, release

SIZE, END_ID, CHUNK_PIECES = 4096, 2, 20_000
_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


#: How the tokenizer of the query parts a word in pieces, as its file has it, and the same for words of lower-case `_PLAIN`, a line each.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"[\x21-\x7e¡«»¿À-ÿ]*")  # NFC leaves these as they are, and each has one lower case
_PLAIN_PATTERN = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_WORD_END = "</w>"


def _laid(ids: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """`ids` is runs of the given sizes, end to end; the runs named in `order`, end to end."""
    n = sizes[order]
    last = np.cumsum(n)
    return ids[np.repeat((np.cumsum(sizes) - sizes)[order] - (last - n), n) + np.arange(last[-1] if len(last) else 0)]


class WordTokenizer:
    """Ids of a tokenizer whose tokens never cross a space or line break, for many texts at a time.

    The texts' distinct words (what lies between spaces and line breaks) are tokenized once, remembered for
    the next texts, and laid out by the numbers of words. Where the tokenizer parts words by `_PATTERN`,
    words of `_PLAIN` are parted here, and their distinct pieces are tokenized many in one call: the end
    mark of a piece's last token tells them apart. Beyond about `most` bytes of remembered words, those
    met once are forgotten.
    """

    def __init__(self, path: str, together: int = 200, most: int = 24 << 20):
        # a task has one core; the tokenizer's own threads would only contend with the other tasks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.model, self.together, self.most, self.pieces = Tokenizer.from_file(path), together, most, None
        form = json.loads(self.model.to_str())
        steps = (form["pre_tokenizer"] or {}).get("pretokenizers", [])
        parted = [x.get("pattern", {}).get("Regex") for x in steps if x["type"] == "Split"] == [_PATTERN]
        lowered = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.special = re.compile("|".join(re.escape(x["content"]) for x in form["added_tokens"]) or r"(?!)")
        if parted and lowered and [x["type"] for x in steps] == ["Split", "ByteLevel"] and form["model"].get("end_of_word_suffix") == _WORD_END:
            self.pieces = Tokenizer.from_str(self.model.to_str())
            self.pieces.normalizer = normalizers.Sequence([])
            self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.pieces.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        for x in (self.model, self.pieces):
            # words come once: remembering them costs more than it saves
            if x is not None and hasattr(x.model, "_resize_cache"):
                x.model._resize_cache(0)
        self._remember({}, np.empty(0, np.uint32), np.empty(0, np.int64))

    def _remember(self, known: dict[str, int], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known, self.known_ids, self.known_sizes = known, ids, sizes
        self.again = np.zeros(len(known), bool)  # met since it was remembered
        self.held = sum(map(len, known)) + 200 * len(known)  # bytes, about

    @staticmethod
    def _encoded(model, texts: list[str], each: int) -> Iterator[list[int]]:
        """Ids of each text; an encoding holds much more than ids, so only `each` of them at once."""
        for a in range(0, len(texts), each):
            yield from (e.ids for e in model.encode_batch_fast(texts[a : a + each], add_special_tokens=False))

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [np.array(x, np.uint32) for x in self._encoded(self.model, words, 10_000)]
        return np.concatenate([np.empty(0, np.uint32), *got]), np.fromiter(map(len, got), np.int64, len(got))

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all words, end to end, and how many each word has."""
        if self.pieces is None:
            return self._each(words)
        plain = np.array([_PLAIN.fullmatch(w) is not None and not ("<" in w and self.special.search(w)) for w in words], bool)
        text = "".join(w + "\n" for w in itertools.compress(words, plain)).lower()
        units = collections.defaultdict(itertools.count().__next__, {"\n": -1})  # distinct pieces by number
        parts = _PLAIN_PATTERN.findall(text)
        order = np.fromiter(map(units.__getitem__, parts), np.int64, len(parts))
        names = list(units)[1:]
        lines = [" ".join(names[a : a + self.together]) for a in range(0, len(names), self.together)]
        ids = np.concatenate([np.empty(0, np.uint32), *(np.array(x, np.uint32) for x in self._encoded(self.pieces, lines, 50))])
        ends = np.flatnonzero(self.ends[ids])
        if len(ends) != len(names):
            return self._each(words)
        sizes = np.append(np.diff(np.r_[-1, ends]), 0)  # a line's end has none
        total = np.cumsum(sizes[order])[order < 0]
        more, more_sizes = self._each(list(itertools.compress(words, ~plain)))
        ids, sizes = np.concatenate([_laid(ids, sizes, order[order >= 0]), more]), np.concatenate([np.diff(np.r_[0, total]), more_sizes])
        place = np.empty(len(words), np.int64)
        place[np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]] = np.arange(len(words))
        return _laid(ids, sizes, place), sizes[place]

    def table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the remembered words and these (distinct) ones, end to end, how many each has, and which of them are these."""
        at = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        fresh = [words[i] for i in new.tolist()]
        self.again[at[at >= 0]] = True
        ids, sizes = self.words(fresh)
        at[new] = np.arange(len(fresh)) + len(self.known)
        ids, sizes = np.concatenate([self.known_ids, ids]), np.concatenate([self.known_sizes, sizes])
        self.known.update(zip(fresh, at[new].tolist(), strict=True))
        self.known_ids, self.known_sizes, self.again = ids, sizes, np.append(self.again, np.zeros(len(fresh), bool))
        self.held += sum(map(len, fresh)) + 200 * len(fresh)
        if self.held > self.most:
            kept = itertools.compress(list(self.known), self.again)
            self._remember({w: i for i, w in enumerate(kept)}, _laid(ids, sizes, np.flatnonzero(self.again)), sizes[self.again])
            if self.held > self.most // 2:
                self._remember({}, ids[:0], sizes[:0])
        return ids, sizes, at

    def ids(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts (strings without nulls), end to end, each followed by `end_id`, and where each text's ids end."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        ids, sizes, at = self.table(coded.dictionary.to_pylist())
        # the end is one more word, after each text's own
        ids, sizes = np.append(ids, np.uint32(end_id)), np.append(sizes, 1)
        bounds = parts.offsets.to_numpy().astype(np.int64)[1:] - parts.offsets[0].as_py()
        order = np.insert(at[coded.indices.to_numpy()], bounds, len(sizes) - 1)
        return _laid(ids, sizes, order), np.cumsum(sizes[order])[bounds + np.arange(len(texts))]


@functools.lru_cache(maxsize=1)
def _word_tokenizer(path: str) -> WordTokenizer:
    """One a worker process, for all its tasks."""
    return WordTokenizer(path)


def _slices(texts: pa.Array, most: int) -> Iterator[slice]:
    """Runs of texts of about `most` bytes."""
    total = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield slice(at, end)
        at = end


def _tokenizer(path: str, size: int, end_id: int, most: int = 32 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _word_tokenizer(path)
        for batch in batches:
            all_ids, all_texts = batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "")
            for part in _slices(all_texts, most):
                rows, start = [], 0
                ids, ends = tokenizer.ids(all_texts[part.start : part.stop], end_id)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                for doc_id, end in zip(all_ids[part], ends.tolist(), strict=True):
                    for at in range(start, end, size):
                        z = min(at + size, end)
                        rows.append((doc_id, at - start, z - at, zlib.crc32(raw[4 * at : 4 * z]), end - start))
                    start = end
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                del ids, raw, rows
                release()

    return run


def pieces(documents: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: whole sequences and a rest of each document."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_tokenizer(tokenizer_path, size, end_id), _PIECE)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[int, ...]]]:
    """Packs as (times, lengths, longest first) that hold every length of the histogram as often as it is counted.

    Longest first; every document goes to a pack with the most room (a shortest pack), to a new one when
    it doesn't fit there. Packs with equal contents are one pattern with a count. All documents of one
    length are placed in rounds: the patterns with the most room take one document each, which moves them
    to a lesser room, where they join those already there; so the work follows lengths and rooms, not
    documents.
    """
    by_room: dict[int, list[list]] = {}  # room -> [times, lengths]
    heap: list[int] = []  # negative rooms that may hold patterns

    def put(room: int, times: int, lengths: tuple[int, ...]) -> None:
        if room not in by_room:
            by_room[room] = []
            heapq.heappush(heap, -room)
        by_room[room].append([times, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while heap and not by_room.get(-heap[0]):
                by_room.pop(-heapq.heappop(heap), None)
            if not heap or -heap[0] < length:
                # nothing fits: a new pack, which is the shortest one until no document of this length fits there any more
                each = size // length
                whole, more = divmod(left, each)
                if whole:
                    put(size - each * length, whole, (length,) * each)
                if more:
                    put(size - more * length, 1, (length,) * more)
                break
            room = -heap[0]
            times, lengths = by_room[room].pop()
            use = min(times, left)
            if times > use:
                by_room[room].append([times - use, lengths])
            put(room - length, use, (*lengths, length))
            left -= use
    return [(times, lengths) for room in sorted(by_room) for times, lengths in by_room[room]]


def places(found: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, as runs: pieces first_rank.. of `length` go, `each` to a sequence, to sequences from `sequence` at `offset`."""
    rows, rank, sequence = [], {}, 0
    for times, lengths in found:
        offset, i = 0, 0
        while i < len(lengths):
            n = 1
            while i + n < len(lengths) and lengths[i + n] == lengths[i]:
                n += 1
            length = lengths[i]
            at = rank.get(length, 0)
            rows.append((length, at, n, sequence, offset))
            rank[length] = at + times * n
            offset += n * length
            i += n
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "sequence", "offset"), cols, strict=True)) | {"sequences": np.array([sequence])}


def _placer(to: dict[str, np.ndarray], size: int):
    top = np.int64(1) << 44  # (length, rank) as one sorted number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = to["length"] * top + to["first"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * top + rank, side="right") - 1
            k = rank - to["first"][at]
            sequence = to["sequence"][at] + k // to["each"][at]
            offset = to["offset"][at] + k % to["each"][at] * length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(documents: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, chunk_pieces: int = CHUNK_PIECES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece, gapless from offset 0 in each sequence."""
    cutout = cut(pieces(documents, tokenizer_path, size, end_id).withColumn("part", F.monotonically_increasing_id()))
    counted = cutout.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `size` rows
    found = patterns({r["length"]: r["n"] for r in counted}, size)
    chunks = parts_for(max((r["n"] for r in counted), default=0), chunk_pieces)
    chunked = cutout.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start"), F.lit(chunks)))
    sums = chunked.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    over = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "chunk", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("from_rank"))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32", "part")
    ranked = chunked.withColumn("r", F.row_number().over(within) - 1).join(starts, ["length", "chunk"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("from_rank") + F.col("r")).cast("bigint").alias("rank"))
    return ranked.mapInArrow(_placer(places(found), size), _PIECE + ", sequence_id bigint, offset bigint")
