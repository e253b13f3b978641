"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a string of `length` bytes that also starts in a document with a smaller doc_id
is removed. Suffixes are sorted by the difference-cover algorithm: triples at positions that aren't
multiples of three are sorted and named, the names are sorted recursively, the remaining suffixes
follow from them and are merged in, and neighbours in the order whose first `length` bytes agree are
one group, of which the least doc_id decides. The recursion ends once names stand for `length` bytes:
what lies beyond can't matter.

How it is distributed. Sorting all suffixes of a corpus moves every one of them several times. So
suffixes are first dealt to buckets that hold all equal ones: every window of `length` bytes is named
by the first of its least-hashed `KMER`-byte strings (its anchor), so equal windows have equal anchors.
(1) Documents are dealt to cells of about `cell_bytes`. Each cell sends the hashes of its anchors,
widened to the left or right by half of what a window holds besides (one of the two lies in the
window), once to the hash's bucket, which answers which of them occur in more than one document.
(2) Each cell sends, for those anchors only, the stretches of text whose windows the anchor names, equal stretches
once and with the least doc_id; each bucket sorts the suffixes of its distinct stretches (as above)
and answers the least doc_id of every window. (3) The cell marks its documents. Nothing is lost by
(1): a window that occurs in two documents has a widened anchor that does.

Whole copies of a document with a smaller doc_id are found first, by digest, and aren't sent at all:
all of their windows are covered, and whatever occurs in them also occurs in that document.

A passage that a third of all documents share costs its bucket one stretch per cell, where the stretch is the same in all; a phrase
shorter than `length` has another stretch around it in each document, and costs its bucket all of these.
Cells and buckets grow in number with the bytes, not in size. The text is shuffled once (all steps read
the same exchange); nothing is broadcast or collected but one sum.

Defined results: null text counts as empty; texts shorter than `length` lose nothing; overlapping
matches count; matches within a document or with an equal doc_id don't; repeated rows get the same
result each; a null doc_id is kept as it is and takes no part; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts_for, trimmed
from .neardup import mix

LENGTH, KMER, CELL_BYTES = 50, 16, 6 << 20
_M = np.uint64(0xD6E8FEB86659FD93)
_NO = np.empty(0, np.int64)


# --- suffix sorting -------------------------------------------------------------------------------


def _packed(*columns: np.ndarray) -> np.ndarray:
    """One sortable integer for each row of non-negative columns, ordered as the rows are."""
    key, bits = columns[0].astype(np.int64), max(1, int(columns[0].max(initial=0)).bit_length())
    for c in columns[1:]:
        more = max(1, int(c.max(initial=0)).bit_length())
        if bits + more > 62:
            _, key = np.unique(key, return_inverse=True)
            bits = max(1, int(key.max(initial=0)).bit_length())
        key, bits = (key << more) | c, bits + more
    return key


def suffix_array(s: np.ndarray, length: int, width: int = 1) -> np.ndarray:
    """Positions of `s` (symbols from 1) ordered by the suffixes there, right for at least the first `length` bytes; a symbol stands for `width` bytes."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: tuple(s[i:])), np.int64)
    t = np.concatenate([np.asarray(s, np.int64), np.zeros(4, np.int64)])
    one = np.arange(1, n + (n % 3 == 1), 3)  # a position past the end closes the first half of the names
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    key = _packed(t[sample], t[sample + 1], t[sample + 2])
    order = np.argsort(key, kind="stable")
    step = np.r_[True, key[order[1:]] != key[order[:-1]]]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(step)
    if not step.all() and width * 3 < length:
        order = suffix_array(names, length, width * 3)
    by_rank = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[by_rank] = np.arange(1, len(by_rank) + 1)
    by_rank = by_rank[by_rank < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(_packed(t[zero], rank[zero + 1]), kind="stable")]
    # each remaining suffix goes after the sampled ones that are less, which are counted by class
    is_one = by_rank % 3 == 1
    a, b = by_rank[is_one], by_rank[~is_one]
    k = _packed(np.concatenate([t[a], t[zero]]), np.concatenate([rank[a + 1], rank[zero + 1]]))
    before = np.searchsorted(k[: len(a)], k[len(a) :])
    both = np.concatenate([b, zero])
    k = _packed(t[both], t[both + 1], rank[both + 2])
    before = before + np.searchsorted(k[: len(b)], k[len(b) :])
    # (a merge by these counts also holds where suffixes that agree for `length` bytes are in any order)
    place = np.concatenate([2 * before, 2 * np.arange(len(by_rank)) + 1])
    return np.concatenate([zero, by_rank])[np.argsort(place, kind="stable")]


def _words(b: np.ndarray) -> np.ndarray:
    """At each position the eight bytes from there as one number; zeros follow the end."""
    w = np.concatenate([b, np.zeros(8, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):
        w[:-shift] |= w[shift:] << np.uint64(8 * shift)
    return w


def least_doc(stretches: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each stretch the least of `docs` for each of its windows, over all stretches that hold the window."""
    sizes = np.array([len(x) for x in stretches])
    text = np.frombuffer(b"".join(stretches), np.uint8)
    order = suffix_array(text.astype(np.int64) + 1, length)
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    fits = np.arange(len(text)) + length <= (base + sizes)[owner]
    order = order[fits[order]]
    w, p, q = _words(text), order[:-1], order[1:]
    same = np.ones(len(p), bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        same &= w[p + at] == w[q + at]
    start = np.flatnonzero(np.r_[True, ~same]) if len(order) else _NO
    least = np.zeros(len(text), np.int64)
    if len(order):
        m = np.minimum.reduceat(docs[owner[order]], start)
        least[order] = np.repeat(m, np.diff(np.r_[start, len(order)]))
    return [least[b : b + n - length + 1] for b, n in zip(base, sizes, strict=True)]


# --- anchors --------------------------------------------------------------------------------------


#: Windows looked at together; small enough that the arrays stay in a processor's cache.
_STEP = 1 << 14


class Anchors:
    """Anchors of all windows of some documents laid end to end: hash, document, and first and last window that each names."""

    def __init__(self, texts: list[bytes], length: int):
        self.bytes = b"".join(texts)
        ends = np.cumsum(np.array([len(t) for t in texts], np.int64))
        b = np.frombuffer(self.bytes, np.uint8)
        n = len(b) - length + 1
        whole = np.ones(max(0, n), bool)  # whether a window lies in one document
        for e in ends.tolist():
            whole[max(0, e - length + 1) : e] = False
        # what a window holds besides its anchor is at least `side` bytes long on one side of it
        side = -(-(length - KMER) // 2)
        wide = KMER + side
        hashes, firsts, befores, ats, lefts, rights = [], [], [], [], [], []
        anchor, window = -1, -1
        for a in range(0, n, _STEP):
            use = np.flatnonzero(whole[a : a + _STEP])
            if not len(use):
                continue
            h = b[a : a + _STEP + length - 1 + side].astype(np.uint64)
            by_power, power, have = {1: (h, _M)}, _M, 1
            with np.errstate(over="ignore"):
                while have * 2 <= wide:
                    h = h[: len(h) - have] * power + h[have:]
                    power, have = power * power, have * 2
                    by_power[have] = (h, power)
                h, _ = by_power[KMER]
                h = mix(h[: min(_STEP + length - KMER, len(b) - a - KMER + 1)])
                at = self._least(h, length - KMER + 1)[use]
                new = np.r_[at[0] + a != anchor, at[1:] != at[:-1]]
                at_new, first_new = at[new], use[new]
                # the anchor with `side` bytes before it, and with as many after it
                for places, out in ((at_new - side, lefts), (at_new, rights)):
                    places = np.clip(places, 0, max(0, len(b) - a - wide))
                    x, k = np.zeros(len(places), np.uint64), 0
                    for size in sorted(by_power, reverse=True):
                        while k + size <= wide:
                            part, power = by_power[size]
                            x = x * power + part[np.minimum(places + k, len(part) - 1)]
                            k += size
                    out.append(mix(x))
            hashes.append(h[at_new])
            ats.append(at_new + a)
            firsts.append(first_new + a)
            befores.append(np.r_[window, use[:-1] + a][new])
            anchor, window = int(at[-1]) + a, int(use[-1]) + a
        none = np.empty(0, np.uint64)
        self.hash, self.first, self.at = np.concatenate([none, *hashes]), np.concatenate([_NO, *firsts]), np.concatenate([_NO, *ats])
        self.last = np.r_[np.concatenate([_NO, *befores])[1:], window][: len(self.first)]
        self.doc = np.searchsorted(ends, self.first, side="right")
        self.left, self.right = np.concatenate([none, *lefts]), np.concatenate([none, *rights]) ^ _M
        self.has_left, self.has_right = self.at - self.first >= side, self.last + length - self.at >= wide

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of widened anchors, one of which each window holds, and their documents."""
        return np.concatenate([self.left[self.has_left], self.right[self.has_right]]), np.concatenate([self.doc[self.has_left], self.doc[self.has_right]])

    def with_keys(self, wanted: np.ndarray) -> np.ndarray:
        """Numbers of anchors that have one of the wanted keys."""
        return np.flatnonzero((self.has_left & np.isin(self.left, wanted)) | (self.has_right & np.isin(self.right, wanted)))

    @staticmethod
    def _least(h: np.ndarray, span: int) -> np.ndarray:
        """For each run of `span` hashes the place of the least, the first of equals: hash and place are one number."""
        m = (h & np.uint64(0xFFFFFFFFFFFF0000)) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while have * 2 <= span:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if span > have:
            m = np.minimum(m[: len(m) - (span - have)], m[span - have :])
        return (m & np.uint64(0xFFFF)).astype(np.int64)

    def stretch(self, i: int, length: int) -> bytes:
        return self.bytes[self.first[i] : self.last[i] + length]


def _texts(t: pa.Table, dropped: set[int]) -> tuple[list[int], list[bytes], np.ndarray]:
    rows, ids = t.column("row").to_pylist(), t.column("doc_id").to_numpy()
    keep = [i for i, r in enumerate(rows) if r not in dropped]
    raw = t.column("text").cast(pa.large_binary()).to_pylist()
    return keep, [raw[i] for i in keep], ids[keep]


def _split(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of `hashes` by bucket, and where each bucket lies in it."""
    if not len(hashes):
        return _NO, []
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, bucket[order[1:]] != bucket[order[:-1]]])
    return order, [(int(bucket[order[a]]), slice(a, z)) for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True)]


def _copies(right: pa.Table) -> set[int]:
    return {x for ids in right.column("copies").to_pylist() if ids for x in ids}


def whole_characters(parts: list[bytes]) -> bytes:
    """What lies between cuts, joined, without the halves of characters that were cut through; all else stays as it is."""
    out = []
    for i, x in enumerate(parts):
        if i:  # begins at a cut
            a = 0
            while a < len(x) and a < 3 and x[a] & 0xC0 == 0x80:
                a += 1
            x = x[a:]
        if i < len(parts) - 1:  # ends at one
            for back in range(1, min(3, len(x)) + 1):
                lead = x[-back]
                if lead & 0xC0 != 0x80:
                    if lead >= 0xC0 and back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                        x = x[:-back]
                    break
        out.append(x)
    return b"".join(out)


def _joined(right: pa.Table, name: str, kind) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(x, kind) for x in right.column(name).to_pylist() if x is not None)])


_ANCHOR = pa.schema([("bucket", pa.int64()), ("cell", pa.int64()), ("hashes", pa.binary()), ("many", pa.binary())])
_SHARED = pa.schema([("cell", pa.int64()), ("copies", pa.list_(pa.int64())), ("hashes", pa.binary())])
_STRETCH = pa.schema([("bucket", pa.int64()), ("cell", pa.int64()), ("hashes", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary())])
_ANSWER = pa.schema([("cell", pa.int64()), ("copies", pa.list_(pa.int64())), ("hashes", pa.binary()), ("names", pa.binary()), ("runs", pa.binary()), ("first", pa.binary()), ("end", pa.binary()), ("doc", pa.binary())])
_SQL = {pa.int64(): "bigint", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _stages(length: int, buckets: int, keep_text: bool, carry: tuple[str, ...]):
    def anchors(left: pa.Table, right: pa.Table) -> pa.Table:
        """Cell -> each anchor's hash once, to its bucket; `many`: it is in more than one document of the cell."""
        rows = []
        if left.num_rows:
            _, texts, ids = _texts(left, _copies(right))
            keys, doc = Anchors(texts, length).keys()
            order = np.argsort(keys, kind="stable")
            h, d = keys[order], ids[doc[order]] if len(order) else _NO
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else _NO
            many = (np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)).astype(np.uint8) if len(h) else np.empty(0, np.uint8)
            h, cell = h[start], left.column("cell")[0].as_py()
            order, parts = _split(h, buckets)
            rows = [{"bucket": b, "cell": cell, "hashes": h[order[s]].tobytes(), "many": many[order[s]].tobytes()} for b, s in parts]
        return pa.Table.from_pylist(rows, _ANCHOR)

    def shared(t: pa.Table) -> pa.Table:
        """Bucket -> to each cell, those of its anchors that are in more than one document."""
        cells = t.column("cell").to_numpy()
        hs = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        h, many = np.concatenate(hs), np.concatenate([np.frombuffer(x, np.uint8) for x in t.column("many").to_pylist()])
        order = np.argsort(h, kind="stable")
        s = h[order]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[start, len(s)])
        yes = np.repeat((size > 1) | (np.maximum.reduceat(many[order], start) > 0), size)
        flag = np.empty(len(h), bool)
        flag[order] = yes
        rows, at = [], 0
        for cell, x in zip(cells, hs, strict=True):
            got = x[flag[at : at + len(x)]]
            at += len(x)
            if len(got):
                rows.append({"cell": int(cell), "copies": None, "hashes": got.tobytes()})
        return pa.Table.from_pylist(rows, _SHARED)

    def stretches(left: pa.Table, right: pa.Table) -> pa.Table:
        """Cell -> distinct stretches of shared anchors with the least and greatest doc_id, to the anchors' buckets."""
        rows, wanted = [], _joined(right, "hashes", np.uint64)
        if left.num_rows and len(wanted):
            _, texts, ids = _texts(left, _copies(right))
            a = Anchors(texts, length)
            hit = a.with_keys(wanted)
            found: dict[bytes, list] = {}
            for i, h, d in zip(hit.tolist(), a.hash[hit].tolist(), ids[a.doc[hit]].tolist(), strict=True):
                x = a.stretch(i, length)
                r = found.get(x)
                if r is None:
                    found[x] = [h, d, d]
                else:
                    r[1], r[2] = min(r[1], d), max(r[2], d)
            keys, values = list(found), list(found.values())
            order, parts = _split(np.array([v[0] for v in values], np.uint64), buckets)
            cell = left.column("cell")[0].as_py()
            for b, s in parts:
                some = order[s].tolist()
                rows.append(
                    {
                        "bucket": b,
                        "cell": cell,
                        "hashes": np.array([values[i][0] for i in some], np.uint64).tobytes(),
                        "low": np.array([values[i][1] for i in some], np.int64).tobytes(),
                        "high": np.array([values[i][2] for i in some], np.int64).tobytes(),
                        "sizes": np.array([len(keys[i]) for i in some], np.uint32).tobytes(),
                        "text": b"".join(keys[i] for i in some),
                    }
                )
        return pa.Table.from_pylist(rows, _STRETCH)

    def answers(t: pa.Table) -> pa.Table:
        """Bucket -> sort the suffixes of its stretches; to each cell, the least doc_id of the windows of its stretches."""
        seen: dict[bytes, int] = {}
        low: list[int] = []
        anchor_of: list[int] = []
        asked = []
        for r in t.to_pylist():
            sizes = np.frombuffer(r["sizes"], np.uint32).tolist()
            own, at = [], 0
            hashes = np.frombuffer(r["hashes"], np.uint64)
            for n, d, h in zip(sizes, np.frombuffer(r["low"], np.int64).tolist(), hashes.tolist(), strict=True):
                x = r["text"][at : at + n]
                at += n
                k = seen.setdefault(x, len(low))
                if k == len(low):
                    low.append(d)
                    anchor_of.append(h)
                else:
                    low[k] = min(low[k], d)
                own.append(k)
            asked.append((r["cell"], hashes, own, np.frombuffer(r["high"], np.int64)))
        texts = list(seen)
        # equal windows have equal anchors: where an anchor has one stretch only, all its windows are that stretch's
        alone = np.zeros(len(texts), bool)
        _, at, n = np.unique(np.array(anchor_of, np.uint64), return_index=True, return_counts=True)
        alone[at[n == 1]] = True
        least = [np.full(len(x) - length + 1, d, np.int64) for x, d in zip(texts, low, strict=True)]
        several = np.flatnonzero(~alone).tolist()
        if several:
            for i, m in zip(several, least_doc([texts[i] for i in several], np.array(low, np.int64)[several], length), strict=True):
                least[i] = m
        names = [xxhash.xxh3_128_digest(x) for x in texts]
        runs = []
        for m in least:
            start = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
            runs.append((start, np.r_[start[1:], len(m)], m[start]))
        rows = []
        for cell, hashes, own, high in asked:
            use = [i for i, k in enumerate(own) if runs[k][2].min() < high[i]]
            if use:
                mine = [runs[own[i]] for i in use]
                rows.append(
                    {
                        "cell": cell,
                        "copies": None,
                        "hashes": hashes[use].tobytes(),
                        "names": b"".join(names[own[i]] for i in use),
                        "runs": np.array([len(r[0]) for r in mine], np.uint32).tobytes(),
                        "first": np.concatenate([r[0] for r in mine]).astype(np.uint32).tobytes(),
                        "end": np.concatenate([r[1] for r in mine]).astype(np.uint32).tobytes(),
                        "doc": np.concatenate([r[2] for r in mine]).astype(np.int64).tobytes(),
                    }
                )
        return pa.Table.from_pylist(rows, _ANSWER)

    def marked(left: pa.Table, right: pa.Table) -> pa.Table:
        """Cell -> its documents with what is removed from them."""
        copies = _copies(right)
        keep, texts, ids = _texts(left, copies) if left.num_rows else ([], [], _NO)
        hits: list[list[tuple[int, int]]] = [[] for _ in texts]
        hashes = _joined(right, "hashes", np.uint64)
        if len(hashes) and len(texts):
            names = b"".join(x for x in right.column("names").to_pylist() if x is not None)
            count, first, end = (_joined(right, c, np.uint32) for c in ("runs", "first", "end"))
            doc = _joined(right, "doc", np.int64)
            stop = np.cumsum(count)
            at = {names[16 * i : 16 * i + 16]: (int(z - c), int(z)) for i, (c, z) in enumerate(zip(count.tolist(), stop.tolist(), strict=True))}
            a = Anchors(texts, length)
            base = np.cumsum([0, *(len(x) for x in texts)])
            hit = np.flatnonzero(np.isin(a.hash, hashes))
            for i, d in zip(hit.tolist(), a.doc[hit].tolist(), strict=True):
                span = at.get(xxhash.xxh3_128_digest(a.stretch(i, length)))
                if span:
                    own, begin = ids[d], int(a.first[i] - base[d])
                    for k in range(*span):
                        if doc[k] < own:
                            hits[d].append((begin + int(first[k]), begin + int(end[k]) - 1 + length))
        out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "cut_text")}
        place = {r: i for i, r in enumerate(keep)}
        raw = left.column("text").cast(pa.large_binary()).to_pylist()
        all_ids = left.column("doc_id").to_pylist()
        for r, x in enumerate(raw):
            spans: list[list[int]] = []
            if r in place:
                for s, e in sorted(hits[place[r]]):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], e)
                    else:
                        spans.append([s, e])
            elif len(x) >= length:
                spans = [[0, len(x)]]
            parts, last = [], 0
            for s, e in spans:
                parts.append(x[last:s])
                last = e
            parts.append(x[last:])
            left_over = b"".join(parts)
            out["doc_id"].append(all_ids[r])
            out["n_bytes"].append(len(x))
            out["n_removed"].append(len(x) - len(left_over))
            out["n_spans"].append(len(spans))
            out["kept_sha256"].append(hashlib.sha256(left_over).hexdigest())
            out["spans"].append([{"start": s, "end": e} for s, e in spans])
            out["kept"].append(left_over if keep_text else None)
            out["cut_text"].append(whole_characters(parts).decode("utf-8", "replace") if keep_text and spans else None)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary(), pa.string()]
        return pa.table([*(pa.array(v, t) for v, t in zip(out.values(), types, strict=True)), *(left.column(c) for c in carry)], [*out, *carry])

    return tuple(map(trimmed, (anchors, shared, stretches, answers, marked)))


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, kept binary, cut_text string"


def dedup(documents: DataFrame, length: int = LENGTH, cell_bytes: int = CELL_BYTES, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte runs) of each row, and the remaining bytes as `kept` if asked for.

    With the bytes comes, for rows with spans, `cut_text`: the same as text, without the halves of characters at the edges of the spans.
    Columns named in `carry` stay with their row.
    """
    if not KMER + 8 <= length <= 1 << 14:
        raise ValueError(f"strings of {KMER + 8} to {1 << 14} bytes are looked for")
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry)
    small = docs.where(F.octet_length("text") >= length).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("row"), F.unhex(F.md5("text")).alias("content"), F.octet_length("text").cast("bigint").alias("n")
    )
    lead = small.groupBy("content").agg(F.min("doc_id").alias("lead"), F.sum("n").alias("n"))
    lead = cut(lead)
    total = lead.agg(F.sum("n")).first()[0] or 0
    cells = parts_for(total, cell_bytes)
    kind = dict(docs.dtypes)
    anchors, shared, stretches, answers, marked = _stages(length, cells, keep_text, carry)
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(cells)).alias("cell")
    copies = small.join(lead.select("content", "lead"), "content").where("doc_id > lead").groupBy(cell).agg(F.collect_set("row").alias("copies"))
    copies = cut(copies)
    known = docs.where("doc_id is not null").select(cell, "doc_id", F.xxhash64("doc_id", "text").alias("row"), "text", *carry).groupBy("cell")
    nothing = [F.lit(None).cast("binary").alias(f.name) for f in _ANSWER][2:]
    to_bucket = known.cogroup(copies.groupBy("cell")).applyInArrow(anchors, _ddl(_ANCHOR))
    in_two = to_bucket.groupBy("bucket").applyInArrow(shared, _ddl(_SHARED))
    sent = known.cogroup(in_two.unionByName(copies.select("cell", "copies", nothing[0])).groupBy("cell")).applyInArrow(stretches, _ddl(_STRETCH))
    answered = sent.groupBy("bucket").applyInArrow(answers, _ddl(_ANSWER))
    result = known.cogroup(answered.unionByName(copies.select("cell", "copies", *nothing)).groupBy("cell")).applyInArrow(marked, ", ".join([_RESULT, *(f"{c} {kind[c]}" for c in carry)]))
    nameless = docs.where("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.encode("text", "utf-8").alias("kept"), F.lit(None).cast("string").alias("cut_text"), *carry,
    )
    result = result.unionByName(nameless)
    return result if keep_text else result.drop("kept", "cut_text")


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> dict[int, list[tuple[int, int]]]:
    """Removed runs by looking every window up, for tests."""
    first: dict[bytes, int] = {}
    texts = sorted((i, (t or "").encode("utf-8", "surrogatepass")) for i, t in rows)
    for i, b in texts:
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = {}
    for i, b in texts:
        runs: list[list[int]] = []
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                if runs and p <= runs[-1][1]:
                    runs[-1][1] = p + length
                else:
                    runs.append([p, p + length])
        out[i] = [tuple(r) for r in runs]
    return out
