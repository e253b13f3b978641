"""Near-duplicate groups by DartMinHash signatures, banding, exact verification and label propagation.

Signature: a document is a weighted set of its five-word shingles. Darts fall on the plane of
(weight, rank) of every element: the plane is cut into regions whose area is one, each region holds a
Poisson(1) number of darts that are fixed by a hash of (element, region, number). A dart counts if it
lies under the element's weight and its rank is under the set's threshold; each is assigned to one of
k coordinates, and the earliest dart per coordinate is that coordinate's min-hash. Two sets agree on a
coordinate with the probability of their weighted Jaccard similarity. About k ln k darts are drawn for
a whole set, whatever its size, instead of k for every element.

The query uses weight 1 for every distinct shingle ("set"), whose weighted Jaccard is the plain
Jaccard that a similarity of 0.8 is measured with; "count" weighs by occurrences.

Pairs: equal shingle sets are folded first (one representative each). Representatives that share a
band's hash form a bucket. All members of a bucket are compared with its first one, and linked ones get
one label. In buckets that are then still split between components, members outside the largest one
are compared with those of all other components, block by block: a task holds two blocks of bounded
size, gets all overlaps of their shingle sets by one matrix product and returns at most one link for a
member and component, so pairs are never rows. Every link rests on the exact shingle sets. Groups are
the connected components of links.

How it scales: text is read once for the signatures and once, for documents in some bucket only, for
the shingle sets, which are kept in the checkpoint folder; exact copies meet in a map-side combined
aggregate; the first comparison is linear in a bucket's size and a lead's set travels once for each
`SALT` members, not once for each pair; of a hot bucket only the members that its largest component
doesn't hold meet the others, in as many tasks as there are pairs of blocks; nothing is collected to
the driver but row counts.

Defined results: null text counts as empty; texts without words all have the empty shingle set and
are one group; fewer than five words are one shingle; rows with equal doc_id are treated as one
document (that with the greatest digest); a null doc_id takes no part; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

WORDS, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 32, 6, 7
#: Members that share one copy of a lead's shingles; members and shingles of one block.
SALT, BLOCK_MEMBERS, BLOCK_SHINGLES = 64, 1024, 1 << 19

_MUL = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _poisson_table() -> np.ndarray:
    """Poisson(1) counts by 16 random bits."""
    p, below, table = np.exp(-1.0), 0.0, np.zeros(1 << 16, np.uint8)
    for n in range(1, 9):
        below += p
        table[int(round(below * (1 << 16))) :] = n
        p /= n
    return table


_POISSON = _poisson_table()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: equal inputs, equal outputs; near inputs, unrelated outputs."""
    with np.errstate(over="ignore"):
        x = x + _MUL
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(1 << 32))
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_LETTERS = np.zeros(256, np.int32)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_P = 0x5851F42D4C957F2D


class Shingler:
    """64-bit hashes of a text's word shingles: lower case, words parted by ASCII white space.

    Word hashes are differences of one running polynomial over the text's bytes, so the work is a
    few passes over an array, whatever the vocabulary.
    """

    def __init__(self, words: int = WORDS):
        self.words, self.powers, self.inverses = words, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if n <= len(self.powers):
            return
        n = max(n, 1 << 14, len(self.powers) * 2)
        with np.errstate(over="ignore"):
            for name, p in (("powers", _P), ("inverses", pow(_P, -1, 1 << 64))):
                a = np.full(n, p, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def word_hashes(self, text: str) -> np.ndarray:
        b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
        part = np.diff(np.r_[True, _SPACE[b], True].view(np.int8))
        starts, ends = np.flatnonzero(part == -1), np.flatnonzero(part == 1)
        if not len(starts):
            return np.empty(0, np.uint64)
        self._reach(len(b) + 1)
        with np.errstate(over="ignore"):
            run = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_BYTES[b] * self.powers[: len(b)], out=run[1:])
            return mix((run[ends] - run[starts]) * self.inverses[starts])

    def scan(self, text: str) -> tuple[np.ndarray, int, np.ndarray]:
        """Word hashes (ASCII case folded only), how many words hold a letter (or anything beyond ASCII), and how often each byte occurs."""
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        part = np.diff(np.r_[True, _SPACE[b], True].view(np.int8))
        starts, ends = np.flatnonzero(part == -1), np.flatnonzero(part == 1)
        self._reach(len(b) + 1)
        run, letters = np.zeros(len(b) + 1, np.uint64), np.zeros(len(b) + 1, np.int32)
        with np.errstate(over="ignore"):
            np.cumsum(_FOLDED[b] * self.powers[: len(b)], out=run[1:])
            h = mix((run[ends] - run[starts]) * self.inverses[starts])
        np.cumsum(_LETTERS[b], out=letters[1:])
        return h, int((letters[ends] > letters[starts]).sum()), np.bincount(b, minlength=256)

    def all(self, text: str) -> np.ndarray:
        h = self.word_hashes(text)
        if not len(h):
            return h
        n = max(1, len(h) - self.words + 1)
        with np.errstate(over="ignore"):
            out = np.full(n, min(self.words, len(h)), np.uint64)
            for i in range(min(self.words, len(h))):
                out = out * _M1 + h[i : i + n]
        return mix(out)

    def set(self, text: str) -> np.ndarray:
        x = np.sort(self.all(text))
        return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x

    def weighted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        x, n = np.unique(self.all(text), return_counts=True)
        return x, n.astype(float)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * (1.0 / (1 << 53))


def signatures(sets: list[tuple[np.ndarray, np.ndarray | None]], k: int, seed: int = SEED) -> np.ndarray:
    """k min-hashes (64-bit names of darts) of each weighted set (elements, weights; weights None is 1 for each). Zeros for an empty set."""
    name = np.zeros((len(sets), k), np.uint64)
    sizes = np.array([len(x) for x, _ in sets])
    darts = k * np.log(k) + 2 * k
    full = np.flatnonzero(sizes)
    room = np.cumsum(np.maximum(sizes[full], darts))
    for part in np.split(full, np.flatnonzero(np.diff(room // 50_000)) + 1):
        if len(part):
            name[part] = _signatures([sets[i] for i in part], k, darts, seed)
    return name


def _signatures(sets, k, darts, seed):
    elements = np.concatenate([x for x, _ in sets])
    owner = np.repeat(np.arange(len(sets)), [len(x) for x, _ in sets])
    weights = None if sets[0][1] is None else np.concatenate([w for _, w in sets])
    total = np.bincount(owner, weights=weights).astype(float)
    best, name = np.full(len(sets) * k, np.inf), np.zeros(len(sets) * k, np.uint64)
    # the rank bound under which so many darts are expected; raised for sets with a coordinate still empty
    lower, upper = np.zeros(len(sets)), darts / total
    while True:
        _throw(elements, weights, owner, lower, upper, k, best, name, seed)
        open_ = ~np.isfinite(best.reshape(-1, k)).all(1)
        if not open_.any():
            return name.reshape(-1, k)
        lower = upper.copy()
        upper = np.where(open_, upper * 2, upper)
        has = open_[owner]
        elements, owner, weights = elements[has], owner[has], None if weights is None else weights[has]


def _throw(elements, weights, owner, lower, upper, k, best, name, seed):
    """Darts of rank [lower, upper) of each set. Weights are cut in slabs [0,1), [1,2), [2,4), ..., each slab in strips of rank so that a region's area is one."""
    slab, w_low, width = 0, 0.0, 1.0
    while True:
        if weights is not None:
            who = weights > w_low
            elements, owner, weights = elements[who], owner[who], weights[who]
        if not len(elements):
            return
        first = np.floor(lower[owner] * width).astype(np.int64)
        n = np.ceil(upper[owner] * width).astype(np.int64) - first
        region = np.repeat(np.arange(len(elements)), n)
        strip = np.arange(len(region)) - np.repeat(np.cumsum(n) - n, n) + first[region]
        with np.errstate(over="ignore"):
            key = mix(mix(elements)[region] ^ mix(strip.astype(np.uint64) * np.uint64(64) + np.uint64(slab) + np.uint64(seed) * _M1))
            count = _POISSON[key >> np.uint64(48)].astype(np.int64)
            at = np.repeat(np.arange(len(key)), count)
            j = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            dart = mix(key[at] + _MUL * (j.astype(np.uint64) + np.uint64(1)))
        rank = (strip[at] + _unit(dart)) / width
        own = owner[region[at]]
        keep = (rank >= lower[own]) & (rank < upper[own])
        if weights is not None:
            keep &= w_low + _unit(mix(dart ^ np.uint64(1))) * width < weights[region[at]]
        dart, rank, own = dart[keep], rank[keep], own[keep]
        cell = own * k + (mix(dart) % np.uint64(k)).astype(np.int64)
        was = best[cell]
        np.minimum.at(best, cell, rank)
        won = (rank == best[cell]) & (rank < was)
        name[cell[won]] = dart[won]
        if weights is None:
            return
        slab, w_low, width = slab + 1, w_low + width, width * (2 if slab else 1)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.arange(1, bands + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = mix(out * _MUL + sig.reshape(bands, rows)[:, r])
    return out.view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signer(words: int, bands: int, rows: int, weighting: str, seed: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches):
            ids, out = batch.column("doc_id").to_pylist(), []
            sets = [shingler.weighted(text or "") if weighting == "count" else (shingler.set(text or ""), None) for text in batch.column("text").to_pylist()]
            signed = signatures(sets, bands * rows, seed)
            for (x, w), sig in zip(sets, signed, strict=True):
                content = xxhash.xxh3_128_digest(x.tobytes() + (b"" if w is None else w.tobytes()))
                out.append((content, len(x), band_hashes(sig, bands, rows) if len(x) else []))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int64()))],
                ["doc_id", "content", "n", "bands"],
            )

    return sign


def _setter(words: int, weighting: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in slices(batches):
            out = []
            for text in batch.column("text").to_pylist():
                x, w = shingler.weighted(text or "") if weighting == "count" else (shingler.set(text or ""), None)
                out.append(x.tobytes() + (b"" if w is None else w.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "shingles"])

    return make


def _similarity(a: bytes, b: bytes, weighting: str) -> float:
    if weighting == "set":
        return jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))
    n, m = len(a) // 16, len(b) // 16
    x, y = np.frombuffer(a[: 8 * n], np.uint64), np.frombuffer(b[: 8 * m], np.uint64)
    v, w = np.frombuffer(a[8 * n :], float), np.frombuffer(b[8 * m :], float)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = np.minimum(v[i], w[j]).sum()
    return float(least / (v.sum() + w.sum() - least)) if len(v) or len(w) else 1.0


def _verifier(weighting: str):
    """Rows of each (a, salt) follow one another: first the lead's shingles (b null), then one row for each b with its own."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for batch in slices(batches):
            out = []
            for a, b, x in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("shingles"), strict=True):
                if b is None:
                    lead = (a, x.as_py())
                elif lead is not None and lead[0] == a:
                    out.append((a, b, _similarity(lead[1], x.as_py(), weighting)))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["a", "b", "s"])

    return verify


def _crossing(left: list[bytes], right: list[bytes], left_own: np.ndarray, right_own: np.ndarray, similarity: float, weighting: str) -> Iterator[tuple[int, int]]:
    """Pairs (of a left and a right number) that are similar enough and of different components, one for each left member and component on the right."""
    if weighting != "set":
        for i, x in enumerate(left):
            met = {int(left_own[i])}
            for j, y in enumerate(right):
                if int(right_own[j]) not in met and _similarity(x, y, weighting) >= similarity:
                    met.add(int(right_own[j]))
                    yield i, j
        return
    a, b = ([np.frombuffer(x, np.uint64) for x in side] for side in (left, right))
    na, nb = (np.array([len(x) for x in side]) for side in (a, b))
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    both = np.zeros((len(a), len(b)), np.float32)  # counts below 2^24 are exact
    for start in range(0, len(shared), 4096):
        columns = shared[start : start + 4096]
        sides = []
        for side in (a, b):
            m = np.zeros((len(side), len(columns)), np.float32)
            for k, x in enumerate(side):
                some = x[np.searchsorted(x, columns[0]) : np.searchsorted(x, columns[-1], side="right")]
                at = np.searchsorted(columns, some)
                m[k, at[columns[at] == some]] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    near = both >= similarity * (na[:, None] + nb[None, :] - both) - 1e-3
    near &= left_own[:, None] != right_own[None, :]
    for i in np.flatnonzero(near.any(1)).tolist():
        js = np.flatnonzero(near[i])
        js = js[[both[i, j] / (na[i] + nb[j] - both[i, j]) >= similarity for j in js.tolist()]]
        for j in js[np.unique(right_own[js], return_index=True)[1]].tolist():
            yield i, j


def _blocks(similarity: float, weighting: str):
    """Rows of each (band, h, i, j) follow one another; links between those of the minor side and the others."""
    key_of = ("band", "h", "i", "j")

    def links(rows: list[tuple[bool, int, int, bytes]]) -> Iterator[tuple[int, int]]:
        left, right = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        if left and right:
            own = [np.array([r[2] for r in side], np.int64) for side in (left, right)]
            for i, j in _crossing([r[3] for r in left], [r[3] for r in right], *own, similarity, weighting):
                yield left[i][1], right[j][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            keys = zip(*(batch.column(c).to_pylist() for c in key_of), strict=True)
            for key, minor, rep, own, x in zip(keys, *(batch.column(c).to_pylist() for c in ("minor", "rep", "own")), batch.column("shingles"), strict=True):
                if key != now:
                    out += links(rows)
                    now, rows = key, []
                rows.append((minor, rep, own, x.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])
        out = list(links(rows))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    return run


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, label): the least node of each connected component of `edges` (a, b); nodes without edges are left out.

    Every round hands each node the least label around it and then jumps to that label's own label, so
    that a chain of n nodes takes about log n rounds, not n.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = cut(lower.join(jump, "mid", "left").select("node", "was", F.least("mid", "far").alias("label")))
        labels = new.select("node", "label")
        if new.where("was <> label").isEmpty():
            return labels
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def groups(
    documents: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
    weighting: str = "set", seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, class_id (the least doc_id of its group), is_kept (whether it is that one)."""
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    signed = cut(docs.mapInArrow(_signer(words, bands, rows, weighting, seed), "doc_id bigint, content binary, n bigint, bands array<bigint>"))
    one = signed.groupBy("doc_id").agg(F.max(F.struct("content", "n", "bands")).alias("x")).select("doc_id", "x.*")
    folded = cut(one.groupBy("content").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "bands"))))
    in_band = folded.where("n > 0").select("rep", "n", F.posexplode("bands").alias("band", "h"))
    bucket = in_band.groupBy("band", "h").agg(F.count("*").alias("size"), F.min("rep").alias("lead")).where("size > 1").select("band", "h", "lead")
    member = cut(in_band.join(bucket, ["band", "h"]).select("band", "h", "lead", "rep", "n"))
    named = member.select(F.col("rep").alias("doc_id")).distinct()
    sets = cut(docs.join(named, "doc_id", "left_semi").mapInArrow(_setter(words, weighting), "doc_id bigint, shingles binary"))

    # the first comparison: a lead's set meets its members in tasks of about SALT members
    pairs = cut(member.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct())
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    salted = cut(pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt")))
    heads = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("doc_id")).select("a", F.lit(None).cast("bigint").alias("b"), "salt", "shingles")
    others = salted.join(sets, F.col("b") == F.col("doc_id")).select("a", "b", "salt", "shingles")
    together = heads.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    linked = cut(together.mapInArrow(_verifier(weighting), "a bigint, b bigint, s double").where(F.col("s") >= similarity).select("a", "b"))
    label = components(linked).select(F.col("node").alias("rep"), F.col("label").alias("own"))

    # the second: buckets that are still split, members outside the largest component against those of the others
    graded = cut(member.join(label, "rep", "left").select("band", "h", "rep", "n", F.coalesce("own", "rep").alias("own")))
    per = graded.groupBy("band", "h", "own").agg(F.count("*").alias("size"), F.sum("n").alias("n_all"))
    split = per.groupBy("band", "h").agg(F.count("*").alias("parts"), F.max(F.struct("size", "own", "n_all")).alias("main"), F.sum("size").alias("size"), F.sum("n_all").alias("n_all")).where("parts > 1")

    def n_blocks(size, n):
        return F.greatest(F.ceil(size / BLOCK_MEMBERS), F.ceil(n / BLOCK_SHINGLES)).cast("bigint")

    split = cut(
        split.select(
            "band", "h", F.col("main.own").alias("main"), n_blocks(F.col("size"), F.col("n_all")).alias("all_blocks"), n_blocks(F.col("size") - F.col("main.size"), F.col("n_all") - F.col("main.n_all")).alias("minor_blocks")
        )
    )
    if not split.isEmpty():
        rest = graded.join(split, ["band", "h"])
        spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
        block = lambda n: F.pmod(F.xxhash64("rep", "band"), F.col(n))
        minor = rest.where("own <> main").select("band", "h", block("minor_blocks").alias("i"), spread("all_blocks").alias("j"), F.lit(True).alias("minor"), "rep", "own")
        every = rest.select("band", "h", spread("minor_blocks").alias("i"), block("all_blocks").alias("j"), F.lit(False).alias("minor"), "rep", "own")
        facing = minor.unionByName(every).join(sets, F.col("rep") == F.col("doc_id")).drop("doc_id")
        facing = facing.repartition("band", "h", "i", "j").sortWithinPartitions("band", "h", "i", "j")
        crossed = cut(facing.mapInArrow(_blocks(similarity, weighting), "a bigint, b bigint").distinct())
        label = components(linked.unionByName(crossed)).select(F.col("node").alias("rep"), F.col("label").alias("own"))

    found = folded.select("content", "rep")
    found = found.join(label, "rep", "left").select("content", F.coalesce("own", "rep").alias("class_id"))
    return one.select("doc_id", "content").join(found, "content").select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("is_kept"))


def brute_force(rows: list[tuple[int, str | None]], words: int = WORDS, similarity: float = SIMILARITY) -> dict[int, int]:
    """Groups by comparing all pairs, for tests."""
    s = Shingler(words)
    sets = {i: s.set(t or "") for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            la, lb = len(sets[a]), len(sets[b])
            if min(la, lb) >= similarity * max(la, lb) and jaccard(sets[a], sets[b]) >= similarity:
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in ids}
