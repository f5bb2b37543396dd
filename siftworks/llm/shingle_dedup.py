"""Near-duplicates by SimHash and by shared five-word shingles: exact at similarity (Jaccard) LEAST or more.

Fingerprints within simhash.RADIUS bits give the first candidates, found by the covering masks of simhash.py. So
few bits hold only the nearest copies (0.8 is about 10 bits apart), so candidates by shingles follow, which no
pair of similarity LEAST escapes. All candidates go through one exact check.

A document is the set of its SHINGLE-word shingles, hashed and lower-cased (A-Z); documents of equal sets
are one class. Two sets of similarity 0.8 share 0.8 of either, so with all shingles in one order, the first
n - ceil(0.8 n) + 1 of each hold a common one: only these heads are exchanged. The order is that of the
hashes, but shingles that crowd the heads (license lines, say) come last, whatever their hash. What meets
under a head shingle and may reach 0.8 by its size and place is a candidate. Candidates are checked twice:
on sketches (each shingle turns one bit, so two sketches differ in at most as many bits as the sets in
shingles, and a pair that they refuse is none), and those that pass on the whole sets.

Scale: texts are never shuffled. Sets are made again from the texts in each pass, which costs less than
keeping them. Heads, a fifth of the shingles, travel packed: a task sends each bucket of shingles arrays of
24 bytes a head. Whole sets travel for likely pairs alone. A shingle with more than SMALL classes gives stars
of candidates, not all pairs: their middles are the classes of least hash, so that shingles of the same
classes agree on them. Once these are joined to components, only members of different components are paired,
as far as their sketches (there at most MOST_SKETCH bits) let them. Of these pairs a round takes a spanning
forest of the components, likeliest pairs first, so it checks fewer pairs than it reads rows; what it leaves
is read again with the components that are then known. Groups of near copies become one component in these
FORESTS rounds; the last round takes every pair that is still between two components, so none is lost. No task holds all members of a shingle
that is in very many heads: above WIDE heads they go to several buckets by their classes, each of which reports
its members, and above TILE members they are paired in tiles of two blocks, by classes of size and by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import bounded_batches, connected_components, stage, unstage
from ._text import Roller, Words, mix, text_slices, trim, trimmed, word_hashes
from .simhash import fingerprint_links, fingerprints_of

SHINGLE = 5
#: Similarity as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)
SMALL = 16
#: Shingles in so many heads come last in the order; at most so many are broadcast (8 bytes each).
HOT, MOST_HOT, HOT_ROUNDS = 64, 1 << 20, 2
#: Heads are counted in one of so many texts, by hash; which come last changes the work, not the result.
SAMPLED = 8
#: Heads of a bucket, and heads that a task gathers before it sends them (24 bytes each).
BUCKET_HEADS, HELD_HEADS, LEAST_BUCKETS = 1 << 20, 1 << 20, 128
#: A shingle in more heads than WIDE is spread over buckets; one of more members than TILE is paired in blocks of so many.
WIDE, TILE = BUCKET_HEADS // 4, 8192
#: Shingles of so many members are broadcast (some 200 bytes each); above, a join finds their blocks.
MOST_TILED = 1 << 17
#: Bits of a sketch: at least so many, and a power of two of twice the set's size or more.
SKETCH, MOST_SKETCH = 512, 4096
#: Of the crowded shingles of a class, so many are known wherever it is paired.
FIRST = 8
#: Rounds in which crowded shingles give forests; the last round gives all pairs that are left.
FORESTS = 2
#: Candidates of a tile that are held at once.
HELD_PAIRS = 100_000
#: Candidates' classes up to so many are broadcast (8 bytes each); above, a join picks their sets.
MOST_IDS = 4 << 20

_SHINGLES = Roller(52)
_U = np.uint64
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def _least_shared(n: np.ndarray) -> np.ndarray:
    return -(-n * LEAST[0] // LEAST[1])


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of some texts, and bounds: text i has bounds[i]:bounds[i+1].

    A text of fewer than SHINGLE words is one shingle; one without words has none.
    """
    data = _LOWERED[data]
    w = Words(data, offsets)
    words = word_hashes(data, w.starts, w.ends, 51)
    n = np.diff(w.bounds)
    doc = w.doc_of_word()
    at = np.arange(len(words))
    stop = np.minimum(at + SHINGLE, w.bounds[1:][doc])
    ok = (stop - at == SHINGLE) | ((at == w.bounds[:-1][doc]) & (n[doc] < SHINGLE))
    doc, h = doc[ok], _SHINGLES.ranges(words, at[ok], stop[ok]).view(np.int64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(offsets)))


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the first text, classes, shingles, bounds) of runs of texts."""
    for row0, data, offsets in text_slices(column):
        h, bounds = shingle_sets(data, offsets)
        sums = np.concatenate((np.zeros(1, dtype=_U), np.cumsum(mix(h.view(_U) ^ _U(SHINGLE)), dtype=_U)))
        yield row0, mix(sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64), h, bounds


def _sketches(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The sketch of each set: bit x is the parity of the shingles whose hash ends in x."""
    n = np.diff(bounds)
    bits = np.maximum(SKETCH, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    ends = np.cumsum(bits)
    doc = np.repeat(np.arange(len(n)), n)
    place = (h & (bits - 1)[doc]) + (ends - bits)[doc]
    raw = np.packbits(np.bincount(place, minlength=int(ends[-1]) if len(ends) else 0) & 1, bitorder="little").tobytes()
    return [raw[(e - b) // 8 : e // 8] for e, b in zip(ends.tolist(), bits.tolist(), strict=True)]


def _folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of the same set with fewer bits, ``size`` bytes of them."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size), axis=0)


@trimmed
def _class_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row0, c, h, bounds in _sets(b.column(1)):
            fp = fingerprints_of(b.column(1).slice(row0, len(c)).cast(pa.large_binary()).to_pylist()).view(np.int64)
            columns = [b.column(0).slice(row0, len(c)), pa.array(c), pa.array(np.diff(bounds)), pa.array(_sketches(h, bounds), pa.binary()), pa.array(fp)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "c", "n", "s", "fp"])


def class_table(docs: DataFrame) -> DataFrame:
    """doc_id, c, the class, n, the size of its set, s, its sketch, and fp, the SimHash fingerprint, of every row."""
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_class_batches, "doc_id long, c long, n long, s binary, fp long")


def by_fingerprint(sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Candidates (u, v) among classes whose fingerprints are equal or linked, and the tables to unstage after use.

    The classes of one fingerprint give a star, as linked fingerprints do.
    """
    own = sets.select("fp", "c").distinct()
    lows = stage(own.groupBy("fp").agg(F.min("c").alias("low")), "shingle-fp")
    equal = own.join(lows, "fp").where("c <> low").select(F.col("c").alias("u"), F.col("low").alias("v"))
    links, staged = fingerprint_links(lows)
    for x in ("u", "v"):
        links = links.join(lows.select(F.col("fp").alias(x), F.col("low").alias("low" + x)), x)
    near = links.where("lowu <> lowv").select(F.least("lowu", "lowv").alias("u"), F.greatest("lowu", "lowv").alias("v"))
    return equal.union(near).distinct(), [lows, *staged]


def _head_arrays(column: pa.Array, late: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Columns k, c, n, p of the heads of some texts, p the shingle's place in the order; ``late`` (sorted) comes last."""
    for _, c, h, bounds in _sets(column):
        n = np.diff(bounds)
        own = np.zeros(len(c), dtype=bool)
        own[np.unique(c, return_index=True)[1]] = True  # copies in a batch send their heads once
        doc = np.repeat(np.arange(len(n)), n)
        if len(late) and len(h):
            spot = np.minimum(np.searchsorted(late, h), len(late) - 1)
            h = h[np.lexsort((h, late[spot] == h, doc))]
        p = np.arange(len(h)) - bounds[:-1][doc]
        keep = p <= (n - _least_shared(n))[doc]
        keep &= (own & (n >= LEAST[0]))[doc]  # smaller sets reach LEAST only when equal
        doc = doc[keep]
        yield [h[keep], c[doc], n[doc].astype(np.int32), p[keep].astype(np.int32)]


def _heads(texts: DataFrame, hot: np.ndarray, spread: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """bucket, k, c, n, p: packed columns of the heads of all texts, by buckets of k, and of c for shingles spread."""
    bounded_batches(texts.sparkSession)
    shared, wide = map(texts.sparkSession.sparkContext.broadcast, (hot, spread))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            own = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            # the high half of a hash picks the bucket
            where = own[0].view(_U).copy()
            spot = _spots(own[0], wide.value[0])
            if (spot >= 0).any():
                at = np.flatnonzero(spot >= 0)
                part = mix(own[1][at].view(_U)) % wide.value[1][spot[at]].astype(_U)
                where[at] = mix(where[at] ^ mix(part + _U(1)))
            b = ((where >> _U(32)) * _U(buckets)) >> _U(32)
            order = np.lexsort((own[1], own[0].view(_U), b))
            own, b = [x[order] for x in own], b[order].astype(np.int32)
            cut = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b))
            packed = [pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in own]
            return pa.RecordBatch.from_arrays([pa.array(b[cut[:-1]]), *packed], names=["bucket", "k", "c", "n", "p"])

        for batch in batches:
            for own in _head_arrays(batch.column(0), shared.value):
                if len(own[0]):
                    held.append(own)
                    size += len(own[0])
                if size >= HELD_HEADS:
                    yield sent()
                    size = 0
        if held:
            yield sent()

    return texts.mapInArrow(run, "bucket int, k binary, c binary, n binary, p binary")


def _spots(k: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Where each of k stands in a sorted array, or -1."""
    if not len(among):
        return np.full(len(k), -1)
    spot = np.minimum(np.searchsorted(among, k), len(among) - 1)
    return np.where(among[spot] == k, spot, -1)


def _whole(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """c, s: the set of each class in ``ids`` (column c), once, as sorted hashes."""
    shared = None
    if ids.count() <= MOST_IDS:
        shared = texts.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column("c").to_numpy()))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in batches:
            for _, c, h, bounds in _sets(b.column(0)):
                chosen = np.arange(len(c)) if shared is None else np.flatnonzero(np.isin(c, shared.value))
                out: list[list] = [[], []]
                for i in chosen.tolist():
                    if shared is None or int(c[i]) not in sent:
                        sent.add(int(c[i]))
                        out[0].append(c[i])
                        out[1].append(h[bounds[i] : bounds[i + 1]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], names=["c", "s"])

    own = texts.mapInArrow(run, "c long, s binary")
    return (own if shared is not None else own.join(ids, "c", "left_semi")).groupBy("c").agg(F.first("s").alias("s"))


def _hot(texts: DataFrame, least: int = HOT, wide: int = WIDE) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Shingles that stand in more than ``least`` heads; those that they make room for are counted in turn.

    Also those in more than ``wide`` heads in any count, and over how many buckets to spread each.
    """
    hot = np.zeros(0, dtype=np.int64)
    parts: dict[int, int] = {}
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    bounded_batches(texts.sparkSession)
    for _ in range(HOT_ROUNDS):
        shared = texts.sparkSession.sparkContext.broadcast(hot)

        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for own in _head_arrays(b.column(0), shared.value):  # noqa: B023
                    yield pa.RecordBatch.from_arrays([pa.array(own[0])], names=["k"])

        crowded = some.mapInArrow(run, "k long").groupBy("k").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") * SAMPLED > least)
        most = crowded.orderBy(F.desc("m"), "k").limit(MOST_HOT).toArrow()
        found, heads = most.column("k").to_numpy(), most.column("m").to_numpy() * SAMPLED
        for k, m in zip(found[heads > wide].tolist(), heads[heads > wide].tolist(), strict=True):
            parts[k] = max(parts.get(k, 0), -(-m // wide))
        more = np.union1d(hot, found)
        if len(more) == len(hot) or len(more) > MOST_HOT:
            break
        hot = more
    keys = np.array(sorted(parts), dtype=np.int64)
    return hot, (keys, np.array([parts[k] for k in keys.tolist()], dtype=np.int64))


def _may_reach(n: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs that can share enough if the shingle at p is the first that they share."""
    need = -(-LEAST[0] * (n[i] + n[j]) // (LEAST[0] + LEAST[1]))
    enough = np.minimum(n[i], n[j]) * LEAST[1] >= np.maximum(n[i], n[j]) * LEAST[0]
    return enough & (np.minimum(n[i] - p[i], n[j] - p[j]) >= need)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns t, c and more of runs of whole groups t; rows come sorted by (t, n, c), a class counts once."""
    rest: list[np.ndarray] = []
    for b in batches:
        if not b.num_rows:
            continue
        own = [x.to_numpy(zero_copy_only=False) for x in b.columns]
        if rest:
            own = [np.concatenate(x) for x in zip(rest, own, strict=True)]
        new = np.ones(len(own[0]), dtype=bool)
        new[1:] = (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])
        own = [x[new] for x in own]
        turn = np.flatnonzero(own[0][1:] != own[0][:-1])
        cut = int(turn[-1]) + 1 if len(turn) else 0
        if cut:
            yield [x[:cut] for x in own]
        rest = [x[cut:].copy() for x in own]
    if rest:
        yield rest


def _distinct_pairs(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows of candidates, each once and the smaller first."""
    return np.unique(np.column_stack((np.minimum(u, v), np.maximum(u, v))), axis=0)


_KINDS = (np.int64, np.int64, np.int32, np.int32)
_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("k", pa.int64()), ("c", pa.binary()), ("n", pa.binary()), ("p", pa.binary())])


def _candidates(small: int, spread: np.ndarray):
    """Of a bucket's rows: candidates (u, v), and the members of each crowded shingle k, packed.

    Shingles in ``spread`` have members in other buckets too: they are crowded, however few are here.
    """

    def run(rows: pa.Table) -> pa.Table:
        k, c, n, p = (np.concatenate([np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]) for name, kind in zip("kcnp", _KINDS, strict=True))
        order = np.lexsort((c, n, k))
        k, c, n, p = k[order], c[order], n[order].astype(np.int64), p[order].astype(np.int64)
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        k, c, n, p = k[new], c[new], n[new], p[new]
        at = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
        size = np.diff(np.append(at, len(k)))
        left = np.repeat(at + size, size) - np.arange(len(k)) - 1  # later members of the same group
        many = (size > small) | (_spots(k[at], spread) >= 0)
        few = np.repeat(~many, size)
        none = [np.zeros(0, dtype=np.int64)]
        us, vs = [], []
        for step in range(1, small):
            i = np.flatnonzero((left >= step) & few)
            if not len(i):
                break
            ok = _may_reach(n, p, i, i + step)
            us.append(i[ok])
            vs.append(i[ok] + step)
        crowded = list(zip(at[many].tolist(), size[many].tolist(), strict=True))
        for a, m in crowded:
            rest = a + np.argsort(c[a : a + m])
            while len(rest) > 1:
                lead, rest = rest[0], rest[1:]
                near = np.minimum(n[rest], n[lead]) * LEAST[1] >= np.maximum(n[rest], n[lead]) * LEAST[0]
                j = rest[near]
                j = j[_may_reach(n, p, np.full(len(j), lead), j)]
                us.append(np.full(len(j), lead))
                vs.append(j)
                rest = rest[~near]
        pairs = _distinct_pairs(c[np.concatenate(us or none)], c[np.concatenate(vs or none)])
        packed = [pa.array([x[a : a + m].astype(kind).tobytes() for a, m in crowded], pa.binary()) for x, kind in zip((c, n, p), _KINDS[1:], strict=True)]
        found = pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *[pa.nulls(len(pairs), f.type) for f in list(_FOUND)[2:]]], schema=_FOUND)
        full = pa.table([pa.nulls(len(crowded), pa.int64())] * 2 + [pa.array([k[a] for a, _ in crowded], pa.int64()), *packed], schema=_FOUND)
        trim()
        return pa.concat_tables([found, full])

    return run


@trimmed
def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, c, n, p of the members of crowded shingles, a row each."""
    for b in batches:
        for i in range(b.num_rows):
            own = [np.frombuffer(b.column(name)[i].as_py(), kind) for name, kind in zip("cnp", _KINDS[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own[0]), b.column("k")[i].as_py())), *map(pa.array, own)], names=["k", "c", "n", "p"])


class _Differences:
    """Bits in which sketches differ; they come by rising size, and a pair's sizes are equal or twice each other."""

    def __init__(self, sketches: np.ndarray) -> None:
        size = np.array([len(x) for x in sketches], dtype=np.int64)
        self.size, self.first, self.own, self.half = size, {}, {}, {}
        for z in np.unique(size).tolist():
            at = np.flatnonzero(size == z)
            self.first[z] = int(at[0])
            self.own[z] = np.frombuffer(b"".join(sketches[at].tolist()), dtype=np.uint64).reshape(len(at), -1)
            self.half[z] = self.own[z][:, : z // 16] ^ self.own[z][:, z // 16 :]

    def __call__(self, i: int, j: np.ndarray) -> np.ndarray:
        z = int(self.size[i])
        x = self.own[z][i - self.first[z]]
        cut = int(np.searchsorted(self.size[j], z, side="right"))
        out = [np.bitwise_count(self.own[z][j[:cut] - self.first[z]] ^ x).sum(axis=1, dtype=np.int64)]
        if cut < len(j):
            out.append(np.bitwise_count(self.half[2 * z][j[cut:] - self.first[2 * z]] ^ x).sum(axis=1, dtype=np.int64))
        return np.concatenate(out)


def _forest(x: np.ndarray, y: np.ndarray, unlike: np.ndarray, n: int) -> np.ndarray:
    """Indexes of the edges (x, y) of a spanning forest over ``n`` nodes, the least unlike first (Kruskal)."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    kept = []
    order = np.argsort(unlike, kind="stable")
    for e, i, j in zip(order.tolist(), x[order].tolist(), y[order].tolist(), strict=True):
        i, j = top(i), top(j)
        if i != j:
            up[i] = j
            kept.append(e)
    return np.array(kept, dtype=np.int64)


_PAIRS = "u long, v long, t long"


def _found_batch(u: np.ndarray, v: np.ndarray, t: list[int]) -> pa.RecordBatch:
    pairs = _distinct_pairs(u, v)
    columns = [pa.concat_arrays([pa.array(pairs[:, i]), pa.nulls(len(t), pa.int64())]) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(t, pa.int64())])], names=["u", "v", "t"])


def _across(forest: bool):
    """Candidates (u, v) of crowded shingles whose components (r) differ and whose sketches (s) may reach LEAST.

    A pair that shares more of these shingles is left to the first of them in the order, as far as the FIRST
    of each member tell: there both have more of their sets before them, so what may reach LEAST here may there.
    Rows come by tiles t; members of side 0 are paired with each other, those of side 1 with those of side 2.
    With ``forest`` a tile gives a spanning forest of its components, and its t alone if that left candidates out.
    """

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, c, k, n, p, side, r, s, *firsts in _groups(batches):
            n, p, side, firsts = n.astype(np.int64), p.astype(np.int64), side.astype(np.int64), np.column_stack(firsts)
            at = np.concatenate(([0], np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)]))
            for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                if (r[a:e] == r[a]).all():
                    continue
                node = np.unique(r[a:e], return_inverse=True)[1]
                stops = a + np.searchsorted(n[a:e], n[a:e] * LEAST[1] // LEAST[0], side="right")
                differ = _Differences(s[a:e])
                held: list[list[np.ndarray]] = []
                size, left = 0, False

                def own() -> list[np.ndarray]:
                    nonlocal left
                    x = [np.concatenate(y) for y in zip(*held, strict=True)]  # noqa: B023
                    if forest:
                        keep = _forest(node[x[0]], node[x[1]], x[2], len(node))  # noqa: B023
                        left |= len(keep) < len(x[0])
                        x = [y[keep] for y in x]
                    return x

                for i, stop in zip(range(a, e), stops.tolist(), strict=True):
                    j = np.arange(i + 1, stop)
                    j = j[(r[j] != r[i]) & (side[j] == (0, 2, 1)[side[i]])]
                    j = j[_may_reach(n, p, np.full(len(j), i), j)]
                    here = np.flatnonzero(firsts[i] == k[i])
                    j = j[~np.isin(firsts[j], firsts[i][: here[0]] if len(here) else firsts[i]).any(axis=1)]
                    bits, both = differ(i - a, j - a), n[j] + n[i]
                    ok = bits * sum(LEAST) <= both * (LEAST[1] - LEAST[0])
                    held.append([np.full(int(ok.sum()), i - a), j[ok] - a, bits[ok] / both[ok]])
                    size += len(held[-1][0])
                    if size > HELD_PAIRS:
                        x = own()
                        held, size = [x] if forest else [], 0
                        if not forest:
                            yield _found_batch(c[a + x[0]], c[a + x[1]], [])
                if held:
                    x = own()
                    yield _found_batch(c[a + x[0]], c[a + x[1]], [int(t[a])] if left else [])

    return run


@trimmed
def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with sizes and sketches, those that may reach LEAST."""
    for b in batches:
        keep = np.zeros(b.num_rows, dtype=bool)
        both = b.column("nu").to_numpy() + b.column("nv").to_numpy()
        for i, (x, y) in enumerate(zip(b.column("su").to_pylist(), b.column("sv").to_pylist(), strict=True)):
            size = min(len(x), len(y))
            differ = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
            keep[i] = differ * sum(LEAST) <= both[i] * (LEAST[1] - LEAST[0])
        yield b.select(["u", "v"]).filter(pa.array(keep))


@trimmed
def _reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their sets, those that reach LEAST."""
    for b in batches:
        keep = np.zeros(b.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(b.column("su").to_pylist(), b.column("sv").to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = shared * LEAST[1] >= (len(x) + len(y) - shared) * LEAST[0]
        yield b.select(["u", "v"]).filter(pa.array(keep))


def _of_both(pairs: DataFrame, own: DataFrame, *columns: str) -> DataFrame:
    """The pairs with columns of the classes u and v, named with u or v behind."""
    for x in ("u", "v"):
        pairs = pairs.join(own.select(F.col("c").alias(x), *[F.col(name).alias(name + x) for name in columns]), x)
    return pairs


def _similar(pairs: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """The candidates (u, v) whose whole sets reach LEAST, staged."""
    pairs = pairs.select("u", "v").distinct()
    likely = stage(_of_both(pairs, classes, "n", "s").mapInArrow(_likely, "u long, v long"), "shingle-likely")
    if likely.isEmpty():
        return likely
    ids = stage(likely.select(F.col("u").alias("c")).union(likely.select("v")).distinct(), "shingle-ids")
    own = stage(_whole(texts, ids), "shingle-own")
    out = stage(_of_both(likely, own, "s").mapInArrow(_reaching, "u long, v long"), "shingle-links")
    for t in (likely, ids, own):
        unstage(t)
    return out


@trimmed
def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes with sketches of at most MOST_SKETCH bits."""
    for b in batches:
        s = [x if len(x) * 8 <= MOST_SKETCH else _folded(x, MOST_SKETCH // 8).tobytes() for x in b.column("s").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("c"), pa.array(s, pa.binary())], names=["c", "s"])


def _tiled(rows: DataFrame, members: DataFrame, tile: int) -> tuple[DataFrame, DataFrame]:
    """The members of shingles once for each tile t in which they are paired, with their side there.

    A shingle of at most ``tile`` members is one tile. The members of others are dealt to classes z of size and,
    in each, by hash to blocks of about ``tile``. Sizes of a pair differ by a factor of 1.25 at most, less than a
    class is wide, so a block is paired with those of its own class and of the next ones. Also the staged table
    that this reads.
    """
    whole = [F.col("k").alias("t"), F.lit(0).alias("side")]
    large = members.groupBy("k").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > tile).select("k")
    z = F.floor(F.log("n") / F.lit(float(np.log(LEAST[1] / LEAST[0]) + 1e-4))).cast("int")
    parts = members.join(large, "k", "left_semi").groupBy("k", z.alias("z")).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("m"))
    # a shingle has some hundred classes of size at most
    parts = stage(parts.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("z", "m"))).alias("parts")), "shingle-tiles")
    few = parts.count()
    if not few:
        return rows.select(*whole, "*"), parts
    own = rows.join(F.broadcast(parts) if few <= MOST_TILED else parts, "k", "left").withColumn("z", z)
    blocks = lambda step: F.coalesce(F.try_element_at("parts", F.col("z") + step), F.lit(0))
    own = own.withColumn("h", F.pmod(F.xxhash64("c"), F.greatest(blocks(0), F.lit(1))).cast("int"))
    place = lambda z, h: F.struct(z.alias("z"), h.cast("int").alias("h"))
    mine = place(F.col("z"), F.col("h"))

    def met(step: int) -> Column:
        def tile_of(g: Column) -> Column:
            other = place(F.col("z") + step, g)
            side = F.when(mine == other, 0).when(mine < other, 1).otherwise(2)
            return F.struct(F.xxhash64("k", F.least(mine, other), F.greatest(mine, other)).alias("t"), side.alias("side"))

        return F.transform(F.when(blocks(step) > 0, F.sequence(F.lit(0), blocks(step) - 1)).otherwise(F.array().cast("array<int>")), tile_of)

    tiles = F.when(F.col("parts").isNull(), F.array(F.struct(*whole))).otherwise(F.concat(met(-1), met(0), met(1)))
    return own.withColumn("x", F.explode(tiles)).select("x.*", *rows.columns), parts


def _components(texts: DataFrame, classes: DataFrame, near: DataFrame, n_heads: int, hot_least: int = HOT, small: int = SMALL, wide: int = WIDE, tile: int = TILE, forests: int = FORESTS) -> DataFrame:
    """(node, root) of every class that is similar to another; ``near``: candidates (u, v) from elsewhere, checked first."""
    buckets = max(LEAST_BUCKETS, -(-n_heads // BUCKET_HEADS))
    hot, spread = _hot(texts, hot_least, wide)
    heads = _heads(texts, hot, spread, buckets)
    found = stage(heads.groupBy("bucket").applyInArrow(_candidates(small, spread[0]), "u long, v long, k long, c binary, n binary, p binary"), "shingle-candidates")
    links = _similar(near.union(found.where("u is not null").select("u", "v")), texts, classes)
    roots = stage(connected_components(links), "shingle-cc")
    crowded = found.where("k is not null").select("k", "c", "n", "p")
    if not crowded.isEmpty():
        members = stage(crowded.mapInArrow(_members, "k long, c long, n int, p int"), "shingle-members")
        least = members.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("p", "k")))["k"].alias("f"))
        least = least.select("c", *[F.coalesce(F.get("f", F.lit(i)), F.lit(2**63 - 1)).alias(f"f{i}") for i in range(FIRST)])
        rows = members.join(classes.mapInArrow(_short, "c long, s binary"), "c").join(least, "c")
        rows, parts = _tiled(rows, members, tile)
        firsts = [f"f{i}" for i in range(FIRST)]
        staged, extra = [members, parts], []
        for turn in range(forests + 1):
            now = rows.join(roots.withColumnRenamed("node", "c"), "c", "left").select("t", "c", "k", "n", "p", "side", F.coalesce("root", "c").alias("r"), "s", *firsts)
            now = now.repartition("t").sortWithinPartitions("t", "n", "c").mapInArrow(_across(turn < forests), _PAIRS)
            now = stage(now, "shingle-across")
            staged.append(now)
            more = _similar(now.where("u is not null"), texts, classes)
            staged.append(more)
            if not more.isEmpty():
                extra.append(more)
                former, whole = roots, links
                for x in extra:
                    whole = whole.union(x)
                roots = stage(connected_components(whole), "shingle-cc")
                unstage(former)
            left = now.where("t is not null").select("t").distinct()
            if left.isEmpty():
                break
            rows = rows.join(left, "t", "left_semi")
        for t in staged:
            unstage(t)
    unstage(found)
    unstage(links)
    return roots


def keep_one_of_each(docs: DataFrame, hot_least: int = HOT, small: int = SMALL, wide: int = WIDE, tile: int = TILE) -> DataFrame:
    """The smallest doc_id of each group of documents linked by a similarity of LEAST or more, with all columns.

    Null and wordless texts are one class. Rows with a null doc_id are kept and link others. Repeated rows
    of one doc_id are all kept or all dropped. A text of any length is one set, whole; it needs some 60 times
    its bytes in its task. Columns other than doc_id and text may have any names. An empty table gives an
    empty result.
    """
    sets = stage(class_table(docs), "shingle-sets")
    classes = stage(sets.groupBy("c").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("s").alias("s")), "shingle-classes")
    n = F.col("n")
    n_heads = sets.agg(F.sum(n - F.ceil(n * F.lit(LEAST[0]) / F.lit(LEAST[1])) + 1)).first()[0] or 0
    near, staged = by_fingerprint(sets)
    roots = _components(docs.select(F.col("text").cast("string").alias("text")), classes.select("c", "n", "s"), near, int(n_heads), hot_least, small, wide, tile)
    rooted = classes.select("c", "low").join(roots.withColumnRenamed("node", "c"), "c", "left").select("c", "low", F.coalesce("root", "c").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("low"))
    keepers = rooted.select("c", "root").join(lows, "root").select("c", "low")
    gone = stage(sets.select("doc_id", "c").join(keepers, "c").where("doc_id <> low").select("doc_id").distinct(), "shingle-gone")
    for t in (roots, classes, sets, *staged):
        unstage(t)
    return docs.join(gone, "doc_id", "left_anti")
