"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits, each the majority of that bit over the XXH64 (seed 42) of the 3-word shingles.
Two fingerprints link at RADIUS or fewer differing bits. Covering masks make the search exact: each of
the 64 bit positions gets a non-zero vector of RADIUS + 1 bits, and table v (one of the 2**(RADIUS+1) - 1
non-zero vectors) keys a fingerprint by the positions whose vector has an odd product with v. At most
RADIUS positions differ, their vectors span at most RADIUS dimensions, so some v is orthogonal to all of
them: in that table both fingerprints have one key. No pair within the radius is missed, whatever the
data.

Scale: a table keeps 34 or so bits of 64. Groups of one key with more than HOT fingerprints are split
by a second family of masks over the bits that the first left free, and if need be a third, so a group's
size has a bound that does not depend on the input (at most 2 to the number of free bits). A group's
output is a spanning star, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import bounded_batches, connected_components, stage, unstage
from ._text import trimmed

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Shingle hashes whose bits are counted at once; a count takes some 600 bytes for each.
FLUSH = 20_000
#: A group of one key with more distinct fingerprints is split by the next family of masks.
HOT = 512


def fingerprints_of(texts: list[bytes | None]) -> np.ndarray:
    """64-bit fingerprints (unsigned) of whole texts; null and wordless texts have 0."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.uint64)
    done = 0

    def close(upto: int) -> None:
        nonlocal done
        h = np.array(hashes, dtype=np.uint64)
        hashes.clear()
        have = np.flatnonzero(counts[done:upto]) + done
        if len(have):
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            at = np.concatenate(([0], np.cumsum(counts[have])[:-1]))
            ones = np.add.reduceat(bits, at, axis=0, dtype=np.int64)
            out[have] = np.packbits(2 * ones > counts[have, None], axis=1).view(">u8").ravel()
        done = upto

    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split() if text else ()
        if not words:
            continue
        joined = b" ".join(words)
        n = len(words)
        if n <= SHINGLE:
            hashes.append(digest(joined, SEED))
            counts[i] = 1
        else:
            lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
            ends = np.cumsum(lens + 1) - 1
            starts = (ends - lens)[: n - SHINGLE + 1].tolist()
            hashes += [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
            counts[i] = n - SHINGLE + 1
        if len(hashes) > FLUSH:
            close(i + 1)
    close(len(texts))
    return out


@trimmed
def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = fingerprints_of(b.column(1).cast(pa.large_binary()).to_pylist()).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _fingerprint_batches, "doc_id long, fp long"
    )


@lru_cache
def _family(free: int) -> tuple[int, ...]:
    """Covering masks over the set bits of ``free``: vectors are dealt in turn, so tables keep alike many bits."""
    at = [i for i in range(64) if free >> i & 1]
    vectors = range(1, 2 ** (RADIUS + 1))
    masks = []
    for v in vectors:
        keep = 0
        for k, i in enumerate(at):
            m = k % len(vectors) + 1
            if (m & v).bit_count() % 2:
                keep |= 1 << i
        masks.append(keep)
    return tuple(masks)


ALL_BITS = 2**64 - 1


@lru_cache
def mask_tables(level: int) -> tuple[int, ...]:
    """Masks of a level, each a superset of one of the level before."""
    if level == 0:
        return _family(ALL_BITS)
    return tuple(up | m for up in mask_tables(level - 1) for m in _family(ALL_BITS & ~up))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _roots(fps: np.ndarray) -> np.ndarray:
    """Index of the root (the first member) of each fingerprint's linked group.

    A search from each unreached member compares it with all that are still unreached: exact, and without
    a list of pairs.
    """
    root = np.arange(len(fps))
    left = np.arange(len(fps))
    while len(left):
        first, left = left[0], left[1:]
        todo = [first]
        while todo and len(left):
            near = np.bitwise_count(fps[left] ^ fps[todo.pop()]) <= RADIUS
            if near.any():
                found = left[near]
                root[found] = first
                todo += found.tolist()
                left = left[~near]
    return root


@trimmed
def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (table, key): each run is a group; emits (fp, root fp) of linked fingerprints."""
    rest_t = rest_k = None
    rest_f = np.zeros(0, dtype=np.uint64)

    def links(t, k, f):
        cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        at = np.concatenate(([0], cut, [len(t)]))
        size = np.diff(at)
        us, vs = [], []
        pairs = at[:-1][size == 2]
        if len(pairs):
            a, b = f[pairs], f[pairs + 1]
            ok = np.bitwise_count(a ^ b) <= RADIUS
            us.append(b[ok])
            vs.append(a[ok])
        for i, n in zip(at[:-1][size > 2], size[size > 2], strict=True):
            g = f[i : i + n]
            r = _roots(g)
            own = r != np.arange(n)
            us.append(g[own])
            vs.append(g[r[own]])
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        t = b.column(0).to_numpy(zero_copy_only=False)
        k = b.column(1).to_numpy(zero_copy_only=False)
        f = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        if rest_t is not None:
            t, k, f = np.concatenate((rest_t, t)), np.concatenate((rest_k, k)), np.concatenate((rest_f, f))
        new = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1]))
        cut = int(new[-1]) + 1 if len(new) else 0
        if cut:
            yield from links(t[:cut], k[:cut], f[:cut])
        rest_t, rest_k, rest_f = t[cut:].copy(), k[cut:].copy(), f[cut:].copy()
    if rest_t is not None and len(rest_t) > 1:
        yield from links(rest_t, rest_k, rest_f)


def _exploded(rows: DataFrame, level: int) -> DataFrame:
    """A row for each mask of the level; ``rows``: fp, and from level 1 on table, the mask's index above."""
    per = 2 ** (RADIUS + 1) - 1
    masks = F.array(*[F.lit(_signed(m)) for m in mask_tables(level)])
    if level == 0:
        rows = rows.select("fp", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("t"))
    else:
        rows = rows.select("fp", F.explode(F.sequence(F.col("t") * per, F.col("t") * per + (per - 1))).alias("t"))
    return rows.select(F.col("t").cast("int").alias("t"), F.col("fp").bitwiseAND(F.element_at(masks, F.col("t").cast("int") + 1)).alias("k"), "fp")


def _linked(rows: DataFrame) -> DataFrame:
    return rows.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(_link_groups, "u long, v long")


def fingerprint_links(fps: DataFrame, hot: int = HOT) -> tuple[DataFrame, list[DataFrame]]:
    """Spanning links (u, v) among distinct fingerprints ``fps`` (column fp), and the tables to unstage after use."""
    parts, staged = [], []
    rows = _exploded(fps.select("fp"), 0)
    for level in range(3):
        crowded = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("t", "k")
        crowded = stage(crowded, "simhash-hot")
        staged.append(crowded)
        if level == 2 or crowded.isEmpty():
            # nothing to split, or at most 2**7 or so free bits are left: the bound holds by construction
            parts.append(_linked(rows))
            break
        parts.append(_linked(rows.join(crowded, ["t", "k"], "left_anti")))
        rows = _exploded(rows.join(crowded, ["t", "k"], "left_semi"), level + 1)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out, staged


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most RADIUS differing bits. Equal
    fingerprints are one class, so copies are never paired. Null and wordless texts have fingerprint 0 and
    link like any other; a null doc_id gets a component but never names one (null if all its members are
    null); repeated rows are kept; a text of any length is read whole, with some 15 bytes of lists and arrays
    a byte; an empty table gives an empty result; other columns are ignored.
    """
    fps = stage(fingerprint_table(docs, id_col, text_col), "simhash-fp")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    links, staged = fingerprint_links(classes)
    roots = stage(connected_components(links), "simhash-cc")
    for t in staged:
        unstage(t)
    root = F.coalesce("root", "fp")
    labelled = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", root.alias("root"))
    # only linked classes need a minimum over their component
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    per_class = labelled.join(linked, "root", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return fps.join(per_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Documents that name their component: the smallest doc_id of each group of near-duplicates.

    Rows with a null doc_id are kept. Repeated rows of one doc_id are all kept or all dropped. Null, empty and
    long texts as in simhash_components; an empty table gives an empty result; other columns stay as they are.
    """
    comps = simhash_components(docs).where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(comps, "doc_id", "left_anti")
