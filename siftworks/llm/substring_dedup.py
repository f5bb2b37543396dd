"""Exact substring dedup with difference-cover anchors.

A window is WINDOW consecutive words of one document. A word goes if it is covered by a window whose word
sequence also starts in a document with a smaller doc_id.

Anchors: {1, 2, 4} is a difference cover modulo 7: whatever two positions a match starts at, some shift
below 7 puts both on cover positions. So it suffices to hash the ANCHOR = 13 - 6 words that start at cover
positions, 3 of 7: two equal windows always share an aligned anchor inside. Anchors found in one document
only are dropped; around the others the match is extended to whole windows, and windows are equal if the
first 128 bits of the SHA-256 of their words (joined by one space) are. Hashes of anchors only choose what
is looked at: a chance equality there costs work and changes nothing.

Shape of the work: documents are dealt once into blocks of about BLOCK_BYTES of text, and one shuffle of
the texts serves all three passes (Spark reuses the exchange). Rows are dealt by doc_id, text and input
partition, so neither a doc_id that many rows share, nor null, nor copies make a large block. What passes
between blocks is packed: a block sends each bucket of hashes its sorted distinct values in one row, and
gets back one bit for each. A value that a third of all documents hold thus costs one entry a block.

With more than FAN blocks, a block sends to at most FAN ranges of buckets, and relays, each for FAN blocks
and one range, sort what they get by bucket and carry the bits back the same way. So rows are at most FAN
a block and FAN a relay, of which there are as many as blocks: linear in the input.

1. anchors: block -> bucket, 4 bytes for each distinct anchor (8 with relays); bucket -> block, a bit: it
   occurs in more than one document.
2. windows that hold a flagged anchor: block -> bucket, 128 bits and the smallest doc_id in the block;
   bucket -> block, a bit: a block with a smaller doc_id has it too.
3. the block marks covered words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import IS_WORD, Roller, Words, text_slices, trim, word_hashes

WINDOW = 13
PERIOD = 7
COVER = (1, 2, 4)
ANCHOR = WINDOW - PERIOD + 1
#: Text of a block; a task holds one block at a time, with arrays of some 25 times its text at worst.
BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 128
#: Most rows that a block sends, and most blocks that a relay serves.
FAN = 1024
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_ROLL = Roller(2)
_ID, _TEXT, _ROW, _BLOCK = "id", "text", "row", "block"
_RETURN = "block long, kind int, bucket long, bits binary"
_PACKED = "block long, bucket long, keys binary"
#: Records of the two passes: an anchor's hash with the flag "in many documents" for its last bit, the former
#: cut to its low half where no relay needs the high one; a window's digest and the smallest doc_id.
_SHORT_KEY, _KEY = np.dtype([("a", "<u4")]), np.dtype([("a", "<u8")])
_WINDOW_KEY = np.dtype([("a", "<u8"), ("b", "<u8"), ("low", "<i8")])
_U = np.uint64


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in h, so that sorted hashes come bucket by bucket; a bucket of n is a range of buckets of n * m."""
    return (((h >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def _starts(w: Words, length: int) -> np.ndarray:
    """True at words that begin ``length`` words of their document."""
    ok = np.zeros(len(w), dtype=bool)
    n = np.diff(w.bounds)
    ok[:] = True
    for k in range(1, length):
        at = w.bounds[1:][n >= k] - k
        ok[at] = False
    return ok


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values in columns sorted together."""
    n = len(sorted_columns[0])
    if not n:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _ends(first: np.ndarray, n: int) -> np.ndarray:
    """Ends of the runs that start at ``first``."""
    out = np.empty_like(first)
    if len(first):
        out[:-1], out[-1] = first[1:], n
    return out


def _digests(w: Words, starts: np.ndarray) -> np.ndarray:
    """128 bits of the SHA-256 of each window's words, joined by one space."""
    keep = IS_WORD[w.data]
    keep[w.ends[w.ends < len(keep)]] = True
    place = np.cumsum(keep)
    # a word at the very end of a text may have no separator behind it; windows do not run over it
    canon = np.where(IS_WORD[w.data], w.data, 0x20)[keep].tobytes()
    lo, hi = place[w.starts[starts]] - 1, place[w.ends[starts + WINDOW - 1] - 1]
    sha = hashlib.sha256
    out = b"".join([sha(canon[x:y]).digest()[:16] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
    return np.frombuffer(out, dtype="<u8").reshape(-1, 2)


class _Block:
    """The words of a block's documents; every pass derives the same order of hashes from them."""

    def __init__(self, docs: pa.Table, ranges: int, text_col: str | None) -> None:
        self.ranges = ranges
        docs = docs.take(pa.array(np.argsort(docs.column(_ID).to_numpy(), kind="stable")))
        self.ids = docs.column(_ID).to_numpy()
        self.rows = None
        if text_col is None:
            self.column = docs.column(_TEXT)
        else:
            self.rows = docs.column(_ROW).combine_chunks()
            self.column = self.rows.field(text_col).cast(pa.string())
        self.slices = []
        anchors, at, doc = [], [], []
        words0 = 0
        for row0, data, offsets in text_slices(self.column):
            w = Words(data, offsets)
            hashes = word_hashes(data, w.starts, w.ends, 1)
            in_doc = np.arange(len(w)) - np.repeat(w.bounds[:-1], np.diff(w.bounds))
            p = np.flatnonzero(_IN_COVER[in_doc % PERIOD] & _starts(w, ANCHOR))
            anchors.append(_ROLL.ranges(hashes, p, p + ANCHOR))
            at.append(p + words0)
            doc.append(np.searchsorted(w.bounds, p, side="right") - 1 + row0)
            self.slices.append((row0, offsets, w, words0))
            words0 += len(w)
        self.n_words = words0
        h, self._at, doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (anchors, at, doc))
        h = h.astype(np.uint64)
        order = np.argsort(h, kind="stable")
        h, self._at, doc = h[order], self._at[order], doc[order]
        first = _runs(h)
        self.anchors = h[first]
        self._run = np.repeat(np.arange(len(first)), _ends(first, len(h)) - first)
        ids = self.ids[doc]
        # documents come in order of doc_id, and so do the rows of a run
        self.many = ids[_ends(first, len(h)) - 1] > ids[first]

    def anchor_keys(self, relays: bool) -> np.ndarray:
        h = (self.anchors & ~_U(1)) | self.many.astype(_U)
        return h.view(_KEY) if relays else h.astype(np.uint32).view(_SHORT_KEY)

    def shared_windows(self, shared: np.ndarray) -> None:
        """Windows that hold an anchor flagged in ``shared``: sorted distinct digests, and the rows behind them."""
        flags = np.zeros(self.n_words + 1, dtype=np.int64)
        flags[self._at[shared[self._run]] + 1] = 1
        seen = np.cumsum(flags)
        keys, at, doc = [np.zeros((0, 2), _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row0, _, w, words0 in self.slices:
            s = np.flatnonzero(_starts(w, WINDOW))
            s = s[seen[words0 + s + PERIOD] > seen[words0 + s]]
            if len(s):
                keys.append(_digests(w, s))
                at.append(s + words0)
                doc.append(np.searchsorted(w.bounds, s, side="right") - 1 + row0)
        a, b = np.concatenate(keys).T
        at, doc = np.concatenate(at), np.concatenate(doc)
        order = np.lexsort((doc, b, a))
        a, b, at, doc = a[order], b[order], at[order], doc[order]
        first = _runs(a, b)
        self.window_at, self.window_id = at, self.ids[doc]
        self.window_run = np.repeat(np.arange(len(first)), _ends(first, len(a)) - first)
        self.windows = np.empty(len(first), dtype=_WINDOW_KEY)
        self.windows["a"], self.windows["b"], self.windows["low"] = a[first], b[first], self.window_id[first]

    def by_range(self, h: np.ndarray) -> Iterator[tuple[int, slice]]:
        b = _bucket_of(h, self.ranges)
        first = _runs(b)
        for lo, hi in zip(first.tolist(), _ends(first, len(b)).tolist(), strict=True):
            yield int(b[lo]), slice(lo, hi)

    def unpacked(self, back: pa.Table, kind: int, h: np.ndarray) -> np.ndarray:
        """A flag for each of the sorted hashes ``h`` from the rows that came back; none came: not set."""
        out = np.zeros(len(h), dtype=bool)
        own = back.filter(pa.array(back.column("kind").to_numpy() == kind))
        rows = dict(zip(own.column("bucket").to_pylist(), own.column("bits").to_pylist(), strict=True))
        for k, part in self.by_range(h):
            out[part] = _unpacked(rows[k], part.stop - part.start)
        return out


def _unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=n).astype(bool)


def _packed_table(block: list[int], bucket: list[int], keys: list[bytes]) -> pa.Table:
    return pa.table([pa.array(block, pa.int64()), pa.array(bucket, pa.int64()), pa.array(keys, pa.binary())], names=["block", "bucket", "keys"])


def _bits_table(kind: int, block: list[int], bucket: list[int], flags: list[np.ndarray]) -> pa.Table:
    bits = [np.packbits(x).tobytes() for x in flags]
    columns = [pa.array(block, pa.int64()), pa.array([kind] * len(bits), pa.int32()), pa.array(bucket, pa.int64()), pa.array(bits, pa.binary())]
    return pa.table(columns, names=["block", "kind", "bucket", "bits"])


def _shared_anchors(r: np.ndarray) -> np.ndarray:
    """True for anchors that another block has too, or that some block has in many documents."""
    key, many = r["a"] >> r["a"].dtype.type(1), (r["a"] & r["a"].dtype.type(1)).astype(bool)
    order = np.argsort(key, kind="stable")
    first = _runs(key[order])
    n = _ends(first, len(key)) - first
    out = np.empty(len(key), dtype=bool)
    out[order] = np.repeat((n > 1) | np.logical_or.reduceat(many[order], first), n)
    return out


def _owned_elsewhere(r: np.ndarray) -> np.ndarray:
    """True for windows that a block with a smaller doc_id has too."""
    order = np.lexsort((r["b"], r["a"]))
    first = _runs(r["a"][order], r["b"][order])
    low = r["low"][order]
    out = np.empty(len(r), dtype=bool)
    out[order] = np.repeat(np.minimum.reduceat(low, first), _ends(first, len(r)) - first) < low
    return out


class _Exchange:
    """The way of packed rows to their buckets and of the bits back, in one hop or over relays."""

    def __init__(self, blocks: int, fan: int = FAN) -> None:
        self.fan = fan
        self.ranges = min(blocks, fan)
        self.each = -(-blocks // self.ranges)  # buckets in a range
        self.relays = self.each > 1

    def back(self, rows: DataFrame, kind: int, key: np.dtype, decide: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
        """block, kind, bucket, bits for each row of block, bucket, keys."""
        fan, ranges, buckets = self.fan, self.ranges, self.ranges * self.each

        def decided(t: pa.Table) -> pa.Table:
            parts = [np.frombuffer(x, dtype=key) for x in t.column("keys").to_pylist()]
            flags = np.split(decide(np.concatenate(parts)), np.cumsum([len(x) for x in parts])[:-1])
            return _bits_table(kind, t.column("block").to_pylist(), t.column("bucket").to_pylist(), flags)

        if not self.relays:
            return rows.groupBy("bucket").applyInArrow(decided, _RETURN)

        def by_bucket(t: pa.Table) -> tuple[pa.Table, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
            """A relay's rows in order of block, their records, and the order and bounds of these by bucket."""
            t = t.take(pa.array(np.argsort(t.column("block").to_numpy(), kind="stable")))
            parts = [np.frombuffer(x, dtype=key) for x in t.column("keys").to_pylist()]
            b = _bucket_of(np.concatenate(parts)["a"], buckets)
            order = np.argsort(b, kind="stable")
            return t, parts, order, b[order], _runs(b[order])

        def forward(t: pa.Table) -> pa.Table:
            relay = t.column("relay")[0].as_py()
            _, parts, order, b, first = by_bucket(t)
            r = np.concatenate(parts)[order]
            keys = [r[x:y].tobytes() for x, y in zip(first.tolist(), _ends(first, len(b)).tolist(), strict=True)]
            return _packed_table([relay] * len(first), b[first].tolist(), keys)

        def backward(t: pa.Table, bits: pa.Table) -> pa.Table:
            t, parts, order, b, first = by_bucket(t)
            of = dict(zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True))
            flags = np.empty(len(b), dtype=bool)
            for x, y in zip(first.tolist(), _ends(first, len(b)).tolist(), strict=True):
                flags[order[x:y]] = _unpacked(of[int(b[x])], y - x)
            parts = np.split(flags, np.cumsum([len(x) for x in parts])[:-1])
            return _bits_table(kind, t.column("block").to_pylist(), t.column("bucket").to_pylist(), parts)

        dealt = rows.withColumn("relay", F.floor(F.col("block") / fan) * ranges + F.col("bucket"))
        sent = dealt.groupBy("relay").applyInArrow(forward, _PACKED)
        found = sent.groupBy("bucket").applyInArrow(decided, _RETURN)
        return dealt.groupBy("relay").cogroup(found.groupBy("block")).applyInArrow(backward, _RETURN)


def _blocks(docs: DataFrame, text_col: str) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(LEAST_BLOCKS, -(-total // BLOCK_BYTES))


class _Passes:
    """The three passes over one table; ``texts``: whole rows come back, else digests."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, blocks: int | None, texts: bool, fan: int = FAN) -> None:
        n = blocks or _blocks(docs, text_col)
        self.by = _Exchange(n, fan)
        self.text_col = text_col if texts else None
        # the row travels as one struct, so no column of the caller's can clash
        own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(_ROW) if texts else F.col(text_col).cast("string").alias(_TEXT)
        text = F.col(text_col).cast("string")
        where = F.pmod(F.xxhash64(F.col(id_col), text, F.spark_partition_id()), F.lit(n)).alias(_BLOCK)
        dealt = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias(_ID), own, where)
        self.by_block = dealt.groupBy(_BLOCK)

    def result(self, last: Callable[[_Block, np.ndarray], pa.Table], schema) -> DataFrame:
        by, relays, ranges, text_col = self.by, self.by.relays, self.by.ranges, self.text_col

        def block_of(docs: pa.Table) -> _Block:
            return _Block(docs, ranges, text_col)

        def anchor_rows(docs: pa.Table) -> pa.Table:
            block, number = block_of(docs), docs.column(_BLOCK)[0].as_py()
            keys = block.anchor_keys(relays)
            parts = list(block.by_range(block.anchors))
            trim()
            return _packed_table([number] * len(parts), [k for k, _ in parts], [keys[x].tobytes() for _, x in parts])

        def window_rows(docs: pa.Table, back: pa.Table) -> pa.Table:
            if not docs.num_rows or not back.num_rows:
                return _packed_table([], [], [])
            block, number = block_of(docs), docs.column(_BLOCK)[0].as_py()
            block.shared_windows(block.unpacked(back, 1, block.anchors))
            parts = list(block.by_range(block.windows["a"]))
            trim()
            return _packed_table([number] * len(parts), [k for k, _ in parts], [block.windows[x].tobytes() for _, x in parts])

        def final(docs: pa.Table, back: pa.Table) -> pa.Table:
            block = block_of(docs)
            gone = np.zeros(block.n_words + 1, dtype=np.int64)
            if back.num_rows:
                block.shared_windows(block.unpacked(back, 1, block.anchors))
                elsewhere = block.unpacked(back, 2, block.windows["a"])
                at = block.window_at[elsewhere[block.window_run] | (block.window_id > block.windows["low"][block.window_run])]
                np.add.at(gone, at, 1)
                np.add.at(gone, np.minimum(at + WINDOW, block.n_words), -1)
            out = last(block, np.cumsum(gone) > 0)
            trim()
            return out

        texts = self.by_block
        key = _KEY if relays else _SHORT_KEY
        shared = by.back(texts.applyInArrow(anchor_rows, _PACKED), 1, key, _shared_anchors)
        windows = texts.cogroup(shared.groupBy("block")).applyInArrow(window_rows, _PACKED)
        owned = by.back(windows, 2, _WINDOW_KEY, _owned_elsewhere)
        return texts.cogroup(shared.union(owned).groupBy("block")).applyInArrow(final, schema)


def _kept_digests(block: _Block, gone: np.ndarray) -> pa.Table:
    """Per document, how much goes, and a digest of the words that stay."""
    out: list[list] = [[], [], [], []]
    for row0, offsets, w, words0 in block.slices:
        raw = w.data.tobytes()
        sums = np.concatenate(([0], np.cumsum(gone[words0 : words0 + len(w)])))
        n_words, n_removed = np.diff(w.bounds), sums[w.bounds[1:]] - sums[w.bounds[:-1]]
        for i, removed in enumerate(n_removed.tolist()):
            if removed:
                lo, hi = w.bounds[i], w.bounds[i + 1]
                left = np.flatnonzero(~gone[words0 + lo : words0 + hi]) + lo
                kept = b" ".join([raw[x:y] for x, y in zip(w.starts[left].tolist(), w.ends[left].tolist(), strict=True)])
            else:
                kept = b" ".join(raw[offsets[i] : offsets[i + 1]].split())
            out[3].append(hashlib.sha256(kept).hexdigest())
        out[0] += block.ids[row0 : row0 + len(n_words)].tolist()
        out[1] += n_words.tolist()
        out[2] += n_removed.tolist()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _kept_rows(text_col: str) -> Callable[[_Block, np.ndarray], pa.Table]:
    def rows(block: _Block, gone: np.ndarray) -> pa.Table:
        """The rows themselves, with the text that stays."""
        texts = block.column.to_pylist()
        for row0, offsets, w, words0 in block.slices:
            sums = np.concatenate(([0], np.cumsum(gone[words0 : words0 + len(w)])))
            for i in np.flatnonzero(sums[w.bounds[1:]] > sums[w.bounds[:-1]]).tolist():
                lo, hi = w.bounds[i], w.bounds[i + 1]
                left = np.flatnonzero(~gone[words0 + lo : words0 + hi]) + lo
                cut = _runs(np.arange(len(left)) - left)
                runs = zip(w.starts[left[cut]], w.ends[left[_ends(cut, len(left)) - 1]], strict=True)
                texts[row0 + i] = b"\n".join(w.data[x:y].tobytes() for x, y in runs).decode("utf-8", "replace")
        names = [f.name for f in block.rows.type]
        columns = block.rows.flatten()
        at = names.index(text_col)
        columns[at] = pa.array(texts, pa.string()).cast(columns[at].type)
        return pa.table(columns, names=names)

    return rows


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, fan: int = FAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; the digest is over the kept words joined by one space.

    A null text has no words. Rows that repeat a doc_id are one document for the order: none has a smaller
    doc_id than the other. Rows with a null doc_id come last in order (as doc_id 2**63 - 1) and come back
    with null. A text of any length is worked whole, in one block, whose task needs some 25 times its bytes.
    An empty table gives an empty result; other columns are ignored.
    """
    p = _Passes(docs, id_col, text_col, blocks, False, fan)
    out = p.result(_kept_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != 2**63 - 1, F.col("doc_id")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, fan: int = FAN) -> DataFrame:
    """The rows with their columns, the text without the removed words; n_chars, if there, follows it.

    Stretches between removals keep their white space and are joined by a line break; a text that loses
    nothing stays as it is, and one that loses all becomes empty. Null texts stay null; a null doc_id comes
    last in order; repeated rows are each returned; long texts and an empty table as in substring_dedup.
    Columns may have any names.
    """
    out = _Passes(docs, id_col, text_col, blocks, True, fan).result(_kept_rows(text_col), docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col).cast(kind), F.col("n_chars")))
    return out


ORACLE = r"""
with tok as (select doc_id, case when text is null then [] else regexp_extract_all(text, '[^\x20\x09-\x0D]+') end as w from documents),
win as (
  select doc_id, w, p, hash(array_to_string(w[p:p+12], chr(32))) h, sha256(array_to_string(w[p:p+12], chr(32))) s
  from (select doc_id, w, unnest(range(1, len(w) - 11)) p from tok where len(w) >= 13)),
firsts as (select s, min(doc_id) m from win group by s),
dup as (select doc_id, list(p) ps from win join firsts using (s) where m < doc_id group by doc_id),
gone as (select doc_id, list_distinct(flatten(list_transform(ps, lambda p: range(p, p + 13)))) g from dup),
kept as (
  select t.doc_id, len(w)::bigint n_words, coalesce(len(g), 0)::bigint n_removed,
    case when g is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(g, x[2])), lambda x: x[1]) end k
  from tok t left join gone using (doc_id))
select doc_id, n_words, n_removed, sha256(array_to_string(k, chr(32))) kept_sha256 from kept
"""
