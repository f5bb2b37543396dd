"""Benchmark decontamination by template windows.

Words are trimmed of punctuation, lower-cased and made templates: a word with a digit or one of NUMBERS is a
number, one of UNITS is a unit, one with an upper-case first letter is a name; each becomes a placeholder of
its type. Windows of WINDOW template tokens of the benchmark are hashed into a table that every task probes
with the windows of its documents (a broadcast hash join). Each hit is then checked: all template tokens must
be equal, and the slots consistent: where the benchmark repeats a value, the document repeats one too. So
the same question with other numbers or names is caught. What slots may hold depends on which of them are
equal alone, so benchmark windows of one template and one such pattern are one entry of the table, however
many variants of a question the benchmark has. All checks are done on arrays, for many windows at once.

Three tables: templates; templates in which names are plain words, for passages whose case was changed
together with their numbers; and plain lower-cased words. A window of fewer than LITERALS literal words says
too little by its shape, so it stands in the last table only: its slots must be equal. A benchmark window
with 7 or more slots of its 13 is thus never found re-parameterised.

An item shorter than a window is one window as a whole. Items of fewer than ``least`` tokens only count where
they are a whole document; by default (1) they count wherever they stand.

Scale: the texts are read once a block of the benchmark and never shuffled. The benchmark is taken in blocks
of at most about BLOCK_BYTES of text, each broadcast alone, and the hits are united; the driver holds one
block at a time while it builds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import bounded_batches
from ._text import Roller, Words, ranges, text_slices, trimmed, word_hashes

WINDOW = 13
LITERALS = 7
BLOCK_BYTES = 8 << 20
#: Measure words that stand in a unit's place.
UNITS = (
    "mm cm km mi ft yd mg kg lb lbs oz ml cl dl gal hz khz mhz ghz kb mb gb tb kw kwh mw ms sec secs min mins hr hrs mph kph kmh "
    "usd eur gbp meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years degree degrees percent "
    "dollar dollars euro euros cent cents"
).split()

#: Number words of English.
NUMBERS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()

LITERAL, NUMBER, UNIT, NAME = range(4)
_SEED, _WINDOWS = 21, Roller(22)
_U = np.uint64

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_ALNUM[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[list(b"0123456789")] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
#: Lower case of the characters of two bytes (U+0080 to U+07FF), where it has two bytes as well.
_LOWER2 = np.array([x if 127 < (x := ord(chr(k).lower()[0])) < 2048 and len(chr(k).lower()) == 1 else k for k in range(2048)], dtype=np.uint16)


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in lower case, and True at the first byte of each upper-case character."""
    low, capital = _LOWERED[data], (data >= 65) & (data <= 90)
    at = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xDF) & (data[1:] & 0xC0 == 0x80))
    code = (data[at].astype(np.uint16) & 0x1F) << 6 | data[at + 1] & 0x3F
    turned = _LOWER2[code]
    at, turned = at[turned != code], turned[turned != code]
    low[at], low[at + 1] = 0xC0 | turned >> 6, 0x80 | turned & 0x3F
    capital[at] = True
    return low, capital


def _word_hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return word_hashes(data, ends - [len(w.encode()) for w in words], ends, _SEED)


_UNIT_HASHES, _NUMBER_HASHES = np.sort(_word_hash(UNITS)), np.sort(_word_hash(NUMBERS))


class Tokens:
    """Template tokens of some texts: byte ranges in ``data`` (lower-cased), kinds, hashes; text i has bounds[i]:bounds[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        w = Words(data, offsets)
        n = len(data)
        keep = _ALNUM[data]
        at = np.arange(n)
        after = np.minimum.accumulate(np.where(keep, at, n)[::-1])[::-1] if n else at
        before = np.maximum.accumulate(np.where(keep, at, -1)) if n else at
        s, e = (after[w.starts], before[w.ends - 1] + 1) if n else (w.starts, w.ends)
        real = s < e
        doc = w.doc_of_word()[real]
        self.starts, self.ends = s[real], e[real]
        self.bounds = np.searchsorted(doc, np.arange(len(offsets)))
        self.data, capital = folded(data)
        digits = np.concatenate(([0], np.cumsum(_DIGIT[data], dtype=np.int64)))
        self.hashes = word_hashes(self.data, self.starts, self.ends, _SEED)
        self.kinds = np.zeros(len(self.starts), dtype=np.uint8)
        if len(self.starts):
            self.kinds[capital[self.starts]] = NAME
            for kind, known in ((UNIT, _UNIT_HASHES), (NUMBER, _NUMBER_HASHES)):
                spot = np.minimum(np.searchsorted(known, self.hashes), len(known) - 1)
                self.kinds[known[spot] == self.hashes] = kind
            self.kinds[digits[self.ends] > digits[self.starts]] = NUMBER

    def values(self, form: int) -> tuple[np.ndarray, np.ndarray]:
        """What a table of this form compares: a value for each token, and which tokens are slots."""
        slots = {TEMPLATE: self.kinds != LITERAL, CASELESS: (self.kinds == NUMBER) | (self.kinds == UNIT), PLAIN: np.zeros(len(self.kinds), dtype=bool)}[form]
        return np.where(slots, _U(0x9E3779B97F4A7C15) * (self.kinds.astype(np.uint64) + _U(1)), self.hashes), slots

    def windows(self, length: int) -> np.ndarray:
        """Starts of all windows of so many tokens."""
        n = np.diff(self.bounds)
        ok = np.ones(len(self.starts), dtype=bool)
        for k in range(1, length):
            ok[self.bounds[1:][n >= k] - k] = False
        return np.flatnonzero(ok)


TEMPLATE, CASELESS, PLAIN = range(3)
#: Window pairs that are checked at once; a check takes some 300 bytes for each.
AT_ONCE = 50_000


class _Table:
    """Distinct windows of one length and form: sorted hashes, a sample of each, its pattern, and the items that hold it."""

    def __init__(self, t: Tokens, form: int, length: int, p: np.ndarray, item: np.ndarray) -> None:
        self.form, self.length = form, length
        values, slots = t.values(form)
        across = np.arange(length)
        if form != PLAIN:
            literal = length - np.add.reduce([slots[p + k] for k in across]) if len(p) else p
            keep = (literal >= LITERALS) & (literal < length)  # without slots, the plain words are the same
            p, item = p[keep], item[keep]
        # the pattern: for each slot, the first one of the same value
        pattern = np.tile(across.astype(np.uint8), (len(p), 1))
        for k in range(length - 1, -1, -1):
            for j in range(k - 1, -1, -1):
                same = slots[p + k] & slots[p + j] & (t.hashes[p + k] == t.hashes[p + j]) & (t.kinds[p + k] == t.kinds[p + j])
                pattern[same, k] = j
        h = _WINDOWS.ranges(values, p, p + length)
        order = np.lexsort((item, *pattern.T, h))
        p, item, pattern, h = p[order], item[order], pattern[order], h[order]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (pattern[1:] != pattern[:-1]).any(axis=1)
        self.hashes, self.pattern = h[new], pattern[new]
        self.sample = values[p[new][:, None] + across] if len(p) else np.zeros((0, length), np.uint64)
        group = np.cumsum(new) - 1
        once = np.ones(len(p), dtype=bool)
        once[1:] = new[1:] | (item[1:] != item[:-1])
        self.items = item[once]
        self.bounds = np.searchsorted(group[once], np.arange(len(self.hashes) + 1))
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self.hashes >> _U(44)] = True

    def hits(self, texts: Tokens, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of the window, item) of all windows at ``p`` that match, each item once a window."""
        values, _ = texts.values(self.form)
        h = _WINDOWS.ranges(values, p, p + self.length)
        maybe = np.flatnonzero(self.seen[h >> _U(44)])
        p, h = p[maybe], h[maybe]
        lo, hi = np.searchsorted(self.hashes, h, side="left"), np.searchsorted(self.hashes, h, side="right")
        own, entry = np.repeat(p, hi - lo), ranges(lo, hi - lo)
        ok = np.zeros(len(own), dtype=bool)
        for x in range(0, len(own), AT_ONCE):
            at = own[x : x + AT_ONCE, None] + np.arange(self.length)
            e, words = entry[x : x + AT_ONCE], texts.hashes[at]
            ok[x : x + AT_ONCE] = ((values[at] == self.sample[e]) & (np.take_along_axis(words, self.pattern[e].astype(np.int64), axis=1) == words)).all(axis=1)
        own, entry = own[ok], entry[ok]
        n = self.bounds[entry + 1] - self.bounds[entry]
        return np.repeat(own, n), self.items[ranges(self.bounds[entry], n)]


class Benchmark:
    """One block of benchmark items, ready to be probed; items of equal text are one."""

    def __init__(self, ids: list, texts: list[str], least: int = 1) -> None:
        self.least = least
        of: dict[str, list] = {}
        for i, text in zip(ids, texts, strict=True):
            of.setdefault(text, []).append(i)
        self.ids = list(of.values())
        self.tables: list[_Table] = []
        slices = list(text_slices(pa.array(list(of), pa.large_string()), most=2**62))
        if not slices:
            return
        t = Tokens(slices[0][1], slices[0][2])
        sizes = np.diff(t.bounds)
        item_of = np.repeat(np.arange(len(sizes)), sizes)
        for length in sorted({WINDOW} | {int(n) for n in sizes if 0 < n < WINDOW}):
            p = t.windows(length)
            if length < WINDOW:
                p = p[sizes[item_of[p]] == length]
            for form in (TEMPLATE, CASELESS, PLAIN):
                table = _Table(t, form, length, p, item_of[p])
                if len(table.hashes):
                    self.tables.append(table)

    def hits(self, texts: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """row, item, windows of the row that match one of the item's, of these with equal words."""
        starts, items, equal = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        at: dict[int, np.ndarray] = {}
        for table in self.tables:
            if table.length not in at:
                p = texts.windows(table.length)
                if table.length < self.least:
                    sizes = np.diff(texts.bounds)
                    p = texts.bounds[:-1][sizes == table.length]
                at[table.length] = p
            p, item = table.hits(texts, at[table.length])
            starts.append(p)
            items.append(item)
            equal.append(np.full(len(p), table.form == PLAIN))
        p, item, same = (np.concatenate(x) for x in (starts, items, equal))
        row = np.searchsorted(texts.bounds, p, side="right") - 1
        order = np.lexsort((~same, p, item, row))
        p, item, row, same = p[order], item[order], row[order], same[order]
        once = np.ones(len(p), dtype=bool)  # a window counts once an item, with equal words if any table says so
        once[1:] = (p[1:] != p[:-1]) | (item[1:] != item[:-1])
        item, row, same = item[once], row[once], same[once]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))[: len(row)])
        if not len(first):
            return row, item, row, row
        return row[first], item[first], np.diff(np.append(first, len(row))), np.add.reduceat(same.astype(np.int64), first)


def benchmark_blocks(benchmark: DataFrame, least: int = 1, most: int = BLOCK_BYTES) -> Iterator[Benchmark]:
    """The benchmark in blocks of about ``most`` bytes of text, dealt by a hash of the text; null texts have no windows."""
    own = benchmark.where("text is not null").select("item_id", "text")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // most)
    for i in range(n):
        rows = own.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).orderBy("item_id", "text").collect()
        if rows:
            yield Benchmark([r.item_id for r in rows], [r.text for r in rows], least)


def _pairs(shared):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for b in batches:
            ids = b.column(0)
            out: list[list] = [[], [], [], []]
            for row0, data, offsets in text_slices(b.column(1)):
                for row, item, n, equal in zip(*(x.tolist() for x in bench.hits(Tokens(data, offsets))), strict=True):
                    for item_id in bench.ids[item]:
                        for column, x in zip(out, (ids[row0 + row].as_py(), item_id, n, equal), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "item_id", "n_windows", "n_equal"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, item_id, n_windows, n_equal, kind: a row for each document and benchmark item that share a window.

    n_windows: windows of the document that match one of the item's; n_equal: of these, with equal words;
    kind: exact if any is, else reparameterised. Null and empty texts of either side match nothing;
    repeated rows and items each count; a null doc_id or item_id comes back as null. A text of any length is
    searched whole, at some 60 bytes of arrays a byte of it. An empty table gives an empty result; other
    columns are ignored.
    """
    schema = "doc_id long, item_id long, n_windows long, n_equal long"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    out = None
    for block in benchmark_blocks(benchmark, least):
        part = own.mapInArrow(_pairs(sc.broadcast(block)), schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumn("kind", F.when(F.col("n_equal") > 0, "exact").otherwise("reparameterised"))


def _clean(shared):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        for b in batches:
            keep = np.ones(b.num_rows, dtype=bool)
            for row0, data, offsets in text_slices(b.column("text")):
                keep[row0 + bench.hits(Tokens(data, offsets))[0]] = False
            yield b.filter(pa.array(keep))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """The documents without a match, with all their columns.

    Documents with a null or empty text stay, and so do null doc_ids; repeated rows are judged alike, texts
    of any length whole. Without items all documents stay; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    for block in benchmark_blocks(benchmark, least):
        docs = docs.mapInArrow(_clean(sc.broadcast(block)), docs.schema)
    return docs
