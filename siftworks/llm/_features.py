"""Document statistics for the quality classifier, computed for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ._text import Words, text_slices, word_hashes



def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_UPPER = _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _flags("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _flags("0123456789")
_STOP = _flags(".?!")
_PLAIN = _flags(".,;:'\"?-()")
_SYMBOL = _flags("#$%&*+/<=>@[\\]^_`{|}~!")
_ALNUM = _UPPER | _LOWER | _DIGIT
_ALNUM[128:] = True

#: Shares: what is counted, and out of what.
SHARES = (
    "upper-case letters of letters",
    "digits a word",
    "plain punctuation a word",
    "symbols a word",
    "words that end in a symbol",
    "words without letters or digits",
    "shouted words",
    "words that end a sentence",
    "short words",
    "occurrences of the most frequent word",
    "words equal to the one before",
    "lines a word",
    "repeated lines of lines",
    "occurrences of words that came before",
)
#: A share of few cases says little: so many cases of the average are added to each.
PSEUDO = 10.0


def _per_doc(counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _distinct(values: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct values, and how often the most frequent one comes."""
    key = (doc.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24))
    key.sort()
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    of = (key[first] >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(of, minlength=n)
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, of, size)
    return distinct, most


def counts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: counts and totals of each share, and (words, bytes in words). Null is as empty: all 0."""
    part, whole, sizes = [np.zeros((0, len(SHARES)))], [np.zeros((0, len(SHARES)))], [np.zeros((0, 2))]
    for _, data, offsets in text_slices(column):
        n = len(offsets) - 1
        w = Words(data, offsets)
        words = np.diff(w.bounds)
        doc = w.doc_of_word()
        length = w.ends - w.starts

        def by_byte(mask: np.ndarray) -> np.ndarray:
            return _per_doc(mask[data], offsets)

        def by_word(mask: np.ndarray) -> np.ndarray:
            return _per_doc(mask, w.bounds)

        alnum, upper, lower = (np.concatenate(([0], np.cumsum(m[data], dtype=np.int64))) for m in (_ALNUM, _UPPER, _LOWER))
        letters = by_byte(_UPPER) + by_byte(_LOWER)
        hashes = word_hashes(data, w.starts, w.ends, 11)
        distinct, most = _distinct(hashes, doc, n)
        twin = np.zeros(len(w), dtype=bool)
        twin[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        edges = np.union1d(offsets, np.flatnonzero(data == 10) + 1)
        at = np.searchsorted(offsets, edges[:-1], side="right") - 1
        lines = np.bincount(at, minlength=n)
        different = _distinct(word_hashes(data, edges[:-1], edges[1:], 11), at, n)[0]
        ends_in = data[w.ends - 1]
        part.append(
            np.stack(
                [
                    by_byte(_UPPER),
                    by_byte(_DIGIT),
                    by_byte(_PLAIN),
                    by_byte(_SYMBOL),
                    by_word(_SYMBOL[ends_in]),
                    by_word(alnum[w.ends] == alnum[w.starts]),
                    by_word((upper[w.ends] - upper[w.starts] > 1) & (lower[w.ends] == lower[w.starts])),
                    by_word(_STOP[ends_in]),
                    by_word(length <= 3),
                    most,
                    by_word(twin),
                    lines,
                    lines - different,
                    words - distinct,
                ],
                axis=1,
            ).astype(float)
        )
        out_of = np.repeat(words[:, None], len(SHARES), axis=1).astype(float)
        out_of[:, 0] = letters
        out_of[:, 12] = lines
        whole.append(out_of)
        sizes.append(np.stack([words, _per_doc(length, w.bounds)], axis=1).astype(float))
    return np.concatenate(part), np.concatenate(whole), np.concatenate(sizes)


WIDTH = len(SHARES) + 2


def transformed(part: np.ndarray, whole: np.ndarray, sizes: np.ndarray, average: np.ndarray) -> np.ndarray:
    """Roots of smoothed shares and logarithms of sizes: WIDTH near-normal statistics a text."""
    shares = (part + PSEUDO * average) / (whole + PSEUDO)
    mean_length = np.log1p((sizes[:, 1] + PSEUDO * 5) / (sizes[:, 0] + PSEUDO))
    return np.column_stack([np.sqrt(shares), np.log1p(sizes[:, 0]), mean_length])
