"""Token counts under a unigram model, with work shared along a trie of distinct pre-tokens.

A text's pre-tokens are its words with the word-boundary mark in front, as SentencePiece splits them. The
tokens of a pre-token are its best segmentation: the sum of the pieces' scores is largest; ties go to the
segmentation whose last piece is the longest, and so on backwards. A character that starts no piece is as
many tokens as it has bytes, at UNKNOWN each (byte fallback).

The forward scores best[i] of a prefix depend on the prefix alone. So the distinct pre-tokens of a slice are
sorted, which is a walk of their trie: of each, only the part behind what it shares with the one before is
computed, on a stack of scores, and its count is stored at its end. The pieces are a trie as well, walked
backwards from each position, so a position costs at most the longest piece that ends there.

Scale: one pass over the texts without a shuffle; a task holds the distinct pre-tokens of one slice of
its texts, about a megabyte of text, and the counts of at most MOST_KNOWN that it met before. The vocabulary is read on the driver from
the path given, at most MOST_VOCABULARY bytes, and sent to the executors with the closure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import bounded_batches
from ._text import Words, text_slices, word_hashes

#: The default vocabulary, among the public ones in /opt/tokenizers; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MOST_VOCABULARY = 16 << 20
#: Distinct pre-tokens whose counts a task keeps from slice to slice (16 bytes each).
MOST_KNOWN = 1 << 21
MARK = "▁"
#: Score of each byte of a character that starts no piece.
UNKNOWN = -40.0
_SEED = 31


def read_vocabulary(path: str = VOCABULARY, most: int = MOST_VOCABULARY) -> dict[str, float]:
    """Pieces of a SentencePiece model file with log-probabilities.

    A file whose scores are ranks (whole numbers of at most 0) has no probabilities; its pieces get those of
    Zipf's law for their rank, log(1 / (rank + 2)) less the logarithm of the sum of these terms.
    """
    import os

    import sentencepiece

    if os.path.getsize(path) > most:
        raise ValueError(f"the vocabulary is larger than {most} bytes")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in normal}
    if all(x <= 0 and x == int(x) for x in scores.values()):
        total = float(np.log(sum(1 / (2 - x) for x in scores.values())))
        scores = {p: -float(np.log(2 - x)) - total for p, x in scores.items()}
    return scores


class Counter:
    """Counts of tokens for sorted pre-tokens."""

    def __init__(self, vocabulary: dict[str, float]) -> None:
        self.vocabulary = vocabulary
        # trie of the pieces from their last character to their first; "" holds the score
        self.endings: dict = {}
        for piece, score in vocabulary.items():
            node = self.endings
            for c in reversed(piece):
                node = node.setdefault(c, {})
            if piece:
                node[""] = score

    def sorted_counts(self, words: list[str]) -> list[int]:
        """Tokens of each of the words, which come sorted."""
        endings, vocabulary = self.endings, self.vocabulary
        best, count = [0.0], [0]
        before, out = "", []
        for word in words:
            shared = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for i in range(shared, len(word)):
                c = word[i]
                if c in vocabulary:
                    top, tokens = -np.inf, 0
                else:
                    tokens = len(c.encode())
                    top = best[i] + UNKNOWN * tokens
                    tokens += count[i]
                node, j = endings.get(c), i
                while node is not None:
                    score = node.get("")
                    if score is not None:
                        score += best[j]
                        if score >= top:
                            top, tokens = score, count[j] + 1
                    j -= 1
                    if j < 0:
                        break
                    node = node.get(word[j])
                best.append(top)
                count.append(tokens)
            out.append(count[-1])
            before = word
        return out


class Known:
    """Counts of the pre-tokens that a task has met, by 64-bit hash; emptied when it holds MOST_KNOWN.

    Two different pre-tokens of MOST_KNOWN share a hash with a chance of about 1e-7.
    """

    def __init__(self, counter: Counter) -> None:
        self.counter = counter
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def look_up(self, hashes: np.ndarray, text) -> np.ndarray:
        """Counts for sorted distinct hashes; ``text(k)`` gives the pre-token of hashes[k]."""
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), dtype=bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != hashes[inside]
        fresh = np.flatnonzero(new)
        words = sorted((text(k), k) for k in fresh.tolist())
        out = np.empty(len(hashes), dtype=np.int64)
        out[[k for _, k in words]] = self.counter.sorted_counts([w for w, _ in words])
        out[~new] = self.counts[at[~new]]
        if len(self.hashes) > MOST_KNOWN:
            self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        spot = np.searchsorted(self.hashes, hashes[fresh])
        self.hashes = np.insert(self.hashes, spot, hashes[fresh])
        self.counts = np.insert(self.counts, spot, out[fresh])
        return out


def _counted(counter: Counter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(counter)
        for b in batches:
            totals: list[np.ndarray] = []
            words: list[np.ndarray] = []
            for _, data, offsets in text_slices(b.column(1)):
                w = Words(data, offsets)
                hashes = word_hashes(data, w.starts, w.ends, _SEED)
                order = np.argsort(hashes, kind="stable")
                h = hashes[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = h[1:] != h[:-1]
                raw = data.tobytes()
                first = order[new]
                starts, ends = w.starts[first], w.ends[first]
                counts = known.look_up(h[new], lambda k: MARK + raw[starts[k] : ends[k]].decode("utf-8", "replace"))  # noqa: B023
                per_word = np.empty(len(h), dtype=np.int64)
                per_word[order] = counts[np.cumsum(new) - 1]
                sums = np.concatenate(([0], np.cumsum(per_word)))
                totals.append(sums[w.bounds[1:]] - sums[w.bounds[:-1]])
                words.append(np.diff(w.bounds))
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.concatenate(words or none)), pa.array(np.concatenate(totals or none))], names=["doc_id", "n_words", "n_tokens"]
            )

    return run


def count_tokens(docs: DataFrame, vocabulary: dict[str, float]) -> DataFrame:
    """doc_id, n_words, n_tokens for every row.

    Null and empty texts have no tokens; a null doc_id is kept; repeated rows are each counted. A text of any
    length is counted whole, at some 60 bytes of arrays a byte; ties between segmentations are settled as the
    module says. An empty table gives an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_counted(Counter(vocabulary)), "doc_id long, n_words long, n_tokens long")
