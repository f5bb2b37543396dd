import random
import re

import pytest

from siftworks.llm import token_counts as T

PIECES = {"▁": -2.0, "▁a": -1.5, "a": -2.5, "b": -3.0, "ab": -2.8, "▁ab": -3.5, "abc": -4.0, "c": -3.0, "bc": -5.5, "é": -3.0, "aa": -5.0}


def brute(word, pieces):
    """All segmentations: the best score, then longest last pieces."""
    word = T.MARK + word

    def ways(end):
        if not end:
            yield 0.0, (), 0
        for k in range(end, 0, -1):
            p = word[end - k : end]
            own = [(pieces[p], 1)] if p in pieces else []
            if k == 1 and p not in pieces:
                n = len(p.encode())
                own.append((T.UNKNOWN * n, n))
            for s, n in own:
                for score, lens, count in ways(end - k):
                    yield score + s, (k, *lens), count + n

    return max(ways(len(word)), key=lambda w: (round(w[0], 9), w[1]))[2]


def test_against_all_segmentations():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("aabcé☃x") for _ in range(rng.randrange(1, 9))) for _ in range(300)})
    got = T.Counter(PIECES).sorted_counts([T.MARK + w for w in words])
    assert got == [brute(w, PIECES) for w in words]


def test_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(30))), "x") for i in range(50)]
    rows += [(None, "a b", "x"), (60, None, "x"), (61, "", None), (62, " \n", "x"), (1, "ab", "x"), (1, "ab", "x"), (63, "abc\t" * 50_000, "x"), (64, "a" * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = [tuple(r) for r in T.count_tokens(df, PIECES).collect()]
    for (i, text, _), r in zip(rows, got, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert r[:2] == (i, len(words))
        if len(words) < 100 and all(len(w) < 20 for w in words):
            assert r[2] == sum(brute(w, PIECES) for w in words)
    assert got[-2][2] == 50_000 * brute("abc", PIECES)
    assert T.count_tokens(df.limit(0), PIECES).collect() == []


def test_known_counts_do_not_change_results(monkeypatch):
    monkeypatch.setattr(T, "MOST_KNOWN", 3)
    import numpy as np

    known = T.Known(T.Counter(PIECES))
    words = ["a", "ab", "abc", "b", "c", "aa"]
    for part in (words, words[::-1], words[2:]):
        h = np.array([hash(w) % 2**64 for w in part], dtype=np.uint64)
        order = np.argsort(h)
        got = known.look_up(h[order], lambda k: T.MARK + part[order[k]])  # noqa: B023
        assert got.tolist() == [brute(part[k], PIECES) for k in order]


def test_public_vocabulary():
    pytest.importorskip("sentencepiece")
    v = T.read_vocabulary()
    assert len(v) > 30_000 and all(s < 0 for s in v.values())
    with pytest.raises(ValueError):
        T.read_vocabulary(most=10)
