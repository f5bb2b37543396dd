import random

import numpy as np
import pyarrow as pa
import pytest

from siftworks.llm._stage import clear, connected_components, shared_dir, stage, unstage
from siftworks.llm._text import LONG, Roller, Words, text_slices, word_hashes


def brute(edges):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return sorted((x, find(x)) for x in parent)


GRAPHS = {
    "path": [(i, i + 1) for i in range(60)],
    "star": [(0, i) for i in range(1, 80)],
    "random": [(random.Random(i).randrange(60), random.Random(-i - 1).randrange(60)) for i in range(45)],
    "negative and repeated": [(-5, 3), (3, -5), (3, 9), (-(2**63), 2**63 - 1)],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    edges = [(a, b) for a, b in GRAPHS[name] if a != b]
    df = spark.createDataFrame([*GRAPHS[name], (None, 1), (4, 4)], "u long, v long")
    assert sorted(tuple(r) for r in connected_components(df).collect()) == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_staged_tables_can_be_deleted(spark):
    t = stage(spark.range(5).toDF("x"), "t")
    assert t.count() == 5
    unstage(t)
    unstage(spark.range(1))


def test_words_and_windows():
    texts = ["a b", None, "", "  x\ty ", "one", "ü é\n", "a b", "z" * 100]
    for most in (1, 5, 10_000):
        got = []
        for row0, data, offsets in text_slices(pa.array(texts), most):
            w = Words(data, offsets)
            raw = data.tobytes()
            for i in range(len(offsets) - 1):
                got.append((row0 + i, [raw[s:e].decode() for s, e in zip(w.starts[w.bounds[i] : w.bounds[i + 1]], w.ends[w.bounds[i] : w.bounds[i + 1]])]))
        assert got == [(k, (t or "").split()) for k, t in enumerate(texts)]


def test_hashes_depend_on_content_alone():
    words = [b"abc", b"", b"a", b"a\0", b"abcdefgh", b"abcdefghi", b"abcdefgh\0", b"x" * LONG, b"x" * (LONG + 1), b"y" * 5000, b"abc"]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    h = word_hashes(data, ends - [len(w) for w in words], ends, 9)
    assert len(set(h.tolist())) == len(set(words)) and h[0] == h[-1]
    for w, x in zip(words, h.tolist(), strict=True):
        alone = np.frombuffer(w, dtype=np.uint8)
        assert word_hashes(alone, np.array([0]), np.array([len(w)]), 9)[0] == x != word_hashes(alone, np.array([0]), np.array([len(w)]), 8)[0]
    r = Roller(9)
    at = np.array([0, 3, 1])
    windows = r.ranges(np.append(h[:3], h[:3]), at, at + 3)
    assert windows[0] == windows[1] != windows[2]


def test_clear_deletes_all_but_one(spark):
    a, b = stage(spark.range(5).toDF("x"), "a"), stage(spark.range(6).toDF("x"), "b")
    clear(spark, keep=b)
    assert b.count() == 6
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(a._staged_at)


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    from types import SimpleNamespace

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))
