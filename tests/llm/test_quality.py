import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siftworks.llm import quality as Q
from siftworks.llm._features import SHARES, counts


def corpus(n=400, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeiourstn") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 200))]
        good = i % 5 != 1
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words) if i % 2 else " ".join(w + rng.choice(["%%%", "$$$"]) for w in words)
        docs.append((i, text, "x", 0.5))
        if i % 2 or i % 3 == 0:
            labels.append((i, int(good), 0))
    return docs, labels


D, L = "doc_id long, text string, lang string, score double", "doc_id long, quality int, toxic int"


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    extra = [(9001, None, "x", 0.0), (9002, "", None, 0.0), (9003, " \n\t", "x", 0.0), (None, "Plain words of a text.", "x", 0.0), (3, docs[3][1], "x", 0.0), (9004, "word " * 60_000, "x", 0.0)]
    df = spark.createDataFrame(docs + extra, D)
    ldf = spark.createDataFrame([*labels, (None, 1, 0), (0, None, 0), (3, 1, None), (3, 1, None)], L)
    model = Q.fit_quality(df, ldf)
    rows = Q.score_quality(df, model).collect()
    assert len(rows) == len(docs) + len(extra)
    truth = dict((i, q) for i, q, _ in labels)
    held = [r for r in rows if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert all(not r.held_out for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5)
    known = [r for r in held if r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in known]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert [r.score for r in Q.score_quality(df, Q.fit_quality(df, ldf)).collect()] == [r.score for r in rows]


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus()
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    df = spark.createDataFrame(docs, D)
    a, b = (Q.fit_quality(df, spark.createDataFrame(x, L)) for x in (labels, turned))
    assert a.prior == b.prior and np.array_equal(a.means, b.means)


def test_few_rows_of_a_class_are_enough(spark):
    docs, labels = corpus()
    known = dict((i, q) for i, q, _ in labels)
    seen = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5]
    few = [x for x in seen if not x[1]][:3] + [x for x in seen if x[1]][:30]
    df = spark.createDataFrame(docs, D)
    rows = Q.score_quality(df, Q.fit_quality(df, spark.createDataFrame(few, L))).collect()
    assert np.mean([r.predicted == known[r.doc_id] for r in rows if r.doc_id in known]) > 0.9


def test_sample_is_bounded_for_each_class_and_the_prior_is_of_all(spark):
    docs, labels = corpus()
    df, ldf = spark.createDataFrame(docs + docs[:50], D), spark.createDataFrame(labels, L)
    seen = [q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5]
    assert len({r.doc_id for r in Q.labelled(df, ldf, 20).collect()}) == 20
    assert Q.fit_quality(df, ldf, 20).prior == (sum(seen) + 1) / (len(seen) + 2)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)]])
def test_without_usable_labels_the_prior_is_the_score(spark, labels):
    df = spark.createDataFrame([(1, "a b", "x", 0.0), (2, None, "x", 0.0)], D)
    rows = Q.score_quality(df, Q.fit_quality(df, spark.createDataFrame(labels, L))).collect()
    assert len({r.score for r in rows}) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], D)
    assert Q.score_quality(df, Q.fit_quality(df, spark.createDataFrame([], L))).collect() == []


def test_mahalanobis_by_cholesky_equals_the_density():
    rng = np.random.default_rng(0)
    n = len(SHARES)
    part, whole = rng.random((300, n)) * 20, np.full((300, n), 40.0)
    part[200:] += 15
    sizes = np.stack([rng.integers(5, 90, 300), rng.integers(50, 400, 300)], axis=1).astype(float)
    y = np.array([1] * 200 + [0] * 100)
    m = Q.Discriminant.fit(part, whole, sizes, y)
    texts = pa.array(["Some plain words, a few of them.", None, "SHOUT!! LOUD!! WORDS!!"])
    from siftworks.llm._features import transformed

    z = (transformed(*counts(texts), m.average) - m.centre) / m.scale
    logs = []
    for mean, factor in zip(m.means, m.factors, strict=True):
        cov = factor @ factor.T
        logs.append([-0.5 * (x - mean) @ np.linalg.solve(cov, x - mean) - 0.5 * np.linalg.slogdet(cov)[1] for x in z])
    odds = np.array(logs[1]) - np.array(logs[0]) + np.log(m.prior / (1 - m.prior))
    assert np.allclose(m.scores(texts), 1 / (1 + np.exp(-odds)))


def brute_counts(text):
    """The shares of _features in plain Python: counts, totals, and (words, bytes in words)."""
    from collections import Counter

    raw = (text or "").encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n")[:-1]] + ([raw.split(b"\n")[-1]] if raw.split(b"\n")[-1] else [])
    # the last line has no line break, so it differs from the same line with one
    distinct = len({(x, k < raw.count(b"\n")) for k, x in enumerate(lines)})
    among = lambda b, chars: b in chars.encode()
    upper, lower, digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    plain, symbols = ".,;:'\"?-()", "#$%&*+/<=>@[\\]^_`{|}~!"
    n = lambda chars: sum(among(b, chars) for b in raw)
    ups = [sum(among(b, upper) for b in w) for w in words]
    lows = [sum(among(b, lower) for b in w) for w in words]
    part = [
        n(upper), n(digit), n(plain), n(symbols), sum(among(w[-1], symbols) for w in words),
        sum(not any(b >= 128 or among(b, upper + lower + digit) for b in w) for w in words),
        sum(u > 1 and not lo for u, lo in zip(ups, lows, strict=True)), sum(among(w[-1], ".?!") for w in words), sum(len(w) <= 3 for w in words),
        max(Counter(words).values(), default=0), sum(a == b for a, b in zip(words, words[1:], strict=False)), len(lines), len(lines) - distinct, len(words) - len(set(words)),
    ]
    whole = [len(words)] * len(part)
    whole[0], whole[12] = n(upper) + n(lower), len(lines)
    return part, whole, [len(words), sum(map(len, words))]


def test_shares_against_plain_python(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += [None, "", "\n", "a\na\na", "a\n\n a \x0bB!! B!! 12.", "É é %% %%", "x" * 3000]
    got = counts(pa.array(texts))
    for k, t in enumerate(texts):
        for have, want in zip(got, brute_counts(t), strict=True):
            assert have[k].tolist() == [float(x) for x in want], t


def test_counts_of_slices_equal_counts_alone():
    texts = ["A b.\nA b.\n", None, "", "x " * 3000, "Ü$ 12 ok!", "one\n\ntwo two"]
    whole = counts(pa.array(texts))
    for k, t in enumerate(texts):
        for a, b in zip(whole, counts(pa.array([t], pa.string())), strict=True):
            assert np.array_equal(a[k], b[0])
