import math
import random
import re
from collections import Counter

from siftworks.llm import search as S


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def brute(docs, queries, k):
    bags = [Counter(words(t)) for _, t in docs]
    lens = [sum(b.values()) for b in bags]
    n, avg = len(docs), sum(lens) / max(1, len(docs))
    df = Counter(w for b in bags for w in b)
    out = []
    for q, text in queries.items():
        asked = Counter(words(text))
        scored = []
        for (i, _), b, dl in zip(docs, bags, lens, strict=True):
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * dl / avg)) for w, c in sorted(asked.items()) if b[w])
            if s > 0:
                scored.append((-round(s, 9), i if i is not None else -(2**63), s))
        for rank, (_, i, s) in enumerate(sorted(scored)[:k], 1):
            out.append((q, rank, i if i != -(2**63) else None, round(s, 5)))
    return sorted(out, key=lambda r: r[:2])


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"W{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([3, 20, 60, 200])))) for i in range(400)]
    docs += [(900, None), (901, ""), (None, "w1 w2 w3"), (902, docs[0][1]), (0, docs[0][1]), (903, "w5 " * 20_000), (904, "Only-here w1")]
    queries = {i: t for i, t in docs if i is not None and i % 100 == 0 and i != 0}
    queries[0] = docs[0][1]
    df = spark.createDataFrame([(i, t, 0, 0.0) for i, t in docs], "doc_id long, text string, rank int, score double")
    qs = spark.createDataFrame([*queries.items(), (None, "w1"), (901, ""), (5, "unknownword")], "query_id long, text string")
    queries[901] = ""
    got = S.search(df.repartition(3), qs, k=7).collect()
    assert sorted(((r.query_id, r.rank, r.doc_id, round(r.score, 5)) for r in got), key=lambda r: r[:2]) == brute(docs, queries, 7)


def test_pruned_blocks_equal_full_scores():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(500)], k=rng.choice([5, 50, 100]))) for _ in range(1500)]
    r = S._shard(np.arange(1500), pa.array(texts))
    shard = S.Shard(r, 50.0)
    full = np.zeros(1500)
    for q in (3, 77, 400):
        t, _, n, _ = S.bags(pa.array([texts[q]]))
        w = n * 1.3
        full[:] = 0
        at = np.searchsorted(shard.terms, t)
        offsets = np.frombuffer(r["offsets"], dtype=np.uint32)
        for a, x in zip(at, w, strict=True):
            full[shard.docs[offsets[a] : offsets[a + 1]]] += x * shard.impact[offsets[a] : offsets[a + 1]]
        order = np.lexsort((shard.ids, -np.round(full, 9)))[:10]
        score, ids = shard.search(t, w, (np.zeros(0), np.zeros(0, np.int64)), 10)
        assert ids.tolist() == shard.ids[order].tolist() and np.allclose(score, full[order])


def test_queries_in_many_blocks(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices("abcdefghij", k=rng.choice([3, 20])))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    qs = df.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "query_id")
    want = brute(docs, {i: t for i, t in docs if i % 10 == 0}, 5)
    monkeypatch.setattr(S, "BLOCK_BYTES", 400)
    got = S.search(df.repartition(3), qs, k=5).collect()
    got = sorted((tuple(r) for r in got), key=lambda r: r[:2])
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 2e-5 for a, b in zip(got, want, strict=True))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert S.search(df, qs).collect() == []
    assert S.search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), qs.limit(0)).collect() == []


def test_queries_together_equal_full_scores(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(700)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(700)], k=rng.choice([1, 5, 50, 400]))) for _ in range(900)]
    texts += texts[:30] + [""] * 5
    for name, value in (("DENSE", 40), ("BATCH", 7), ("TILE", 4 * S.BLOCK), ("POSTINGS", 50)):
        monkeypatch.setattr(S, name, value)
    n = len(texts)
    shard = S.Shard(S._shard(np.arange(n), pa.array(texts)), 100.0)
    asked = [*range(0, n, 31), 934]
    term, row, times, _ = S.bags(pa.array([texts[q] for q in asked]))
    order = np.lexsort((term, row))
    term, weights = term[order], times[order] * 1.3
    starts = np.append(0, np.cumsum(np.bincount(row, minlength=len(asked))))
    known, place = np.unique(np.append(term, np.uint64(5)), return_inverse=True)
    full = np.zeros((len(asked), n))
    for q in range(len(asked)):
        for t, w in zip(term[starts[q] : starts[q + 1]], weights[starts[q] : starts[q + 1]], strict=True):
            own = np.flatnonzero(shard.terms[shard.of_term] == t)
            full[q, shard.docs[own]] += w * shard.impact[own]
    tenth = np.sort(full, axis=1)[:, -10]
    for floors in (np.zeros(len(asked)), tenth, tenth * 1.01):
        got, rough = ([(np.zeros(0), np.zeros(0, np.int64)) for _ in asked] for _ in range(2))
        shard.search_all(S.Asked(starts, place[:-1], weights, known), got, 10, floors)
        shard.search_all(S.Asked(starts, place[:-1], weights, known), rough, 10, 0 * floors, rough=True)
        for q, (score, ids) in enumerate(got):
            keep = np.flatnonzero(full[q] >= max(floors[q], 1e-300))
            keep = keep[np.lexsort((shard.ids[keep], -full[q, keep]))[:10]]
            assert ids.tolist() == shard.ids[keep].tolist() and score.tolist() == full[q, keep].tolist()
            assert len(rough[q][0]) >= len(score) and (rough[q][0][: len(score)] <= score).all()
