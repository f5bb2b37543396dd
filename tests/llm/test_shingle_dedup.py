import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from siftworks.llm import shingle_dedup as D


def brute(rows):
    """Positions of the rows that stay, from all pairs of word-tuple sets."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if comp[i] != comp[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
            old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
            comp = [new if c == old else c for c in comp]
    low = {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    gone = {i for (i, _), c in zip(rows, comp, strict=True) if i is not None and low[c] != i}
    return sorted(((i, t) for i, t in rows if i not in gone), key=lambda r: (r[0] is not None, r[0]))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(rng.choices(words, k=30))  # in many texts, so its shingles crowd the heads
    texts = [None, "", " ", "One two", "one  TWO", "a b c d e f g h", "a b c d e f g h i"]
    while len(texts) < n:
        if rng.random() < 0.6 and len(texts) > 20:
            w = rng.choice(texts[7:]).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words).upper()
        else:
            w = rng.choices(words, k=rng.randint(5, 150)) + (line.split() if rng.random() < 0.4 else [])
        texts.append(" ".join(w))
    return list(enumerate(texts[:n]))


@pytest.mark.parametrize("hot, small, wide, tile", [(D.HOT, D.SMALL, D.WIDE, D.TILE), (3, 2, D.WIDE, D.TILE), (3, 2, 12, 3), (10**9, 2, 12, 5)])
def test_same_as_brute_force(spark, hot, small, wide, tile):
    rows = corpus(hot, 160)
    docs = spark.createDataFrame([*rows, (None, rows[30][1]), (40, rows[40][1])], "doc_id long, text string")
    got = D.keep_one_of_each(docs, hot, small, wide, tile)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute([tuple(r) for r in docs.collect()]), key=repr)
    assert D.keep_one_of_each(docs.limit(0), hot, small, wide, tile).collect() == []


def test_no_near_copy_stays_in_the_stage(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((r.doc_id, r.text) for r in P.simhash_dedup(spark, docs, sf_dir).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert 177 not in {i for i, _ in got} and 145 not in {i for i, _ in got}  # copies of 1 and 6, over 3 SimHash bits away


def test_positions_hold_every_similar_pair():
    n = np.arange(4, 200)
    assert (D._least_shared(n) == [-(-4 * x // 5) for x in n.tolist()]).all()


def test_differences_of_sketches_of_unlike_sizes():
    rng = np.random.default_rng(4)
    n = np.sort(rng.integers(200, 300, 40))
    h = [np.unique(rng.integers(-(2**63), 2**63 - 1, k)) for k in n]
    s = D._sketches(np.concatenate(h), np.concatenate(([0], np.cumsum([len(x) for x in h]))))
    assert len({len(x) for x in s}) == 2
    differ = D._Differences(np.array(s, dtype=object))
    for i in range(39):
        j = np.arange(i + 1, 40)
        want = [int(np.bitwise_count(D._folded(s[i], min(len(s[i]), len(s[k]))) ^ D._folded(s[k], min(len(s[i]), len(s[k])))).sum()) for k in j]
        assert differ(i, j).tolist() == want


def test_sketches_never_differ_in_more_bits_than_the_sets():
    rng = np.random.default_rng(3)
    for n, m in ((3, 4), (100, 110), (900, 1100), (5000, 5100)):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        b = np.unique(np.concatenate((rng.choice(a, n * 9 // 10, replace=False), rng.integers(-(2**63), 2**63 - 1, m - n * 9 // 10))))
        x, y = D._sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        size = min(len(x), len(y))
        differ = int(np.bitwise_count(D._folded(x, size) ^ D._folded(y, size)).sum())
        assert differ <= len(np.setxor1d(a, b)) and (differ - len(np.setxor1d(a, b))) % 2 == 0
        assert len(x) * 8 >= max(D.SKETCH, 2 * len(a)) and not np.any(D._folded(x, 64) ^ D._folded(D._folded(x, max(64, len(x) // 2)).tobytes(), 64))


def test_crowded_shingles_are_spread_and_paired_in_tiles(spark):
    docs = spark.createDataFrame(corpus(3, 400), "doc_id long, text string").select("text")
    _, (keys, parts) = D._hot(docs, 3, 12)
    assert len(keys) and (parts > 1).all() and (np.diff(keys) > 0).all()
    members = spark.createDataFrame([(7, c, 4 + c % 90, 0) for c in range(60)] + [(8, c, 9, 0) for c in range(3)], "k long, c long, n int, p int")
    rows, _ = D._tiled(members, members, 5)
    tiles = {}
    for r in rows.collect():
        tiles.setdefault(r.t, []).append(r)
    met = set()
    for own in tiles.values():
        assert len(own) < 30
        met |= {(a.k, min(a.c, b.c), max(a.c, b.c)) for a in own for b in own if a.c != b.c and (a.side, b.side) in ((0, 0), (1, 2))}
    for a, b in itertools.combinations(members.collect(), 2):
        assert a.k != b.k or 5 * min(a.n, b.n) < 4 * max(a.n, b.n) or (a.k, min(a.c, b.c), max(a.c, b.c)) in met



def test_a_tile_of_near_copies_gives_a_forest_and_says_what_it_left():
    rng = np.random.default_rng(6)
    base, m = rng.integers(-(2**63), 2**63 - 1, 100), 60
    h = [np.unique(np.concatenate((base[:95], rng.integers(-(2**63), 2**63 - 1, 5)))) for _ in range(m)]
    s = D._sketches(np.concatenate(h), np.arange(m + 1) * 100)
    most = np.full(m, 2**63 - 1)
    firsts = [np.full(m, 7), *[most] * (D.FIRST - 1)]
    tile = [np.full(m, 9), np.arange(m), np.full(m, 7), np.full(m, 100, np.int32), np.zeros(m, np.int32), np.zeros(m, np.int32), np.arange(m)]
    names = [*"tcknp", "side", "r", "s", *[f"f{i}" for i in range(D.FIRST)]]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, tile), pa.array(s, pa.binary()), *map(pa.array, firsts)], names=names)
    for forest, n, left in ((True, m - 1, [9]), (False, m * (m - 1) // 2, [])):
        rows = [r for b in D._across(forest)(iter([batch])) for r in b.to_pylist()]
        pairs = [(r["u"], r["v"]) for r in rows if r["t"] is None]
        assert len(set(pairs)) == len(pairs) == n and [r["t"] for r in rows if r["t"] is not None] == left
        roots = list(range(m))
        for u, v in pairs:
            roots = [roots[v] if x == roots[u] else x for x in roots]
        assert len(set(roots)) == 1


def test_the_stage_checks_what_simhash_links(spark, monkeypatch):
    import corpus_pipeline as P
    from siftworks.llm import simhash as S

    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base[:-1] + ["other"]), " ".join(base[:200] + ["Word"] + base[200:]), " ".join(rng.choices(base, k=300)), "a b", "b a", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {r.doc_id: r for r in D.class_table(docs).collect()}
    fps = S.fingerprints_of([(t or "").encode() for t in texts]).tolist()
    assert [sets[i].fp % 2**64 for i in range(len(texts))] == fps
    want = {tuple(sorted((sets[i].c, sets[j].c))) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i].c != sets[j].c and (fps[i] ^ fps[j]).bit_count() <= S.RADIUS}
    assert len(want) >= 1
    checked, similar = [], D._similar

    def seen(pairs, *more):
        checked.extend((r.u, r.v) for r in pairs.select("u", "v").collect())
        return similar(pairs, *more)

    monkeypatch.setattr(D, "_similar", seen)
    monkeypatch.setattr(D, "_candidates", lambda small, spread: lambda rows: D._FOUND.empty_table())  # SimHash alone
    left = sorted(r.doc_id for r in P.simhash_dedup(spark, docs, "").collect())

    def groups(pairs):
        out = {x: {x} for pair in pairs for x in pair}
        for u, v in pairs:
            both = out[u] | out[v]
            out |= dict.fromkeys(both, both)
        return set(map(frozenset, out.values()))

    assert groups(checked) == groups(want)  # linked fingerprints come as stars
    assert 1 not in left and {0, 3, 4, 5, 6} <= set(left)
