import itertools
import random

import numpy as np
import pytest
import xxhash

from siftworks.llm import simhash as S


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    h = np.array(h, dtype=np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))


def brute_components(rows):
    fps = [brute_fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(rows)), 2):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    groups = {}
    for i, c in enumerate(comp):
        groups.setdefault(c, []).append(rows[i][0])
    low = {c: min((x for x in ids if x is not None), default=None) for c, ids in groups.items()}
    return [(rows[i][0], f"{fps[i]:016x}", low[comp[i]]) for i in range(len(rows))]


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(6)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5, 60])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i * 3 + 1, " ".join(text)))
    rows += [(None, rows[0][1]), (None, "only here with no id at all"), (5000, None), (5001, ""), (5002, " \t\n"), (5003, "One"), (5004, "one"), (5005, "a b"), (2, rows[5][1]), (2, rows[5][1])]
    return rows + [(6000, "word " * 20_000), (6001, "Ünïcode ÀB cd ef")]


@pytest.mark.parametrize("hot", [512, 3])
def test_components_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(S.fingerprint_links, "__defaults__", (hot,))
    rows = corpus(7, 120)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, root string")
    got = [tuple(r) for r in S.simhash_components(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


def test_every_pair_within_the_radius_shares_a_table():
    masks = S.mask_tables(0)
    assert len(masks) == 15
    rng = random.Random(1)
    for flips in itertools.chain(itertools.combinations(range(64), 2), (rng.sample(range(64), 3) for _ in range(5000))):
        d = sum(1 << f for f in flips)
        assert any(not d & m for m in masks)
    for level in (1, 2):
        inner = S.mask_tables(level)
        for _ in range(300):
            d = sum(1 << f for f in rng.sample(range(64), 3))
            up = [k for k, m in enumerate(S.mask_tables(level - 1)) if not d & m]
            assert all(any(not d & inner[k * 15 + j] for j in range(15)) for k in up)
    assert max(64 - m.bit_count() for m in S.mask_tables(2)) <= 8


def test_roots_against_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    f = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(20)]))
    r = S._roots(f)
    for i in range(len(f)):
        for j in range(i):
            if int(f[i] ^ f[j]).bit_count() <= 3:
                assert r[i] == r[j]


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_keep_one(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, "quite another text here now"), (None, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or -1) for r in S.keep_one_of_each(df).collect()) == [-1, 1, 3]
