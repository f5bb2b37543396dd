import hashlib
import re

import pytest

from siftworks.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int"


def water_fill(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if target[s] > 3 * sizes[s]}
        if not over:
            return target | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def brute(rows):
    n = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]
    sizes = {}
    for (_, _, s, _), k in zip(rows, n, strict=True):
        sizes[s] = sizes.get(s, 0) + k
    targets = water_fill(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    out = []
    for (i, _, s, _), k in zip(rows, n, strict=True):
        rate = targets[s] / sizes[s] if sizes[s] else 0.0
        coin = int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
        out.append((i, k, sizes[s], targets[s], (int(rate) + (coin < rate - int(rate))) * k))
    return out


CASES = {
    "plain": [(i, "w " * (i % 7 + 1), f"s{i % 4}", 9) for i in range(200)],
    "one source far below its share": [(i, " a\tb ", "a" if i < 3 else "b" if i < 90 else "c", 0) for i in range(300)],
    "nulls, empty, repeats": [(1, None, None, 1), (None, "x y", "s", 1), (None, "x y", "s", 1), (2, "", "t", 1), (2, "a b c\r\n", None, 1)],
    "no words": [(1, None, "a", 1), (2, " \n", "b", 1)],
    "one huge text": [(1, "word " * 300_000, "a", 1), (2, "x", "b", 1)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, name):
    rows = CASES[name]
    got = mixing.mixed(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "size", "source_size", "target", "taken").collect()
    want = brute(rows)

    def plain(r):
        return (r[0] is not None, r[0] or 0, r[1], r[2], round(r[3], 6), r[4])

    assert sorted(map(plain, got)) == sorted(map(plain, want))


def test_sources_come_near_their_targets(spark):
    rows = [(i, "w " * (1 + i % 50), "abc"[i % 3] if i % 9 else "d", 0) for i in range(6000)]
    source = {i: s for i, _, s, _ in rows}
    got = [r for r in mixing.mixed(spark.createDataFrame(rows, SCHEMA)).collect()]
    for s in "abcd":
        own = [r for r in got if source[r.doc_id] == s]
        rate = own[0].target / own[0].source_size
        sigma = (sum(r.size**2 for r in own) * (rate % 1) * (1 - rate % 1)) ** 0.5
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4 * sigma + 1
        assert all(r.taken <= 3 * r.size for r in own)


def test_mix_repeats_rows(spark):
    rows = [(i, "w x", "ab"[i % 2], 0) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.doc_id: r.copies for r in mixing.mixed(df).collect() if r.copies}
    rows = mixing.mix_documents(df).collect()
    got = [r.doc_id for r in rows]
    assert {i: got.count(i) for i in set(got)} == want
    assert all(sorted(r["copy"] for r in rows if r.doc_id == i) == list(range(1, n + 1)) for i, n in want.items())


def test_mix_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b", "s", 5)], SCHEMA).selectExpr("*", "1 as copy", "2 as row", "3 as target", "4 as target_source", "5 as copies", "6 as `x.y`", "7 as taken")
    out = mixing.mix_documents(df)
    assert out.columns == [*df.columns, "_copy"] and {tuple(r[: len(df.columns)]) for r in out.collect()} == {tuple(df.first())}
