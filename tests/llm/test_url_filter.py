import itertools
import random
import re
import time

import numpy as np
import pytest

from pyspark.sql import functions as F

from siftworks.llm import url_filter as U

URLS = [
    "https://A.Example.NET/en/1?x=1", "http://example.net/EN/1", "http://example.net/en/", "http://example.net", "http://badexample.net/en/", "https://x.com/de/", "http://m.example.com/de/5#t",
    "http://example.com/de", "ftp://a.org/fr/1", "http://org/fr/x", "http://a.org/france", None, "", "no scheme/net/", "http://", "http:///de/", "a://b://c/d", "http://u@net:80/x", "http://net/\n/y", "http://x.net?a/b", "http://x.net/" + "a" * 50_000,
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fit, key=lambda r: len(r.text)) if fit else None


def labelled(spark):
    rows = [(f"http://spam-{i % 3}.example.com/{'win' if i % 2 else 'news'}/{i}.html?utm={i}", bool(i % 2)) for i in range(200)] + [(None, True), ("http://x", None)]
    return spark.createDataFrame(rows, "url string, bad boolean")


def test_explicit_rules_and_mined_rules_against_brute_force(spark):
    mined = U.mine_rules(labelled(spark), rows=10, confidence=0.6)
    rules = [set(r.tokens) for r in mined.collect()]
    assert rules == [{"p:win"}]
    urls = [*URLS, "http://spam-1.example.com/win/7.html", "http://other.example.com/WIN/", "http://x.net/win/", "http://x.net/win/"]
    df = spark.createDataFrame([(k if k % 5 else None, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    tokens = {u: set(t or []) for u, t in spark.createDataFrame([(u,) for u in set(urls)], "url string").select("url", U.tokens_of(F.col("url"))).collect()}
    want = []
    for k, u in enumerate(urls):
        host, path, rule = brute(u)
        verdict = rule.verdict if rule else "block" if any(r <= tokens[u] for r in rules) else "allow"
        want.append((k if k % 5 else None, host, path, rule.text if rule else None, verdict))
    got = [tuple(r) for r in U.judge(df, mined).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_without_labels_there_are_no_rules(spark):
    mined = U.mine_rules(labelled(spark).limit(0))
    df = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert mined.count() == 0 and U.judge(df, mined).collect()[0].verdict == "allow"
    assert U.judge(df.limit(0), mined).collect() == []


def test_weaker_combinations_are_pruned(spark):
    rules = {tuple(r.tokens): r.confidence for r in U.mine_rules(labelled(spark), rows=2, confidence=0.3).collect()}
    for a, c in rules.items():
        assert not any(set(b) < set(a) and d >= c for b, d in rules.items())


def brute_rules(baskets, rows, confidence):
    """All sets of items, where tokens of the same urls are one item: tokens to confidence."""
    where = {}
    for k, (t, _) in enumerate(baskets):
        for x in t:
            where.setdefault(x, set()).add(k)
    bad = {k for k, (_, b) in enumerate(baskets) if b}
    items = {}
    for x, rows_of in where.items():
        if len(rows_of & bad) >= rows:
            items.setdefault(frozenset(rows_of), set()).add(x)
    confident = {}
    for n in range(1, len(items) + 1):
        for combination in itertools.combinations(items, n):
            both = frozenset.intersection(*combination)
            if len(both & bad) >= rows:
                confident[frozenset(combination)] = (len(both & bad) / len(both), len(both))
    out = {}
    for x, (c, n) in confident.items():
        z = U.QUANTILE
        low = (c + z * z / (2 * n) - z * ((c * (1 - c) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)
        if c >= confidence and low > len(bad) / len(baskets) and not any(y < x and d >= c for y, (d, _) in confident.items()):
            out[tuple(sorted(t for i in x for t in items[i]))] = c
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_rules_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        keys = [k for k, p in zip("abcdef", (0.5, 0.4, 0.3, 0.6, 0.2, 0.5)) if rng.random() < p]
        keys += ["g", "h"] if "a" in keys and rng.random() < 0.8 else []
        bad = rng.random() < (0.9 if {"a", "b"} <= set(keys) else 0.8 if "e" in keys else 0.2)
        rows.append((f"http://x.org/p?{'&'.join(k + '=1' for k in keys)}", bad))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    baskets = [(set(r.t), r.bad) for r in df.select(U.tokens_of(F.col("url")).alias("t"), "bad").collect()]
    want = brute_rules(baskets, 15, 0.5)
    got = {tuple(r.tokens): r.confidence for r in U.mine_rules(df, rows=15, confidence=0.5).collect()}
    assert got == want and len(want) > 1


def test_many_keys_are_mined_in_seconds(spark):
    rng = random.Random(7)
    wide = "&".join(f"k{i}=1" for i in range(200))
    rows = [(f"http://a.org/{i}?x=1", i % 3 == 0) for i in range(50)] + [("http://a.org/z?" + wide, True)]
    rows += [("http://b.org/t?" + "&".join(f"m{i}=1" for i in range(40)), True)] * 40
    rows += [("http://c.org/t?" + "&".join(f"n{i}=1" for i in range(30) if rng.random() < 0.9), True) for _ in range(80)]
    start = time.monotonic()
    df = spark.createDataFrame(rows, "url string, bad boolean")
    mined = U.mine_rules(df)
    pages = spark.createDataFrame([(1, "http://b.org/other"), (2, "http://a.org/z?" + wide), (3, "http://d.com/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge(pages, mined).collect()}
    assert got[3] == "allow" and time.monotonic() - start < 120


def test_urls_with_spaces_are_told_apart(spark):
    mined = spark.createDataFrame([(["p:b"], "p:b", 0.9)], "tokens array<string>, key string, confidence double")
    pages = spark.createDataFrame([(1, "http://q.org/a p:b"), (2, "http://q.org/a/b"), (3, "http://q.org/a p:b")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in U.judge(pages, mined).collect()} == {1: "allow", 2: "block", 3: "allow"}


def all_rules(baskets, rows, confidence):
    """As brute_rules, over all sets of up to some 20 items at once: sets are bit masks."""
    where = {}
    for k, (t, _) in enumerate(baskets):
        for x in t:
            where.setdefault(x, set()).add(k)
    merged = {}
    for x, rows_of in where.items():
        if sum(baskets[k][1] for k in rows_of) >= rows:
            merged.setdefault(frozenset(rows_of), []).append(x)
    items = list(merged.values())
    counts = np.zeros((2, 1 << len(items)))
    for t, b in baskets:
        counts[int(b), sum(1 << j for j, x in enumerate(items) if x[0] in t)] += 1
    halves = [(np.arange(1 << len(items)) >> j & 1).astype(bool) for j in range(len(items))]
    for j, has in enumerate(halves):  # urls that hold the set and more
        counts[:, ~has] += counts[:, has]
    good, bad = counts
    ok = bad >= rows
    ok[0] = False
    c = np.where(ok, bad / np.maximum(bad + good, 1), 0)
    most = c.copy()
    for has in halves:
        most[has] = np.maximum(most[has], most[~has])
    below = np.zeros(len(c))
    for has in halves:
        below[has] = np.maximum(below[has], most[~has])
    n, z = np.maximum(bad + good, 1), U.QUANTILE
    low = (c + z * z / (2 * n) - z * np.sqrt((c * (1 - c) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    rule = ok & (c >= confidence) & (low > bad[0] / (bad[0] + good[0])) & (c > below)
    return {tuple(sorted(t for j, x in enumerate(items) if m >> j & 1 for t in x)): c[m] for m in map(int, np.flatnonzero(rule))}


@pytest.mark.parametrize("seed", [1, 2])
def test_urls_of_many_items_are_mined_whole(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        pair = rng.choice(("", "a", "b", "ab"))
        bad = rng.random() < {"": 0.5, "a": 0.05, "b": 0.05, "ab": 0.85}[pair]
        # 17 parameters that nearly all urls have go more with bad labels than a and b do
        gone = {j for j in range(17) if i in (20 * j, 20 * j + 1) and bad or i > 396 and rng.random() < 0.5}
        keys = [*pair, *(f"f{j}" for j in range(17) if j not in gone)]
        rows.append((f"http://x.org/p?{'&'.join(k + '=1' for k in keys)}", bad and i <= 396))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    baskets = [(set(r.t), r.bad) for r in df.select(U.tokens_of(F.col("url")).alias("t"), "bad").collect()]
    want = all_rules(baskets, 15, 0.5)
    got = {tuple(r.tokens): r.confidence for r in U.mine_rules(df, rows=15, confidence=0.5).collect()}
    assert got == want and any({"q:a", "q:b"} <= set(x) for x in want)


@pytest.mark.parametrize("seed", [3, 4])
def test_long_rules_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        keys = [k for k in "abcdefghij" if rng.random() < 0.75]
        bad = rng.random() < 0.05 + 0.9 * len(set(keys) & set("abcdef")) ** 4 / 6**4
        rows.append((f"http://x.org/p?{'&'.join(k + '=1' for k in keys)}", bad))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    baskets = [(set(r.t), r.bad) for r in df.select(U.tokens_of(F.col("url")).alias("t"), "bad").collect()]
    want = all_rules(baskets, 15, 0.5)
    got = {tuple(r.tokens): r.confidence for r in U.mine_rules(df, rows=15, confidence=0.5).collect()}
    assert got == want and max(map(len, want)) > 4
