import hashlib
import random
import re

import pytest

from siftworks.llm import substring_dedup as D


def brute(rows, window=13):
    docs = [(i if i is not None else 2**63 - 1, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for (i, w), (raw, _) in zip(docs, rows, strict=True):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((raw, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passages = [[rng.choice(words) for _ in range(rng.choice([12, 13, 14, 30, 80]))] for _ in range(12)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(rng.randrange(6)):
            text += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(40))]
        rows.append((rng.randrange(70), rng.choice([" ", "\n", "  \t"]).join(text)))
    rows += [(None, rows[3][1]), (None, None), (7, None), (8, ""), (9, " \n "), (10, "ünï " * 15), (11, "ünï " * 15), (12, "x y " * 30_000), (13, "x y " * 40)]
    return rows


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize(("seed", "blocks"), [(1, 8), (2, 1), (3, 64)])
def test_against_brute_force(spark, seed, blocks):
    rows = corpus(seed)
    df = spark.createDataFrame([(t, i, 1, "b") for i, t in rows], "text string, doc_id long, block int, bucket string")
    assert plain(D.substring_dedup(df, blocks=blocks).collect()) == plain(brute(rows))


@pytest.mark.parametrize(("blocks", "fan"), [(16, 4), (7, 3), (9, 2)])
def test_relays_against_brute_force(spark, blocks, fan):
    rows = corpus(blocks)
    df = spark.createDataFrame([(t, i) for i, t in rows], "text string, doc_id long")
    assert plain(D.substring_dedup(df, blocks=blocks, fan=fan).collect()) == plain(brute(rows))


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_a_power_of_two_modulus_confuses(spark):
    one = thue_morse(10)
    other = one.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(12)]
    rows = [(1, " ".join([*around, one])), (2, " ".join([*around, other])), (3, " ".join([*around, one]))]
    got = {r.doc_id: r.n_removed for r in D.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), blocks=2).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_null_ids_and_repeated_rows_are_dealt_over_blocks(spark):
    rows = [(None, f"t{k % 5} " * 20) for k in range(40)] + [(7, f"r{k % 3} " * 20) for k in range(30)] + [(9, "t1 " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "text")
    assert plain(D.substring_dedup(df, blocks=8).collect()) == plain(brute(rows))


def test_kept_texts_and_other_columns(spark):
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(2, f"before it\n\n{shared} after  it", "b", 0), (1, shared, "a", 0), (3, shared, "c", 0), (4, None, "d", 9), (5, "as  it\twas ", "e", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").selectExpr("*", "source as block", "source as id", "n_chars as row", "struct(source) as `a.b`")
    got = {r.doc_id: r for r in D.deduplicated(df, blocks=4).collect()}
    assert got[1].text == shared and got[2].text == "before it\nafter  it" and got[3].text == "" and got[4].text is None
    assert got[5].text == "as  it\twas " and got[2].n_chars == len(got[2].text) and got[4].n_chars == 9 and got[2].source == got[2].block == got[2].id == got[2]["a.b"].source == "b" and got[4].row == 9


def test_any_two_starts_share_a_cover_position():
    for t in range(D.PERIOD):
        assert any(a in D.COVER and (a + t) % D.PERIOD in D.COVER for a in range(D.PERIOD))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert D.substring_dedup(df, blocks=4).collect() == [] and D.deduplicated(df, blocks=4).collect() == []
