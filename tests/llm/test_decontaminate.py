import random
import re

import pytest

from siftworks.llm import decontaminate as D


def lower(word):
    return "".join(c.lower() if ord(c) < 2048 and len(c.lower().encode()) == len(c.encode()) else c for c in word)


def template(text):
    out = []
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        w = re.sub(r"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x00-\x1f]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x00-\x1f]+$", "", w)
        if not w:
            continue
        low = lower(w)
        kind = "n" if re.search("[0-9]", w) or low in D.NUMBERS else "u" if low in D.UNITS else "N" if lower(w[0]) != w[0] else ""
        out.append((kind, low))
    return out


def match(a, b):
    if [x for _, x in a] == [x for _, x in b]:
        return "exact"
    caseless = [[(k if k in ("n", "u") else "", x) for k, x in w] for w in (a, b)]
    return match_template(a, b) or match_template(*caseless)


def match_template(a, b):
    there, literals = {}, 0
    for (k, x), (l, y) in zip(a, b, strict=True):
        if k != l or (not k and x != y) or (k and there.setdefault((k, x), y) != y):
            return None
        literals += not k
    return "reparameterised" if literals >= D.LITERALS else None


def shapes(w):
    return {("t", *(k or x for k, x in w)), ("c", *(k if k in ("n", "u") else x for k, x in w)), ("p", *(x for _, x in w))}


def brute(docs, items, least=1):
    """All pairs of windows, by way of what any match must share."""
    out = []
    at = {}
    parsed = [(j, template(item)) for j, item in items]
    for j, (_, b) in enumerate(parsed):
        n = min(13, len(b))
        for q in range(len(b) - n + 1 if n else 0):
            for x in shapes(b[q : q + n]):
                at.setdefault(x, []).append((j, q))
    for i, text in docs:
        t = template(text)
        kinds = {}
        for n in {min(13, len(b)) for _, b in parsed} - {0}:
            if n < least and len(t) != n:
                continue
            for p in range(len(t) - n + 1):
                hits = {}
                for j, q in {y for x in shapes(t[p : p + n]) for y in at.get(x, [])}:
                    if len(parsed[j][1][q : q + 13]) == n and (m := match(parsed[j][1][q : q + n], t[p : p + n])):
                        hits[j] = min(m, hits.get(j, m))
                for j, m in hits.items():
                    kinds.setdefault(j, []).append(m)
        out += [(i, parsed[j][0], len(ms), ms.count("exact"), "exact" if "exact" in ms else "reparameterised") for j, ms in kinds.items()]
    return out


ITEMS = [
    (1, "Alice has 12 apples and gives 5 apples to Bob so how many apples does Alice have left after 3 days"),
    (2, "A train leaves at 9 and runs 60 km per hour for 2 hours before it stops and waits there for long"),
    (7, "Ж Čas vital àé 8 mots qui restent toujours les mêmes dans la phrase finale ici"), (8, " ".join(str(k % 7) for k in range(40))),
    (3, "short item here"), (4, None), (5, ""), (6, "Élan vital àé 7 mots qui restent toujours les mêmes dans la phrase finale ici"),
    (1, "Alice has 12 apples and gives 5 apples to Bob so how many apples does Alice have left after 3 days"),
]
DOCS = [
    (10, "Intro words. " + ITEMS[0][1] + " and more."),
    (11, "Other. Carol has 40 apples and gives 9 apples to Dave so how many apples does Carol have left after 8 days? yes"),
    (12, "Carol has 40 apples and gives 9 apples to Dave so how many apples does Erin have left after 8 days"),
    (13, "Carol has 40 pears and gives 9 apples to Dave so how many apples does Carol have left"),
    (14, "short item here"), (15, "a short item here"), (16, None), (17, ""), (None, ITEMS[1][1].upper()), (None, ITEMS[1][1]),
    (18, "élan vital àé 7 mots qui restent toujours les mêmes dans la phrase finale ici"), (19, "Élan vital ÀÉ 8 mots qui restent toujours les mêmes dans la phrase finale ici"),
    (20, "-- ".join(["x"] * 5_000) + ' "' + ITEMS[0][1].replace(" ", "  \n") + '"'),
    (10, "Intro words. " + ITEMS[0][1] + " and more."),
    # two values that become one; number words; case and numbers at once; capitals of other scripts
    (22, "Carol has 7 apples and gives 7 apples to Dave so how many apples does Carol have left after 7 days"),
    (23, "A train leaves at nine and runs sixty km per hour for two hours before it stops and waits there for long"),
    (24, ITEMS[0][1].replace("12", "80").replace("5", "6").upper()),
    (25, "\u010capek \u0141\u00f3d\u017a \u0416\u0437 vital \u00e0\u00e9 7 mots qui restent toujours les m\u00eames dans la phrase finale ici"),
    (26, " ".join(str(k % 7) for k in range(300))),
    # another word in the middle of every window
    (21, "Alice has 12 apples and gives 5 apples for Bob so how many apples does Alice have left after 3 hours"),
]


def frames(spark, docs=DOCS, items=ITEMS):
    return spark.createDataFrame([(i, t, 0, "k") for i, t in docs], "doc_id long, text string, n_windows int, kind string"), spark.createDataFrame(
        [(i, t, 1) for i, t in items], "item_id long, text string, doc_id int"
    )


def plain(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.mark.parametrize("most", [D.BLOCK_BYTES, 60])
def test_pairs_against_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(D.benchmark_blocks, "__defaults__", (1, most))
    docs, items = frames(spark)
    want = brute(DOCS, ITEMS)
    assert {(10, 1), (11, 1), (14, 3), (15, 3), (22, 1), (23, 2), (24, 1), (25, 6), (25, 7), (26, 8)} <= {w[:2] for w in want} and not {16, 17, 21} & {w[0] for w in want}
    assert plain(D.contamination(docs, items).collect()) == plain(want)
    want = brute(DOCS, ITEMS, 8)
    assert (14, 3) in {w[:2] for w in want} and 15 not in {w[0] for w in want}
    assert plain(D.contamination(docs, items, 8).collect()) == plain(want)


def test_numbers_upon_numbers_end():
    import time

    import numpy as np

    rng = random.Random(1)
    numbers = [str(rng.randrange(50)) for _ in range(1_000_000)]
    bench = D.Benchmark(list(range(1000)), [" ".join(numbers[k * 900 : k * 900 + 13]) for k in range(1000)])
    data = np.frombuffer(" ".join(numbers).encode(), dtype=np.uint8)
    start = time.monotonic()
    row, item, n, equal = bench.hits(D.Tokens(data, np.array([0, len(data)])))
    assert len(item) == 1000 and (n == equal).all() and time.monotonic() - start < 20


def test_random_texts_against_brute_force(spark):
    rng = random.Random(2)
    words = "the a cat sat 3 17 km Bob Ann 5kg on, mat. (and) ran".split()
    docs = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(40)]
    items = [(j, " ".join(docs[rng.randrange(40)][1].split()[5 : 5 + rng.choice([4, 9, 13, 25])])) for j in range(15)]
    a, b = frames(spark, docs, items)
    assert plain(D.contamination(a, b).collect()) == plain(brute(docs, items))


def test_clean_documents_stay(spark):
    docs, items = frames(spark)
    bad = {w[0] for w in brute(DOCS, ITEMS)}
    got = D.decontaminated(docs, items)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.where("doc_id is not null").collect()) == sorted(i for i, _ in DOCS if i is not None and i not in bad)
    kept = {r.doc_id for r in got.collect()}
    assert not kept & {10, 11, 14, 15, 22, 23, 24} and {16, 17, 21} <= kept


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert D.contamination(docs.limit(0), items).collect() == []
    assert D.contamination(docs, items.limit(0)).collect() == []
    assert D.decontaminated(docs, items.limit(0)).count() == len(DOCS)
