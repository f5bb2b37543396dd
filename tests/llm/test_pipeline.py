"""The pipeline's rows against the brute-force versions of its stages, on a whole small table."""

import corpus_pipeline as P
from siftworks.llm import quality as Q

from . import test_decontaminate, test_mixing, test_shingle_dedup


def removed_text(rows):
    """Texts after substring dedup, by the brute-force word lists."""
    import re

    docs = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    first = {}
    for i, w in docs:
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in docs:
        gone = set()
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone.update(range(p, p + 13))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_stages_and_result(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_filter", "simhash_dedup", "substring_dedup", "decontamination", "source_mix"]
    scores = {r.doc_id: r.score for r in Q.score_quality(docs, Q.fit_quality(docs, labels)).collect()}
    rows = [r for r in docs.collect() if scores[r.doc_id] >= 0.3]
    stay = set(test_shingle_dedup.brute([(r.doc_id, r.text) for r in rows]))
    rows = [r for r in rows if (r.doc_id, r.text) in stay]
    kept = removed_text(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = [(r.doc_id, " ".join(kept[r.doc_id])) for r in rows]
    bad = {x[0] for x in test_decontaminate.brute(texts, items)}
    source = {r.doc_id: r.source for r in rows}
    left = [(i, t, source[i], 0) for i, t in texts if i not in bad]
    text = {i: t.split() for i, t, _, _ in left}
    want = sorted((i, k, t.split()) for (i, t, _, _), (_, size, _, _, taken) in zip(left, test_mixing.brute(left), strict=True) for k in range(1, taken // max(size, 1) + 1))
    out = P.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "copy"]
    got = sorted((r.doc_id, r["copy"], r.text.split()) for r in out.collect())
    assert [r for r in got if r[2]] == want and all(not text[i] for i, _, t in got if not t)


def test_filtering_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in P.STAGES[:-1]:
        assert f(spark, docs, sf_dir).schema == docs.schema or f(spark, docs, sf_dir).dtypes == docs.dtypes
