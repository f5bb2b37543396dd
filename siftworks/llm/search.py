"""Exact top-k BM25 search: sharded inverted index with block-max WAND pruning.

Index: documents are packed into shards of bounded size; in a shard, documents are ordered so that like
ones are neighbours (by their most frequent term) and cut into blocks of BLOCK. Each term has its postings,
and for each block it occurs in the largest term score there.

Search in one shard, with each query's k-th score so far as its threshold, for BATCH queries and TILE documents
at a time. Rare terms, whose largest scores are high, are read posting by posting. The DENSE most frequent terms
of the shard only enter by their block maxima: with the largest sum of rare terms in the block they bound each
block for each query. Blocks below the threshold are never scored, which includes those without a pivot, as the
other terms together stay below it. What departs from the textbook: all blocks of a tile are judged at once, bounds
of frequent terms are one matrix product for all queries, and the scores in a block are one for all queries that
have not skipped it, since steps of single documents and queries cost too much outside compiled code. These
products are in single precision; what comes within their error of the threshold is scored again in double
precision, in the order of terms, so the result is exact. One shard in SEEDS is searched first: the k-th score there is a floor for
the whole collection, from which every task starts; inside a task the k best so far are carried from shard
to shard as well. Scores use statistics of the whole collection, so the tasks' lists merge exactly. Ties go
to the smaller doc_id.

Scale: the index is built in one pass without a shuffle and staged in the shared folder; document
frequencies are summed by term with partial aggregation. Queries come in blocks of at most about
BLOCK_BYTES of terms. A block is a job of its own: its terms are broadcast, its k best are merged and staged,
and its broadcast is destroyed before the next, so the driver and the executors hold one block however many
queries there are. A task emits k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._stage import bounded_batches, stage, staged_path, unstage
from ._text import Words, ranges, text_slices, trimmed, word_hashes

K1, B = 1.2, 0.75
TOP = 10
BLOCK = 64
SHARD_BYTES = 16 << 20
SHARD_DOCS = 60_000
BLOCK_BYTES = 16 << 20
#: Frequent terms of a shard that are scored by matrix products, and the queries, documents and rare postings taken at a time.
DENSE, BATCH, TILE, POSTINGS = 1024, 256, 64 * BLOCK, 1 << 15
#: One shard in so many is searched first, for the scores below which no document can be among the k best.
SEEDS = 8
_HITS = "query_id long, doc_id long, score double"
NO_ID = -(2**63)
_SEED = 41
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32

_INDEX = "n_docs long, n_words long, ids binary, lens binary, terms binary, offsets binary, docs binary, tfs binary"


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    n = len(sorted_columns[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _sizes(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(first, append=n) if len(first) else first


def bags(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, times) of all texts, sorted by term and row, and the number of words of each row.

    A term is the 64-bit hash of a word with A-Z lower-cased.
    """
    terms, rows, lens = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row0, data, offsets in text_slices(column):
        w = Words(data, offsets)
        terms.append(word_hashes(_LOWERED[data], w.starts, w.ends, _SEED))
        rows.append(w.doc_of_word() + row0)
        lens.append(np.diff(w.bounds))
    term, row = np.concatenate(terms), np.concatenate(rows)
    order = np.argsort(term, kind="stable")  # rows ascend, so they stay in order within a term
    term, row = term[order], row[order]
    first = _runs(term, row)
    return term[first], row[first], _sizes(first, len(term)), np.concatenate(lens)


def _shard(ids: np.ndarray, column: pa.Array) -> dict:
    term, row, tf, lens = bags(column)
    # neighbours alike: rows by their most frequent term, then by length
    top = np.zeros(len(lens), dtype=np.uint64)
    by_tf = np.lexsort((term, tf))
    top[row[by_tf]] = term[by_tf]
    place = np.empty(len(lens), dtype=np.int64)
    order = np.lexsort((ids, lens, top))
    place[order] = np.arange(len(lens))
    row = place[row]
    order2 = np.lexsort((row, term))
    term, row, tf = term[order2], row[order2], tf[order2]
    first = _runs(term)
    return {
        "n_docs": len(lens),
        "n_words": int(lens.sum()),
        "ids": ids[order].astype(np.int64).tobytes(),
        "lens": lens[order].astype(np.uint32).tobytes(),
        "terms": term[first].tobytes(),
        "offsets": np.append(first, len(term)).astype(np.uint32).tobytes(),
        "docs": row.astype(np.uint16).tobytes(),
        "tfs": tf.astype(np.uint32).tobytes(),
    }


@trimmed
def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.binary()) for x in _INDEX.split(", ")])
    held: list[pa.Table] = []
    size = rows = 0

    def close() -> pa.RecordBatch:
        t = pa.concat_tables(held)
        ids = t.column(0).fill_null(NO_ID).to_numpy()
        out = _shard(ids, t.column(1))
        held.clear()
        return pa.RecordBatch.from_pylist([out], schema)

    for b in batches:
        t = pa.Table.from_batches([b])
        at = 0
        lens = np.nan_to_num(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        ends = np.cumsum(lens)
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + SHARD_BYTES - size, side="right")))
            to = min(to, at + SHARD_DOCS - rows, b.num_rows)
            held.append(t.slice(at, to - at))
            size += int(ends[to - 1] - base)
            rows += to - at
            at = to
            if size >= SHARD_BYTES or rows >= SHARD_DOCS or at < b.num_rows:
                yield close()
                size = rows = 0
    if held:
        yield close()


def build_index(docs: DataFrame) -> DataFrame:
    """Shards of all rows, staged; null and empty texts are documents without words, repeated rows are each indexed.

    A text longer than SHARD_BYTES is a shard of its own, whole. An empty table gives no shards.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(own.mapInArrow(_build, _INDEX), "bm25-index")


@trimmed
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for terms, offsets in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            df = np.diff(np.frombuffer(offsets, dtype=np.uint32).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, dtype=np.int64)), pa.array(df)], names=["term", "df"])


@trimmed
def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        term, row, tf, _ = bags(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(term.view(np.int64)), pa.array(tf)], names=["query_id", "term", "times"])


@dataclass(frozen=True)
class Asked:
    """Queries: those of query i have places ``starts[i]`` to ``starts[i + 1]``, in order of terms.

    ``vocabulary`` has the terms of all, sorted, and ``term`` the index of each place in it.
    """

    starts: np.ndarray
    term: np.ndarray
    weights: np.ndarray
    vocabulary: np.ndarray


class Shard:
    def __init__(self, r: dict, average: float) -> None:
        self.ids = np.frombuffer(r["ids"], dtype=np.int64)
        lens = np.frombuffer(r["lens"], dtype=np.uint32)
        self.terms = np.frombuffer(r["terms"], dtype=np.uint64)
        offsets = np.frombuffer(r["offsets"], dtype=np.uint32).astype(np.int64)
        docs = np.frombuffer(r["docs"], dtype=np.uint16)
        self.docs = docs.astype(np.int64)
        tf = np.frombuffer(r["tfs"], dtype=np.uint32)
        norm = K1 * (1 - B + B * lens / average) if average else np.full(len(lens), K1)
        self.impact = tf * (K1 + 1) / (tf + norm[self.docs])
        if not len(self.terms):
            return
        df = np.diff(offsets)
        often = np.argpartition(-df, DENSE)[:DENSE] if len(df) > DENSE else np.arange(len(df))
        self.column = np.full(len(df), -1, dtype=np.int32)
        self.column[often] = np.arange(len(often))
        self.n_dense = len(often)
        self.of_term = np.repeat(np.arange(len(df), dtype=np.int32), df)
        # the same postings by document, terms in order
        by_doc = np.argsort(docs, kind="stable")
        self.doc_terms, self.doc_impact = self.of_term[by_doc], self.impact[by_doc]
        self.doc_start = np.append(0, np.cumsum(np.bincount(docs, minlength=len(self.ids))))
        self.weight = np.zeros(len(df))

    def tiles(self) -> Iterator[tuple]:
        """First document, scores of frequent terms (block, term, document), their maxima, and the rare postings by term."""
        for d0 in range(0, len(self.ids), TILE):
            n_blocks = -(-min(TILE, len(self.ids) - d0) // BLOCK)
            here = np.flatnonzero((self.docs >= d0) & (self.docs < d0 + TILE)) if len(self.ids) > TILE else slice(None)
            term, doc, impact = self.of_term[here], self.docs[here] - d0, self.impact[here].astype(np.float32)
            column = self.column[term]
            often = column >= 0
            frequent = np.zeros((n_blocks, self.n_dense, BLOCK), dtype=np.float32)
            block, at = np.divmod(doc[often], BLOCK)
            frequent[block, column[often], at] = impact[often]
            rare = np.flatnonzero(~often)
            first = np.append(0, np.cumsum(np.bincount(term[rare], minlength=len(self.terms))))
            yield d0, frequent, np.ascontiguousarray(frequent.max(axis=2).T), first, _packed(doc[rare], impact[rare])

    def search(
        self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, floor: float = 0.0
    ) -> tuple[np.ndarray, np.ndarray]:
        """The k best of ``best`` (scores, ids; in order) and this shard, without those that score below ``floor``. Terms ascend."""
        out = [best]
        self.search_all(Asked(np.array([0, len(terms)]), np.arange(len(terms)), weights, terms), out, k, np.array([floor]))
        return out[0]

    def search_all(self, asked: Asked, best: list[tuple[np.ndarray, np.ndarray]], k: int, floors: np.ndarray, rough: bool = False) -> None:
        """``search`` for each query; ``best`` is changed in place. If ``rough``, scores are lower bounds."""
        if not len(self.terms) or not len(asked.vocabulary):
            return
        at = np.searchsorted(self.terms, asked.vocabulary)
        at[at == len(self.terms)] = 0
        at[self.terms[at] != asked.vocabulary] = -1
        n = len(asked.starts) - 1
        for tile in self.tiles():
            for a in range(0, n, BATCH):
                self._search_tile(tile, asked, at, a, min(a + BATCH, n), best, k, floors, rough)

    def _search_tile(self, tile: tuple, asked: Asked, at: np.ndarray, a: int, b: int, best: list, k: int, floors: np.ndarray, rough: bool) -> None:
        d0, frequent, most, first, postings = tile
        n, n_blocks = b - a, len(frequent)
        width = n_blocks * BLOCK
        lo, hi = asked.starts[a], asked.starts[b]
        term, q, w = at[asked.term[lo:hi]], np.repeat(np.arange(n), np.diff(asked.starts[a : b + 1])), asked.weights[lo:hi]
        have = term >= 0
        term, q, w = term[have], q[have], w[have]
        n_terms = np.bincount(q, minlength=n)
        own = np.append(0, np.cumsum(n_terms))
        least = np.array([max(floors[i], best[i][0][k - 1]) if len(best[i][0]) >= k else floors[i] for i in range(a, b)])
        slack = (n_terms + 16) * 2.0**-22  # four times the relative error of sums in single precision, as no term is negative
        column = self.column[term]
        often = column >= 0
        wide = np.zeros((n, self.n_dense), dtype=np.float32)
        wide[q[often], column[often]] = w[often]
        score = np.zeros(n * width, dtype=np.float32)
        size = first[term + 1] - first[term]
        rare = np.flatnonzero(size)  # frequent terms have no rare postings
        size, asking = size[rare], _packed(q[rare] * width, w[rare])
        ends = np.cumsum(size)
        start = first[term[rare]] - ends + size
        cuts = np.flatnonzero(np.diff(ends // POSTINGS, prepend=0))
        for i, j in zip(np.append(0, cuts), np.append(cuts, len(size)), strict=True):
            if i == j:
                continue
            posting = np.repeat(start[i:j], size[i:j])
            posting += np.arange(ends[i] - size[i], ends[j - 1])
            of_doc, of_query = np.take(postings, posting, mode="clip"), np.repeat(asking[i:j], size[i:j])
            place = (of_doc.view(np.int32)[::2] + of_query.view(np.int32)[::2]).astype(np.intp)
            np.add.at(score, place, of_doc.view(np.float32)[1::2] * of_query.view(np.float32)[1::2])
        score = score.reshape(n, n_blocks, BLOCK)
        bound = wide @ most + score.max(axis=2)
        alive = (bound > 0) & (bound * (1 + slack[:, None]) >= least[:, None])
        for block in np.flatnonzero(alive.any(axis=0)):
            mine = np.flatnonzero(alive[:, block])
            score[mine, block] += wide[mine] @ frequent[block]
        score = score.reshape(n, width)
        found = (score > 0) & (score >= (least * (1 - slack)).astype(np.float32)[:, None])
        many = np.flatnonzero(np.count_nonzero(found, axis=1) > (k if rough else 4 * k))
        if len(many):
            kth = np.partition(score[many], width - k, axis=1)[:, width - k]
            found[many] &= score[many] >= (kth * (1 - 2 * slack[many])).astype(np.float32)[:, None]
        hit_q, hit_d = np.nonzero(found)
        hit_d += d0
        new = _runs(hit_q)
        for i, j in zip(new, new + _sizes(new, len(hit_q)), strict=True):
            x, d = hit_q[i], hit_d[i:j]
            if rough:
                exact = score[x, d - d0] * (1 - slack[x])
            else:
                mine = slice(own[x], own[x + 1])
                self.weight[term[mine]] = w[mine]
                size = self.doc_start[d + 1] - self.doc_start[d]
                posting = ranges(self.doc_start[d], size)
                exact = np.bincount(np.repeat(np.arange(len(d)), size), self.doc_impact[posting] * self.weight[self.doc_terms[posting]], len(d))
                self.weight[term[mine]] = 0
            keep = exact >= max(least[x], 1e-300)
            best[a + x] = _top(np.concatenate((best[a + x][0], exact[keep])), np.concatenate((best[a + x][1], self.ids[d[keep]])), k)


def _packed(place: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A place (32 bits) and a value (single precision) in one word, so that both are gathered at once."""
    out = np.empty(len(place), dtype=np.int64)
    out.view(np.int32)[::2] = place
    out.view(np.float32)[1::2] = value
    return out


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        keep = score >= cut
        score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def _searcher(shared, average: float, k: int, rough: bool = False):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, floors = shared.value
        best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]
        for b in batches:
            for i in range(b.num_rows):
                Shard(b.slice(i, 1).to_pylist()[0], average).search_all(asked, best, k, floors, rough)
        if best:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, [len(s) for s, _ in best])), pa.array(np.concatenate([d for _, d in best])), pa.array(np.concatenate([s for s, _ in best]))],
                names=["query_id", "doc_id", "score"],
            )

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, doc_id, score: the k best rows of ``docs`` for each row of ``queries`` (query_id, text).

    A query's term counts as often as it comes. Only documents that share a term with the query are found,
    so a null, empty or unknown query has no rows. Query rows with a null id are left out; rows that repeat
    a query_id are one query with the first of their texts in order. Repeated documents are each found, ties
    in order of doc_id; a null doc_id comes back as null, before others in ties. Empty tables give an empty
    result; other columns are ignored. Documents and queries of any length are taken whole; a document longer
    than a shard is a shard of its own.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    total = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_words").alias("words")).first()
    n, average = total.docs or 0, (total.words or 0) / max(total.docs or 0, 1)
    df = index.select("terms", "offsets").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    asked = queries.where("query_id is not null").groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.min(F.col("text").cast("string")).alias("text"))
    words = stage(asked.mapInArrow(_query_terms, "query_id long, term long, times long"), "bm25-words")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = stage(words.join(df, "term").select("query_id", "term", (idf * F.col("times")).alias("weight")), "bm25-queries")
    blocks = -(-weighted.count() * 16 // BLOCK_BYTES)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    shards, found = index.drop("n_docs", "n_words"), staged_path(spark, "bm25-found")
    some = shards.where(F.pmod(F.xxhash64("ids"), F.lit(SEEDS)) == 0)
    for i in range(blocks):
        rows = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toArrow()
        q, t, w = (rows.column(c).to_numpy() for c in ("query_id", "term", "weight"))
        t = t.view(np.uint64)
        order = np.lexsort((t, q))
        q, t, w = q[order], t[order], w[order]
        first = _runs(q)
        ids = q[first]
        vocabulary, place = np.unique(t, return_inverse=True)
        block = Asked(np.append(first, len(q)), place.astype(np.int32), w, vocabulary)
        sent = spark.sparkContext.broadcast((ids, block, np.zeros(len(ids))))
        seed = some.mapInArrow(_searcher(sent, average, k, rough=True), _HITS)
        kth = seed.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", "score").toArrow()
        sent.destroy()
        floors = np.zeros(len(ids))
        floors[np.searchsorted(ids, kth.column("query_id").to_numpy())] = kth.column("score").to_numpy()
        sent = spark.sparkContext.broadcast((ids, block, floors))
        part = shards.mapInArrow(_searcher(sent, average, k), _HITS).withColumn("rank", rank).where(F.col("rank") <= k)
        part.write.mode("append").parquet(found)
        sent.destroy()
    for t in (index, words, weighted):
        unstage(t)
    schema = _HITS + ", rank int"
    ranked = spark.read.schema(schema).parquet(found) if blocks else spark.createDataFrame([], schema)
    doc = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), doc.alias("doc_id"), F.round("score", 6).alias("score"))


ORACLE = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) t
  from documents where text is not null),
tf as (select doc_id, t, count(*) tf from words group by all),
df as (select t, count(*) df from tf group by t),
len as (select d.doc_id, count(t) dl from documents d left join words w on d.doc_id = w.doc_id group by d.doc_id),
st as (select count(*) n, sum(dl)::double / count(*) a from len),
q as (select doc_id as query_id, t, tf as times from tf where doc_id % 100 = 0),
s as (
  select query_id, tf.doc_id, sum(times * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / a))) score
  from q join df using (t) join tf using (t) join len on len.doc_id = tf.doc_id cross join st group by all),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from s)
select query_id, rank::bigint as rank, doc_id, round(score, 6) as score from r where rank <= 10
"""
