"""Mixing sources to target weights, in DataFrame functions only.

Each source gets a share of all words by its weight, but no more than MOST times its own words; what is
above is shared again by weight. A source's rate is target over size; a document comes floor(rate) times,
and once more if its seeded hash falls below the fraction.

The shares have a closed form: order the sources by MOST * size / weight; those that stop at their cap
are a prefix of this order, so one pass of running sums finds the level at which the rest settles (the
level over the rest grows as sources are capped and falls once one is taken out that need not be, so it is
the highest).

Scale: documents are read once; their sizes are staged and read twice, for partial sums by source and for
the result (``mix_documents`` reads the documents twice instead). The only table joined is one row a source;
its size is measured, and up to BROADCAST_BYTES it is broadcast, so that documents are not shuffled. Above,
the join shuffles and adaptive execution splits a hot source's rows. The sources themselves are put in order
in one task, 100 bytes each: millions of sources, not billions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import stage

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix"
#: The table of sources is broadcast up to so many bytes of names and numbers; above, the join shuffles.
BROADCAST_BYTES = 4 << 20
_WORD = "[^\\x20\\x09-\\x0D]++"


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null counts 0. Counted in place, without an array of words."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(_WORD)).cast("long")


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and doc_id alone, so reruns and retried tasks agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row a source, so one task orders them."""
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    slot = (F.row_number().over(by_name) - 1) % n
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (slot + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long"))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    level = (total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onward)
    filled = ranked.withColumn("level", level.cast("double"))
    settled = F.max(F.when(most * F.col("source_size") >= F.col("level") * F.col("weight"), F.col("level"))).over(everything)
    share = F.least((F.col("source_size") * most).cast("double"), F.col("weight") * F.coalesce(settled, F.lit(0.0)))
    return filled.select("source", "source_size", share.cast("double").alias("target"))


def _with_targets(sized: DataFrame, sizes: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> DataFrame:
    """``sized`` (with doc_id, source, size) and source_size, target, copies, taken; ``sizes``: staged, a row a source."""
    measured = sizes.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 32).alias("n")).first()
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "target_source")
    if (measured.n or 0) <= BROADCAST_BYTES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = whole + F.when(coin(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("target_source")))
        .withColumn("copies", copies.cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def _sizes(sized: DataFrame) -> DataFrame:
    return stage(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row of ``docs``.

    A null text has size 0; a null source is a source of its own, last in order; a null doc_id draws one
    fixed coin; rows repeated under one doc_id draw the same coin. A text of any length is counted whole, in
    place. Wordless sources have target 0. An empty table gives an empty result; other columns are ignored.
    """
    sized = stage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    out = _with_targets(sized, _sizes(sized), weights, most, seed)
    return out.select("doc_id", "size", "source_size", "target", "copies", "taken")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns and the number of the copy.

    The copy's column is called copy, with underscores before it if the documents have such a column. Nulls,
    ties, repeated rows, long texts and empty tables as in ``mixed``; columns may have any names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sized = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), row)
    taken = _with_targets(sized, _sizes(sized.drop("row")), weights, most, seed).where("copies > 0")
    name = "copy"
    while name in docs.columns:
        name = "_" + name
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(name)).select("row.*", name)


ORACLE = r"""
with sized as (
  select doc_id, source, (case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end)::bigint as size
  from documents),
sizes as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, (case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::bigint as weight
  from sizes),
filled as (
  select *, ((sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by source_size::double / weight, source asc nulls last
      rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by source_size::double / weight, source asc nulls last
      rows between current row and unbounded following))::double) as level
  from ranked),
settled as (
  select *, max(case when 3 * source_size >= level * weight then level end) over () as final from filled),
targets as (
  select source, source_size, least((3 * source_size)::double, weight * coalesce(final, 0.0::double))::double as target from settled),
rated as (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size::double else 0.0::double end as rate,
    (('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, 'null')), 1, 8))::bigint)::double / 4294967296.0::double as coin
  from sized d join targets t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  ((floor(rate) + case when coin < rate - floor(rate) then 1 else 0 end)::bigint * size)::bigint as taken
from rated
"""
