"""Latency metrics, peaks, ratios and quality flags."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import numbered

CAPACITY = 10_000


def join_groups(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Inner join on group keys, null a key like any other; without keys both are one row, or ``b`` is."""
    if not by:
        return a.crossJoin(F.broadcast(b))
    renamed = b.withColumnsRenamed({k: f"_by_{k}" for k in by})
    return a.join(renamed, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by])).drop(*[f"_by_{k}" for k in by])


def order_statistics(df: DataFrame, value: str, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """Values at ranks that are expressions over n, per group, without gathering or ordering a group in one task.

    Equal values are counted first (partial aggregation). The distinct values are put in one global order of
    range partitions with running counts; a group's own counts begin at its smallest running count, and each
    rank falls into the interval of one value.
    """
    tally = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    keys = [*[F.col(k).asc_nulls_first() for k in by], F.col(value).asc()]
    run = numbered(tally, *keys, name="_row", totals={"_hi": F.col("_c")})
    groups = run.groupBy(*by).agg(F.min(F.col("_hi") - F.col("_c")).alias("_start"), F.sum("_c").alias("n"))
    spread = join_groups(run, groups, by)
    at = {k: F.col("_start") + r for k, r in ranks.items()}
    picks = [F.max(F.when((r > F.col("_hi") - F.col("_c")) & (r <= F.col("_hi")), F.col(value))).alias(k) for k, r in at.items()]
    return spread.groupBy(*by).agg(*picks)


def timing_metrics(df: DataFrame, value: str, by: list[str], capacity: int = CAPACITY) -> DataFrame:
    """count, min, mean, p50 (midpoint), p95 by both rules, max, and whether the count is within ``capacity``.

    The quantiles are exact at any size; quantiles_exact says what a bounded sample would have been.
    """
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    floor, ceil = (F.greatest(F.lit(1), f(F.col("n") * 0.95)) for f in (F.floor, F.ceil))
    ranks = order_statistics(df, value, by, {"_lo": low, "_hi2": high, "p95_floor": floor, "p95_ceil": ceil})
    base = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("min"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("max")
    )
    return join_groups(base, ranks, by).select(
        *by, "n", (F.col("n") <= capacity).alias("quantiles_exact"), "min", "mean",
        F.round((F.col("_lo") + F.col("_hi2")) / 2, 6).alias("p50"), "p95_floor", "p95_ceil", "max",
    )


def stage_rows(df: DataFrame, stages: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("value")) for s in stages])).alias("x")).select("x.*")


def model_stats(models: DataFrame, calls: DataFrame) -> DataFrame:
    """calls, errors, mean_ms, max_ms of every model; times are null for a model without calls."""
    per = calls.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.round(F.avg("elapsed_ms"), 6).alias("mean_ms"),
        F.max("elapsed_ms").alias("max_ms"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return models.select("model_id").join(per, "model_id", "left").select("model_id", zero("calls"), zero("errors"), "mean_ms", "max_ms")


def quality_flags(df: DataFrame) -> DataFrame:
    """warnings and headline_eligible from provider, cpu_percent and gpu_percent at the start of a run."""
    warnings = F.array_compact(
        F.array(
            F.when(F.col("cpu_percent") > 25.0, "cpu_busy_at_start"),
            F.when((F.col("provider") != "cpu") & (F.col("gpu_percent") > 20), "gpu_busy_at_start"),
        )
    )
    return df.withColumn("warnings", F.array_join(warnings, ",")).withColumn("headline_eligible", F.col("warnings") == "")
