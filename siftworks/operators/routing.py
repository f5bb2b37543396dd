"""Routing of records to models, and the enrichment rows that come of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .udf import Adapter, call_adapter

ROUTES = ("ALL", "ALLOW", "REVIEW", "BLOCK", "ERROR")


def routed(verdict: Column, when: Column) -> Column:
    return F.array_contains(when, "ALL") | F.array_contains(when, verdict)


def route_theta(records: DataFrame, models: DataFrame) -> DataFrame:
    """The rule as it is stated: a nested-loop join over the few models of a configuration."""
    return records.join(F.broadcast(models.where("enabled")), routed(F.col("verdict"), F.col("when")))


def route_equi(records: DataFrame, models: DataFrame) -> DataFrame:
    """The same rows by a hash join: a model's routes are exploded to verdicts, ALL to every verdict."""
    every = F.array(*[F.lit(r) for r in ROUTES[1:]])
    verdicts = F.when(F.array_contains("when", "ALL"), every).otherwise(F.array_distinct("when"))
    wide = models.where("enabled").select("model_id", "ordinal", F.explode(verdicts).alias("verdict"))
    return records.join(wide, "verdict")


def enriched(records: DataFrame, models: DataFrame) -> DataFrame:
    """One row a record, with the routed models in the order of the configuration; none gives an empty array.

    A record's models are at most those of the configuration, so they are picked by array functions from one
    broadcast row instead of a join and a regrouping.
    """
    own = models.where("enabled").agg(F.array_sort(F.collect_list(F.struct("ordinal", "model_id", "when"))).alias("models"))
    hits = F.filter("models", lambda m: routed(F.col("verdict"), m["when"]))
    return records.crossJoin(F.broadcast(own)).withColumn("analyses", F.transform(hits, lambda m: m["model_id"])).drop("models")


def analysed(records: DataFrame, models: list[Row], key: str, make: Callable[[Row], Callable[[], Adapter]]) -> DataFrame:
    """Records with ``analyses``: what each routed model says of them, in the order of the configuration.

    A model gets the record as a line of JSON under its ``key``, which must be unique. Each model of the
    configuration is one pass over the records that are routed to it.
    """
    line = F.to_json(F.struct(*[c for c in records.columns])).alias("_line")
    calls = None
    for m in models:
        own = records.where(routed(F.col("verdict"), F.array(*map(F.lit, m.when)))).select(key, line)
        said = call_adapter(own, make(m), key, "_line").select(F.col(key).alias("_key"), F.struct(F.lit(m.ordinal).alias("ordinal"), F.lit(m.id).alias("model_id"), "ok", "code", "outputs").alias("_x"))
        calls = said if calls is None else calls.unionByName(said)
    if calls is None:
        return records.withColumn("analyses", F.array())
    per = calls.groupBy("_key").agg(F.array_sort(F.collect_list("_x")).alias("analyses"))
    return records.join(per, records[key] == per["_key"], "left").drop("_key").withColumn("analyses", F.coalesce("analyses", F.array()))


def verified(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records bound again to their files: null, or the reason why a record must not be enriched."""
    joined = records.join(files, "relative_path", "left")
    return joined.withColumn(
        "code",
        F.when(F.col("sha256").isNull(), "missing_digest")
        .when(F.col("file_sha256").isNull(), "artifact_unavailable")
        .when(F.col("file_sha256") != F.col("sha256"), "changed_after_base_scan"),
    )
