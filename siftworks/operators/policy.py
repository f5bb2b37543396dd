"""Threshold policies: scores to verdicts with reasons, and what a run exits with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, review threshold, block threshold; lower bounds are inclusive.
POLICIES = (
    ("low-threshold-v1", 0.15, 0.65),
    ("medium-threshold-v1", 0.35, 0.80),
    ("high-threshold-v1", 0.60, 0.93),
    ("safety-first-v1", 0.15, 0.65),
    ("balanced-v1", 0.35, 0.80),
    ("high-precision-v1", 0.60, 0.93),
)
DEFAULT_POLICY = "medium-threshold-v1"
#: Reason codes of results.
BLOCK_REASON = "nsfw_score_at_or_above_block_threshold"
REVIEW_REASON = "nsfw_score_in_review_band"
ALLOW_REASON = "nsfw_score_below_review_threshold"
ANIMATED_REASON = "animated_media_requires_frame_aware_scan"
#: Exit codes of verdicts, worst last.
SEVERITY = (("ALLOW", 0), ("REVIEW", 10), ("BLOCK", 20), ("ERROR", 30))


def policy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "policy string, review_threshold double, block_threshold double")


def thresholds(name: str = DEFAULT_POLICY) -> tuple[float, float]:
    for policy, review, block in POLICIES:
        if policy == name:
            return review, block
    raise ValueError(f"unknown policy {name!r}; there are {sorted(p for p, _, _ in POLICIES)}")


def valid_score(score: Column) -> Column:
    """NaN is checked first: Spark orders it above every number."""
    return score.isNotNull() & ~F.isnan(score) & (score >= 0) & (score <= 1)


def valid_policy(review: Column, block: Column) -> Column:
    return F.coalesce(~F.isnan(review) & ~F.isnan(block) & (review >= 0) & (review < block) & (block <= 1), F.lit(False))


def verdict(score: Column, review: Column, block: Column) -> Column:
    """ERROR for a score that is null, NaN or outside [0, 1]: never ALLOW by default."""
    return F.when(~valid_score(score), "ERROR").when(score >= block, "BLOCK").when(score >= review, "REVIEW").otherwise("ALLOW")


def reason(verdict_: Column) -> Column:
    return F.when(verdict_ == "BLOCK", BLOCK_REASON).when(verdict_ == "REVIEW", REVIEW_REASON).when(verdict_ == "ALLOW", ALLOW_REASON)


def severity(verdict_: Column) -> Column:
    out = F.lit(30)
    for name, code in SEVERITY:
        out = F.when(verdict_ == name, code).otherwise(out)
    return out


def apply_policy(scored: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    review, block = thresholds(policy)
    v = verdict(F.col("score"), F.lit(review), F.lit(block))
    return scored.withColumn("verdict", v).withColumn("reason", reason(F.col("verdict")))


def policy_matrix(scored: DataFrame) -> DataFrame:
    """How many rows get each verdict under each policy: six sums in one pass, no join."""
    arms = [F.struct(F.lit(p).alias("policy"), verdict(F.col("score"), F.lit(r), F.lit(b)).alias("verdict")) for p, r, b in POLICIES]
    return scored.select(F.explode(F.array(*arms)).alias("x")).groupBy("x.policy", "x.verdict").agg(F.count(F.lit(1)).alias("n"))


def exit_policy(verdicts: DataFrame) -> DataFrame:
    """Exit code for each setting of fail_on, from one row of verdict flags."""
    n = lambda v: F.max((F.col("verdict") == v).cast("int"))
    flags = verdicts.agg(n("ERROR").alias("e"), n("BLOCK").alias("b"), n("REVIEW").alias("r"))
    rows = flags.select("e", "b", "r", F.explode(F.array(*map(F.lit, ("never", "error", "block", "review")))).alias("fail_on"))
    code = (
        F.when(F.col("fail_on") == "never", 0)
        .when(F.col("e") == 1, 30)
        .when((F.col("b") == 1) & F.col("fail_on").isin("block", "review"), 20)
        .when((F.col("r") == 1) & (F.col("fail_on") == "review"), 10)
        .otherwise(0)
    )
    return rows.select("fail_on", code.alias("exit_code"))
