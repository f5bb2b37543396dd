"""Evaluation of results against independent human labels, by split and domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ("calibration", "test")
VERDICTS = ("ALLOW", "REVIEW", "BLOCK", "ERROR")
LABELS = ("safe", "nsfw")


def one_label_per_digest(labels: DataFrame) -> DataFrame:
    """The label with the lowest line of each digest; a grouped minimum, so a hot digest is combined early."""
    low = F.min(F.struct("line", "label", "domain", "split")).alias("x")
    return labels.where("sha256 is not null").groupBy(F.lower("sha256").alias("sha256")).agg(low).select("sha256", "x.label", "x.domain", "x.split")


def matched(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Inner join on the digest; the optimiser broadcasts the labels where they are small."""
    return results.join(labels, "sha256")


def unlabelled(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Results without a label; those without a digest are among them."""
    return results.join(labels.select("sha256"), "sha256", "left_anti")


def first_predictions(joined: DataFrame) -> DataFrame:
    """The first result of each digest in line order."""
    low = F.min(F.struct("line", "verdict", "score", "label", "domain", "split")).alias("x")
    return joined.groupBy("sha256").agg(low).select("sha256", "x.line", "x.verdict", "x.score", "x.label", "x.domain", "x.split")


def prediction_conflicts(joined: DataFrame) -> DataFrame:
    """Digests whose results differ in verdict or score."""
    firsts = F.min(F.struct("line", "verdict", "score")).alias("x")
    kinds = F.min(F.struct("verdict", "score")), F.max(F.struct("verdict", "score"))
    return (
        joined.groupBy("sha256")
        .agg(firsts, F.count(F.lit(1)).alias("n"), (~kinds[0].eqNullSafe(kinds[1])).alias("conflict"))
        .select("sha256", "n", F.col("x.line").alias("first_line"), F.col("x.verdict").alias("first_verdict"), "conflict")
    )


def confusion(firsts: DataFrame) -> DataFrame:
    return firsts.groupBy("split", "domain", "label", "verdict").agg(F.count(F.lit(1)).alias("n"))


def rollup(firsts: DataFrame) -> DataFrame:
    """Counts per split and per split and domain; domain is null in the rows of a whole split."""
    return firsts.groupingSets([["split", "label", "verdict"], ["split", "domain", "label", "verdict"]], "split", "domain", "label", "verdict").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("domain").cast("int").alias("whole_split")
    )


def rate(part: Column, whole: Column) -> Column:
    """Null on an empty whole, else rounded to six places."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6)


def summary(firsts: DataFrame) -> DataFrame:
    """Both splits, also where empty: the 2 x 4 counts, scored totals, five rates and the error count."""
    n = {(a, v): F.count_if((F.col("label") == a) & (F.col("verdict") == v)).alias(f"{a}_{v.lower()}") for a in LABELS for v in VERDICTS}
    counts = firsts.groupBy("split").agg(*n.values())
    splits = firsts.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    wide = splits.join(counts, "split", "left").na.fill(0)
    c = lambda name: F.col(name)
    scored = {a: c(f"{a}_allow") + c(f"{a}_review") + c(f"{a}_block") for a in LABELS}
    return wide.select(
        "*",
        scored["safe"].alias("safe_scored"),
        scored["nsfw"].alias("nsfw_scored"),
        rate(c("safe_review") + c("safe_block"), scored["safe"]).alias("safe_attention_rate"),
        rate(c("safe_block"), scored["safe"]).alias("safe_block_rate"),
        rate(c("nsfw_allow"), scored["nsfw"]).alias("nsfw_false_allow_rate"),
        rate(c("nsfw_review") + c("nsfw_block"), scored["nsfw"]).alias("nsfw_attention_rate"),
        rate(c("nsfw_block"), scored["nsfw"]).alias("nsfw_block_rate"),
        (c("safe_error") + c("nsfw_error")).alias("error_count"),
    )


def coverage(results: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: labels, matched images, unmatched labels, result rows, duplicates, unlabelled rows and errors."""
    seen = results.where("sha256 is not null").groupBy("sha256").agg(F.count(F.lit(1)).alias("rows"))
    both = labels.select("sha256", F.lit(1).alias("_l")).join(seen, "sha256", "left")
    left = both.agg(
        F.count(F.lit(1)).alias("label_count"),
        F.count("rows").alias("matched_images"),
        F.count_if(F.col("rows").isNull()).alias("unmatched_labels"),
        F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).cast("long").alias("duplicate_result_records"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("matched_result_records"),
    )
    marked = results.join(labels.select("sha256", F.lit(1).alias("_l")), "sha256", "left")
    right = marked.agg(
        F.count(F.lit(1)).alias("result_records"),
        F.count_if(F.col("_l").isNull()).alias("unlabelled_result_records"),
        F.count_if(F.col("_l").isNull() & (F.col("verdict") == "ERROR")).alias("unlabelled_error_records"),
    )
    return left.crossJoin(F.broadcast(right))  # one row each


def differs_from_first(df: DataFrame, key: Column, line: str = "line") -> DataFrame:
    """Rows whose ``key`` differs from that of the first line; the first is a grouped minimum of one row."""
    first = df.agg(F.min(F.struct(F.col(line), key.alias("k"))).alias("x")).select(F.col("x.k").alias("_first"))
    return df.withColumn("_key", key).crossJoin(F.broadcast(first)).where(~F.col("_key").eqNullSafe(F.col("_first"))).drop("_key", "_first")


def first_violation(violations: DataFrame) -> DataFrame:
    """The violation with the lowest line, and of its line the one that is checked first; no row if there is none."""
    return violations.agg(F.min(F.struct("line", "priority", "code")).alias("x")).where("x is not null").select("x.line", "x.priority", "x.code")


def repeated(df: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Rows whose key, in any case, a row with a lower line has; a grouped minimum and an equi-join."""
    low = F.lower(F.col(key))
    firsts = df.groupBy(low.alias("_key")).agg(F.min(line).alias("_first"))
    return df.join(firsts, low == F.col("_key")).where(F.col(line) > F.col("_first")).drop("_key", "_first")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
