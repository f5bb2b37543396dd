"""Discovery, gates, digests, scoring and the rows of a scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import order as O
from . import policy as P

SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
#: Files that one run may select.
PATH_LIMIT = 100_000


def supported(path: Column, report_dir: str = "reports") -> Column:
    """By suffix, and no part of the path is the report directory."""
    return S.suffix(path).isin(*SUFFIXES) & ~F.exists(F.split(path, "/"), lambda p: F.lower(p) == report_dir)


def discovered(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """Supported files with their 1-based index in the order of lower-cased path, then path."""
    return O.numbered(files.where(supported(F.col(path))), F.lower(path), F.col(path))


def selection_report(files: DataFrame, most: int, path: str = "relative_path") -> DataFrame:
    n = files.where(supported(F.col(path))).agg(F.count(F.lit(1)).alias("candidates"))
    chosen = F.least("candidates", F.lit(most))
    return n.select("candidates", chosen.cast("long").alias("selected"), (F.col("candidates") - chosen).alias("omitted"), (F.col("candidates") > most).alias("truncated"))


def score_distinct(rows: DataFrame, key: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Score each distinct digest once and bring the scores back; cache_hit marks rows beyond the first.

    ``score`` maps a table with the key and the payload to one with the key and score.
    """
    firsts = rows.groupBy(key).agg(F.min("line").alias("_first"), F.min_by("text", "line").alias("text"))
    scored = score(firsts.select(key, "text")).select(key, "score")
    return rows.join(scored, key).join(firsts.select(key, "_first"), key).withColumn("cache_hit", F.col("line") > F.col("_first")).drop("_first")


def scanned(artifacts: DataFrame, max_bytes: int, policy: str = P.DEFAULT_POLICY) -> DataFrame:
    """One row for each artifact, whatever happens: oversized ones are ERROR, animated ones REVIEW without a score."""
    review, block = P.thresholds(policy)
    big = F.col("byte_length") > max_bytes
    score = F.when(~big & ~F.col("animated"), F.col("score"))
    verdict = F.when(big, "ERROR").when(F.col("animated"), "REVIEW").otherwise(P.verdict(F.col("score"), F.lit(review), F.lit(block)))
    reasons = F.when(big, F.lit(None)).when(F.col("animated"), P.ANIMATED_REASON).otherwise(P.reason(F.col("verdict")))
    return (
        artifacts.withColumn("verdict", verdict)
        .withColumn("reason", reasons)
        .withColumn("error_code", F.when(big, "artifact_too_large"))
        .withColumn("nsfw", score)
    )


def link_name(index: Column, score: Column, path: Column) -> Column:
    """0000012_0.8312_name.url; no-score where there is none."""
    number = F.when(score.isNotNull(), F.format_string("%.4f", score)).otherwise("no-score")
    return F.concat(F.lpad(index.cast("string"), 7, "0"), F.lit("_"), number, F.lit("_"), S.slug(S.stem(path)), F.lit(".url"))
