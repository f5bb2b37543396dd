"""Scans of image files: headers, gates, scores of distinct digests, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import order as O
from .operators import policy as P
from .operators import udf as U
from .operators import validate as V
from .sources import images

MAX_PIXELS = 40_000_000


def judged(files: DataFrame) -> DataFrame:
    """path, byte_length, sha256, animated, score, error_code of files as ``images`` reads them; a digest is scored once."""
    head = images.header(F.col("content"))
    seen = files.select("path", F.col("length").alias("byte_length"), "sha256", "content", "code", head.alias("h"))
    bad = F.coalesce("code", V.format_gate(F.col("h.format")), V.pixel_gate(F.col("h.width"), F.col("h.height"), MAX_PIXELS))
    seen = seen.withColumn("error_code", bad).withColumn("animated", F.col("h.animated"))
    wanted = seen.where("error_code is null and not animated").groupBy("sha256").agg(F.min_by("content", "path").alias("content"))
    scores = U.score_with(wanted, U.DigestScorer, "content", "sha256").withColumnsRenamed({"sha256": "_sha"})
    rows = seen.drop("content").join(scores, F.col("sha256") == F.col("_sha"), "left")
    return rows.select("path", "byte_length", "sha256", "animated", "score", F.coalesce("error_code", "error").alias("error_code"))


def scan_folder(spark: SparkSession, root: str, max_bytes: int, policy: str) -> DataFrame:
    """Rows of a folder in path order: digest, header, score of each distinct digest, verdict or error code."""
    review, block = P.thresholds(policy)
    verdict = (
        F.when(F.col("error_code").isNotNull(), "ERROR").when(F.col("animated"), "REVIEW").otherwise(P.verdict(F.col("score"), F.lit(review), F.lit(block)))
    )
    rows = judged(images.read_images(spark, root, max_bytes)).withColumn("verdict", verdict).withColumnRenamed("path", "relative_path")
    return O.numbered(rows.select("relative_path", "byte_length", "sha256", "animated", "score", "verdict", "error_code"), F.lower("relative_path"), F.col("relative_path"))
