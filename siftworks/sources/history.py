"""Measured performance over time: one JSON document a benchmark, read as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

RECORD = "struct<provider:string, workers:int, total_p50_ms:double, throughput_images_per_second:double, peak_process_rss_bytes:double>"
#: Fixed value: how the kind of a benchmark over a real folder ends.
REAL = "real-world"
SINGLE, FOLDER, REAL_FOLDER = "single image", "folder fixture", "real folder"


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """stem and text of the JSON files of a folder."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return files.select(S.stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("text"))


def records(documents: DataFrame, single: str = "single") -> DataFrame:
    """All records of documents (stem, text): stem, position, date, workload, provider, workers, p50, throughput, rss, code.

    ``single`` names the list of single-image records; ``measurements`` holds those of folders. A document that is
    no JSON object, and a record without a provider or a number, is a row with a code. A document without a date is
    dated by its name.
    """
    shape = f"measurement_date string, benchmark_kind string, measurements array<{RECORD}>, `{single}` array<{RECORD}>"
    read = documents.select("stem", F.from_json("text", shape).alias("d"), F.try_parse_json("text").isNull().alias("broken"))
    kind = F.when(F.coalesce(F.col("d.benchmark_kind"), F.lit("")).endswith(REAL), REAL_FOLDER).otherwise(FOLDER)

    def tagged(name: str, workload: Column) -> Column:
        own = F.coalesce(F.col(f"d.`{name}`"), F.array().cast(f"array<{RECORD}>"))
        return F.transform(own, lambda r: F.struct(workload.alias("workload"), r.alias("r")))

    every = F.concat(tagged(single, F.lit(SINGLE)), tagged("measurements", kind))
    none = F.array(F.struct(F.lit(None).cast("string").alias("workload"), F.lit(None).cast(RECORD).alias("r")))
    rows = read.select("stem", F.coalesce("d.measurement_date", F.substring("stem", 1, 10)).alias("date"), "broken", F.posexplode(F.when(F.col("broken"), none).otherwise(every)).alias("position", "x"))
    r = lambda name: F.col(f"x.r.{name}")
    whole = r("provider").isNotNull() & r("total_p50_ms").isNotNull() & r("throughput_images_per_second").isNotNull() & r("peak_process_rss_bytes").isNotNull()
    return rows.select(
        "stem", "position", "date", F.col("x.workload").alias("workload"), r("provider").alias("provider"), r("workers").alias("workers"), r("total_p50_ms").alias("p50"),
        r("throughput_images_per_second").alias("throughput"), r("peak_process_rss_bytes").alias("rss"),
        F.when(F.col("broken"), "invalid_json").when(~whole, "bad_measurement").alias("code"),
    )


def measurements(rows: DataFrame) -> DataFrame:
    """The history: every good single-image record, and of each document's folder records a provider's fastest, the first on a tie."""
    good = rows.where("code is null").drop("code")
    folders = good.where(F.col("workload") != SINGLE)
    best = folders.groupBy("stem", "provider").agg(F.max_by(F.struct(*good.columns), F.struct("throughput", -F.col("position"))).alias("x")).select("x.*")
    return good.where(F.col("workload") == SINGLE).unionByName(best).withColumn("peak_rss_mib", F.col("rss") / F.lit(1048576.0))
