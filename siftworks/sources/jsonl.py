"""Line-oriented JSON: bounded lines with numbers, typed fields, ordered violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LINE = 1_000_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line and text of a file or folder of lines; numbers follow the order within each file."""
    rows = spark.read.text(path, lineSep="\n").select(F.col("value").alias("text"), "_metadata.file_path", F.monotonically_increasing_id().alias("_at"))
    first = rows.groupBy("file_path").agg(F.min("_at").alias("_first"))
    # a file larger than one split spans partitions: its rows are numbered by a range-partitioned count
    from ..operators.order import numbered

    counted = numbered(rows, F.col("file_path"), F.col("_at"), name="_k")
    starts = counted.join(first, "file_path").where(F.col("_at") == F.col("_first")).select("file_path", F.col("_k").alias("_start"))
    return counted.join(starts, "file_path").select("file_path", (F.col("_k") - F.col("_start") + 1).alias("line"), "text")


def kind_of(value: Column) -> Column:
    """object, array, string, number, boolean, null of a variant, or missing where there is none."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "missing")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .otherwise("number")
    )


def json_kind(text: Column) -> Column:
    """object, array, string, number, boolean, null, or invalid."""
    value = F.try_parse_json(text)
    return F.when(value.isNull(), "invalid").otherwise(kind_of(value))


def field_kind(text: Column, name: str) -> Column:
    """Kind of a field; missing where there is none."""
    return kind_of(F.try_variant_get(F.try_parse_json(text), f"$.{name}", "variant"))


def canonical(text: Column) -> Column:
    """The same object with sorted keys; null for invalid JSON."""
    return F.to_json(F.try_parse_json(text))


def bounded(lines: DataFrame, most: int = MAX_LINE) -> DataFrame:
    """Lines with a code: line_too_long, invalid_json, not_an_object or null."""
    kind = json_kind(F.col("text"))
    code = F.when(F.octet_length("text") > most, "line_too_long").when(kind == "invalid", "invalid_json").when(kind != "object", "not_an_object")
    return lines.withColumn("code", code)


def first_bad_line(lines: DataFrame, most: int = MAX_LINE) -> DataFrame:
    bad = bounded(lines, most).where("code is not null")
    return bad.agg(F.min(F.struct("line", "code")).alias("x")).where("x is not null").select("x.line", "x.code")
