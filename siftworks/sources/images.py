"""Image folders as DataFrames: discovery, bounded bytes, headers, and a walk for hidden paths."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.order import staged
from ..operators.scan import supported

MAX_BYTES = 25 << 20
#: Entries of a folder that a task holds at a time.
LISTED = 10_000


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """path and length of supported files below ``root``; the content column is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.where(supported(F.col("path")))


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """path, length and whether it is a folder, of what lies in each folder; no links."""
    for b in batches:
        for folder in b["path"]:
            with os.scandir(folder) as entries:
                own = ((e.path, e.stat(follow_symlinks=False).st_size, e.is_dir(follow_symlinks=False)) for e in entries if not e.is_symlink())
                while rows := list(islice(own, LISTED)):
                    yield pd.DataFrame(rows, columns=["path", "length", "folder"])


def walk_images(spark: SparkSession, root: str) -> DataFrame:
    """The same by a walk, for mounted roots with hidden folders, which Spark's listing leaves out. No links.

    Tasks list the folders of one depth at a time, so no list of files is gathered; an unreadable folder is an error.
    """
    folders, found = spark.createDataFrame([(root,)], "path string"), None
    while True:
        level = staged(folders.repartition("path").mapInPandas(_listed, "path string, length long, folder boolean"))
        files = level.where(~F.col("folder")).select("path", "length")
        found = files if found is None else found.union(files)
        folders = level.where("folder").select("path")
        if folders.isEmpty():
            return found.where(supported(F.col("path")))


def read_images(spark: SparkSession, root: str, most: int = MAX_BYTES) -> DataFrame:
    """path, length, sha256, content, code: oversized files keep their row, and their bytes are not read.

    The size test reaches the scan of the first branch, so only files within the limit are opened.
    """
    return _bounded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(supported(F.col("path"))), most)


def load_images(spark: SparkSession, paths: list[str], most: int = MAX_BYTES) -> DataFrame:
    """The same of some named files, whatever their suffix."""
    return _bounded(spark.read.format("binaryFile").load(paths), most)


def _bounded(files: DataFrame, most: int) -> DataFrame:
    small = files.where(F.col("length") <= most)
    read = small.select("path", "length", F.sha2("content", 256).alias("sha256"), "content", F.lit(None).cast("string").alias("code"))
    big = files.where(F.col("length") > most)
    none = F.lit(None)
    return read.unionByName(big.select("path", "length", none.cast("string").alias("sha256"), none.cast("binary").alias("content"), F.lit("artifact_too_large").alias("code")))


def _number(content: Column, start: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, start, size)), 16, 10).cast("long")


def header(content: Column) -> Column:
    """struct<format,width,height,animated> from the first bytes alone; format is null for other content.

    PNG and WebP carry their size at fixed places. A JPEG's size is in its first frame header, which is
    found by its marker in the hex of the first 64 KiB.
    """
    png = F.substring(content, 1, 8) == F.unhex(F.lit("89504E470D0A1A0A"))
    webp = (F.substring(content, 1, 4) == F.unhex(F.lit("52494646"))) & (F.substring(content, 9, 4) == F.unhex(F.lit("57454250")))
    jpeg = F.substring(content, 1, 3) == F.unhex(F.lit("FFD8FF"))
    kind = F.decode(F.substring(content, 13, 4), "ISO-8859-1")
    le = lambda at, n: sum((_number(content, at + k, 1) * (1 << 8 * k) for k in range(1, n)), _number(content, at, 1))
    lossless = le(22, 4)
    webp_width = F.when(kind == "VP8X", le(25, 3) + 1).when(kind == "VP8L", lossless.bitwiseAND(F.lit(0x3FFF)) + 1).when(kind == "VP8 ", le(27, 2).bitwiseAND(F.lit(0x3FFF)))
    webp_height = (
        F.when(kind == "VP8X", le(28, 3) + 1)
        .when(kind == "VP8L", F.shiftright(lossless, 14).bitwiseAND(F.lit(0x3FFF)) + 1)
        .when(kind == "VP8 ", le(29, 2).bitwiseAND(F.lit(0x3FFF)))
    )
    frame = F.regexp_extract(F.hex(F.substring(content, 1, 65536)), "^(?:..)*?FFC[0-3](?:....)(?:..)((?:..){4})", 1)
    jpeg_height = F.conv(F.substring(frame, 1, 4), 16, 10).cast("long")
    jpeg_width = F.conv(F.substring(frame, 5, 4), 16, 10).cast("long")
    animated = F.when(webp & (kind == "VP8X"), _number(content, 21, 1).bitwiseAND(F.lit(2)) > 0).otherwise(F.lit(False))
    return F.struct(
        F.when(png, "PNG").when(webp, "WEBP").when(jpeg, "JPEG").alias("format"),
        F.when(png, _number(content, 17, 4)).when(webp, webp_width).when(jpeg, jpeg_width).alias("width"),
        F.when(png, _number(content, 21, 4)).when(webp, webp_height).when(jpeg, jpeg_height).alias("height"),
        F.coalesce(animated, F.lit(False)).alias("animated"),
    )


def verify_artifact(spark: SparkSession, path: str, pinned: str, most: int = 64 << 20) -> DataFrame:
    """One row a file: its digest, and whether it is the pinned one within the size limit."""
    f = spark.read.format("binaryFile").load(path).select("path", "length", S.digest(F.col("content")).alias("sha256"))
    return f.withColumn("ok", (F.col("length") <= most) & (F.col("sha256") == pinned.lower()))
