"""The request bridge over line streams: batches of lines in, as many responses out, in their order."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import policy as P
from .scanning import judged
from .sources import images
from .streaming import bridge


def bounded_lines(stream: TextIO, most: int = bridge.MAX_LINE) -> Iterator[str]:
    """The lines of a stream; of a longer one only ``most`` + 1 characters are kept, which the bridge refuses."""
    while line := stream.readline(most + 1):
        last = line
        while len(last) > most and not last.endswith("\n"):
            last = stream.readline(most + 1)
        yield line if len(line) > most else line.rstrip("\n")


def artifacts(spark: SparkSession, paths: list[str], roots: list[str], max_bytes: int) -> DataFrame:
    """The files of one batch of requests. Links are resolved, and a file outside the roots is not opened."""
    real = [os.path.realpath(r) for r in roots]
    found = []
    for path in paths:
        try:
            at = os.path.realpath(os.path.join(real[0], path), strict=True)
        except (OSError, ValueError):
            continue
        found.append((path, at, any(at == r or at.startswith(r.rstrip("/") + "/") for r in real)))
    asked = spark.createDataFrame(found, "path string, real string, inside boolean")
    inside = sorted({at for _, at, ok in found if ok and os.path.isfile(at)})
    if not inside:
        return asked.select("path", F.when(~F.col("inside"), "").alias("sha256"), F.lit(None).cast("double").alias("score"), "inside")
    files = judged(images.load_images(spark, inside, max_bytes))
    files = files.select(F.regexp_replace("path", "^file:/+", "/").alias("real"), "sha256", "score", F.col("error_code").alias("code"), "animated")
    rows = asked.join(files, "real", "left")
    return rows.select("path", F.when(~F.col("inside"), "").otherwise(F.col("sha256")).alias("sha256"), "score", "code", "animated", "inside")


def answer(spark: SparkSession, lines: list[str], roots: list[str], max_bytes: int = images.MAX_BYTES) -> list[str]:
    """The responses to a batch of lines, in their order; blank lines have none."""
    asked = spark.createDataFrame(list(enumerate(lines)), "at long, text string")
    scans = bridge.requests(asked).where("code is null and operation = 'scan'").select("path").distinct()
    known = artifacts(spark, [r.path for r in scans.collect()], roots, max_bytes)  # at most a batch
    rows = bridge.responses(asked, known, roots, P.policy_table(spark))
    out = rows.select("at", F.struct(*rows.columns).alias("x")).select("at", "x.*")
    return [r.value for r in bridge.response_lines(out.orderBy("at")).collect()]


def serve(spark: SparkSession, source: TextIO, sink: TextIO, roots: list[str], batch: int = 1, max_bytes: int = images.MAX_BYTES) -> None:
    """Answer a stream to its end, ``batch`` lines a job; 1 answers each line before the next is read."""
    if not roots or batch < 1:
        raise ValueError("the bridge needs a root and a batch of one line or more")
    lines = bounded_lines(source)
    while own := list(islice(lines, batch)):
        for line in answer(spark, own, roots, max_bytes):
            sink.write(line + "\n")
        sink.flush()
