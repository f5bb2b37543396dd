"""Run folders: results, flags, summary and status, published only when complete; and reading them again."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERDICTS = ("ALLOW", "REVIEW", "BLOCK", "ERROR")


def new_run_id(now: datetime | None = None) -> str:
    return (now or datetime.now(UTC)).astimezone(UTC).strftime("%Y%m%dT%H%M%S.%fZ")


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: a temporary file that is then renamed, on any Hadoop file system."""
    fs, part = _fs(spark, path + ".part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    replace(spark, path + ".part", path)


def replace(spark: SparkSession, part: str, path: str) -> None:
    """Rename over a file that may be there, in one step: a reader sees the former file or the new one."""
    fs, target = _fs(spark, path)
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(_fs(spark, part)[1]), fs.makeQualified(target), how)


def get_json(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(path, wholetext=True).first()
    return json.loads(row.value)


def summary_of(rows: DataFrame, elapsed: float) -> dict:
    """Counts, flagged rows, bytes and rate in one pass."""
    count = {v: F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS}
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("verdict") != "ERROR", F.col("byte_length"))), F.lit(0)).alias("bytes"), *count.values()).first()
    counts = {v: r[v] for v in sorted(VERDICTS) if r[v]}
    return {
        "scanned_count": r.n,
        "input_bytes": r.bytes,
        "counts": counts,
        "flagged_count": r.n - r.ALLOW,
        "elapsed_seconds": elapsed,
        "throughput_per_second": r.n / elapsed if elapsed else None,
    }


def write_run(rows: DataFrame, root: str, run_id: str, started: datetime | None = None) -> dict:
    """Results and flags as JSON lines, then summary.json, and last status.json and latest.json.

    A reader that sees latest.json or a complete status sees whole tables: Spark's committer publishes each
    table at its end, and the pointers are written after both.
    """
    spark = rows.sparkSession
    run = f"{root.rstrip('/')}/{run_id}"
    put_text(spark, f"{run}/status.json", json.dumps({"run_id": run_id, "complete": False}))
    rows.write.json(f"{run}/all-results")
    stored = spark.read.schema(rows.schema).json(f"{run}/all-results")
    stored.where("verdict <> 'ALLOW'").write.json(f"{run}/flags")
    elapsed = (datetime.now(UTC) - started).total_seconds() if started else 0.0
    summary = {"schema_version": 1, "run_id": run_id, **summary_of(stored, elapsed), "reports": {"all_results": f"{run}/all-results", "flags": f"{run}/flags"}}
    put_text(spark, f"{run}/summary.json", json.dumps(summary, sort_keys=True, indent=2))
    put_text(spark, f"{run}/status.json", json.dumps({"run_id": run_id, "complete": True}))
    put_text(spark, f"{root.rstrip('/')}/latest.json", json.dumps({"run_id": run_id, "summary": f"{run}/summary.json"}))
    return summary


def resolve_input(spark: SparkSession, path: str, root: str | None = None) -> dict:
    """Where the rows of a run lie: from its summary, or from results and an explicit root.

    Limits must be positive whole numbers; a boolean is not one.
    """
    if not path.endswith("summary.json"):
        if root is None:
            raise ValueError("results without a summary need an explicit root")
        return {"results": path, "root": root, "run_id": None, "limits": {}}
    s = get_json(spark, path)
    results = s.get("reports", {}).get("all_results")
    if not results:
        raise ValueError("the summary names no results")
    limits = {k: v for k, v in s.get("limits", {}).items() if type(v) is int and v > 0}
    return {"results": results, "root": root or s.get("root"), "run_id": s.get("run_id"), "limits": limits}


def digest_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """filename, size and SHA-256 of the files in a folder, in order of name."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("filename"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).orderBy("filename")


def host_sample() -> dict:
    """What the driver's host shows now: processors, load, and this process's peak memory."""
    import resource

    return {
        "logical_cpus": os.cpu_count(),
        "load_1m": os.getloadavg()[0],
        "peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024,
        "sampled_at": datetime.now(UTC).isoformat(),
    }


def gpu_sample(line: Column) -> Column:
    """A GPU monitor's CSV line of five fields (name, driver, total, used, percent) as a struct; null otherwise."""
    parts = F.transform(F.split(line, ","), lambda x: F.trim(x))
    number = lambda k: F.element_at(parts, k).try_cast("int")
    whole = (F.size(parts) == 5) & number(3).isNotNull() & number(4).isNotNull() & number(5).isNotNull()
    return F.when(
        whole,
        F.struct(F.element_at(parts, 1).alias("name"), F.element_at(parts, 2).alias("driver"), number(3).alias("memory_total_mib"), number(4).alias("memory_used_mib"), number(5).alias("utilization_percent")),
    )
