"""Pinned model files: their state, and installation from a path of any Hadoop file system."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .images import verify_artifact
from .runs import _fs, replace

MAX_MODEL = 512 << 20


def model_status(spark: SparkSession, path: str, sha256: str, most: int = MAX_MODEL) -> dict:
    """installed, valid, path, bytes, and of an installed file its digest."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return {"installed": False, "valid": False, "path": path, "bytes": None}
    row = verify_artifact(spark, path, sha256, most).first()
    return {"installed": True, "valid": bool(row.ok), "path": path, "bytes": row.length, "sha256": row.sha256}


def install_model(spark: SparkSession, source: str, target: str, sha256: str, most: int = MAX_MODEL) -> dict:
    """Copy a file to ``target`` if it is the pinned one; a valid target stays, and a bad source changes nothing.

    The copy is checked where it lies and only then renamed, so a reader never sees another file.
    """
    have = model_status(spark, target, sha256, most)
    if have["valid"]:
        return have
    from_fs, origin = _fs(spark, source)
    if not from_fs.exists(origin):
        raise ValueError("model_unavailable")
    if from_fs.getFileStatus(origin).getLen() > most:
        raise ValueError("model_too_large")
    part = target + ".part"
    fs, copy = _fs(spark, part)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(from_fs, origin, fs, copy, False, True, spark._jsc.hadoopConfiguration())
    if not model_status(spark, part, sha256, most)["valid"]:
        fs.delete(copy, False)
        raise ValueError("model_digest_mismatch")
    replace(spark, part, target)
    return model_status(spark, target, sha256, most)
