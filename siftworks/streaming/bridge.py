"""The request bridge: JSON lines in, one response a line out; the same function for batch and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import policy as P
from ..operators import validate as V
from ..sources.jsonl import kind_of

#: Protocol name, limits in characters.
PROTOCOL = "safety-bridge/v1"
MAX_LINE, MAX_ID, MAX_PATH = 1_048_576, 128, 4096
CODES = {"protocol": "bridge_protocol_error", "input": "invalid_input", "path": "path_outside_allowed_roots"}


#: Fields of a request, by the name under which they are checked.
FIELDS = {"id": "id", "protocol": "protocol", "operation": "operation", "artifact": "artifact", "kind": "artifact.kind", "path": "artifact.path", "sha256": "artifact.sha256", "policy": "policy", "profile": "policy.profile"}
KINDS = ("id", "artifact", "path", "sha256", "policy", "profile")
TEXTS = ("id", "protocol", "operation", "kind", "path", "sha256", "profile")


def _fields(lines: DataFrame) -> DataFrame:
    """The lines with struct columns _is, kinds of fields, and _in, their texts. Each line is parsed once."""
    parsed = lines.where(F.trim("text") != "").withColumn("_json", F.try_parse_json("text"))
    at = lambda name, kind: F.try_variant_get("_json", f"$.{FIELDS[name]}", kind)
    kinds = F.struct(kind_of(F.col("_json")).alias("line"), *[kind_of(at(name, "variant")).alias(name) for name in KINDS])
    return parsed.withColumns({"_is": kinds, "_in": F.struct(*[at(name, "string").alias(name) for name in TEXTS])}).drop("_json")


def requests(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their request fields and the code of the first failed check, or null.

    Checks come in protocol order; the id is given back only once it is valid.
    """
    kind, text = (lambda name: F.col(f"_is.{name}")), (lambda name: F.col(f"_in.{name}"))
    good_id = (kind("id") == "string") & (F.length(text("id")) > 0) & (F.length(text("id")) <= MAX_ID) & ~text("id").rlike("[\\x00-\\x1f]")
    scan = text("operation") == "scan"
    profile = F.coalesce(text("profile"), F.lit(P.DEFAULT_POLICY))
    code = V.first_failed(
        (F.length("text") <= MAX_LINE, CODES["protocol"]),
        (kind("line") == "object", CODES["protocol"]),
        (good_id, CODES["protocol"]),
        (text("protocol") == PROTOCOL, CODES["protocol"]),
        (text("operation").isin("health", "scan"), CODES["protocol"]),
        (~scan | (kind("artifact") == "object"), CODES["protocol"]),
        (~scan | (text("kind") == "file"), CODES["protocol"]),
        (~scan | ((kind("path") == "string") & (F.length(text("path")) >= 1) & (F.length(text("path")) <= MAX_PATH)), CODES["protocol"]),
        (~scan | kind("sha256").isin("string", "null", "missing"), CODES["protocol"]),
        (~scan | kind("policy").isin("object", "missing"), CODES["protocol"]),
        (~scan | kind("profile").isin("string", "missing"), CODES["protocol"]),
        (~scan | profile.isin([p for p, _, _ in P.POLICIES]), CODES["input"]),
    )
    return _fields(lines).select(
        *lines.columns,
        F.when(F.coalesce(good_id & (F.length("text") <= MAX_LINE), F.lit(False)), text("id")).alias("id"),
        text("operation").alias("operation"),
        text("path").alias("path"),
        text("sha256").alias("claimed"),
        profile.alias("policy"),
        code.alias("code"),
    )


def responses(lines: DataFrame, artifacts: DataFrame, roots: list[str], profiles: DataFrame) -> DataFrame:
    """One response a request: ok, verdict or code. Paths are never given back.

    ``artifacts``: path, sha256, score; where there are any, code (why a file has no score), animated, and inside
    (whether the file lies below a root, links resolved; else the path itself is judged). Two lookups, both stream-static if ``lines`` is a stream; anything
    that fails is an error, never an ALLOW.
    """
    r = requests(lines)
    # one row a path, so that a request has one response
    own = lambda name, kind: (F.col(name) if name in artifacts.columns else F.lit(None).cast(kind)).alias(f"_{name}")
    full = F.struct(F.col("sha256").alias("_sha"), F.col("score").alias("_score"), own("code", "string"), own("animated", "boolean"), own("inside", "boolean"))
    known = artifacts.groupBy(F.col("path").alias("_path")).agg(F.min(full).alias("x")).select("_path", "x.*")
    rows = r.join(known, r.path == known._path, "left").join(F.broadcast(profiles), "policy", "left")
    scan = F.col("operation") == "scan"
    bound = V.digest_binding(F.col("claimed"), F.col("_sha"))
    code = F.coalesce(
        F.col("code"),
        F.when(scan & F.col("_sha").isNull() & F.col("_code").isNull(), CODES["input"]),
        F.when(scan & ~F.coalesce("_inside", V.inside_root(F.col("path"), roots)), CODES["path"]),
        F.when(scan & (bound == "malformed"), CODES["input"]),
        F.when(scan & F.col("_sha").isNotNull() & (bound == "mismatch"), "artifact_digest_mismatch"),
        F.when(scan, F.col("_code")),
    )
    verdict = F.when(code.isNull() & scan & F.coalesce("_animated", F.lit(False)), "REVIEW").when(code.isNull() & scan, P.verdict(F.col("_score"), F.col("review_threshold"), F.col("block_threshold")))
    status = F.when(code.isNull() & ~scan, "ready")
    extra = [c for c in lines.columns if c != "text"]
    return rows.select(*extra, F.lit(PROTOCOL).alias("protocol"), "id", code.isNull().alias("ok"), verdict.alias("verdict"), status.alias("status"), code.alias("code"))


def response_lines(rows: DataFrame) -> DataFrame:
    """Compact JSON with sorted keys."""
    result = F.when(F.col("ok"), F.to_json(F.struct("id", "ok", "protocol", F.struct("status", "verdict").alias("result"))))
    error = F.to_json(F.struct(F.struct("code").alias("error"), "id", "ok", "protocol"))
    return rows.select(F.coalesce(result, error).alias("value"))


def run_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame], files: int = 16) -> None:
    """Answer all lines in the folder ``source`` and stop; each file is answered once, also after a restart."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files).load(source).withColumnRenamed("value", "text")
    out = response_lines(answer(lines))
    out.writeStream.format("text").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_verdicts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """An extension: verdict counts by event-time window, late rows dropped after ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "verdict").agg(F.count(F.lit(1)).alias("n"))


def first_of_digest(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """An extension: each digest once within the watermark, the streaming form of scoring distinct digests."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["sha256"])
