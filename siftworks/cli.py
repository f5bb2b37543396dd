"""Command line: python -m siftworks.cli scan|folder|evaluate|enrich|bridge|benchmark|chart|history|config|init|doctor|model|verify ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import measure, serve
from .functions import charts
from .operators import adapters as A
from .operators import evaluate as E
from .operators import order as O
from .operators import policy as P
from .operators import routing as R
from .operators import validate as V
from .operators.scan import discovered
from .scanning import scan_folder
from .session import get_spark
from .sources import config, history, images, jsonl, models, review, runs


#: A configuration to begin with: all models are off until they are reviewed.
STARTER = """schema_version = 1

[privacy]
mode = "local-only"  # or remote-tls
acknowledge_remote_image_disclosure = false

[[models]]
id = "local"
adapter = "command"
enabled = false
trusted = false
command = ["my-adapter"]
tasks = ["describe"]
when = ["REVIEW", "BLOCK"]
timeout_seconds = 30

[[models]]
id = "remote"
adapter = "http-json"
enabled = false
url = "https://models.example.invalid/analyze"
auth_env = "MODEL_TOKEN"
tasks = ["describe"]
when = ["ALL"]
"""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftworks")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "folder"):
        s = sub.add_parser(name, help="scan a folder of images" + (" into a run folder" if name == "folder" else ""))
        s.add_argument("root")
        s.add_argument("--policy", default=P.DEFAULT_POLICY, choices=[n for n, _, _ in P.POLICIES])
        s.add_argument("--max-bytes", type=int, default=images.MAX_BYTES)
        if name == "folder":
            s.add_argument("--output", required=True)
            s.add_argument("--links", help="folder for shortcuts and pages of the flagged files")
            s.add_argument("--fail-on", default="never", choices=["never", "error", "block", "review"])
    s = sub.add_parser("evaluate", help="results against labels, both JSON lines")
    s.add_argument("--labels", required=True)
    s.add_argument("--results", required=True)
    s = sub.add_parser("enrich", help="route results to the models of a configuration")
    s.add_argument("results")
    s.add_argument("--config", required=True)
    s.add_argument("--call", action="store_true", help="call the adapters of the routed models")
    s.add_argument("--fail-on", default="error", choices=["never", "error"])
    s = sub.add_parser("bridge", help="answer requests, JSON lines from standard input to standard output")
    s.add_argument("--allow-root", action="append", help="files may be read below this folder; may be repeated, default: here")
    s.add_argument("--batch", type=int, default=1)
    s.add_argument("--max-bytes", type=int, default=images.MAX_BYTES)
    s = sub.add_parser("benchmark", help="measure the scorer on made-up payloads")
    s.add_argument("--runs", type=int, default=30)
    s.add_argument("--warmups", type=int, default=3)
    s.add_argument("--output")
    s = sub.add_parser("history", help="chart a folder of benchmarks")
    s.add_argument("folder")
    s.add_argument("--output", required=True)
    s = sub.add_parser("init", help="write a configuration with all models off")
    s.add_argument("path")
    s.add_argument("--force", action="store_true")
    s = sub.add_parser("doctor", help="check a configuration and shake hands with its models")
    s.add_argument("path")
    s = sub.add_parser("model", help="the pinned model file")
    s.add_argument("action", choices=["status", "install"])
    s.add_argument("path")
    s.add_argument("sha256")
    s.add_argument("--source", help="where install copies from")
    s = sub.add_parser("chart", help="throughput over a run's timeline (JSON lines of completed, elapsed_seconds)")
    s.add_argument("timeline")
    s.add_argument("--output", required=True)
    s = sub.add_parser("config", help="check a model configuration")
    s.add_argument("path")
    s = sub.add_parser("verify", help="check a model file against its digest")
    s.add_argument("path")
    s.add_argument("sha256")
    return p


LABEL_LINE = "sha256 string, label string, domain string, split string, label_source string"
RESULT_LINE = "artifact struct<sha256:string>, sha256 string, verdict string, scores struct<nsfw:double>, score double, model struct<id:string, sha256:string>, policy string"


def _checked(spark: SparkSession, path: str, schema: str, violation: Column) -> tuple[DataFrame, DataFrame]:
    """The records of a file of JSON lines by file line, and (line, code) of lines that are no record or violate a rule."""
    lines = jsonl.bounded(jsonl.read_lines(spark, path).where(F.trim("text") != ""))
    bad = lines.where("code is not null").select("line", "code")
    records = lines.where("code is null").select("line", F.from_json("text", schema).alias("x")).select("line", "x.*")
    return records, bad.union(records.select("line", violation.alias("code")).where("code is not null"))


def _config_violations(own: DataFrame) -> bool:
    """Print what is wrong with the models of a configuration; whether anything is."""
    bad = own.select("id", V.config_violation().alias("code")).where("code is not null").orderBy("id").collect()
    for r in bad:
        print(f"{r.id}: {r.code}")
    return bool(bad)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or get_spark("siftworks")
    if a.command in ("scan", "folder"):
        rows = scan_folder(spark, a.root, a.max_bytes, a.policy)
        if a.command == "scan":
            for r in rows.orderBy("index").toLocalIterator():
                print(f"{r.verdict}\t{r.relative_path}\t{(r.sha256 or '')[:12]}\t{r.error_code or ''}")
            return rows.agg(F.coalesce(F.max(P.severity(F.col("verdict"))), F.lit(0))).first()[0]
        run_id = runs.new_run_id()
        print(json.dumps(runs.write_run(rows, a.output, run_id, datetime.now(UTC)), sort_keys=True))
        stored = spark.read.schema(rows.schema).json(f"{a.output.rstrip('/')}/{run_id}/all-results")
        if a.links:
            review.write_links(stored.withColumnRenamed("relative_path", "path"), f"{a.links.rstrip('/')}/{run_id}", run_id, a.policy)
        return {r.fail_on: r.exit_code for r in P.exit_policy(stored).collect()}[a.fail_on] or 0
    if a.command == "evaluate":
        lines, bad = _checked(spark, a.labels, LABEL_LINE, V.label_violation())
        bad = bad.union(E.repeated(lines, "sha256").select("line", F.lit("duplicate_digest")))
        records, bad_records = _checked(spark, a.results, RESULT_LINE, F.when(~F.coalesce(F.col("verdict").isin("ALLOW", "REVIEW", "BLOCK", "ERROR"), F.lit(False)), "bad_verdict"))
        identity = F.concat_ws("|", F.coalesce("model.id", F.lit("-")), F.coalesce("model.sha256", F.lit("-")), F.coalesce("policy", F.lit("-")))
        bad_records = bad_records.union(E.differs_from_first(records, identity).select("line", F.lit("mixed_identity")))
        res = records.select("line", F.lower(F.coalesce("artifact.sha256", "sha256")).alias("sha256"), "verdict", F.coalesce("scores.nsfw", "score").alias("score"))
        labels = E.one_label_per_digest(lines)
        conflicts = E.prediction_conflicts(E.matched(res, labels)).where("conflict").select(F.col("first_line").alias("line"), F.lit("prediction_conflict"))
        for what, found in (("labels", bad), ("results", bad_records), ("results", conflicts.toDF("line", "code"))):
            first = E.first_violation(found.withColumn("priority", F.lit(0))).collect()
            if first:
                print(f"{what}: line {first[0].line}: {first[0].code}", file=sys.stderr)
                return 2
        report = {"coverage": E.coverage(res, labels).first().asDict(), "splits": [r.asDict() for r in E.summary(E.first_predictions(E.matched(res, labels))).collect()]}
        print(json.dumps(report, sort_keys=True))
        return 0 if report["coverage"]["matched_images"] else 2
    if a.command == "enrich":
        own = config.load_models(spark, Path(a.config).read_text())
        rows = spark.read.schema("index long, relative_path string, sha256 string, verdict string").json(a.results)
        rows = rows.withColumn("verdict", F.upper(F.coalesce("verdict", F.lit("ERROR"))))
        if not a.call:
            out = R.enriched(rows, own.withColumnRenamed("id", "model_id"))
        else:
            if _config_violations(own):
                return 30
            try:
                out = R.analysed(rows, own.where("enabled").orderBy("ordinal").collect(), "index", lambda m: A.from_model(m, os.environ))
            except A.AdapterError as e:
                print(f"adapter: {e}", file=sys.stderr)
                return 30
            out = O.staged(out)  # what was printed and what is counted come of the same calls
        for line in out.select(F.to_json(F.struct(*sorted(out.columns))).alias("x")).toLocalIterator():
            print(line.x)
        failed = a.call and a.fail_on == "error" and not out.where(F.exists("analyses", lambda x: ~x["ok"])).isEmpty()
        return 31 if failed else 0
    if a.command == "bridge":
        serve.serve(spark, sys.stdin, sys.stdout, a.allow_root or [os.getcwd()], a.batch, a.max_bytes)
        return 0
    if a.command == "benchmark":
        report = json.dumps(measure.benchmark(spark, a.runs, a.warmups), sort_keys=True, indent=2)
        if a.output:
            runs.put_text(spark, a.output, report)
        print(report)
        return 0
    if a.command == "history":
        rows = history.measurements(history.records(history.read_documents(spark, a.folder))).orderBy("stem", "provider", "position").limit(charts.MOST_POINTS + 1).collect()
        if not 0 < len(rows) <= charts.MOST_POINTS:
            print("history: no measurements" if not rows else f"history: more than {charts.MOST_POINTS} points", file=sys.stderr)
            return 2
        Path(a.output).write_text(measure.history_chart(rows))
        return 0
    if a.command == "init":
        if os.path.exists(a.path) and not a.force:
            print(f"{a.path} exists", file=sys.stderr)
            return 30
        runs.put_text(spark, Path(a.path).absolute().as_uri(), STARTER)
        return 0
    if a.command == "doctor":
        own = config.load_models(spark, Path(a.path).read_text())
        if _config_violations(own):
            return 30
        report = []
        for m in own.where("enabled").orderBy("ordinal").collect():
            try:
                A.from_model(m, os.environ)().close()
                report.append({"id": m.id, "ok": True, "tasks": m.tasks})
            except (A.AdapterError, OSError) as e:
                report.append({"id": m.id, "ok": False, "error": str(e)[:200]})
        print(json.dumps({"ok": all(r["ok"] for r in report), "models": report}, sort_keys=True))
        return 0 if all(r["ok"] for r in report) else 30
    if a.command == "model":
        try:
            state = models.model_status(spark, a.path, a.sha256) if a.action == "status" else models.install_model(spark, a.source or a.path, a.path, a.sha256)
        except ValueError as e:
            print(f"model: {e}", file=sys.stderr)
            return 30
        print(json.dumps(state, sort_keys=True))
        return 0 if state["valid"] else 30
    if a.command == "chart":
        rows = spark.read.schema("completed long, elapsed_seconds double").json(a.timeline)
        points = O.decimated(O.last_of_consecutive(rows, "completed", F.col("elapsed_seconds")), charts.MOST_POINTS, F.col("elapsed_seconds"))
        series = [(r.elapsed_seconds, r.completed / r.elapsed_seconds if r.elapsed_seconds else 0.0) for r in points.collect()]
        Path(a.output).write_text(charts.chart([("items a second", {"throughput": series})], "Run"))
        return 0
    if a.command == "config":
        return 30 if _config_violations(config.load_models(spark, Path(a.path).read_text())) else 0
    ok = images.verify_artifact(spark, a.path, a.sha256).collect()[0].ok
    print("ok" if ok else "digest or size differs")
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
