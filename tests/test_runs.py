"""Run folders, charts and the command line on small real files."""

import hashlib
import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from siftworks import cli
from siftworks.functions import charts
from siftworks.sources import runs

from .test_behaviour import png


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    for k in range(6):
        (root / f"p{k}.png").write_bytes(png(100 + k % 4, 50))
    (root / "broken.jpg").write_bytes(b"nothing")
    return root


def test_folder_run(spark, folder, tmp_path, capsys):
    out = f"file://{tmp_path}/out"
    code = cli.main(["folder", f"file://{folder}", "--output", out, "--fail-on", "error", "--links", f"file://{tmp_path}/links"], spark)
    summary = json.loads(capsys.readouterr().out)
    assert code == 30 and summary["scanned_count"] == 7 and summary["counts"]["ERROR"] == 1
    links = tmp_path / "links" / summary["run_id"]
    assert len(list(links.glob("*/*.url"))) == summary["flagged_count"] and (links / "ERROR" / "index.html").exists()
    latest = runs.get_json(spark, f"{out}/latest.json")
    there = runs.resolve_input(spark, latest["summary"])
    rows = spark.read.json(there["results"])
    assert rows.count() == 7 and [r["index"] for r in rows.orderBy("relative_path").collect()] == [1, 2, 3, 4, 5, 6, 7]
    same = rows.where("sha256 is not null and score is not null").groupBy("sha256").agg(F.count_distinct("score").alias("n")).collect()
    assert all(r.n == 1 for r in same)
    assert runs.get_json(spark, f"{out}/{summary['run_id']}/status.json")["complete"]
    with pytest.raises(ValueError):
        runs.resolve_input(spark, there["results"])


def test_scan_prints_a_line_a_file(spark, folder, capsys):
    assert cli.main(["scan", f"file://{folder}"], spark) == 30
    assert len(capsys.readouterr().out.splitlines()) == 7


def test_evaluate(spark, tmp_path, capsys):
    h = [hashlib.sha256(bytes([k])).hexdigest() for k in range(3)]
    labels = [{"sha256": x, "label": "nsfw" if k else "safe", "domain": "d", "split": "test", "label_source": "human"} for k, x in enumerate(h)]
    results = [{"artifact": {"sha256": x.upper()}, "verdict": "BLOCK" if k else "ALLOW", "scores": {"nsfw": 0.9 if k else 0.1}} for k, x in enumerate(h[:2])]
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, labels)))
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, results)))
    assert cli.main(["evaluate", "--labels", f"file://{tmp_path}/l.jsonl", "--results", f"file://{tmp_path}/r.jsonl"], spark) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["coverage"]["matched_images"] == 2 and report["coverage"]["unmatched_labels"] == 1
    def refused(labels, results):
        (tmp_path / "l.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in labels))
        (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, results)))
        assert cli.main(["evaluate", "--labels", f"file://{tmp_path}/l.jsonl", "--results", f"file://{tmp_path}/r.jsonl"], spark) == 2
        return capsys.readouterr().err.strip()

    again = {**labels[0], "sha256": h[0].upper(), "label": "nsfw"}
    assert refused([*labels, "", again], results) == "labels: line 5: duplicate_digest"
    assert refused([labels[0], "{", *labels[1:]], results) == "labels: line 2: invalid_json"
    assert refused(labels, [*results, {**results[0], "verdict": "REVIEW"}]) == "results: line 1: prediction_conflict"
    assert refused(labels, [{**results[0], "model": {"id": "a"}}, {**results[1], "model": {"id": "b"}}]) == "results: line 2: mixed_identity"
    assert refused(labels, [results[0], {**results[1], "verdict": "MAYBE"}]) == "results: line 2: bad_verdict"
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, results)))
    labels[0]["label_source"] = "model"
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, labels)))
    assert cli.main(["evaluate", "--labels", f"file://{tmp_path}/l.jsonl", "--results", f"file://{tmp_path}/r.jsonl"], spark) == 2


def test_enrich_config_chart(spark, tmp_path, capsys):
    (tmp_path / "m.toml").write_text('schema_version = 1\n[[models]]\nid = "a"\nadapter = "command"\ntrusted = true\ntasks = ["t"]\nwhen = ["BLOCK"]\n')
    (tmp_path / "r.jsonl").write_text('{"index": 1, "relative_path": "x", "verdict": "block"}\n{"index": 2, "relative_path": "y"}\n')
    assert cli.main(["config", f"{tmp_path}/m.toml"], spark) == 0
    assert cli.main(["enrich", f"file://{tmp_path}/r.jsonl", "--config", f"{tmp_path}/m.toml"], spark) == 0
    rows = {r["index"]: r for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert rows[1]["analyses"] == ["a"] and rows[2]["analyses"] == [] and rows[2]["verdict"] == "ERROR"
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps({"completed": k, "elapsed_seconds": k / 7}) for k in range(1, 50)))
    assert cli.main(["chart", f"file://{tmp_path}/t.jsonl", "--output", f"{tmp_path}/c.svg"], spark) == 0
    ElementTree.parse(tmp_path / "c.svg")


def test_gpu_lines_and_charts(spark):
    df = spark.createDataFrame([("RTX, 610.62, 10240, 916, 12",), ("none",), ("a, b, c, d, e",)], "l string")
    got = [r[0] for r in df.select(runs.gpu_sample(F.col("l"))).collect()]
    assert got[0].memory_used_mib == 916 and got[1] is None and got[2] is None
    assert runs.host_sample()["logical_cpus"] > 0
    svg = charts.chart([("a & b", {"x": [(0, 1), (5, 9)], "y": []})], "<t>")
    ElementTree.fromstring(svg)
    with pytest.raises(ValueError):
        charts.panel("t", {"x": [(k, k) for k in range(5000)]})
