"""Bridge, model store, history, review links, benchmark and adapters from the command line."""

import hashlib
import io
import json
import os
import sys
from xml.etree import ElementTree

import pytest

from siftworks import cli, measure, serve
from siftworks.sources import history, images, models, review

from .test_adapters import CHILD
from .test_behaviour import png


def ask(ident, path, **more):
    return json.dumps({"protocol": "safety-bridge/v1", "id": ident, "operation": "scan", "artifact": {"kind": "file", "path": path, **more}})


@pytest.mark.parametrize("batch", [1, 50])
def test_bridge_answers_each_line_in_order(spark, tmp_path, batch):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.png").write_bytes(png(40, 30))
    (root / "b.png").write_bytes(b"no image")
    (root / "big.png").write_bytes(png(40, 30) + b"\0" * 5000)
    (tmp_path / "out.png").write_bytes(png(40, 30))
    (root / "link.png").symlink_to(tmp_path / "out.png")
    sha = hashlib.sha256(png(40, 30)).hexdigest()
    lines = [
        '{"protocol": "safety-bridge/v1", "id": "h", "operation": "health"}', "", ask("1", "a.png"), ask("2", str(root / "a.png"), sha256=sha.upper()),
        ask("3", "a.png", sha256="0" * 64), ask("4", "gone.png"), ask("5", "../out.png"), ask("6", "link.png"), ask("7", "b.png"), ask("8", "big.png"), "{", ask("9", "a.png", sha256="x"),
    ]
    if batch == 1:
        lines = lines[1:4] + lines[6:7]
    out = io.StringIO()
    serve.serve(spark, io.StringIO("\n".join(lines) + "\n"), out, [str(root)], batch, 4000)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert all(str(tmp_path) not in x for x in out.getvalue().splitlines())
    codes = {r.get("id"): r["error"]["code"] if not r["ok"] else r["result"].get("verdict", r["result"].get("status")) for r in got}
    score = int(sha[:4], 16) / 65535
    verdict = "BLOCK" if score >= 0.8 else "REVIEW" if score >= 0.35 else "ALLOW"
    want = {"h": "ready", "1": verdict, "2": verdict, "3": "artifact_digest_mismatch", "4": "invalid_input", "5": "path_outside_allowed_roots", "6": "path_outside_allowed_roots", "7": "unsupported_media", "8": "artifact_too_large", None: "bridge_protocol_error", "9": "invalid_input"}
    asked = [None if x == "{" else json.loads(x)["id"] for x in lines if x]
    assert [r.get("id") for r in got] == asked and codes == {k: want[k] for k in asked}


def test_long_lines_are_cut_and_refused():
    assert [len(x) for x in serve.bounded_lines(io.StringIO("x" * 50 + "\nab\n" + "y" * 10), 10)] == [11, 2, 10]
    with pytest.raises(ValueError):
        serve.serve(None, io.StringIO(), io.StringIO(), [])


def test_model_store(spark, tmp_path, capsys):
    (tmp_path / "m").write_bytes(b"weights")
    sha, target = hashlib.sha256(b"weights").hexdigest(), f"file://{tmp_path}/store/model.onnx"
    assert cli.main(["model", "status", target, sha], spark) == 30
    assert not json.loads(capsys.readouterr().out)["installed"]
    with pytest.raises(ValueError, match="digest"):
        models.install_model(spark, f"file://{tmp_path}/m", target, "0" * 64)
    with pytest.raises(ValueError, match="unavailable"):
        models.install_model(spark, f"file://{tmp_path}/gone", target, sha)
    with pytest.raises(ValueError, match="large"):
        models.install_model(spark, f"file://{tmp_path}/m", target, sha, 3)
    assert not [p for p in (tmp_path / "store").glob("*") if p.suffix != ".crc"]
    assert cli.main(["model", "install", target, sha.upper(), "--source", f"file://{tmp_path}/m"], spark) == 0
    assert (tmp_path / "store" / "model.onnx").read_bytes() == b"weights"
    (tmp_path / "m").unlink()
    assert models.install_model(spark, f"file://{tmp_path}/m", target, sha)["valid"]  # what is valid stays


def test_history(spark, tmp_path, capsys):
    rec = lambda p, t, **more: {"provider": p, "throughput_images_per_second": t, "total_p50_ms": 2.5, "peak_process_rss_bytes": 3 << 20, **more}
    (tmp_path / "2031-02-03-a.json").write_text(json.dumps({"single": [rec("cpu", 4), rec("cpu", 5)], "measurements": [rec("cpu", 7, workers=1), rec("cpu", 9, workers=4), rec("cpu", 9, workers=2), rec("gpu", 8)]}))
    (tmp_path / "b.json").write_text(json.dumps({"measurement_date": "2031-03-01", "benchmark_kind": "x-real-world", "measurements": [rec("cpu", 6), {"provider": "cpu"}]}))
    (tmp_path / "c.json").write_text("{")
    rows = history.records(history.read_documents(spark, f"file://{tmp_path}"))
    assert sorted((r.stem, r.code) for r in rows.where("code is not null").collect()) == [("b", "bad_measurement"), ("c", "invalid_json")]
    got = sorted((r.date, r.workload, r.provider, r.throughput, r.workers, r.peak_rss_mib) for r in history.measurements(rows).collect())
    assert got == [
        ("2031-02-03", "folder fixture", "cpu", 9, 4, 3), ("2031-02-03", "folder fixture", "gpu", 8, None, 3), ("2031-02-03", "single image", "cpu", 4, None, 3),
        ("2031-02-03", "single image", "cpu", 5, None, 3), ("2031-03-01", "real folder", "cpu", 6, None, 3),
    ]
    assert cli.main(["history", f"file://{tmp_path}", "--output", f"{tmp_path}/h.svg"], spark) == 0
    ElementTree.parse(tmp_path / "h.svg")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.json").write_text("{}")
    assert cli.main(["history", f"file://{tmp_path}/none", "--output", f"{tmp_path}/n.svg"], spark) == 2


def test_review_links(spark, tmp_path):
    rows = [(k, f"file:/in/ä b&{k}.png", k / 10, ("ALLOW", "BLOCK", "REVIEW")[k % 3]) for k in range(1, 12)]
    df = spark.createDataFrame(rows, "index long, path string, score double, verdict string").repartition(3)
    counts = review.write_links(df, f"file://{tmp_path}/links", "r1", "p", per_page=2)
    assert counts == {"BLOCK": 4, "REVIEW": 4, "ERROR": 0}
    made = sorted(p.name for p in (tmp_path / "links" / "BLOCK").iterdir())
    assert len(made) == 6 and made[-2:] == ["index-1.html", "index.html"] and made[0].startswith("0000001_0.1000_")
    assert (tmp_path / "links" / "BLOCK" / made[0]).read_text() == "[InternetShortcut]\nURL=file:///in/%C3%A4%20b%261.png\n"
    first, second = ((tmp_path / "links" / "BLOCK" / n).read_text() for n in ("index.html", "index-1.html"))
    assert "index-1.html" in first and "previous" not in first and "index.html" in second and "next" not in second
    assert "BLOCK/index.html" in (tmp_path / "links" / "index.html").read_text() and "ä b&amp;1.png" in first


def test_benchmark(spark, tmp_path, capsys):
    assert cli.main(["benchmark", "--runs", "3", "--warmups", "1", "--output", f"file://{tmp_path}/b.json"], spark) == 0
    report = json.loads((tmp_path / "b.json").read_text())
    t = report["timings_ms"]
    assert report["runs"] == 3 and 0 < t["total_p50"] <= t["total_p95"] and report["throughput_per_second"] > 0
    assert measure.nearest_rank([3, 1, 2], 0.95) == 3 and measure.nearest_rank([1, 2], 0.5) == 1
    with pytest.raises(ValueError):
        measure.benchmark(spark, 0)


def test_enrich_calls_the_routed_models(spark, tmp_path, capsys):
    (tmp_path / "child.py").write_text(CHILD)
    model = lambda name, when, more="": f'[[models]]\nid = "{name}"\nadapter = "command"\ntrusted = true\ncommand = ["{sys.executable}", "{tmp_path}/child.py"]\ntasks = ["caption"]\nwhen = [{when}]\n{more}'
    (tmp_path / "m.toml").write_text("schema_version = 1\n" + model("b", '"BLOCK"') + model("a", '"ALL"') + model("off", '"ALL"', "enabled = false\n"))
    (tmp_path / "r.jsonl").write_text('{"index": 1, "relative_path": "x", "verdict": "block"}\n{"index": 2, "relative_path": "y"}\n')
    assert cli.main(["doctor", f"{tmp_path}/m.toml"], spark) == 0
    assert [m["id"] for m in json.loads(capsys.readouterr().out)["models"]] == ["b", "a"]
    assert cli.main(["enrich", f"file://{tmp_path}/r.jsonl", "--config", f"{tmp_path}/m.toml", "--call"], spark) == 0
    rows = {r["index"]: r for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert [x["model_id"] for x in rows[1]["analyses"]] == ["b", "a"] and [x["model_id"] for x in rows[2]["analyses"]] == ["a"]
    assert all(x["ok"] and json.loads(x["outputs"])["n"] > 10 for r in rows.values() for x in r["analyses"])
    (tmp_path / "m.toml").write_text("schema_version = 1\n" + model("a", '"ALL"', 'auth_env = "NOT_SET_ANYWHERE"\n'))
    assert "NOT_SET_ANYWHERE" not in os.environ
    assert cli.main(["doctor", f"{tmp_path}/m.toml"], spark) == 30
    assert cli.main(["enrich", f"file://{tmp_path}/r.jsonl", "--config", f"{tmp_path}/m.toml", "--call"], spark) == 30


def test_init_writes_models_that_are_off(spark, tmp_path, capsys):
    assert cli.main(["init", f"{tmp_path}/m.toml"], spark) == 0 and cli.main(["init", f"{tmp_path}/m.toml"], spark) == 30
    assert cli.main(["config", f"{tmp_path}/m.toml"], spark) == 0
    assert cli.main(["doctor", f"{tmp_path}/m.toml"], spark) == 0 and json.loads(capsys.readouterr().out)["models"] == []


def test_walk_finds_hidden_folders_and_no_links(spark, tmp_path):
    for name in ("a.png", ".hidden/b.JPG", ".hidden/deep/_c.webp", "x/notes.txt", "x/d.jpeg"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"12")
    (tmp_path / "in" / "l.png").symlink_to(tmp_path / "in" / "a.png")
    (tmp_path / "in" / "y").symlink_to(tmp_path / "in" / "x")
    got = {r.path.split("/in/")[1]: r.length for r in images.walk_images(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.png": 2, ".hidden/b.JPG": 2, ".hidden/deep/_c.webp": 2, "x/d.jpeg": 2}
    (tmp_path / "none").mkdir()
    assert images.walk_images(spark, str(tmp_path / "none")).collect() == []
