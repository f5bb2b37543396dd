"""Behaviours of the operators as tables of inputs and expected rows."""

import hashlib
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from siftworks.operators import evaluate as E
from siftworks.operators import metrics as M
from siftworks.operators import order as O
from siftworks.operators import policy as P
from siftworks.operators import routing as R
from siftworks.operators import scan
from siftworks.operators import udf as U
from siftworks.operators import validate as V
from siftworks.functions import scalars as S
from siftworks.plans import enrichment_queries as EQ
from siftworks.sources import config, images, jsonl
from siftworks.streaming import bridge


def test_policy_boundaries(spark):
    rows = [(0.3499, "ALLOW"), (0.35, "REVIEW"), (0.7999, "REVIEW"), (0.80, "BLOCK"), (float("nan"), "ERROR"), (None, "ERROR"), (-0.1, "ERROR"), (1.1, "ERROR"), (0.0, "ALLOW"), (1.0, "BLOCK")]
    df = spark.createDataFrame(rows, "score double, want string")
    assert all(r.verdict == r.want for r in P.apply_policy(df).collect())
    with pytest.raises(ValueError):
        P.thresholds("none")
    for old, new in (("safety-first-v1", "low-threshold-v1"), ("balanced-v1", "medium-threshold-v1"), ("high-precision-v1", "high-threshold-v1")):
        assert P.thresholds(old) == P.thresholds(new)


def test_quantile_rules(spark):
    df = spark.range(1, 200).select(F.col("id").cast("double").alias("v"))
    r = M.timing_metrics(df, "v", []).collect()[0]
    assert (r.n, r.p50, r.p95_floor, r.p95_ceil, r["min"], r["max"]) == (199, 100.0, 189.0, 190.0, 1.0, 199.0)
    one = M.timing_metrics(df.limit(1), "v", []).collect()[0]
    assert one.p95_floor == one.p95_ceil == one.p50
    assert not M.timing_metrics(df, "v", [], capacity=10).collect()[0].quantiles_exact


def test_numbering_is_global_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(5)
    rows = O.numbered(df, F.col("k"), name="i", totals={"s": F.col("k")}).collect()
    assert all(r.i == r.k + 1 and r.s == r.k * (r.k + 1) // 2 for r in rows) and len(rows) == 1000


@pytest.mark.parametrize(("n", "capacity"), [(0, 8), (1, 8), (8, 8), (9, 8), (100, 8), (17, 16)])
def test_decimation(spark, n, capacity):
    got = sorted(r.position for r in O.decimated(spark.range(n), capacity, F.col("id")).collect())
    kept, stride = [], 1
    for k in range(n):
        if k % stride == 0:
            kept.append(k)
            if len(kept) > capacity:
                kept, stride = kept[::2], 2 * stride
    assert got == kept


def test_discovery(spark):
    paths = ["b/x.PNG", "a/y.jpeg", "A/z.webp", "reports/r.png", "a/Reports/q.png", "a/n.txt", "a/.png", "c.jpg"]
    df = spark.createDataFrame([(p,) for p in paths], "relative_path string")
    assert [(r["index"], r.relative_path) for r in scan.discovered(df).orderBy("index").collect()] == [(1, "a/y.jpeg"), (2, "A/z.webp"), (3, "b/x.PNG"), (4, "c.jpg")]


def test_scan_keeps_every_row(spark):
    df = spark.createDataFrame([(0.9, 10, False), (0.9, 10_000, False), (0.9, 10, True), (None, 10, False)], "score double, byte_length long, animated boolean")
    got = scan.scanned(df, 4000).select("verdict", "nsfw", "error_code").collect()
    assert [tuple(r) for r in got] == [("BLOCK", 0.9, None), ("ERROR", None, "artifact_too_large"), ("REVIEW", None, None), ("ERROR", None, None)]


def test_link_names(spark):
    df = spark.createDataFrame([(7, 0.83121, "in/Größe  (1).png"), (12, None, "in/???.jpg")], "i int, s double, p string")
    got = [r[0] for r in df.select(scan.link_name(F.col("i"), F.col("s"), F.col("p"))).collect()]
    assert got == ["0000007_0.8312_Groe-1.url", "0000012_no-score_image.url"]


def test_evaluation_counts(spark):
    res = spark.createDataFrame([(1, "a", "BLOCK", 0.9), (2, "a", "BLOCK", 0.9), (3, "b", "ALLOW", 0.1), (4, None, "ERROR", None), (5, "x", "ALLOW", 0.2)], "line long, sha256 string, verdict string, score double")
    lab = spark.createDataFrame([("a", "nsfw", "d1", "test"), ("b", "safe", "d1", "test"), ("c", "safe", "d2", "calibration")], "sha256 string, label string, domain string, split string")
    c = E.coverage(res, lab).collect()[0]
    assert (c.label_count, c.matched_images, c.unmatched_labels, c.duplicate_result_records, c.unlabelled_result_records, c.unlabelled_error_records) == (3, 2, 1, 1, 2, 1)
    s = {r.split: r for r in E.summary(E.first_predictions(E.matched(res, lab))).collect()}
    assert s["test"].nsfw_block_rate == 1.0 and s["test"].safe_block_rate == 0.0 and s["calibration"].nsfw_block_rate is None


def test_routing_forms_agree(spark):
    records = spark.createDataFrame([(i, v) for i, v in enumerate(["ALLOW", "REVIEW", "BLOCK", "ERROR"] * 3)], "doc_id int, verdict string")
    models = spark.createDataFrame(list(EQ.B.MODELS), "model_id string, ordinal int, enabled boolean, `when` array<string>")
    pick = lambda d: sorted((r.doc_id, r.model_id) for r in d.collect())
    assert pick(R.route_theta(records, models)) == pick(R.route_equi(records, models))
    rows = {r.doc_id: r.analyses for r in R.enriched(records, models).collect()}
    assert rows[0] == ["captions", "faces"] and rows[2] == ["faces", "ocr"] and len(rows) == 12


def test_paths_and_digests(spark):
    rows = [("/in/a.png", True), ("/in/../in/a", True), ("/in/../etc", False), ("/inside/a", False), ("in/a", False), ("/in", True), ("/../in/x", True)]
    df = spark.createDataFrame(rows, "p string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", V.inside_root(F.col("p"), ["/in"])).collect())
    h = hashlib.sha256(b"x").hexdigest()
    df = spark.createDataFrame([(None, "unclaimed"), (h.upper(), "bound"), (h + "\n", "malformed"), ("0" * 64, "mismatch")], "c string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", V.digest_binding(F.col("c"), F.lit(h))).collect())


def test_urls(spark):
    df = spark.createDataFrame([("https://u:p@H.org:8443/x?q", "https://h.org:8443", False), ("http://127.0.0.1/x", "http://127.0.0.1", True), ("http://localhost:1", "http://localhost:1", True), ("ftp://x", None, False)], "u string, o string, l boolean")
    for r in df.withColumns({"go": S.url_origin(F.col("u")), "gl": F.coalesce(S.is_loopback(F.col("u")), F.lit(False))}).collect():
        assert (r.go, r.gl) == (r.o, r.l)


def test_bridge_stream_equals_batch(spark):
    stream = sorted(r.value for r in EQ.bridge_responses(spark, "").collect())
    batch = sorted(r.value for r in bridge.response_lines(EQ._answer(spark, EQ._lines(spark))).collect())
    assert stream == batch and len(batch) == len(EQ.REQUESTS) - 1
    assert not any("/in" in x or "/etc" in x for x in batch)


def test_event_time_extensions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("verdict", F.lit("ALLOW"))
    assert bridge.windowed_verdicts(e).agg(F.sum("n")).first()[0] == e.count()


def png(width, height):
    body = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body))


def test_image_folder(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(png(640, 360))
    (tmp_path / "a" / "big.JPG").write_bytes(b"\xff\xd8\xff" + b"0" * 5000)
    (tmp_path / "a" / "n.txt").write_bytes(b"no")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "h.webp").write_bytes(b"RIFF....WEBP")
    root = f"file://{tmp_path}"
    assert images.list_images(spark, root).count() == 2 and images.walk_images(spark, str(tmp_path)).count() == 3
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.read_images(spark, root, 4000).withColumn("h", images.header(F.col("content"))).collect()}
    assert rows["big.JPG"].code == "artifact_too_large" and rows["big.JPG"].content is None
    assert rows["x.png"].sha256 == hashlib.sha256(png(640, 360)).hexdigest()
    assert tuple(rows["x.png"].h)[:3] == ("PNG", 640, 360)
    pinned = images.verify_artifact(spark, f"{root}/a/x.png", hashlib.sha256(png(640, 360)).hexdigest().upper())
    assert pinned.collect()[0].ok


def test_headers(spark):
    rows = {r.name: r for r in EQ.decode_header(spark, "").collect()}
    assert [(rows[k].format, rows[k].width, rows[k].height, rows[k].animated) for k in ("png", "jpeg", "webp", "text")] == [("PNG", 640, 360, False), ("JPEG", 640, 360, False), ("WEBP", 640, 360, True), (None, None, None, False)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": true}\nnope\n')
    lines = jsonl.read_lines(spark, f"file://{tmp_path}/l.jsonl")
    assert [r.text for r in lines.orderBy("line").collect()] == ['{"a": 1}', "", "[1]", '{"a": true}', "nope"]
    assert tuple(jsonl.first_bad_line(lines.where("text <> ''")).collect()[0]) == (3, "not_an_object")
    kinds = {r.line: r.k for r in lines.select("line", jsonl.field_kind(F.col("text"), "a").alias("k")).collect()}
    assert kinds[1] == "number" and kinds[4] == "boolean"


def test_configurations(spark):
    assert config.load_models(spark, EQ.TOML).count() == 3
    for bad in ("schema_version = 2", 'schema_version = 1\n[privacy]\nmode = "x"', "schema_version = 1\n[privacy]\nmax_upload_mib = 0", "schema_version = 1\n[privacy]\nmax_upload_mib = true"):
        with pytest.raises(ValueError):
            config.model_rows(bad)


def test_scorers_and_adapters(spark):
    class Broken:
        def predict(self, payloads):
            raise RuntimeError("x")

    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    good = {r.k: r.score for r in U.score_with(df, U.DigestScorer, "t", "k").collect()}
    assert good[1] == int(hashlib.sha256(b"a").hexdigest()[:4], 16) / 65535.0
    assert all(r.score is None and r.error.startswith("inference_failed") for r in U.score_with(df, Broken, "t", "k").collect())
    with pytest.raises(RuntimeError):
        U.OnnxScorer(b"", provider="NoSuchProvider")
    codes = {r.request_id: r.code for r in EQ.adapter_validate(spark, "").collect()}
    assert codes == {"r1": None, "r2": "wrong_request_id", "r3": "wrong_protocol", "r4": "not_an_object", "r5": "unsupported_version", "r6": "invalid_json", "r7": "no_boolean_ok"}
    assert json.loads(U.MockAdapter().call("q", "x"))["request_id"] == "q"


def test_consecutive_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, "a")], "i int, k string")
    assert sorted(r.i for r in O.last_of_consecutive(df, "k", F.col("i")).collect()) == [2, 3, 5]
