import hashlib
import io

import pytest

from siftworks.llm import warc as W

BIG, BIGGER = "é" * 500, "y" * 1001
PAGES = [(1, "http://a/1", BIG), (5, "http://a/5", BIG), (3, None, BIG), (2, "u\r\nX: y", "x" * 999), (4, "u", "x" * 999), (6, "u", None), (7, "u", ""), (9, "u", BIGGER), (9, "u", BIGGER), (8, "u", BIGGER), (None, "u", BIGGER), (None, "v", "z" * 2000), (None, "v", "z" * 2000), (10, "u", "WARC/1.1\r\n\r\n" * 200)]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, compression):
    got = [tuple(r) for r in W.round_trip(frame(spark), compression).collect()]
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        stored = max((j for j, _, h in PAGES if h == html and j is not None), default=None)
        revisit = len(data) >= 1000 and stored is not None and i != stored
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", stored if revisit else None))
    key = lambda r: (r[0] or 0, r[1:4], r[4] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_filters_are_pushed_and_payloads_come_back(spark, tmp_path):
    W.register(spark)
    path = f"file://{tmp_path}/a"
    W.page_records(frame(spark)).write.format("warc").mode("append").option("roll_bytes", 3000).save(path)
    back = spark.read.format("warc").load(path)
    kept = back.where("record_type = 'response' and content_length > 500")
    plan = kept._jdf.queryExecution().toString()
    assert "EqualTo" in plan or "record_type" in plan
    rows = kept.collect()
    assert rows and all(bytes(r.payload) and "sha1:" + hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest for r in rows)
    assert back.where("record_id in ('<urn:x-page:1>')").select("refers_to").collect()[0][0] == "<urn:x-page:5>"
    narrow = spark.read.format("warc").schema("record_type string, target_uri string").load(path)
    assert narrow.count() == len(PAGES) and narrow.where("target_uri is null").count() == 1


def test_unwanted_blocks_are_not_read():
    class Once(io.BytesIO):
        most = 0

        def read(self, n=-1):
            self.most = max(self.most, n)
            return super().read(n)

    records = b"".join(W.record_bytes({"record_id": f"<r{k}>", "record_type": "response", "payload": b"p" * 5000}) for k in range(4))
    stream = Once(records)
    assert [r["record_id"] for r in W.records(stream, lambda r: r["record_id"] == "<r2>", False)] == ["<r2>"] and stream.most == 0
    with pytest.raises(ValueError):
        list(W.records(io.BytesIO(records[:-3000]), lambda r: True, True))
    with pytest.raises(ValueError):
        list(W.records(io.BytesIO(b"HTTP/1.1 200\r\n"), lambda r: True, True))


def test_files_of_failed_attempts_are_not_read(spark, tmp_path):
    W.register(spark)
    path = f"file://{tmp_path}/b"
    W.page_records(frame(spark)).write.format("warc").mode("append").save(path)
    (tmp_path / "b" / "part-stray.warc").write_bytes(W.record_bytes({"record_id": "<stray>", "record_type": "resource", "payload": b"x"}))
    assert spark.read.format("warc").load(path).count() == len(PAGES)
    W.page_records(frame(spark)).write.format("warc").mode("append").save(path)
    assert spark.read.format("warc").load(path).count() == 2 * len(PAGES)


def test_empty_table(spark):
    assert W.round_trip(frame(spark, [])).collect() == []
