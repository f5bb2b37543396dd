"""Adapters against a real child process and a loopback server."""

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from siftworks.operators import udf as U
from siftworks.operators.adapters import AdapterError, CommandAdapter, HttpAdapter

CHILD = """
import json, sys, time
for line in sys.stdin:
    m = json.loads(line)
    out = {k: m[k] for k in ("protocol", "version", "request_id")} | {"type": "hello" if m["type"] == "hello" else "result", "ok": True}
    if m["type"] == "hello":
        out["tasks"] = ["caption"]
    elif m["payload"] == "slow":
        time.sleep(30)
    elif m["payload"] == "big":
        out["outputs"] = "x" * 400000
    else:
        out["outputs"] = {"n": len(m["payload"])}
    print(json.dumps(out), flush=True)
"""


@pytest.fixture
def command(tmp_path):
    path = tmp_path / "child.py"
    path.write_text(CHILD)
    return [sys.executable, str(path)]


def test_rows_through_a_child_process(spark, command):
    df = spark.createDataFrame([(k, "x" * k) for k in range(1, 6)] + [(6, "slow"), (7, "abc")], "k int, t string").coalesce(1)
    rows = {r.k: r for r in U.call_adapter(df, lambda: CommandAdapter(command, ["caption"], timeout=3), "k", "t").collect()}
    assert json.loads(rows[5].outputs) == {"n": 5} and rows[1].ok
    assert not rows[6].ok and not rows[7].ok and rows[7].code == "AdapterError"


def test_limits_and_handshake(command):
    with pytest.raises(AdapterError, match="missing_tasks"):
        CommandAdapter(command, ["ocr"])
    a = CommandAdapter(command, ["caption"], most=10_000)
    with pytest.raises(AdapterError, match="response_too_large"):
        a.call("r", "big")
    with pytest.raises(AdapterError, match="not_running"):
        a.call("r", "x")
    with pytest.raises(AdapterError):
        HttpAdapter("ftp://x", [])


def test_http():
    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            m = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            out = {k: m[k] for k in ("protocol", "version", "request_id")} | {"ok": True, "tasks": ["ocr"], "type": "hello" if m["type"] == "hello" else "result"}
            data = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    a = HttpAdapter(f"http://127.0.0.1:{server.server_port}/x", ["ocr"])
    assert U.response_code(a.call("r1", "p"), "r1") is None and U.response_code(a.call("r2", "p"), "r1") == "wrong_request_id"
    a.close()
    server.shutdown()
