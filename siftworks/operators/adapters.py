"""Adapters that talk to a model outside: a child process over lines, or a service over HTTP.

One is made a task and lives as long. After a timeout a child is killed and later rows of the task fail;
nothing is repeated by the adapter itself.
"""

from __future__ import annotations

import http.client
import json
import queue
import subprocess
import threading
from collections.abc import Callable
from urllib.parse import urlsplit

from .udf import PROTOCOL, PROTOCOL_VERSION, response_code


class AdapterError(RuntimeError):
    pass


def envelope(protocol: str, kind: str, request_id: str, **more) -> dict:
    return {"protocol": protocol, "version": PROTOCOL_VERSION, "type": kind, "request_id": request_id, **more}


def check_hello(line: str, request_id: str, tasks: list[str], protocol: str) -> None:
    """The handshake's reply must be accepted and declare every configured task."""
    code = response_code(line, request_id, "hello", protocol)
    reply = json.loads(line) if code is None else {}
    declared = reply.get("tasks")
    if code is not None or reply["ok"] is not True or not isinstance(declared, list):
        raise AdapterError(code or "handshake_rejected")
    missing = sorted(set(tasks) - set(declared))
    if missing:
        raise AdapterError(f"missing_tasks: {missing}")


def from_model(model, environment: dict[str, str]) -> Callable[[], CommandAdapter | HttpAdapter]:
    """How to make the adapter of a model of the configuration. Its secret is read here, on the driver."""
    token = environment.get(model.auth_env) if model.auth_env else None
    if model.auth_env and not token:
        raise AdapterError("missing_secret")
    most = (model.max_response_kib or 256) << 10
    if model.adapter == "command":
        if not model.command or not model.trusted:
            raise AdapterError("untrusted_command")
        return lambda: CommandAdapter(list(model.command), list(model.tasks), model.timeout_seconds, most)
    return lambda: HttpAdapter(model.url, list(model.tasks), model.timeout_seconds, most, token)


class CommandAdapter:
    """A child process that answers one JSON line with one JSON line."""

    def __init__(self, command: list[str], tasks: list[str], timeout: float = 30.0, most: int = 256 << 10, protocol: str = PROTOCOL) -> None:
        self.tasks, self.timeout, self.most, self.protocol = tasks, timeout, most, protocol
        self.child = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        self.lines: queue.Queue = queue.Queue()
        threading.Thread(target=self._read, daemon=True).start()
        check_hello(self._ask(envelope(protocol, "hello", "hello", tasks=tasks)), "hello", tasks, protocol)

    def _read(self) -> None:
        while line := self.child.stdout.readline(self.most + 1):
            self.lines.put(line)
        self.lines.put(None)

    def _ask(self, message: dict) -> str:
        if self.child.poll() is not None:
            raise AdapterError("not_running")
        self.child.stdin.write(json.dumps(message).encode() + b"\n")
        self.child.stdin.flush()
        try:
            line = self.lines.get(timeout=self.timeout)
        except queue.Empty:
            self.close()
            raise AdapterError("timeout") from None
        if line is None or len(line) > self.most:
            self.close()
            raise AdapterError("no_response" if line is None else "response_too_large")
        return line.decode("utf-8", "replace")

    def call(self, request_id: str, payload: str) -> str:
        return self._ask(envelope(self.protocol, "analyze", request_id, tasks=self.tasks, payload=payload))

    def close(self) -> None:
        self.child.kill()
        self.child.wait()


class HttpAdapter:
    """A service that takes the same messages by POST, over one kept connection."""

    def __init__(self, url: str, tasks: list[str], timeout: float = 30.0, most: int = 256 << 10, token: str | None = None, protocol: str = PROTOCOL) -> None:
        parts = urlsplit(url)
        kind = {"http": http.client.HTTPConnection, "https": http.client.HTTPSConnection}.get(parts.scheme)
        if kind is None or not parts.hostname:
            raise AdapterError("bad_url")
        self.connection = kind(parts.hostname, parts.port, timeout=timeout)
        self.path, self.tasks, self.most, self.token, self.protocol = parts.path or "/", tasks, most, token, protocol
        check_hello(self._ask(envelope(protocol, "hello", "hello", tasks=tasks)), "hello", tasks, protocol)

    def _ask(self, message: dict) -> str:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        self.connection.request("POST", self.path, json.dumps(message), headers)
        reply = self.connection.getresponse()
        data = reply.read(self.most + 1)
        if reply.status != 200:
            raise AdapterError(f"status_{reply.status}")
        if len(data) > self.most:
            self.connection.close()
            raise AdapterError("response_too_large")
        return data.decode("utf-8", "replace")

    def call(self, request_id: str, payload: str) -> str:
        return self._ask(envelope(self.protocol, "analyze", request_id, tasks=self.tasks, payload=payload))

    def close(self) -> None:
        self.connection.close()
