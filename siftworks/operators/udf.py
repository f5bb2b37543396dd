"""Pluggable models: scorers and adapters behind Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Protocol of adapters: the name is a parameter everywhere, the version is fixed.
PROTOCOL, PROTOCOL_VERSION = "vision-adapter", 1


class Scorer(Protocol):
    """A model: texts or bytes in, unsafe scores in [0, 1] out, a batch at a time."""

    def predict(self, payloads: list) -> np.ndarray: ...


class DigestScorer:
    """The deterministic stand-in: four hex digits of the SHA-256. It classifies nothing."""

    def predict(self, payloads: list) -> np.ndarray:
        import hashlib

        as_bytes = (p.encode() if isinstance(p, str) else bytes(p) for p in payloads)
        return np.array([int(hashlib.sha256(b).hexdigest()[:4], 16) / 65535.0 for b in as_bytes])


class OnnxScorer:
    """An ONNX classifier with two logits, the first unsafe. A provider that is not there is an error, never replaced."""

    def __init__(self, model: bytes, provider: str = "CPUExecutionProvider", threads: int = 1) -> None:
        import onnxruntime as ort

        if provider not in ort.get_available_providers():
            raise RuntimeError(f"execution provider {provider} is not available")
        options = ort.SessionOptions()
        options.intra_op_num_threads = threads
        self.session = ort.InferenceSession(model, options, providers=[provider])
        self.name = self.session.get_inputs()[0].name

    def predict(self, payloads: list) -> np.ndarray:
        x = np.stack([np.asarray(p, dtype=np.float32) for p in payloads])
        logits = self.session.run(None, {self.name: x})[0].astype(np.float64)
        if logits.shape != (len(payloads), 2) or not np.isfinite(logits).all():
            raise RuntimeError("the model's output is not two finite logits a row")
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e[:, 0] / e.sum(axis=1)


def score_with(df: DataFrame, make: Callable[[], Scorer], payload: str, key: str) -> DataFrame:
    """(key, score, error) of each row; the model is made once a task. A failing batch gives error rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            try:
                model = model or make()
                scores, error = model.predict(b[payload].tolist()), None
            except Exception as e:  # noqa: BLE001
                scores, error = [None] * len(b), f"inference_failed: {type(e).__name__}"
            yield pd.DataFrame({key: b[key], "score": scores, "error": error})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, payload).mapInPandas(run, f"{key} {kind}, score double, error string")


def response_code(response: str, request_id: str, kind: str = "result", protocol: str = PROTOCOL) -> str | None:
    """The first failed check of an adapter's response line, in protocol order; None if all hold."""

    def refuse(_: str) -> None:
        raise ValueError("not finite")

    try:
        r = json.loads(response, parse_constant=refuse)
    except ValueError:
        return "invalid_json"
    if not isinstance(r, dict):
        return "not_an_object"
    for ok, code in (
        (r.get("protocol") == protocol, "wrong_protocol"),
        (r.get("version") == PROTOCOL_VERSION, "unsupported_version"),
        (r.get("type") == kind, "wrong_type"),
        (r.get("request_id") == request_id, "wrong_request_id"),
        (isinstance(r.get("ok"), bool), "no_boolean_ok"),
    ):
        if not ok:
            return code
    return None


class MockAdapter:
    """A deterministic adapter: answers with the length and digest prefix of what it gets."""

    def __init__(self, protocol: str = PROTOCOL) -> None:
        self.protocol = protocol

    def call(self, request_id: str, payload: str) -> str:
        import hashlib

        out = {"length": len(payload), "prefix": hashlib.sha256(payload.encode()).hexdigest()[:8]}
        return json.dumps({"protocol": self.protocol, "version": PROTOCOL_VERSION, "type": "result", "request_id": request_id, "ok": True, "outputs": out}, sort_keys=True)


class Adapter(Protocol):
    protocol: str

    def call(self, request_id: str, payload: str) -> str: ...


def call_adapter(df: DataFrame, make: Callable[[], Adapter], key: str, payload: str) -> DataFrame:
    """(key, ok, code, outputs) for each row. The adapter lives for a task; a row that fails is an error row.

    A task that Spark repeats calls again; for calls at most once set spark.task.maxFailures to 1.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter = make()
        try:
            for b in batches:
                out = []
                for k, p in zip(b[key], b[payload], strict=True):
                    try:
                        line = adapter.call(str(k), p)
                        code = response_code(line, str(k), protocol=adapter.protocol)
                        outputs = None if code else json.dumps(json.loads(line).get("outputs"), sort_keys=True)
                    except Exception as e:  # noqa: BLE001
                        code, outputs = type(e).__name__, None
                    out.append((k, code is None, code, outputs))
                yield pd.DataFrame(out, columns=[key, "ok", "code", "outputs"])
        finally:  # also when the task fails or its reader stops early
            close = getattr(adapter, "close", None)
            if close:
                close()

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, payload).mapInPandas(run, f"{key} {kind}, ok boolean, code string, outputs string")


def validated(df: DataFrame) -> DataFrame:
    """Recorded responses (request_id, response) with the code of their first failed check."""
    code = F.pandas_udf(lambda r, i: pd.Series([response_code(x, y) for x, y in zip(r, i, strict=True)], dtype=object), "string")
    return df.withColumn("code", code("response", "request_id"))
