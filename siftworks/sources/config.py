"""Model configurations in TOML: read on the driver, typed, and handed on as a small table."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

SCHEMA = (
    "ordinal int, id string, adapter string, enabled boolean, trusted boolean, url string, tasks array<string>, `when` array<string>, "
    "timeout_seconds double, auth_env string, mode string, acknowledged boolean, command array<string>, max_response_kib int"
)
#: Bounds of the privacy numbers, least, most, default.
BOUNDS = {"remote_max_edge": (128, 8192, 1280), "remote_jpeg_quality": (40, 95, 85), "max_upload_mib": (1, 128, 8), "max_response_kib": (1, 16384, 256)}


def privacy_of(config: dict) -> dict:
    """The privacy table with defaults; a number outside its bounds or of another type is refused."""
    own = config.get("privacy", {})
    out = {"mode": own.get("mode", "local-only"), "acknowledged": own.get("acknowledge_remote_image_disclosure", False)}
    if out["mode"] not in ("local-only", "remote-tls"):
        raise ValueError("privacy.mode must be local-only or remote-tls")
    for name, (least, most, default) in BOUNDS.items():
        value = own.get(name, default)
        if type(value) is not int or not least <= value <= most:
            raise ValueError(f"privacy.{name} must be a whole number from {least} to {most}")
        out[name] = value
    return out


def model_rows(text: str) -> list[tuple]:
    config = tomllib.loads(text)
    if config.get("schema_version") != 1:
        raise ValueError("schema_version must be 1")
    privacy = privacy_of(config)
    rows = []
    for k, m in enumerate(config.get("models", []), 1):
        rows.append(
            (k, m["id"], m["adapter"], m.get("enabled", True), m.get("trusted", False), m.get("url"), m.get("tasks", []),
             [w.upper() for w in m.get("when", [])], float(m.get("timeout_seconds", 30.0)), m.get("auth_env"), privacy["mode"], privacy["acknowledged"],
             m.get("command"), privacy["max_response_kib"])
        )
    return rows


def load_models(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(model_rows(text), SCHEMA)


def evidence(models: DataFrame) -> DataFrame:
    """What may be reported of a configuration: origins instead of urls, and whether a secret is set, not which."""
    return models.select(
        "ordinal", "id", "adapter", "enabled", S.url_origin(F.col("url")).alias("url_origin"),
        F.col("auth_env").isNotNull().alias("auth_from_environment"), F.array_sort(F.array_distinct("when")).alias("when"), "timeout_seconds",
    )
