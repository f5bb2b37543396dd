"""Ordered checks: every row gets the code of its first failed check, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import policy as P


def first_failed(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that is not true; a check that is null counts as failed."""
    out = F.lit(None).cast("string")
    for ok, code in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)).otherwise(out)
    return out


def priority(code: Column, codes: list[str]) -> Column:
    out = F.lit(None).cast("int")
    for k, c in enumerate(codes):
        out = F.when(code == c, F.lit(k)).otherwise(out)
    return out


LABEL_CODES = ["bad_digest", "label_source", "bad_label", "bad_split", "bad_domain"]


def label_violation() -> Column:
    c = F.col
    return first_failed(
        (F.lower(c("sha256")).rlike(S.SHA256), "bad_digest"),
        (c("label_source") == "human", "label_source"),
        (c("label").isin("safe", "nsfw"), "bad_label"),
        (c("split").isin("calibration", "test"), "bad_split"),
        (c("domain").rlike(S.DOMAIN), "bad_domain"),
    )


RESULT_CODES = ["bad_digest", "bad_verdict", "bad_score", "score_range", "bad_model", "bad_model_digest", "bad_policy", "verdict_mismatch"]


def result_violation() -> Column:
    """For rows of sha256, verdict, score (double), score_kind, model_id, model_sha256, review, block."""
    c = F.col
    error = c("verdict") == "ERROR"
    derived = P.verdict(c("score"), c("review"), c("block"))
    return first_failed(
        (F.lower(c("sha256")).rlike(S.SHA256), "bad_digest"),
        (c("verdict").isin("ALLOW", "REVIEW", "BLOCK", "ERROR"), "bad_verdict"),
        (error | (c("score_kind") == "number"), "bad_score"),
        (error | P.valid_score(c("score")), "score_range"),
        (F.length("model_id") > 0, "bad_model"),
        (c("model_sha256").rlike(S.SHA256), "bad_model_digest"),
        (P.valid_policy(c("review"), c("block")), "bad_policy"),
        (error | (derived == c("verdict")), "verdict_mismatch"),
    )


def digest_binding(claimed: Column, actual: Column) -> Column:
    """unclaimed, malformed, mismatch or bound; case does not matter."""
    low = F.lower(claimed)
    return F.when(claimed.isNull(), "unclaimed").when(~low.rlike(S.SHA256), "malformed").when(low != actual, "mismatch").otherwise("bound")


def byte_gate(length: Column, most: int) -> Column:
    return F.when(length > most, "artifact_too_large")


def pixel_gate(width: Column, height: Column, most: int) -> Column:
    bad = (width <= 0) | (height <= 0) | (width.cast("long") * height.cast("long") > most)
    return F.when(bad, "artifact_too_large")


def format_gate(media_format: Column, allowed: tuple[str, ...] = ("JPEG", "PNG", "WEBP")) -> Column:
    return F.when(~F.coalesce(F.upper(media_format).isin(*allowed), F.lit(False)), "unsupported_media")


def inside_root(path: Column, roots: list[str]) -> Column:
    """Whether a path, with . and .. folded, is one of the roots or below one. An array fold, no UDF."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)),
    )
    full = F.concat(F.lit("/"), F.array_join(folded, "/"))
    out = F.lit(False)
    for root in roots:
        out = out | (full == root) | full.startswith(root.rstrip("/") + "/")
    return path.startswith("/") & out


CONFIG_CODES = ["bad_id", "bad_adapter", "bad_timeout", "untrusted_command", "bad_url", "remote_in_local_only", "not_https", "not_acknowledged"]


def config_violation() -> Column:
    """For model rows with id, adapter, enabled, trusted, url, timeout_seconds, mode, acknowledged."""
    c = F.col
    http = c("adapter") == "http-json"
    loop = F.coalesce(S.is_loopback(c("url")), F.lit(False))
    away = http & c("enabled") & ~loop
    return first_failed(
        (c("id").rlike(S.SAFE_NAME), "bad_id"),
        (c("adapter").isin("command", "http-json"), "bad_adapter"),
        ((c("timeout_seconds") >= 0.1) & (c("timeout_seconds") <= 3600.0), "bad_timeout"),
        (~((c("adapter") == "command") & c("enabled") & ~c("trusted")), "untrusted_command"),
        (~http | S.url_origin(c("url")).isNotNull(), "bad_url"),
        (~(away & (c("mode") == "local-only")), "remote_in_local_only"),
        (~away | F.lower("url").startswith("https://"), "not_https"),
        (~away | c("acknowledged"), "not_acknowledged"),
    )
