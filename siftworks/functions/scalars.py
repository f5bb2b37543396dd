"""Scalar expressions: digests, names, paths, urls, rounding. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a slug keeps, its length, and its stand-in.
SLUG_KEEPS, SLUG_LENGTH, SLUG_DEFAULT = "A-Za-z0-9._-", 80, "image"
SHA256 = "^[0-9a-f]{64}\\z"
DOMAIN = "^[A-Za-z0-9_-]{1,64}\\z"
SAFE_NAME = "^[A-Za-z0-9_.:-]{1,64}\\z"


def digest(content: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(content.cast("binary"), 256)


def hex_fraction(hex_digest: Column, start: int = 1) -> Column:
    """Four hex digits as a number in [0, 1]: the deterministic stand-in for a model's score."""
    return F.conv(F.substring(hex_digest, start, 4), 16, 10).cast("int") / F.lit(65535.0)


def suffix(path: Column) -> Column:
    """Lower-case suffix of the last path part with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.instr(name, ".") > 1, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def slug(value: Column) -> Column:
    """Runs of other characters become one dash, ends are trimmed; accents go by a table of Latin letters."""
    plain = F.translate(value, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")
    ascii_only = F.regexp_replace(plain, "[^\\x00-\\x7F]", "")
    dashed = F.regexp_replace(ascii_only, f"[^{SLUG_KEEPS}]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^[-._]+|[-._]+$", ""), 1, SLUG_LENGTH)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(SLUG_DEFAULT))


def escape_html(value: Column) -> Column:
    out = value
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def url_origin(url: Column) -> Column:
    """scheme://host[:port] without credentials, path or query; null if it is no http(s) url."""
    scheme = F.lower(F.regexp_extract(url, r"^(?i)(https?)://", 1))
    host = F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    port = F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?[^/:?#]+(:[0-9]+)", 1)
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, port))


def is_loopback(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1))
    return host.isin("localhost", "[::1]") | host.rlike(r"^127(\.[0-9]{1,3}){3}$")


def clean_error(message: Column, root: Column, class_name: Column) -> Column:
    """A message without the root path, at most 500 characters, else the class name."""
    return F.coalesce(F.nullif(F.substring(F.replace(message, root, F.lit("<root>")), 1, 500), F.lit("")), class_name)


def stable_softmax(first: Column, second: Column) -> Column:
    """Probability of the first of two logits, shifted by the larger one."""
    top = F.greatest(first, second)
    a, b = F.exp(first - top), F.exp(second - top)
    return a / (a + b)


def base64_line(text: Column) -> Column:
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "[\\r\\n]", "")
