"""How the concepts of a scan are bound to the driver tables, and the same as SQL.

No table holds images or model scores: a document's text stands for the encoded bytes, four hex digits of
its digest for the score, four more for that of the second background.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import policy as P
from ..operators import scan

MAX_BYTES = 4000
EXTENSIONS = ("jpg", "JPEG", "png", "webp", "txt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select(
        "doc_id", "lang", "source", "text",
        F.col("doc_id").alias("line"),
        S.digest(F.col("text")).alias("sha256"),
        F.octet_length("text").cast("long").alias("byte_length"),
        (F.col("doc_id") % 37 == 0).alias("animated"),
        F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("relative_path"),
    ).withColumns({"score": S.hex_fraction(F.col("sha256")), "score2": S.hex_fraction(F.col("sha256"), 5)})


ART = """art as (
  select doc_id, doc_id as line, lang, source, text, sha256(text) as sha256, octet_length(encode(text))::bigint as byte_length,
    doc_id % 37 = 0 as animated,
    source || '/' || lang || '_' || doc_id || '.' || (['jpg','JPEG','png','webp','txt'])[(doc_id % 5 + 1)::int] as relative_path,
    ('0x' || substr(sha256(text), 1, 4))::int / 65535.0::double as score,
    ('0x' || substr(sha256(text), 5, 4))::int / 65535.0::double as score2
  from documents)"""


def verdict_sql(score: str, review: str = "0.35::double", block: str = "0.8::double") -> str:
    return f"case when {score} is null or isnan({score}) or {score} < 0 or {score} > 1 then 'ERROR' when {score} >= {block} then 'BLOCK' when {score} >= {review} then 'REVIEW' else 'ALLOW' end"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a run that keeps the digest of its errors: line, sha256, verdict, score (null for errors)."""
    a = artifacts(spark, sf_dir)
    big = F.col("byte_length") > MAX_BYTES
    return a.select(
        "line", "sha256",
        F.when(big, "ERROR").otherwise(P.verdict(F.col("score"), F.lit(0.35), F.lit(0.8))).alias("verdict"),
        F.when(~big, F.col("score")).alias("score"),
    )


RES = f"""{ART},
res as (select line, sha256, case when byte_length > {MAX_BYTES} then 'ERROR' else {verdict_sql("score")} end as verdict,
  case when byte_length <= {MAX_BYTES} then score end as score from art)"""


def human_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest lines: line, sha256, label, domain, split, label_source."""
    joined = artifacts(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select(
        "line", "sha256",
        F.when(F.col("toxic") == 1, "nsfw").otherwise("safe").alias("label"),
        F.col("lang").alias("domain"),
        F.when(F.col("doc_id") % 5 == 0, "calibration").otherwise("test").alias("split"),
        F.lit("human").alias("label_source"),
    )


MAN = """man as (select line, sha256, case when toxic = 1 then 'nsfw' else 'safe' end as label, lang as domain,
  case when doc_id % 5 = 0 then 'calibration' else 'test' end as split, 'human' as label_source from art join labels using (doc_id))"""
LAB = f"""{MAN},
lab as (select sha256, label, domain, split from (select *, row_number() over (partition by sha256 order by line) k from man) where k = 1)"""
FIRSTS = f"""{RES}, {LAB},
joined as (select res.*, label, domain, split from res join lab using (sha256)),
firsts as (select * from (select *, row_number() over (partition by sha256 order by line) k from joined) where k = 1)"""


def labels_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.one_label_per_digest(human_labels(spark, sf_dir))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.matched(results(spark, sf_dir), labels_once(spark, sf_dir))


def firsts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.first_predictions(joined(spark, sf_dir))


#: model_id, ordinal, enabled, routes: a configuration for the routing queries.
MODELS = (
    ("captions", 1, True, ["ALLOW", "REVIEW"]),
    ("faces", 2, True, ["ALL"]),
    ("objects", 3, False, ["ALL"]),
    ("ocr", 4, True, ["BLOCK"]),
)
MOD = """models(model_id, ordinal, enabled, routes) as (values ('captions', 1, true, ['ALLOW','REVIEW']), ('faces', 2, true, ['ALL']),
  ('objects', 3, false, ['ALL']), ('ocr', 4, true, ['BLOCK']))"""


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODELS), "model_id string, ordinal int, enabled boolean, `when` array<string>")


def scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scanned(artifacts(spark, sf_dir), MAX_BYTES)


SCAN = f"""{ART},
scn as (select *, case when byte_length > {MAX_BYTES} then 'ERROR' when animated then 'REVIEW' else {verdict_sql("score")} end as verdict,
  case when byte_length > {MAX_BYTES} then 'artifact_too_large' end as error_code,
  case when byte_length <= {MAX_BYTES} and not animated then score end as nsfw from art)"""
