"""Queries: label manifests, evaluation joins, roll-ups, validation and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluate as E
from ..operators import policy as P
from ..operators import validate as V
from . import bindings as B
from .registry import query


@query("labels_load", f"with {B.ART}, {B.LAB} select * from lab")
def labels_load(spark: SparkSession, sf: str) -> DataFrame:
    return B.labels_once(spark, sf)


def _damaged(man: DataFrame) -> DataFrame:
    """Manifest lines with planted faults, by line number."""
    k = F.col("line")
    return man.select(
        "line",
        F.when(k % 11 == 0, F.substring("sha256", 1, 63)).otherwise(F.upper("sha256")).alias("sha256"),
        F.when(k % 13 == 0, "model").otherwise("human").alias("label_source"),
        F.when(k % 17 == 0, "unsure").otherwise(F.col("label")).alias("label"),
        F.when(k % 19 == 0, "train").otherwise(F.col("split")).alias("split"),
        F.when(k % 23 == 0, "a b").otherwise(F.col("domain")).alias("domain"),
    )


DAM = f"""{B.ART}, {B.MAN}, dam as (select line, case when line % 11 = 0 then substr(sha256, 1, 63) else upper(sha256) end sha256,
  case when line % 13 = 0 then 'model' else 'human' end label_source, case when line % 17 = 0 then 'unsure' else label end label_,
  case when line % 19 = 0 then 'train' else split end split_, case when line % 23 = 0 then 'a b' else domain end domain_ from man),
vio as (select line, case when not regexp_full_match(lower(sha256), '[0-9a-f]{{64}}') then 'bad_digest' when label_source <> 'human' then 'label_source'
  when label_ not in ('safe','nsfw') then 'bad_label' when split_ not in ('calibration','test') then 'bad_split'
  when not regexp_full_match(domain_, '[A-Za-z0-9_-]{{1,64}}') then 'bad_domain' end as code from dam)"""


@query("labels_violations", f"with {DAM} select line, code from vio where code is not null")
def labels_violations(spark: SparkSession, sf: str) -> DataFrame:
    return _damaged(B.human_labels(spark, sf)).select("line", V.label_violation().alias("code")).where("code is not null")


@query("first_violation", f"""with {DAM} select line, (case code when 'bad_digest' then 0 when 'label_source' then 1 when 'bad_label' then 2 when 'bad_split' then 3 else 4 end)::int as priority, code
  from vio where code is not null order by line limit 1""")
def first_violation(spark: SparkSession, sf: str) -> DataFrame:
    bad = labels_violations(spark, sf)
    return E.first_violation(bad.withColumn("priority", V.priority(F.col("code"), V.LABEL_CODES)))


@query("duplicate_keys", f"with {B.ART}, {B.MAN} select sha256, count(*) as n from man group by sha256 having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return E.duplicate_keys(B.human_labels(spark, sf), "sha256")


@query("eval_join", f"with {B.FIRSTS} select line, sha256, verdict, score, label, domain, split from joined")
def eval_join(spark: SparkSession, sf: str) -> DataFrame:
    return B.joined(spark, sf).select("line", "sha256", "verdict", "score", "label", "domain", "split")


@query("eval_unmatched_labels", f"with {B.RES}, {B.LAB} select sha256 from lab anti join (select * from res where line % 3 <> 0) r using (sha256)")
def eval_unmatched_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels without a result, in a run that left out every third line."""
    return B.labels_once(spark, sf).join(B.results(spark, sf).where("line % 3 <> 0"), "sha256", "left_anti").select("sha256")


@query("eval_unlabelled", f"with {B.RES}, {B.LAB} select line, verdict from res anti join lab using (sha256)")
def eval_unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    return E.unlabelled(B.results(spark, sf), B.labels_once(spark, sf)).select("line", "verdict")


@query("eval_matched", f"with {B.RES}, {B.LAB} select sha256, label from lab semi join res using (sha256)")
def eval_matched(spark: SparkSession, sf: str) -> DataFrame:
    return B.labels_once(spark, sf).join(B.results(spark, sf), "sha256", "left_semi").select("sha256", "label")


@query("eval_first_prediction", f"with {B.FIRSTS} select sha256, line, verdict, score from firsts")
def eval_first_prediction(spark: SparkSession, sf: str) -> DataFrame:
    return B.firsts(spark, sf).select("sha256", "line", "verdict", "score")


@query("eval_duplicates", f"with {B.FIRSTS} select (count(*) - count(distinct sha256))::bigint as duplicate_result_records from joined")
def eval_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    per = B.joined(spark, sf).groupBy("sha256").agg((F.count(F.lit(1)) - 1).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("duplicate_result_records"))


@query("prediction_conflicts", f"""with {B.FIRSTS}, j2 as (select line, sha256, case when line % 7 = 0 then 'BLOCK' else verdict end verdict, score from joined),
  f as (select *, first_value(verdict) over (partition by sha256 order by line) fv, first_value(line) over (partition by sha256 order by line) fl from j2)
  select sha256, count(*) as n, min(fl) as first_line, min(fv) as first_verdict, count(distinct (verdict, score)) > 1 as conflict from f group by sha256""")
def prediction_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """With every seventh line turned to BLOCK, so that copies disagree."""
    turned = B.joined(spark, sf).withColumn("verdict", F.when(F.col("line") % 7 == 0, "BLOCK").otherwise(F.col("verdict")))
    return E.prediction_conflicts(turned)


@query("identity_conflicts", f"""with {B.RES}, i as (select line, case when line % 10 = 3 then 'model-b' else 'model-a' end || '|' || case when line % 15 = 4 then '0.60' else '0.35' end as identity from res)
  select line, identity from i where identity <> (select arg_min(identity, line) from i)""")
def identity_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("line")
    identity = F.concat(F.when(k % 10 == 3, "model-b").otherwise("model-a"), F.lit("|"), F.when(k % 15 == 4, "0.60").otherwise("0.35"))
    return E.differs_from_first(B.results(spark, sf).select("line", identity.alias("identity")), F.col("identity"))


@query("eval_confusion", f"with {B.FIRSTS} select split, domain, label, verdict, count(*) as n from firsts group by all")
def eval_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(B.firsts(spark, sf))


@query("eval_rollup", f"""with {B.FIRSTS} select split, domain, label, verdict, count(*) as n, grouping(domain)::int as whole_split
  from firsts group by grouping sets ((split, label, verdict), (split, domain, label, verdict))""")
def eval_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return E.rollup(B.firsts(spark, sf)).select("split", "domain", "label", "verdict", "n", "whole_split")


_COUNTS = ", ".join(f"count(*) filter (label = '{a}' and verdict = '{v}') as {a}_{v.lower()}" for a in E.LABELS for v in E.VERDICTS)


@query("eval_summary", f"""with {B.FIRSTS}, c as (select s.split, {_COUNTS} from (values ('calibration'), ('test')) s(split) left join firsts f on f.split = s.split group by s.split),
  t as (select *, safe_allow + safe_review + safe_block as safe_scored, nsfw_allow + nsfw_review + nsfw_block as nsfw_scored from c)
  select *, round((safe_review + safe_block)::double / nullif(safe_scored, 0)::double, 6) as safe_attention_rate, round(safe_block::double / nullif(safe_scored, 0)::double, 6) as safe_block_rate,
    round(nsfw_allow::double / nullif(nsfw_scored, 0)::double, 6) as nsfw_false_allow_rate, round((nsfw_review + nsfw_block)::double / nullif(nsfw_scored, 0)::double, 6) as nsfw_attention_rate,
    round(nsfw_block::double / nullif(nsfw_scored, 0)::double, 6) as nsfw_block_rate, safe_error + nsfw_error as error_count from t""")
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.summary(B.firsts(spark, sf))


@query("eval_coverage", f"""with {B.RES}, {B.LAB}, m as (select l.sha256, count(r.line) k from lab l left join res r using (sha256) group by l.sha256),
  u as (select r.*, l.label from res r left join lab l using (sha256))
  select (select count(*) from lab) as label_count, (select count(*) from m where k > 0) as matched_images, (select count(*) from m where k = 0) as unmatched_labels,
    (select coalesce(sum(k - 1) filter (k > 0), 0)::bigint from m) as duplicate_result_records, (select sum(k)::bigint from m) as matched_result_records,
    (select count(*) from u) as result_records, (select count(*) from u where label is null) as unlabelled_result_records,
    (select count(*) from u where label is null and verdict = 'ERROR') as unlabelled_error_records""")
def eval_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return E.coverage(B.results(spark, sf), B.labels_once(spark, sf))


@query("eval_coverage_native", f"""with {B.RES}, {B.LAB}, r2 as (select line, case when verdict <> 'ERROR' then sha256 end sha256, verdict from res),
  m as (select l.sha256, count(r.line) k from lab l left join r2 r using (sha256) group by l.sha256), u as (select r.*, l.label from r2 r left join lab l using (sha256))
  select (select count(*) from lab) as label_count, (select count(*) from m where k > 0) as matched_images, (select count(*) from m where k = 0) as unmatched_labels,
    (select coalesce(sum(k - 1) filter (k > 0), 0)::bigint from m) as duplicate_result_records, (select sum(k)::bigint from m) as matched_result_records,
    (select count(*) from u) as result_records, (select count(*) from u where label is null) as unlabelled_result_records,
    (select count(*) from u where label is null and verdict = 'ERROR') as unlabelled_error_records""")
def eval_coverage_native(spark: SparkSession, sf: str) -> DataFrame:
    """As a run writes them: error rows carry no digest."""
    native = B.results(spark, sf).withColumn("sha256", F.when(F.col("verdict") != "ERROR", F.col("sha256")))
    return E.coverage(native, B.labels_once(spark, sf))


@query("verdict_consistency", f"with {B.RES}, c as (select line, score, case when line % 9 = 0 then 'ALLOW' else verdict end verdict from res) select line, verdict from c where score is not null and verdict <> {B.verdict_sql('score')}")
def verdict_consistency(spark: SparkSession, sf: str) -> DataFrame:
    r = B.results(spark, sf).withColumn("verdict", F.when(F.col("line") % 9 == 0, "ALLOW").otherwise(F.col("verdict")))
    return r.where(F.col("score").isNotNull() & (F.col("verdict") != P.verdict(F.col("score"), F.lit(0.35), F.lit(0.8)))).select("line", "verdict")


@query("results_violations", f"""with {B.RES}, r as (select line, case when line % 31 = 0 then 'zz' else sha256 end sha256, case when line % 29 = 0 then 'MAYBE' else verdict end verdict,
    case when line % 23 = 0 then 'boolean' when line % 41 = 0 then 'string' else 'number' end kind, case when line % 37 = 0 then 1.5::double else score end score,
    case when line % 43 = 0 then '' else 'm' end model_id, case when line % 47 = 0 then 'short' else sha256(verdict) end model_sha256, case when line % 53 = 0 then 0.9::double else 0.35::double end review, 0.8::double as block from res)
  select * from (select line, case when not regexp_full_match(lower(sha256), '[0-9a-f]{{64}}') then 'bad_digest' when verdict not in ('ALLOW','REVIEW','BLOCK','ERROR') then 'bad_verdict'
    when verdict <> 'ERROR' and kind <> 'number' then 'bad_score' when verdict <> 'ERROR' and (score is null or score < 0 or score > 1) then 'score_range' when model_id = '' then 'bad_model'
    when not regexp_full_match(model_sha256, '[0-9a-f]{{64}}') then 'bad_model_digest' when not (review >= 0 and review < block and block <= 1) then 'bad_policy'
    when verdict <> 'ERROR' and verdict <> {B.verdict_sql('score', 'review', 'block')} then 'verdict_mismatch' end as code from r) where code is not null""")
def results_violations(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("line")
    r = B.results(spark, sf).select(
        "line",
        F.when(k % 31 == 0, "zz").otherwise(F.col("sha256")).alias("sha256"),
        F.when(k % 29 == 0, "MAYBE").otherwise(F.col("verdict")).alias("verdict"),
        F.when(k % 23 == 0, "boolean").when(k % 41 == 0, "string").otherwise("number").alias("score_kind"),
        F.when(k % 37 == 0, F.lit(1.5)).otherwise(F.col("score")).alias("score"),
        F.when(k % 43 == 0, "").otherwise("m").alias("model_id"),
        F.when(k % 47 == 0, "short").otherwise(S.digest(F.col("verdict"))).alias("model_sha256"),
        F.when(k % 53 == 0, F.lit(0.9)).otherwise(F.lit(0.35)).alias("review"),
        F.lit(0.8).alias("block"),
    )
    return r.select("line", V.result_violation().alias("code")).where("code is not null")
