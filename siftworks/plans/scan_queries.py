"""Queries: discovery, gates, digests, policies and scan rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import order as O
from ..operators import policy as P
from ..operators import scan
from ..operators import validate as V
from . import bindings as B
from .registry import query

SUPPORTED = "regexp_matches(lower(relative_path), '\\.(jpg|jpeg|png|webp)$')"


@query("scan_discovery", f"with {B.ART} select row_number() over (order by lower(relative_path), relative_path)::bigint as \"index\", relative_path from art where {SUPPORTED}")
def scan_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return scan.discovered(B.artifacts(spark, sf).select("relative_path")).select("index", "relative_path")


@query("scan_bounded_bytes", f"with {B.ART} select doc_id, byte_length, case when byte_length <= 4000 then sha256 end as sha256, case when byte_length > 4000 then 'artifact_too_large' end as error_code from art")
def scan_bounded_bytes(spark: SparkSession, sf: str) -> DataFrame:
    docs = B.table(spark, sf, "documents").withColumn("byte_length", F.octet_length("text").cast("long"))
    small = F.col("byte_length") <= B.MAX_BYTES
    return docs.select("doc_id", "byte_length", F.when(small, S.digest(F.col("text"))).alias("sha256"), V.byte_gate(F.col("byte_length"), B.MAX_BYTES).alias("error_code"))


@query("scan_in_memory", "select * from (values ('a', 1::bigint, sha256('a')), ('', 0::bigint, sha256('')), ('pixels', 6::bigint, sha256('pixels'))) t(payload, byte_length, sha256)")
def scan_in_memory(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b""),), (bytearray(b"pixels"),)], "content binary")
    return df.select(F.decode("content", "UTF-8").alias("payload"), F.octet_length("content").cast("long").alias("byte_length"), S.digest(F.col("content")).alias("sha256"))


@query("scan_documents", f"with {B.SCAN} select doc_id, relative_path, sha256, byte_length, verdict, nsfw, error_code, error_code is null as ok from scn")
def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    return B.scan_rows(spark, sf).select("doc_id", "relative_path", "sha256", "byte_length", "verdict", "nsfw", "error_code", F.col("error_code").isNull().alias("ok"))


@query("scan_flags", f"with {B.SCAN} select doc_id, verdict from scn where verdict <> 'ALLOW'")
def scan_flags(spark: SparkSession, sf: str) -> DataFrame:
    return B.scan_rows(spark, sf).where("verdict <> 'ALLOW'").select("doc_id", "verdict")


@query("verdict_counts", f"with {B.SCAN} select verdict, count(*) as n from scn group by verdict")
def verdict_counts(spark: SparkSession, sf: str) -> DataFrame:
    return B.scan_rows(spark, sf).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("run_summary", f"""with {B.SCAN} select count(*) as scanned_count, count(*) filter (verdict <> 'ALLOW') as flagged_count,
  sum(case when error_code is null then byte_length else 0 end)::bigint as input_bytes, count(*) / 8.0::double as throughput from scn""")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("error_code").isNull()
    return B.scan_rows(spark, sf).agg(
        F.count(F.lit(1)).alias("scanned_count"),
        F.count_if(F.col("verdict") != "ALLOW").alias("flagged_count"),
        F.sum(F.when(ok, F.col("byte_length")).otherwise(0)).alias("input_bytes"),
        F.try_divide(F.count(F.lit(1)).cast("double"), F.lit(8.0)).alias("throughput"),
    )


@query("scan_lines", f"with {B.SCAN} select verdict || chr(9) || relative_path || chr(9) || substr(sha256, 1, 12) as line from scn")
def scan_lines(spark: SparkSession, sf: str) -> DataFrame:
    return B.scan_rows(spark, sf).select(F.format_string("%s\t%s\t%s", "verdict", "relative_path", F.substring("sha256", 1, 12)).alias("line"))


@query("pixel_gate", """select width, height, case when width <= 0 or height <= 0 or width * height > 40000000 then 'artifact_too_large' end as code
  from (select (p_partkey % 97 * 100 - 50)::bigint as width, (p_partkey % 89 * 100)::bigint as height from part)""")
def pixel_gate(spark: SparkSession, sf: str) -> DataFrame:
    p = B.table(spark, sf, "part").select((F.col("p_partkey") % 97 * 100 - 50).alias("width"), (F.col("p_partkey") % 89 * 100).alias("height"))
    return p.select("width", "height", V.pixel_gate(F.col("width"), F.col("height"), 40_000_000).alias("code"))


@query("format_gate", f"with {B.ART}, f as (select doc_id, upper(regexp_extract(relative_path, '[^.]*$')) as ext from art) select doc_id, ext, case when replace(ext, 'JPG', 'JPEG') not in ('JPEG','PNG','WEBP') then 'unsupported_media' end as code from f")
def format_gate(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.upper(F.regexp_extract("relative_path", "([^.]*)$", 1))
    a = B.artifacts(spark, sf).select("doc_id", ext.alias("ext"))
    return a.select("doc_id", "ext", V.format_gate(F.regexp_replace("ext", "^JPG$", "JPEG")).alias("code"))


CLAIM_SQL = "case doc_id % 4 when 0 then null when 1 then upper(sha256) when 2 then 'xyz' else sha256('x' || sha256) end"


@query("digest_binding", f"""with {B.ART}, c as (select doc_id, sha256, {CLAIM_SQL} as claimed from art)
  select doc_id, case when claimed is null then 'unclaimed' when not regexp_full_match(lower(claimed), '[0-9a-f]{{64}}') then 'malformed'
    when lower(claimed) <> sha256 then 'mismatch' else 'bound' end as binding from c""")
def digest_binding(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 4
    claimed = F.when(k == 1, F.upper("sha256")).when(k == 2, "xyz").when(k == 3, S.digest(F.concat(F.lit("x"), "sha256")))
    return B.artifacts(spark, sf).select("doc_id", V.digest_binding(claimed, F.col("sha256")).alias("binding"))


@query("policy_verdict", f"with {B.ART} select doc_id, score, {B.verdict_sql('score')} as verdict from art")
def policy_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return P.apply_policy(B.artifacts(spark, sf)).select("doc_id", "score", "verdict")


POL = "pol(policy, r, b) as (values ('low-threshold-v1', 0.15::double, 0.65::double), ('medium-threshold-v1', 0.35, 0.8), ('high-threshold-v1', 0.6, 0.93), ('safety-first-v1', 0.15, 0.65), ('balanced-v1', 0.35, 0.8), ('high-precision-v1', 0.6, 0.93))"


@query("policy_matrix", f"with {B.ART}, {POL} select policy, {B.verdict_sql('score', 'r', 'b')} as verdict, count(*) as n from art cross join pol group by all")
def policy_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return P.policy_matrix(B.artifacts(spark, sf))


@query("policy_violations", "select r as review, b as block, not (r >= 0 and r < b and b <= 1) as violated from (select (i // 5) / 4.0::double - 0.25::double as r, (i % 5) / 4.0::double + 0.25::double as b from range(30) t(i))")
def policy_violations(spark: SparkSession, sf: str) -> DataFrame:
    g = spark.range(30).select((F.floor(F.col("id") / 5) / 4.0 - 0.25).alias("review"), (F.col("id") % 5 / 4.0 + 0.25).alias("block"))
    return g.select("review", "block", (~P.valid_policy(F.col("review"), F.col("block"))).alias("violated"))


@query("softmax_scores", """with p as (select vec_id, unnest(range(0, len(embedding) // 2)) as pair, embedding from embeddings), e as (select vec_id, pair, embedding[(2 * pair + 1)::int]::double a, embedding[(2 * pair + 2)::int]::double b from p)
  select vec_id, pair::bigint as pair, round(exp(a - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) as nsfw from e""")
def softmax_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair of neighbouring numbers of a vector as two logits."""
    v = F.col("embedding")
    logits = lambda k: F.struct(F.element_at(v, 2 * k + 1).cast("double").alias("a"), F.element_at(v, 2 * k + 2).cast("double").alias("b"))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.size(v)), lambda k: 2 * k + 2 <= F.size(v)), logits)
    e = B.table(spark, sf, "embeddings").select("vec_id", F.posexplode(pairs).alias("pair", "x"))
    return e.select("vec_id", F.col("pair").cast("long").alias("pair"), F.round(S.stable_softmax(F.col("x.a"), F.col("x.b")), 6).alias("nsfw"))


@query("normalize_vector", "select l_orderkey, l_linenumber, l_partkey, list_transform([l_quantity, l_discount * 100, l_tax * 100], lambda x: round((x / 255.0::double - 0.5::double) / 0.5::double, 6)) as pixels from lineitem")
def normalize_vector(spark: SparkSession, sf: str) -> DataFrame:
    px = F.array(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100)
    return B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.transform(px, lambda x: F.round((x / 255.0 - 0.5) / 0.5, 6)).alias("pixels"))


@query("variant_explode", f"with {B.ART} select doc_id, unnest(case when doc_id % 3 = 0 then ['dark','light'] else ['plain'] end) as background from art")
def variant_explode(spark: SparkSession, sf: str) -> DataFrame:
    backgrounds = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("dark"), F.lit("light"))).otherwise(F.array(F.lit("plain")))
    return B.artifacts(spark, sf).select("doc_id", F.explode(backgrounds).alias("background"))


@query("variant_max", f"""with {B.ART} select doc_id, case when doc_id % 3 = 0 and score2 > score then 'light' when doc_id % 3 = 0 then 'dark' else 'plain' end as background,
  case when doc_id % 3 = 0 then greatest(score, score2) else score end as nsfw from art""")
def variant_max(spark: SparkSession, sf: str) -> DataFrame:
    """A row's variants are two at most, so the best is picked in the row; the first wins a tie."""
    twice = (F.col("doc_id") % 3 == 0).alias("twice")
    a = B.artifacts(spark, sf).select("doc_id", twice, "score", "score2")
    second = F.col("twice") & (F.col("score2") > F.col("score"))
    name = F.when(second, "light").when(F.col("twice"), "dark").otherwise("plain")
    return a.select("doc_id", name.alias("background"), F.when(second, F.col("score2")).otherwise(F.col("score")).alias("nsfw"))


@query("animated_review", f"with {B.SCAN} select doc_id, verdict, nsfw, 'animated_media_requires_frame_aware_scan' as reason from scn where animated and byte_length <= 4000")
def animated_review(spark: SparkSession, sf: str) -> DataFrame:
    return B.scan_rows(spark, sf).where(f"animated and byte_length <= {B.MAX_BYTES}").select("doc_id", "verdict", "nsfw", "reason")


@query("reason_codes", f"""with {B.ART}, v as (select doc_id, {B.verdict_sql('score')} verdict from art)
  select doc_id, list_concat([case verdict when 'BLOCK' then 'nsfw_score_at_or_above_block_threshold' when 'REVIEW' then 'nsfw_score_in_review_band' else 'nsfw_score_below_review_threshold' end],
    case when doc_id % 3 = 0 then ['transparent_image_scanned_on_dark_and_light_backgrounds'] else [] end) as reasons from v""")
def reason_codes(spark: SparkSession, sf: str) -> DataFrame:
    a = P.apply_policy(B.artifacts(spark, sf))
    one = F.array("reason")
    both = F.array_append(one, F.lit("transparent_image_scanned_on_dark_and_light_backgrounds"))
    return a.select("doc_id", F.when(F.col("doc_id") % 3 == 0, both).otherwise(one).alias("reasons"))


@query("score_dedup", f"with {B.ART} select doc_id, score as nsfw, row_number() over (partition by sha256 order by doc_id) > 1 as cache_hit from art")
def score_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.artifacts(spark, sf).select("doc_id", "line", "sha256", "text")
    out = scan.score_distinct(rows, "sha256", lambda d: d.withColumn("score", S.hex_fraction(F.col("sha256"))))
    return out.select("doc_id", F.col("score").alias("nsfw"), "cache_hit")


@query("exit_severity", f"with {B.SCAN} select source, max(case verdict when 'ALLOW' then 0 when 'REVIEW' then 10 when 'BLOCK' then 20 else 30 end)::int as exit_code from scn group by source")
def exit_severity(spark: SparkSession, sf: str) -> DataFrame:
    return B.scan_rows(spark, sf).groupBy("source").agg(F.max(P.severity(F.col("verdict"))).alias("exit_code"))


@query("exit_policy", f"""with {B.SCAN}, n as (select max((verdict = 'ERROR')::int) e, max((verdict = 'BLOCK')::int) b, max((verdict = 'REVIEW')::int) r from scn)
  select fail_on, (case when fail_on = 'never' then 0 when e = 1 then 30 when b = 1 and fail_on in ('block','review') then 20 when r = 1 and fail_on = 'review' then 10 else 0 end)::int as exit_code
  from n cross join (values ('never'), ('error'), ('block'), ('review')) f(fail_on)""")
def exit_policy(spark: SparkSession, sf: str) -> DataFrame:
    return P.exit_policy(B.scan_rows(spark, sf))


@query("review_links", f"""with {B.SCAN}, x as (select *, row_number() over (order by lower(relative_path), relative_path) i from scn where {SUPPORTED})
  select verdict, lpad(i::varchar, 7, '0') || '_' || coalesce(case when nsfw is not null then printf('%.4f', nsfw) end, 'no-score') || '_' || regexp_replace(regexp_extract(relative_path, '[^/]*$'), '\\.[^.]*$', '') || '.url' as name
  from x where verdict in ('BLOCK','REVIEW','ERROR')""")
def review_links(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan.discovered(B.scan_rows(spark, sf).select("relative_path", "verdict", "nsfw"))
    kept = rows.where(F.col("verdict").isin("BLOCK", "REVIEW", "ERROR"))
    return kept.select("verdict", scan.link_name(F.col("index"), F.col("nsfw"), F.col("relative_path")).alias("name"))


@query("top_k_paths", f"with {B.ART} select relative_path from art where {SUPPORTED} order by lower(relative_path), relative_path limit 25")
def top_k_paths(spark: SparkSession, sf: str) -> DataFrame:
    a = B.artifacts(spark, sf).select("relative_path").where(scan.supported(F.col("relative_path")))
    return O.top_k(a, 25, F.lower("relative_path"), F.col("relative_path"))


@query("selection_report", f"with {B.ART} select count(*) as candidates, least(count(*), 100)::bigint as selected, (count(*) - least(count(*), 100))::bigint as omitted, count(*) > 100 as truncated from art where {SUPPORTED}")
def selection_report(spark: SparkSession, sf: str) -> DataFrame:
    return scan.selection_report(B.artifacts(spark, sf).select("relative_path"), 100)


@query("limit_prefix", f"with {B.ART} select line, sha256 from art where line <= 50")
def limit_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return B.artifacts(spark, sf).where("line <= 50").select("line", "sha256")


@query("doc_digest", f"with {B.ART} select doc_id, sha256 from art")
def doc_digest(spark: SparkSession, sf: str) -> DataFrame:
    return B.artifacts(spark, sf).select("doc_id", "sha256")


@query("digest_inventory", f"with {B.ART} select relative_path as filename, byte_length as size, sha256 from art")
def digest_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return B.artifacts(spark, sf).select(F.col("relative_path").alias("filename"), F.col("byte_length").alias("size"), "sha256")


@query("synthetic_rectangles", "select step::bigint as step, i::bigint as i, ((step * 71 + i * 29) % 1180)::bigint as x, ((step * 43 + i * 17) % 620)::bigint as y from range(24) s(step) cross join range(4) t(i)")
def synthetic_rectangles(spark: SparkSession, sf: str) -> DataFrame:
    """The rectangles of the synthetic workload: 24 steps on each of 4 pictures."""
    r = spark.range(96).select((F.col("id") % 24).alias("step"), F.floor(F.col("id") / 24).alias("i"))
    return r.select("step", "i", ((F.col("step") * 71 + F.col("i") * 29) % 1180).alias("x"), ((F.col("step") * 43 + F.col("i") * 17) % 620).alias("y"))
