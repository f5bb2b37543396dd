"""Queries: routing, enrichment, configurations, JSON lines, the bridge, scalars and pluggable models."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import routing as R
from ..operators import udf as U
from ..operators import validate as V
from ..operators.order import shared_dir
from ..operators.policy import policy_table
from ..sources import config, images, jsonl
from ..streaming import bridge
from . import bindings as B
from .registry import query

_ROUTED = f"with {B.SCAN}, {B.MOD} select doc_id, verdict, model_id from scn join models on enabled and (list_contains(routes, 'ALL') or list_contains(routes, verdict))"


@query("route_models", _ROUTED)
def route_models(spark: SparkSession, sf: str) -> DataFrame:
    return R.route_theta(B.scan_rows(spark, sf).select("doc_id", "verdict"), B.models(spark)).select("doc_id", "verdict", "model_id")


@query("route_models_equi", _ROUTED)
def route_models_equi(spark: SparkSession, sf: str) -> DataFrame:
    return R.route_equi(B.scan_rows(spark, sf).select("doc_id", "verdict"), B.models(spark)).select("doc_id", "verdict", "model_id")


_VIS = f"{B.SCAN}, {B.MOD}, vis as (select doc_id, verdict, list(model_id order by ordinal) filter (model_id is not null) as analyses from scn left join models on enabled and (list_contains(routes, 'ALL') or list_contains(routes, verdict)) group by doc_id, verdict)"


@query("vision_results", f"with {_VIS} select doc_id, verdict, coalesce(analyses, []) as analyses from vis")
def vision_results(spark: SparkSession, sf: str) -> DataFrame:
    return R.enriched(B.scan_rows(spark, sf).select("doc_id", "verdict"), B.models(spark)).select("doc_id", "verdict", "analyses")


@query("vision_summary", f"with {_VIS} select verdict, count(*) as records, sum(len(coalesce(analyses, [])))::bigint as calls, count(*) filter (doc_id % 10 = 0) as errors from vis group by verdict")
def vision_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = vision_results(spark, sf)
    return rows.groupBy("verdict").agg(F.count(F.lit(1)).alias("records"), F.sum(F.size("analyses")).alias("calls"), F.count_if(F.col("doc_id") % 10 == 0).alias("errors"))


@query("verify_artifacts", f"""with {B.SCAN} select doc_id, case when error_code is not null then 'missing_digest' when doc_id % 13 = 0 then 'artifact_unavailable' when doc_id % 17 = 0 then 'changed_after_base_scan' end as code from scn""")
def verify_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    scan = B.scan_rows(spark, sf)
    records = scan.select("doc_id", "relative_path", F.when(F.col("error_code").isNull(), F.col("sha256")).alias("sha256"))
    now = F.when(F.col("doc_id") % 17 == 0, S.digest(F.concat("text", F.lit("!")))).otherwise(F.col("sha256"))
    files = scan.where("doc_id % 13 <> 0").select("relative_path", now.alias("file_sha256"))
    return R.verified(records, files).select("doc_id", "code")


@query("path_boundary", """with p as (select page_id, (['/data/in/', '/data/in/../in/', '/data/other/', '/data/in/../../', 'data/in/', '/data/inside/'])[(page_id % 6 + 1)::int] || page_id || '.png' as path from pages)
  select page_id, page_id % 6 in (0, 1) as inside from p""")
def path_boundary(spark: SparkSession, sf: str) -> DataFrame:
    heads = F.array(*map(F.lit, ("/data/in/", "/data/in/../in/", "/data/other/", "/data/in/../../", "data/in/", "/data/inside/")))
    path = F.concat(F.element_at(heads, (F.col("page_id") % 6 + 1).cast("int")), F.col("page_id").cast("string"), F.lit(".png"))
    return B.table(spark, sf, "pages").select("page_id", V.inside_root(path, ["/data/in"]).alias("inside"))


TOML = """
schema_version = 1
[privacy]
mode = "remote-tls"
[[models]]
id = "captions"
adapter = "command"
trusted = true
tasks = ["caption"]
when = ["review", "allow"]
[[models]]
id = "remote"
adapter = "http-json"
url = "https://user:pw@models.example.org:8443/v1?key=1"
tasks = ["detect", "ocr"]
when = ["BLOCK", "block"]
timeout_seconds = 5
auth_env = "TOKEN"
[[models]]
id = "local"
adapter = "http-json"
url = "http://127.0.0.1:9000/run"
enabled = false
tasks = ["ocr"]
when = ["all"]
"""


@query("config_models", """select * from (values (1, 'captions', 'command', true, null, false, ['ALLOW','REVIEW'], 30.0::double), (2, 'remote', 'http-json', true, 'https://models.example.org:8443', true, ['BLOCK'], 5.0),
  (3, 'local', 'http-json', false, 'http://127.0.0.1:9000', false, ['ALL'], 30.0)) t(ordinal, id, adapter, enabled, url_origin, auth_from_environment, "when", timeout_seconds)""")
def config_models(spark: SparkSession, sf: str) -> DataFrame:
    return config.evidence(config.load_models(spark, TOML))


@query("config_violations", """select * from (values (1, null), (2, 'untrusted_command'), (3, 'bad_url'), (4, 'remote_in_local_only'), (5, 'not_https'), (6, 'not_acknowledged'), (7, null), (8, 'bad_id'), (9, 'bad_adapter'), (10, 'bad_timeout'), (11, null)) t(case_id, code)""")
def config_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = [
        (1, "a", "command", True, True, None, 30.0, "local-only", False),
        (2, "a", "command", True, False, None, 30.0, "local-only", False),
        (3, "a", "http-json", True, False, "ftp://x", 30.0, "local-only", False),
        (4, "a", "http-json", True, False, "https://x.org", 30.0, "local-only", True),
        (5, "a", "http-json", True, False, "http://x.org", 30.0, "remote-tls", True),
        (6, "a", "http-json", True, False, "https://x.org", 30.0, "remote-tls", False),
        (7, "a", "http-json", True, False, "http://127.0.0.1:8000/x", 30.0, "local-only", False),
        (8, "a b", "command", True, True, None, 30.0, "local-only", False),
        (9, "a", "grpc", True, True, None, 30.0, "local-only", False),
        (10, "a", "command", True, True, None, 0.01, "local-only", False),
        (11, "a", "command", False, False, None, 30.0, "local-only", False),
    ]
    df = spark.createDataFrame(rows, "case_id int, id string, adapter string, enabled boolean, trusted boolean, url string, timeout_seconds double, mode string, acknowledged boolean")
    return df.select("case_id", V.config_violation().alias("code"))


@query("missing_tasks", f"with {B.MOD}, t as (select model_id, ['caption','ocr','detect'][1:ordinal] as want, ['caption','detect'] as have from models) select model_id, list_filter(want, lambda x: not list_contains(have, x)) as missing from t")
def missing_tasks(spark: SparkSession, sf: str) -> DataFrame:
    tasks = F.array(*map(F.lit, ("caption", "ocr", "detect")))
    return B.models(spark).select("model_id", F.array_except(F.slice(tasks, 1, F.col("ordinal")), F.array(F.lit("caption"), F.lit("detect"))).alias("missing"))


@query("unknown_routes", "select event_type, list_sort(list_filter([upper(event_type), 'ALL', 'BLOCK'], lambda x: x not in ('ALL','ALLOW','REVIEW','BLOCK','ERROR'))) as unknown from (select distinct event_type from events)")
def unknown_routes(spark: SparkSession, sf: str) -> DataFrame:
    kinds = B.table(spark, sf, "events").select("event_type").distinct()
    routes = F.array(F.upper("event_type"), F.lit("ALL"), F.lit("BLOCK"))
    return kinds.select("event_type", F.array_sort(F.array_except(routes, F.array(*map(F.lit, R.ROUTES)))).alias("unknown"))


@query("request_response", "select event_id, user_id, value as answer from events where event_id % 5 <> 0")
def request_response(spark: SparkSession, sf: str) -> DataFrame:
    """Requests met with their responses by id; every fifth has none."""
    e = B.table(spark, sf, "events")
    ids = F.concat(F.lit("req-"), F.col("event_id").cast("string"))
    asked = e.select("event_id", "user_id", ids.alias("request_id"))
    answers = e.where("event_id % 5 <> 0").select(ids.alias("request_id"), F.col("value").alias("answer"))
    return asked.join(answers, "request_id").select("event_id", "user_id", "answer")


@query("regex_validate", f"with {B.ART} select doc_id, doc_id % 4 not in (1, 3) as digest_ok, regexp_full_match(source || case when doc_id % 6 = 0 then ' x' else '' end, '[A-Za-z0-9_-]{{1,64}}') as domain_ok from art")
def regex_validate(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 4
    h = F.when(k == 1, F.concat("sha256", F.lit("\n"))).when(k == 3, F.substring("sha256", 1, 60)).otherwise(F.col("sha256"))
    d = F.concat("source", F.when(F.col("doc_id") % 6 == 0, " x").otherwise(""))
    return B.artifacts(spark, sf).select("doc_id", h.rlike(S.SHA256).alias("digest_ok"), d.rlike(S.DOMAIN).alias("domain_ok"))


@query("url_parts", """select page_id, coalesce(regexp_extract(url, '^([a-z]+)://', 1), '') as scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host,
  regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/.][^/]*?(\\.[^./]*)$', 1) as suffix from pages""")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    path = F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)
    return B.table(spark, sf, "pages").select("page_id", F.regexp_extract(url, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(url, "^[a-z]+://([^/:?#]+)", 1).alias("host"), S.suffix(path).alias("suffix"))


@query("slugify", """with s as (select p_partkey, trim(regexp_replace(p_name || ' / #' || p_partkey || '..', '[^A-Za-z0-9._-]+', '-', 'g'), '-._') as v from part) select p_partkey, coalesce(nullif(left(v, 80), ''), 'image') as slug from s""")
def slugify(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "part").select("p_partkey", S.slug(F.concat("p_name", F.lit(" / #"), F.col("p_partkey").cast("string"), F.lit(".."))).alias("slug"))


@query("html_escape", """select page_id, replace(replace(replace(replace(replace('<a href="' || url || '">it''s</a>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as escaped from pages""")
def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "pages").select("page_id", S.escape_html(F.concat(F.lit('<a href="'), "url", F.lit("\">it's</a>"))).alias("escaped"))


@query("url_origin", "select page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as origin, page_id % 4 = 0 as loopback from pages")
def url_origin(spark: SparkSession, sf: str) -> DataFrame:
    local = F.when(F.col("page_id") % 4 == 0, F.lit("http://u:p@127.0.0.1:80/x")).otherwise(F.col("url"))
    return B.table(spark, sf, "pages").select("page_id", S.url_origin(F.col("url")).alias("origin"), S.is_loopback(local).alias("loopback"))


@query("json_typed_extract", "select event_id, (props->>'k')::bigint as k, case event_id % 4 when 0 then 'number' when 1 then 'boolean' when 2 then 'string' else 'missing' end as kind from events")
def json_typed_extract(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("event_id") % 4
    text = F.when(m == 0, F.lit('{"n": 0.5}')).when(m == 1, F.lit('{"n": true}')).when(m == 2, F.lit('{"n": "x"}')).otherwise(F.lit('{"m": 1}'))
    return B.table(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), jsonl.field_kind(text, "n").alias("kind"))


@query("canonical_json", """select event_id, '{"a":' || event_id || ',"b":{"c":true,"d":"x"}}' as canonical from events""")
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit('{"b": {"d": "x", "c": true}, "a": '), F.col("event_id").cast("string"), F.lit("}"))
    return B.table(spark, sf, "events").select("event_id", jsonl.canonical(text).alias("canonical"))


@query("clean_error", """select page_id, coalesce(nullif(left(replace(case when page_id % 7 = 0 then '' else 'cannot open /srv/data/' || url || html end, '/srv/data', '<root>'), 500), ''), 'OSError') as message from pages""")
def clean_error(spark: SparkSession, sf: str) -> DataFrame:
    message = F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("cannot open /srv/data/"), "url", "html"))
    return B.table(spark, sf, "pages").select("page_id", S.clean_error(message, F.lit("/srv/data"), F.lit("OSError")).alias("message"))


@query("timing_round", "select event_id, round(value / 3, 4) as ms from events")
def timing_round(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "events").select("event_id", F.round(F.col("value") / 3, 4).alias("ms"))


@query("run_id_format", "select event_id, strftime(ts, '%Y%m%dT%H%M%S.%fZ') as run_id from events")
def run_id_format(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss.SSSSSS'Z'").alias("run_id"))


@query("base64_payload", "select item_id, to_base64(encode(text)) as data, octet_length(encode(text))::bigint as byte_length from benchmark")
def base64_payload(spark: SparkSession, sf: str) -> DataFrame:
    return B.table(spark, sf, "benchmark").select("item_id", S.base64_line(F.col("text")).alias("data"), F.octet_length("text").cast("long").alias("byte_length"))


@query("map_merge", "select event_id, case when event_id % 2 = 0 then 'threads=2,provider=cuda' else 'threads=2,provider=cpu' end as merged from events")
def map_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The later map wins; keys in order, longest first only to show that order is chosen."""
    base = F.create_map(F.lit("provider"), F.lit("cpu"), F.lit("threads"), F.lit("2"))
    more = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("provider"), F.lit("cuda"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(more, k)), more)
    pairs = F.transform(F.sort_array(F.map_entries(merged), asc=False), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return B.table(spark, sf, "events").select("event_id", F.array_join(pairs, ",").alias("merged"))


# ---- JSON lines


def _numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    text = F.when(k % 97 == 0, F.lit("{broken")).when(k % 89 == 0, F.lit("[1]")).otherwise(F.col("props"))
    return B.table(spark, sf, "events").select(k.alias("line"), text.alias("text"))


@query("jsonl_scan", "select event_id as line, case when event_id % 97 = 0 then 'invalid_json' when event_id % 89 = 0 then 'not_an_object' end as code from events")
def jsonl_scan(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.bounded(_numbered_lines(spark, sf)).select("line", "code")


@query("jsonl_first_bad_line", "select event_id as line, case when event_id % 97 = 0 then 'invalid_json' else 'not_an_object' end as code from events where event_id % 97 = 0 or event_id % 89 = 0 order by event_id limit 1")
def jsonl_first_bad_line(spark: SparkSession, sf: str) -> DataFrame:
    return jsonl.first_bad_line(_numbered_lines(spark, sf))


# ---- the bridge

REQUESTS = (
    (1, '{"protocol":"safety-bridge/v1","id":"a","operation":"health"}'),
    (2, '{"protocol":"safety-bridge/v1","id":"b","operation":"scan","artifact":{"kind":"file","path":"/in/1.png"}}'),
    (3, "   "),
    (4, "{not json"),
    (5, '{"protocol":"other/v9","id":"c","operation":"health"}'),
    (6, '{"protocol":"safety-bridge/v1","id":7,"operation":"health"}'),
    (7, '{"protocol":"safety-bridge/v1","id":"d","operation":"scan","artifact":{"kind":"file","path":"/etc/2.png"}}'),
    (8, '{"protocol":"safety-bridge/v1","id":"e","operation":"scan","artifact":{"kind":"file","path":"/in/1.png","sha256":"00"}}'),
    (9, '{"protocol":"safety-bridge/v1","id":"f","operation":"scan","artifact":{"kind":"file","path":"/in/1.png"},"policy":{"profile":"low-threshold-v1"}}'),
    (10, '{"protocol":"safety-bridge/v1","id":"g","operation":"scan","artifact":{"kind":"file","path":"/in/1.png"},"policy":{"profile":"none"}}'),
    (11, '{"protocol":"safety-bridge/v1","id":"h","operation":"delete"}'),
    (12, '{"protocol":"safety-bridge/v1","id":"i","operation":"scan","artifact":{"kind":"url","path":"/in/1.png"}}'),
    (13, '{"protocol":"safety-bridge/v1","id":"j","operation":"scan","artifact":{"kind":"file","path":"/in/missing.png"}}'),
)


def _artifacts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("/in/1.png", "ab" * 32, 0.7), ("/etc/2.png", "cd" * 32, 0.1)], "path string, sha256 string, score double")


def _answer(spark: SparkSession, lines: DataFrame) -> DataFrame:
    return bridge.responses(lines, _artifacts(spark), ["/in"], policy_table(spark))


def _lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REQUESTS), "line int, text string")


@query("bridge_requests", """select * from (values (1,'a','health',null),(2,'b','scan',null),(4,null,null,'bridge_protocol_error'),(5,'c','health','bridge_protocol_error'),(6,null,'health','bridge_protocol_error'),
  (7,'d','scan',null),(8,'e','scan',null),(9,'f','scan',null),(10,'g','scan','invalid_input'),(11,'h','delete','bridge_protocol_error'),(12,'i','scan','bridge_protocol_error'),(13,'j','scan',null)) t(line, id, operation, code)""")
def bridge_requests(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.requests(_lines(spark)).select("line", "id", "operation", "code")


_ANSWERS = """(values ('a',null,'ready',null),('b',null,null,'REVIEW'),('f',null,null,'BLOCK'),(null,'bridge_protocol_error',null,null),(null,'bridge_protocol_error',null,null),('c','bridge_protocol_error',null,null),
  ('h','bridge_protocol_error',null,null),('i','bridge_protocol_error',null,null),('d','path_outside_allowed_roots',null,null),('e','invalid_input',null,null),('g','invalid_input',null,null),('j','invalid_input',null,null)) t(id, code, status, verdict)"""


@query("bridge_responses", f"""select '{{' || case when code is not null then '"error":{{"code":"' || code || '"}},' else '' end || coalesce('"id":"' || id || '",', '')
  || '"ok":' || case when code is null then 'true' else 'false' end || ',"protocol":"{bridge.PROTOCOL}"' || case when code is not null then '' when status is not null then ',"result":{{"status":"' || status || '"}}'
  else ',"result":{{"verdict":"' || verdict || '"}}' end || '}}' as value from {_ANSWERS}""")
def bridge_responses(spark: SparkSession, sf: str) -> DataFrame:
    """The requests as a stream of files, answered and read back."""
    import uuid

    at = f"{shared_dir(spark).rstrip('/')}/bridge-{uuid.uuid4().hex}"
    _lines(spark).coalesce(1).select("text").write.text(f"{at}/in")
    bridge.run_stream(spark, f"{at}/in", f"{at}/out", f"{at}/state", lambda lines: _answer(spark, lines))
    return spark.read.text(f"{at}/out")


@query("bridge_dispatch", """select * from (values (1,'a',true,null,'ready',null),(2,'b',true,'REVIEW',null,null),(4,null,false,null,null,'bridge_protocol_error'),(5,'c',false,null,null,'bridge_protocol_error'),
  (6,null,false,null,null,'bridge_protocol_error'),(7,'d',false,null,null,'path_outside_allowed_roots'),(8,'e',false,null,null,'invalid_input'),(9,'f',true,'BLOCK',null,null),(10,'g',false,null,null,'invalid_input'),
  (11,'h',false,null,null,'bridge_protocol_error'),(12,'i',false,null,null,'bridge_protocol_error'),(13,'j',false,null,null,'invalid_input')) t(line, id, ok, verdict, status, code)""")
def bridge_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    return _answer(spark, _lines(spark)).select("line", "id", "ok", "verdict", "status", "code")


_PROFILE = "(['low-threshold-v1','medium-threshold-v1','high-threshold-v1','nothing'])[(doc_id % 4 + 1)::int]"


@query("bridge_policy", f"""with {B.ART}, r as (select *, {_PROFILE} as policy from art), p(policy, r, b) as (values ('low-threshold-v1', 0.15::double, 0.65::double), ('medium-threshold-v1', 0.35, 0.8), ('high-threshold-v1', 0.6, 0.93))
  select doc_id, r.policy, case when p.policy is null then 'ERROR' else {B.verdict_sql('score', 'p.r', 'p.b')} end as verdict from r left join p using (policy)""")
def bridge_policy(spark: SparkSession, sf: str) -> DataFrame:
    """The policy that a request names; an unknown one is an error."""
    from ..operators import policy as P

    names = F.array(*map(F.lit, ("low-threshold-v1", "medium-threshold-v1", "high-threshold-v1", "nothing")))
    rows = B.artifacts(spark, sf).select("doc_id", "score", F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")).alias("policy"))
    joined = rows.join(F.broadcast(policy_table(spark)), "policy", "left")  # six rows
    known = F.col("review_threshold").isNotNull()
    return joined.select("doc_id", "policy", F.when(known, P.verdict(F.col("score"), F.col("review_threshold"), F.col("block_threshold"))).otherwise("ERROR").alias("verdict"))


# ---- pluggable models and sources without SQL


_DIGITS = "('0x' || substr(sha256(text), 1, 4))::int / 65535.0::double"
_ECHO = """true as ok, null::varchar as code, '{"length": ' || length(text) || ', "prefix": "' || substr(sha256(text), 1, 8) || '"}' as outputs"""


@query("udf_score", f"select doc_id, {_DIGITS} as score, null::varchar as error from documents")
def udf_score(spark: SparkSession, sf: str) -> DataFrame:
    return U.score_with(B.table(spark, sf, "documents"), U.DigestScorer, "text", "doc_id")


@query("udf_mock_adapter", f"select item_id, {_ECHO} from benchmark")
def udf_mock_adapter(spark: SparkSession, sf: str) -> DataFrame:
    return U.call_adapter(B.table(spark, sf, "benchmark"), U.MockAdapter, "item_id", "text")


@query("adapter_calls", f"with {B.SCAN}, hit as (select doc_id from scn where verdict = 'BLOCK') select doc_id, {_ECHO} from documents join hit using (doc_id)")
def adapter_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Only flagged rows reach the adapter."""
    flagged = B.scan_rows(spark, sf).where("verdict = 'BLOCK'").select("doc_id", "text")
    return U.call_adapter(flagged, U.MockAdapter, "doc_id", "text")


#: Responses as they were recorded, and the check that each fails.
RECORDED = (
    ("r1", '{"ok":true,"protocol":"vision-adapter","request_id":"r1","type":"result","version":1}', None),
    ("r2", '{"ok":true,"protocol":"vision-adapter","request_id":"other","type":"result","version":1}', "wrong_request_id"),
    ("r3", '{"protocol": "x"}', "wrong_protocol"),
    ("r4", "[]", "not_an_object"),
    ("r5", '{"protocol":"vision-adapter","version":2}', "unsupported_version"),
    ("r6", '{"value": NaN}', "invalid_json"),
    ("r7", '{"protocol":"vision-adapter","version":1,"type":"result","request_id":"r7","ok":1}', "no_boolean_ok"),
)


@query("adapter_validate", "select * from (values " + ", ".join(f"('{i}', '{r}', {'null' if c is None else repr(c)})" for i, r, c in RECORDED) + ") t(request_id, response, code)")
def adapter_validate(spark: SparkSession, sf: str) -> DataFrame:
    return U.validated(spark.createDataFrame([(i, r) for i, r, _ in RECORDED], "request_id string, response string"))


@query("decode_header", """select * from (values ('png', 'PNG', 640::bigint, 360::bigint, false), ('jpeg', 'JPEG', 640, 360, false), ('webp', 'WEBP', 640, 360, true), ('text', null, null, null, false))
  t(name, format, width, height, animated)""")
def decode_header(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes from the first bytes of hand-made headers."""
    png = "89504E470D0A1A0A0000000D49484452000002800000016808060000"
    jpeg = "FFD8FFE000104A46494600010100000100010000FFC00011080168028003"
    webp = "524946461A00000057454250565038580A000000020000007F0200670100"
    df = spark.createDataFrame([("png", png), ("jpeg", jpeg), ("webp", webp), ("text", "68656C6C6F")], "name string, hex string")
    return df.select("name", images.header(F.unhex("hex")).alias("h")).select("name", "h.*")


@query("bridge_documents", f"""with {B.ART}, q as (select *, case when doc_id % 10 = 0 then '/etc/' else '/in/' end || relative_path as path, ['low-threshold-v1', 'medium-threshold-v1', 'none'][(1 + doc_id % 3)::int] as policy from art),
  c as (select *, case when policy = 'none' then 'invalid_input' when doc_id % 10 = 0 then 'path_outside_allowed_roots' when doc_id % 7 = 0 then 'artifact_digest_mismatch' end as code from q)
  select 'd' || doc_id as id, code is null as ok, code, case when code is null and animated then 'REVIEW' when code is null and policy = 'low-threshold-v1' then {B.verdict_sql('score', '0.15::double', '0.65::double')}
  when code is null then {B.verdict_sql('score')} end as verdict from c""")
def bridge_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A request for every document: some outside the roots, some with another digest, some under no policy."""
    a = B.artifacts(spark, sf)
    path = F.concat(F.when(F.col("doc_id") % 10 == 0, "/etc/").otherwise("/in/"), "relative_path")
    policy = F.element_at(F.array(*map(F.lit, ("low-threshold-v1", "medium-threshold-v1", "none"))), (F.col("doc_id") % 3 + 1).cast("int"))
    claimed = F.when(F.col("doc_id") % 7 == 0, F.repeat(F.lit("0"), 64)).otherwise(F.upper("sha256"))
    request = F.struct(
        F.lit(bridge.PROTOCOL).alias("protocol"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("scan").alias("operation"),
        F.struct(F.lit("file").alias("kind"), path.alias("path"), claimed.alias("sha256")).alias("artifact"), F.struct(policy.alias("profile")).alias("policy"),
    )
    known = a.select(path.alias("path"), "sha256", "score", "animated")
    return bridge.responses(a.select(F.to_json(request).alias("text")), known, ["/in"], policy_table(spark)).select("id", "ok", "code", "verdict")


@query("model_verify")
def model_verify(spark: SparkSession, sf: str) -> DataFrame:
    """A table file against its own digest and against another."""
    path = f"{sf}/region.parquet"
    own = images.verify_artifact(spark, path, "0" * 64).select(F.lit("other").alias("pin"), "length", "ok")
    return own.withColumn("name", F.lit(os.path.basename(path)))
