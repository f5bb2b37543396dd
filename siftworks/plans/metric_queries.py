"""Queries: latency metrics, peaks, running totals, decimation, history and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import order as O
from ..sources import history as H
from . import bindings as B
from .registry import query

_METRIC = """count(value) as n, count(value) <= 10000 as quantiles_exact, min(value) as min, round(avg(value), 6) as mean, round(median(value), 6) as p50,
  list_sort(list(value))[greatest(1, floor(count(value) * 0.95::double))::int] as p95_floor, list_sort(list(value))[greatest(1, ceil(count(value) * 0.95::double))::int] as p95_ceil, max(value) as max"""


@query("timing_metrics", f"select {_METRIC} from events")
def timing_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.timing_metrics(B.table(spark, sf, "events").select("value"), "value", [])


@query("timing_metrics_by_type", f"select event_type, {_METRIC} from events group by event_type")
def timing_metrics_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return M.timing_metrics(B.table(spark, sf, "events").select("event_type", "value"), "value", ["event_type"])


STAGES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("stage_metrics", f"with s as (select unnest(['l_quantity','l_extendedprice','l_discount','l_tax']) as stage, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as value from lineitem) select stage, {_METRIC} from s group by stage")
def stage_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.timing_metrics(M.stage_rows(B.table(spark, sf, "lineitem").select(*STAGES), STAGES), "value", ["stage"])


@query("bench_summary", """select count(*) as runs, median(value) as p50, list_sort(list(value))[ceil(count(*) * 0.95::double)::int] as p95, round(avg(value), 6) as mean,
  round(count(*) / (sum(value) / 1000.0::double), 4) as throughput from events""")
def bench_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank quantiles, and runs a second of summed milliseconds."""
    v = B.table(spark, sf, "events").select("value")
    m = M.timing_metrics(v, "value", []).select(F.col("n").alias("runs"), "p50", F.col("p95_ceil").alias("p95"), "mean")
    total = v.agg(F.round(F.count("value") / (F.sum("value") / 1000.0), 4).alias("throughput"))
    return m.crossJoin(F.broadcast(total))  # one row each


@query("model_stats", f"""with {B.MOD}, c as (select case event_type when 'click' then 'captions' when 'view' then 'faces' else 'ocr' end model_id, event_id % 10 <> 0 ok, value from events)
  select m.model_id, count(c.value) as calls, count(*) filter (not ok) as errors, round(avg(value), 6) as mean_ms, max(value) as max_ms from models m left join c using (model_id) group by m.model_id""")
def model_stats(spark: SparkSession, sf: str) -> DataFrame:
    model = F.when(F.col("event_type") == "click", "captions").when(F.col("event_type") == "view", "faces").otherwise("ocr")
    calls = B.table(spark, sf, "events").select(model.alias("model_id"), (F.col("event_id") % 10 != 0).alias("ok"), F.col("value").alias("elapsed_ms"))
    return M.model_stats(B.models(spark), calls)


@query("running_throughput", "select event_id, (count(*) over w)::bigint as completed, round((sum(round(value * 100)::bigint) over w)::double / 100.0::double, 2) as elapsed from events window w as (order by ts, event_id rows unbounded preceding)")
def running_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Running sums in whole hundredths, so that the order of addition cannot show."""
    e = B.table(spark, sf, "events").select("ts", "event_id", "value")
    out = O.numbered(e, F.col("ts"), F.col("event_id"), name="completed", totals={"cents": F.round(F.col("value") * 100).cast("long")})
    return out.select("event_id", "completed", F.round(F.col("cents").cast("double") / 100.0, 2).alias("elapsed"))


@query("progress_samples", "with n as (select event_id, row_number() over (order by ts, event_id) as completed, count(*) over () as total from events) select event_id, completed from n where completed % 100 = 0 or completed = total")
def progress_samples(spark: SparkSession, sf: str) -> DataFrame:
    rows = O.numbered(B.table(spark, sf, "events").select("ts", "event_id"), F.col("ts"), F.col("event_id"), name="completed")
    last = F.broadcast(rows.agg(F.max("completed").alias("_last")))  # one row
    return rows.crossJoin(last).where((F.col("completed") % 100 == 0) | (F.col("completed") == F.col("_last"))).select("event_id", "completed")


@query("timeline_decimate", """with n as (select event_id, row_number() over (order by ts, event_id) - 1 as position, count(*) over () as total from events)
  select event_id, position::bigint as position from n where position % pow(2, greatest(0, ceil(log2(total / 256.0::double))))::bigint = 0""")
def timeline_decimate(spark: SparkSession, sf: str) -> DataFrame:
    return O.decimated(B.table(spark, sf, "events").select("ts", "event_id"), 256, F.col("ts"), F.col("event_id")).select("event_id", "position")


@query("timeline_dedup_consecutive", "select event_id, event_type from (select *, lead(event_type) over (order by ts, event_id) nxt from events) where nxt is null or nxt <> event_type")
def timeline_dedup_consecutive(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").select("ts", "event_id", "event_type")
    return O.last_of_consecutive(e, "event_type", F.col("ts"), F.col("event_id")).select("event_id", "event_type")


@query("peak_delta", """select user_id % 50 as host, max(value) as peak, arg_max(event_id, (value, -event_id)) as peak_event, round(greatest(0, max(value) - arg_min(value, (ts, event_id))), 6) as delta
  from events group by user_id % 50""")
def peak_delta(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").withColumn("host", F.col("user_id") % 50)
    start = F.min_by("value", F.struct("ts", "event_id"))
    return e.groupBy("host").agg(
        F.max("value").alias("peak"),
        F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("peak_event"),
        F.round(F.greatest(F.lit(0.0), F.max("value") - start), 6).alias("delta"),
    )


#: Events as records of benchmarks, sixteen a document: the numbers are invented, the format is that of a history.
HIS = """his(stem, position, date, workload, provider, workers, p50, throughput, rss) as (
  select 'b' || event_id // 16, row_number() over (partition by event_id // 16 order by event_type <> 'click', event_id) - 1, '2031-01-' || lpad((1 + event_id // 16 % 28)::varchar, 2, '0'),
    case when event_type = 'click' then 'single image' when event_id // 16 % 2 = 0 then 'real folder' else 'folder fixture' end,
    ['cpu', 'cuda', 'directml'][(1 + event_id % 3)::int], 1 + event_id % 2 * 3, value, value * 2, event_id * 1048576::double + 524288 from events),
  best as (select *, row_number() over (partition by stem, provider order by throughput desc, position) k from his where workload <> 'single image'),
  mea as (select * from his where workload = 'single image' union all select * exclude (k) from best where k = 1)"""


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Records read from the documents; a document has at most sixteen."""
    i = F.col("event_id")
    document = F.floor(i / 16)
    record = F.struct(
        i, F.element_at(F.array(*map(F.lit, ("cpu", "cuda", "directml"))), (i % 3 + 1).cast("int")).alias("provider"), (1 + i % 2 * 3).alias("workers"),
        F.col("value").alias("total_p50_ms"), (F.col("value") * 2).alias("throughput_images_per_second"), (i * 1048576.0 + 524288).alias("peak_process_rss_bytes"),
    )
    click = F.col("event_type") == "click"
    texts = B.table(spark, sf, "events").groupBy(document.alias("document")).agg(
        F.array_sort(F.collect_list(F.when(click, record))).alias("single"), F.array_sort(F.collect_list(F.when(~click, record))).alias("measurements")
    )
    day = F.concat(F.lit("2031-01-"), F.lpad((1 + F.col("document") % 28).cast("string"), 2, "0")).alias("measurement_date")
    kind = F.when(F.col("document") % 2 == 0, "folder-real-world").otherwise("folder").alias("benchmark_kind")
    return H.records(texts.select(F.concat(F.lit("b"), F.col("document").cast("string")).alias("stem"), F.to_json(F.struct(day, kind, "single", "measurements")).alias("text")))


@query("history_records", f"with {HIS} select stem, position::bigint as position, date, workload, provider, workers::bigint as workers, p50, throughput, rss from his")
def history_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of every document, read back from JSON."""
    return history(spark, sf).drop("code").withColumns({"position": F.col("position").cast("long"), "workers": F.col("workers").cast("long")})


@query("perf_history", f"with {HIS} select stem, date, workload, provider, p50, throughput, rss / 1048576.0::double as peak_rss_mib from mea")
def perf_history(spark: SparkSession, sf: str) -> DataFrame:
    """All single-image rows, and of each folder document the best row of a provider."""
    return H.measurements(history(spark, sf)).select("stem", "date", "workload", "provider", "p50", "throughput", "peak_rss_mib")


@query("best_per_provider", f"with {HIS}, k as (select *, row_number() over (partition by provider order by throughput desc, stem, position) k from his) select provider, stem, workload, throughput from k where k = 1")
def best_per_provider(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    ties = h.groupBy("provider", "throughput").agg(F.min(F.struct("stem", "position", "workload")).alias("x"))
    top = ties.groupBy("provider").agg(F.max("throughput").alias("throughput"), F.max_by("x", "throughput").alias("x"))
    return top.select("provider", "x.stem", "x.workload", "throughput")


@query("speedup_ratio", f"""with {HIS} select provider, workload, round(max(throughput) filter (workers = 4) / max(throughput) filter (workers = 1), 3) as ratio from his
  where workload <> 'single image' group by provider, workload""")
def speedup_ratio(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf).where("workload <> 'single image'")
    rate = lambda n: F.max(F.when(F.col("workers") == n, F.col("throughput")))
    return h.groupBy("provider", "workload").agg(F.round(rate(4) / rate(1), 3).alias("ratio"))


@query("headline_eligible", """with r as (select event_id, case event_id % 3 when 0 then 'cpu' when 1 then 'cuda' else 'directml' end provider, value / 4 as cpu, value / 3 as gpu from events),
  w as (select *, list_filter([case when cpu > 25 then 'cpu_busy_at_start' end, case when provider <> 'cpu' and gpu > 20 then 'gpu_busy_at_start' end], lambda x: x is not null) l from r)
  select event_id, array_to_string(l, ',') as warnings, len(l) = 0 as headline_eligible from w""")
def headline_eligible(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    provider = F.when(k == 0, "cpu").when(k == 1, "cuda").otherwise("directml")
    rows = B.table(spark, sf, "events").select("event_id", provider.alias("provider"), (F.col("value") / 4).alias("cpu_percent"), (F.col("value") / 3).alias("gpu_percent"))
    return M.quality_flags(rows).select("event_id", "warnings", "headline_eligible")


@query("history_points", f"""with {HIS}, s as (select provider, max(throughput) throughput from his where workload = 'single image' group by provider),
  r as (select *, dense_rank() over (order by provider) - 1 as lane from s), m as (select max(throughput) * 1.15::double top from s)
  select provider, (92 + lane * 22)::bigint as x, round(170 - 170 * throughput / top, 4) as y from r cross join m""")
def history_points(spark: SparkSession, sf: str) -> DataFrame:
    """Chart points of each provider's fastest single image; lanes are ranks of the few providers."""
    s = history(spark, sf).where("workload = 'single image'").groupBy("provider").agg(F.max("throughput").alias("throughput"))
    head = F.broadcast(s.agg(F.array_sort(F.collect_set("provider")).alias("lanes"), (F.max("throughput") * 1.15).alias("top")))  # one row
    p = s.crossJoin(head).withColumn("lane", F.array_position("lanes", F.col("provider")) - 1)
    return p.select("provider", (92 + F.col("lane") * 22).alias("x"), F.round(170 - 170 * F.col("throughput") / F.col("top"), 4).alias("y"))


@query("chart_points", """with m as (select min(epoch_us(ts)) lo, max(epoch_us(ts)) hi, greatest(1, 1.08::double * max(value)) top from events)
  select event_id, round(108 + 1000 * (epoch_us(ts) - lo)::double / greatest(1, hi - lo)::double, 4) as x, round(172 + 122 * (1 - greatest(0, least(1, value / top))), 4) as y from events cross join m""")
def chart_points(spark: SparkSession, sf: str) -> DataFrame:
    e = B.table(spark, sf, "events").select("event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    m = F.broadcast(e.agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.greatest(F.lit(1.0), F.lit(1.08) * F.max("value")).alias("top")))
    p = e.crossJoin(m)
    x = 108 + 1000 * (F.col("t") - F.col("lo")).cast("double") / F.greatest(F.lit(1), F.col("hi") - F.col("lo")).cast("double")
    y = 172 + 122 * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / F.col("top"))))
    return p.select("event_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


_GRID = """g as (select i as case_id, (i % 7 * 4 + 1)::bigint cpus, ((i % 5) * 700 + 300)::bigint budget, ((i % 11) * 90000000 + 50000000)::bigint rss, case when i % 4 = 0 then null else (i % 9 + 1)::bigint end requested from (select event_id as i from events))"""


@query("worker_plan", f"""with {_GRID}, p as (select *, ceil(rss / 1048576.0::double)::bigint base, least(4, greatest(1, cpus // 4)) cap from g),
  q as (select *, greatest(1, floor((budget - base - 96) / 128.0::double)::bigint) slots from p), r as (select *, greatest(1, least(cap, slots)) rec from q)
  select case_id, rec::bigint as recommended, coalesce(requested, rec)::bigint as effective, (2 * coalesce(requested, rec))::bigint as max_in_flight, base + 96 + 128 * coalesce(requested, rec) > budget as over_budget from r""")
def worker_plan(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    g = B.table(spark, sf, "events").select(
        i.alias("case_id"), (i % 7 * 4 + 1).alias("cpus"), (i % 5 * 700 + 300).alias("budget"), (i % 11 * 90000000 + 50000000).alias("rss"),
        F.when(i % 4 != 0, i % 9 + 1).alias("requested"),
    )
    base = F.ceil(F.col("rss") / 1048576.0)
    slots = F.greatest(F.lit(1), F.floor((F.col("budget") - base - 96) / 128.0))
    recommended = F.greatest(F.lit(1), F.least(F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.col("cpus") / 4))), slots)).cast("long")
    effective = F.coalesce("requested", recommended)
    return g.select("case_id", recommended.alias("recommended"), effective.alias("effective"), (2 * effective).alias("max_in_flight"), (base + 96 + 128 * effective > F.col("budget")).alias("over_budget"))


@query("thread_plan", """with g as (select i as case_id, case when i % 3 = 0 then 'cuda' else 'cpu' end provider, (i % 4 * 2)::bigint requested, case when i % 5 = 0 then null else (i % 6 + 1)::bigint end workers, case when i % 7 = 0 then null else (i % 25)::bigint end physical from (select event_id as i from events)),
  p as (select *, greatest(1, coalesce(nullif(physical, 0), 1)) cores from g)
  select case_id, (case when requested <> 0 or provider <> 'cpu' then requested else greatest(1, least(4, cores // coalesce(workers, least(4, cores)))) end)::bigint as threads from p""")
def thread_plan(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    g = B.table(spark, sf, "events").select(
        i.alias("case_id"), F.when(i % 3 == 0, "cuda").otherwise("cpu").alias("provider"), (i % 4 * 2).alias("requested"),
        F.when(i % 5 != 0, i % 6 + 1).alias("workers"), F.when(i % 7 != 0, i % 25).alias("physical"),
    )
    cores = F.greatest(F.lit(1), F.coalesce(F.nullif("physical", F.lit(0)), F.lit(1)))
    workers = F.coalesce("workers", F.least(F.lit(4), cores))
    auto = F.greatest(F.lit(1), F.least(F.lit(4), F.floor(cores / workers)))
    return g.select("case_id", F.when((F.col("requested") != 0) | (F.col("provider") != "cpu"), F.col("requested")).otherwise(auto).cast("long").alias("threads"))
