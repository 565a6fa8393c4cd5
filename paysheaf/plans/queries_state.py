"""Queries over unit results and jobs, derived from the event table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from .. import session
from ..operators import state
from ..sources import job_listing, job_store, testviews
from ..streaming import unit_results
from .catalogue import query
from .duck import view, with_views

NOW = "2024-01-20 00:00:00"


def event_table(spark, sf, stream: bool = False):
    if not stream:
        return testviews.table(spark, sf, "events")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def results(spark, sf, stream: bool = False):
    events = event_table(spark, sf, stream)
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").cast("string").alias("job_id"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("page:"), F.col("event_id") % 7)).otherwise(F.concat(F.lit("page:"), F.col("event_id") % 7, F.lit(":"), "event_type")).alias("result_key"),
        (F.col("event_id") % 7).alias("page_number"), F.when(F.col("event_type") == "purchase", "final").otherwise("checkpoint").alias("result_kind"),
        F.col("props").alias("value"), (k > 20).cast("int").alias("executed"), F.col("ts").alias("completed_at"), F.col("event_id").alias("seq"),
    )


view(
    "v_res",
    [],
    """SELECT CAST(user_id AS VARCHAR) AS job_id, CASE WHEN event_type = 'view' THEN 'page:' || (event_id % 7) ELSE 'page:' || (event_id % 7) || ':' || event_type END AS result_key,
         event_id % 7 AS page_number, CASE WHEN event_type = 'purchase' THEN 'final' ELSE 'checkpoint' END AS result_kind, props AS value,
         CAST(CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) > 20 AS INTEGER) AS executed, ts AS completed_at, event_id AS seq FROM events""",
)
view(
    "v_latest",
    ["v_res"],
    """SELECT job_id, result_key, arg_max(page_number, (completed_at, seq)) AS page_number, arg_max(result_kind, (completed_at, seq)) AS result_kind, arg_max(value, (completed_at, seq)) AS value,
         arg_max(executed, (completed_at, seq)) AS executed, max(completed_at) AS completed_at, count(*) AS attempts FROM v_res GROUP BY 1, 2""",
)
LATEST = "SELECT job_id, result_key, page_number, result_kind, value, executed, strftime(completed_at, '%Y-%m-%d %H:%M:%S.%f') AS completed_at, attempts FROM v_latest"


def _printed(df):
    return df.withColumn("completed_at", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def _streamed(spark, rows, fold, keys):
    """The table that a stream over everything available leaves, in a fresh folder of the session."""
    root = session.scratch_dir(spark, "stream")
    unit_results.run_to_table(rows, f"{root}/table", f"{root}/checkpoint", fold, keys)
    return unit_results.read_table(spark, f"{root}/table", fold, keys)


@query("checkpoint_latest", with_views(["v_latest"], LATEST))
def checkpoint_latest(spark, sf):
    return _printed(state.latest_results(results(spark, sf)))


@query("checkpoint_stream", with_views(["v_latest"], LATEST))
def checkpoint_stream(spark, sf):
    rows = unit_results.unit_rows(results(spark, sf, stream=True))
    return _printed(_streamed(spark, rows, unit_results.fold_units, state.UNIT).drop("seq"))


@query("verified_results", with_views(["v_latest"], "SELECT job_id, result_key, page_number, executed FROM v_latest WHERE executed > 0"))
def verified_results(spark, sf):
    return state.verified(state.latest_results(results(spark, sf))).select("job_id", "result_key", "page_number", "executed")


@query("execution_gate", with_views(["v_latest"], "SELECT job_id, count(*) AS units, count(*) FILTER (executed <= 0) AS unconfirmed FROM v_latest GROUP BY 1"))
def execution_gate(spark, sf):
    latest = state.latest_results(results(spark, sf))
    return state.execution_gate(latest)


PENDING = """SELECT DISTINCT u.job_id, u.result_key, u.page_number FROM v_res u
  WHERE NOT EXISTS (SELECT 1 FROM v_latest d WHERE d.executed > 0 AND d.job_id = u.job_id AND (d.result_key = u.result_key OR d.result_key = 'page:' || u.page_number))"""


def _units(df):
    return df.select("job_id", "result_key", "page_number")


@query("pending_units", with_views(["v_latest", "v_res"], PENDING))
def pending_units(spark, sf):
    done = state.verified(state.latest_results(results(spark, sf)))
    return state.pending_units(_units(results(spark, sf)).distinct(), done)


@query("pending_stream", with_views(["v_latest", "v_res"], PENDING))
def pending_stream(spark, sf):
    done = state.verified(state.latest_results(results(spark, sf)))
    live = unit_results.pending(_units(results(spark, sf, stream=True)), done)
    return _streamed(spark, live, lambda rows: rows.distinct(), ["job_id", "result_key"])


@query("completed_pages", with_views(["v_latest"], "SELECT job_id, CAST(substr(result_key, 6) AS INTEGER) AS page_number FROM v_latest WHERE result_kind = 'checkpoint' AND regexp_full_match(result_key, 'page:[0-9]+')"))
def completed_pages(spark, sf):
    return state.page_numbers(state.latest_results(results(spark, sf)))


def job_events(spark, sf, stream: bool = False):
    e = event_table(spark, sf, stream)
    kind = F.when(F.col("event_type") == "click", "retry").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("progress")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.when(k % 2 == 0, F.col("props")).alias("error"),
        F.when(F.col("event_type") == "view", k).alias("current"), F.when(F.col("event_type") == "signup", k).alias("total"),
        F.when(F.col("event_id") % 5 == 0, k).alias("percentage"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("message"),
        F.concat("event_type", F.lit(" "), "event_id").alias("log"), "ts",
    )


view(
    "v_jev",
    [],
    """SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, CASE event_type WHEN 'click' THEN 'retry' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'progress' END AS event,
         CASE WHEN k % 2 = 0 THEN props END AS error, CASE WHEN event_type = 'view' THEN k END AS current, CASE WHEN event_type = 'signup' THEN k END AS total,
         CASE WHEN event_id % 5 = 0 THEN k END AS percentage, CASE WHEN event_id % 3 = 0 THEN event_type END AS message, event_type || ' ' || event_id AS log, ts
       FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
)
view(
    "v_status",
    ["v_jev"],
    """SELECT job_id, arg_max(state, seq) AS status, count(*) FILTER (event = 'retry' AND before <> 'processando') AS retry_count, max(seq) AS last_seq,
         arg_max(CASE WHEN event = 'fail' THEN coalesce(nullif(error, ''), 'Erro interno no processamento do documento') ELSE '' END, seq) FILTER (event IN ('fail', 'retry')) AS last_error
       FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY job_id ORDER BY seq), 'processando') AS before
             FROM (SELECT *, CASE event WHEN 'complete' THEN 'concluido' WHEN 'fail' THEN 'erro' ELSE 'processando' END AS state FROM v_jev WHERE event <> 'progress')) GROUP BY 1""",
)


@query("job_status", with_views(["v_status"], "SELECT * REPLACE (nullif(last_error, '') AS last_error) FROM v_status"))
def job_status(spark, sf):
    return state.job_status(job_events(spark, sf))


PROGRESS = """SELECT job_id, arg_max(current, seq) FILTER (current IS NOT NULL) AS current, arg_max(total, seq) FILTER (total IS NOT NULL) AS total,
             arg_max(percentage, seq) FILTER (percentage IS NOT NULL) AS percentage, arg_max(message, seq) FILTER (message IS NOT NULL) AS message, least(count(*), 100) AS log_lines,
             list_aggregate(list(log ORDER BY seq)[-100:], 'string_agg', '|') AS logs FROM v_jev GROUP BY 1"""


@query("job_progress", with_views(["v_jev"], PROGRESS))
def job_progress(spark, sf):
    return state.job_progress(job_events(spark, sf)).withColumn("logs", F.array_join("logs", "|"))


@query("progress_stream", with_views(["v_jev"], PROGRESS))
def progress_stream(spark, sf):
    rows = unit_results.progress_rows(job_events(spark, sf, stream=True))
    folded = _streamed(spark, rows, unit_results.fold_progress, ["job_id"])
    return unit_results.progress_table(folded).withColumn("logs", F.array_join("logs", "|"))


@query("unit_progress", with_views(["v_latest"], "SELECT job_id, c AS current, t AS total, CAST(least(95, floor(10 + c / t * 85 + 0.5)) AS INTEGER) AS percentage FROM (SELECT job_id, count(*) FILTER (executed > 0) AS c, count(*) AS t FROM v_latest GROUP BY 1)"))
def unit_progress(spark, sf):
    return state.unit_progress(state.latest_results(results(spark, sf)).withColumn("done", F.col("executed") > 0))


def jobs(spark, sf):
    e = testviews.table(spark, sf, "events")
    per = e.groupBy(F.col("user_id").cast("string").alias("job_id")).agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.count("*").alias("n"))
    status = F.when(F.col("n") % 3 == 0, "concluido").when(F.col("n") % 3 == 1, "erro").otherwise("processando")
    shift = F.when(F.col("n") % 4 == 0, F.col("created_at") + F.expr("interval 10 days")).when(F.col("n") % 4 == 1, F.col("created_at") + F.expr("interval 90 days"))
    return per.select(
        "job_id", status.alias("status"), "updated_at", (F.col("created_at") + F.make_interval(hours=(F.col("n") * 7 % 480).cast("int"))).alias("created_at"), shift.alias("expires_at"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("Holerite-"), "job_id", F.lit(".pdf"))).alias("file_name"), F.when(F.col("n") % 5 == 0, "outro").otherwise("holerite").alias("document_type"),
    )


view(
    "v_jobs",
    [],
    """SELECT job_id, CASE n % 3 WHEN 0 THEN 'concluido' WHEN 1 THEN 'erro' ELSE 'processando' END AS status, updated_at, created + to_hours(n * 7 % 480) AS created_at,
         CASE n % 4 WHEN 0 THEN created + INTERVAL 10 DAY WHEN 1 THEN created + INTERVAL 90 DAY END AS expires_at, CASE WHEN n % 2 = 0 THEN 'Holerite-' || job_id || '.pdf' END AS file_name,
         CASE WHEN n % 5 = 0 THEN 'outro' ELSE 'holerite' END AS document_type
       FROM (SELECT CAST(user_id AS VARCHAR) AS job_id, min(ts) AS created, max(ts) AS updated_at, count(*) AS n FROM events GROUP BY 1)""",
)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(
    "retention",
    with_views(["v_jobs", "v_latest"], f"SELECT d.job_id, d.result_key FROM v_latest d JOIN v_jobs j USING (job_id) WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 240 HOUR"),
)
def retention(spark, sf):
    return state.purge_older_than(jobs(spark, sf), state.latest_results(results(spark, sf)), now(), hours=240)[1].select("job_id", "result_key")


@query(
    "expiry",
    with_views(["v_jobs", "v_latest"], f"SELECT d.job_id, d.result_key FROM v_latest d JOIN v_jobs j USING (job_id) WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{NOW}'"),
)
def expiry(spark, sf):
    return state.expire(jobs(spark, sf), state.latest_results(results(spark, sf)), now())[1].select("job_id", "result_key")


@query(
    "expiry_stored",
    with_views(["v_jobs", "v_latest"], f"SELECT d.job_id, d.result_key, d.attempts FROM v_latest d JOIN v_jobs j USING (job_id) WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{NOW}'"),
)
def expiry_stored(spark, sf):
    store = job_store.JobStore(spark, session.scratch_dir(spark, "jobs"))
    store.add(jobs(spark, sf), state.latest_results(results(spark, sf)))
    store.sweep(datetime.fromisoformat(NOW))
    return store.read(now())[1].select("job_id", "result_key", "attempts")


@query(
    "retention_stored",
    with_views(["v_jobs"], f"SELECT job_id, status FROM v_jobs WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 240 HOUR"),
)
def retention_stored(spark, sf):
    before = datetime.fromisoformat(NOW) - timedelta(hours=240)
    store = job_store.JobStore(spark, session.scratch_dir(spark, "jobs"), clock="created_at")
    store.add(jobs(spark, sf), state.latest_results(results(spark, sf)))
    store.sweep(before)
    return store.read(F.lit(before).cast("timestamp_ntz"))[0].select("job_id", "status")


@query("delete_jobs", with_views(["v_jobs", "v_latest"], "SELECT d.job_id, d.result_key FROM v_latest d JOIN v_jobs j USING (job_id) WHERE status <> 'erro'"))
def delete_jobs(spark, sf):
    j = jobs(spark, sf)
    return state.delete_jobs(j, state.latest_results(results(spark, sf)), j.where("status = 'erro'"))[1].select("job_id", "result_key")


@query(
    "job_results",
    with_views(
        ["v_jobs", "v_latest"],
        """SELECT l.job_id, l.page_number, l.result_key, l.value FROM v_latest l JOIN v_jobs j USING (job_id) WHERE status = 'concluido' AND result_kind = 'final' AND page_number <> CAST(job_id AS BIGINT) % 7
           AND CAST(job_id AS BIGINT) % 3 <> 0
           UNION ALL SELECT r.job_id, r.page_number, 'page:' || r.page_number, arg_max(r.value, r.seq) FROM v_res r JOIN v_jobs j USING (job_id) WHERE status = 'concluido'
             AND job_id NOT IN (SELECT job_id FROM v_latest WHERE result_kind = 'final' AND page_number <> CAST(job_id AS BIGINT) % 7 AND CAST(job_id AS BIGINT) % 3 <> 0) GROUP BY 1, 2""",
    ),
)
def job_results(spark, sf):
    res = results(spark, sf)
    kept = state.latest_results(res).where((F.col("page_number") != F.col("job_id").cast("long") % 7) & (F.col("job_id").cast("long") % 3 != 0))
    legacy = res.groupBy("job_id", "page_number").agg(F.max_by("value", "seq").alias("value"))
    return state.job_results(jobs(spark, sf), kept, legacy)


@query(
    "replace_final",
    with_views(
        ["v_latest"],
        """SELECT job_id, result_key, page_number, result_kind, attempts FROM v_latest WHERE result_kind <> 'final' OR CAST(job_id AS BIGINT) % 2 <> 0
           UNION ALL SELECT DISTINCT job_id, printf('final:%05d', page_number), page_number, 'final', 1 FROM v_latest WHERE CAST(job_id AS BIGINT) % 2 = 0""",
    ),
)
def replace_final(spark, sf):
    latest = state.latest_results(results(spark, sf))
    finals = latest.where(F.col("job_id").cast("long") % 2 == 0).groupBy("job_id", "page_number").agg(F.min("value").alias("value"), F.max("completed_at").alias("completed_at")).withColumn("position", F.col("page_number"))
    return state.replace_final(latest, finals).drop("value", "completed_at")


@query("job_search", with_views(["v_jobs"], "SELECT job_id, status, file_name FROM v_jobs WHERE status = 'concluido' AND contains(lower(coalesce(file_name, job_id)), '1')"))
def job_search(spark, sf):
    return state.search(jobs(spark, sf), " 1 ", "concluido").select("job_id", "status", "file_name")


@query("job_page", with_views(["v_jobs"], "SELECT job_id, status FROM v_jobs ORDER BY updated_at DESC, job_id LIMIT 10 OFFSET 10"))
def job_page(spark, sf):
    listing = job_listing.JobListing(spark, session.scratch_dir(spark, "listing"))
    listing.write(jobs(spark, sf))
    return listing.page(2).select("job_id", "status")


@query("job_counts", with_views(["v_jobs"], "SELECT count(*) AS total, count(*) FILTER (status = 'concluido') AS completed, count(*) FILTER (status = 'processando') AS running, count(*) FILTER (status = 'erro') AS failed FROM v_jobs"))
def job_counts(spark, sf):
    return state.status_counts(jobs(spark, sf))


@query("job_types", with_views(["v_jobs"], "SELECT job_id, status = 'concluido' AND file_name IS NOT NULL AS completed FROM v_jobs WHERE document_type = 'holerite'"))
def job_types(spark, sf):
    return state.supported(jobs(spark, sf)).select("job_id", state.is_completed(F.col("status"), F.col("file_name")).alias("completed"))
