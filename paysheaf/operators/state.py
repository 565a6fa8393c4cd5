"""Unit results and jobs as tables: upsert, resume, progress, retention, listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, vocab
from ..functions.text import first_filled, text
from ..plans import segmented

UNIT = ["job_id", "result_key"]


def latest_results(results: DataFrame) -> DataFrame:
    """Keyed upsert: the newest row of a unit wins, attempts count its rows."""
    at = F.struct("completed_at", "seq")
    rest = ["page_number", "result_kind", "value", "executed"]
    return results.groupBy(*UNIT).agg(
        F.max_by(F.struct(*rest), at).alias("r"), F.max("completed_at").alias("completed_at"), F.count("*").alias("attempts")
    ).select(*UNIT, "r.*", "completed_at", "attempts")


def verified(results: DataFrame) -> DataFrame:
    """Results with at least one confirmed execution."""
    return results.where(F.coalesce(F.col("executed"), F.lit(0)) > 0)


def execution_gate(results: DataFrame) -> DataFrame:
    """Units and units without a confirmed execution per job; an unknown execution is not confirmed."""
    return results.groupBy("job_id").agg(
        F.count("*").alias("units"), F.count_if(F.coalesce(F.col("executed"), F.lit(0)) <= 0).alias("unconfirmed")
    )


def assert_verified(results: DataFrame) -> DataFrame:
    """Fail when a unit has no confirmed execution; the input is returned unchanged."""
    unconfirmed = execution_gate(results).agg(F.sum("unconfirmed")).first()[0]
    if unconfirmed:
        raise ValueError(f"REQUIRED_EXECUTION_MISSING: {unconfirmed} unit(s) without a confirmed execution")
    return results


def pending_units(units: DataFrame, done: DataFrame) -> DataFrame:
    """Units without a result under their own key or under the key of their whole page."""
    keys = done.select(*UNIT).distinct()
    page_key = F.concat(F.lit("page:"), F.col("page_number").cast("string"))
    left = units.join(keys, UNIT, "left_anti").withColumn("_own", F.col("result_key")).withColumn("result_key", page_key)
    return left.join(keys, UNIT, "left_anti").withColumn("result_key", F.col("_own")).drop("_own")


def page_numbers(results: DataFrame) -> DataFrame:
    """Numbers of pages completed as a whole (keys ``page:N`` only)."""
    plain = results.where((F.col("result_kind") == "checkpoint") & F.col("result_key").rlike("^page:[0-9]+$"))
    return plain.select("job_id", F.expr("substring(result_key, 6)").try_cast("int").alias("page_number"))


def job_results(jobs: DataFrame, results: DataFrame, legacy: DataFrame) -> DataFrame:
    """Final rows of completed jobs; jobs without any fall back to their older page rows."""
    done = jobs.where(F.col("status") == "concluido").select("job_id")
    final = results.where(F.col("result_kind") == "final").join(done, "job_id", "left_semi").select("job_id", "page_number", "result_key", "value")
    without = done.join(final.select("job_id").distinct(), "job_id", "left_anti")
    older = legacy.join(without, "job_id", "left_semi").select(
        "job_id", "page_number", F.concat(F.lit("page:"), F.col("page_number").cast("string")).alias("result_key"), "value"
    )
    return final.unionByName(older)


def replace_final(results: DataFrame, finals: DataFrame) -> DataFrame:
    """Results with the final rows of the given jobs replaced.

    ``finals``: job_id, position (0, 1, ...), page_number (nullable), value, completed_at.
    """
    fresh = finals.select(
        "job_id", F.format_string("final:%05d", F.col("position").cast("int")).alias("result_key"),
        F.coalesce("page_number", F.col("position") + 1).cast("long").alias("page_number"), F.lit("final").alias("result_kind"),
        "value", "completed_at", F.lit(1).cast("long").alias("attempts"),
    )
    jobs = finals.select("job_id").distinct()
    old_final = (F.col("result_kind") == "final")
    kept = results.where(~old_final).unionByName(results.where(old_final).join(jobs, "job_id", "left_anti"))
    return kept.select(*fresh.columns).unionByName(fresh)


def job_status(events: DataFrame) -> DataFrame:
    """Status of a job from its ordered events (retry, complete, fail).

    A retry while the job runs changes nothing, so only a retry right after a finished or
    failed state counts.
    """
    state = F.when(F.col("event") == "complete", "concluido").when(F.col("event") == "fail", "erro").otherwise("processando")
    marked = events.where(F.col("event").isin("retry", "complete", "fail")).withColumn("state", state)
    marked = segmented.last_before(marked, ["job_id"], ["seq"], F.floor(F.col("seq") / 65536), F.col("state"), "before")
    marked = marked.withColumn("before", F.coalesce("before", F.lit("processando")))
    counted = (F.col("event") == "retry") & (F.col("before") != "processando")
    failure = F.when(F.col("event") == "fail", first_filled(F.col("error"), F.lit("Erro interno no processamento do documento")))
    return marked.groupBy("job_id").agg(
        F.max_by("state", "seq").alias("status"), F.count_if(counted).alias("retry_count"),
        F.max_by(failure, F.when(F.col("event").isin("fail", "retry"), F.col("seq"))).alias("last_error"),
        F.max("seq").alias("last_seq"),
    )


def job_progress(events: DataFrame, logs: int = vocab.LOG_LINES) -> DataFrame:
    """Latest known current, total, percentage and message of a job, and its last log lines."""
    def latest(name: str, known: Column) -> Column:
        return F.max_by(name, F.when(known, F.col("seq"))).alias(name)

    heads = events.groupBy("job_id").agg(
        latest("current", F.col("current").isNotNull()), latest("total", F.col("total").isNotNull()),
        latest("percentage", F.col("percentage").isNotNull()), latest("message", text(F.col("message")) != ""),
    )
    return heads.join(last_logs(events, logs), "job_id", "left").na.fill(0, ["log_lines"])


def last_logs(events: DataFrame, limit: int = vocab.LOG_LINES) -> DataFrame:
    """The last ``limit`` log lines of every job in order.

    The rank filter drops older lines in every task before the shuffle.
    """
    w = Window.partitionBy("job_id").orderBy(F.col("seq").desc())
    kept = events.where(text(F.col("log")) != "").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    rows = F.array_sort(F.collect_list(F.struct("seq", "log")))
    return kept.groupBy("job_id").agg(F.transform(rows, lambda r: r["log"]).alias("logs"), F.count("*").alias("log_lines"))


def unit_progress(units: DataFrame) -> DataFrame:
    """Percent done per job (units: job_id, done)."""
    counted = units.groupBy("job_id").agg(F.count_if("done").alias("current"), F.count("*").alias("total"))
    return counted.withColumn("percentage", dates.progress_percent(F.col("current"), F.col("total")))


def purge_older_than(jobs: DataFrame, dependants: DataFrame, now: Column, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """Jobs younger than the retention time and the rows that belong to them."""
    kept = jobs.where(F.col("created_at") >= now - F.make_interval(hours=F.lit(hours)))
    return kept, dependants.join(kept.select("job_id"), "job_id", "left_semi")


def expire(jobs: DataFrame, dependants: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Drop jobs past their own expiry time and their rows; no expiry means they stay."""
    gone = jobs.where(F.col("expires_at").isNotNull() & (F.col("expires_at") < now)).select("job_id")
    return jobs.join(gone, "job_id", "left_anti"), dependants.join(gone, "job_id", "left_anti")


def delete_jobs(jobs: DataFrame, dependants: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = ids.select("job_id")
    return jobs.join(keys, "job_id", "left_anti"), dependants.join(keys, "job_id", "left_anti")


def supported(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("document_type") == "holerite")


def is_completed(status: Column, value: Column) -> Column:
    return F.coalesce((status == "concluido") & value.isNotNull(), F.lit(False))


def list_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs, newest update first."""
    return jobs.orderBy(F.desc("updated_at"), "job_id")


def search(jobs: DataFrame, words: str = "", status: str = "todos") -> DataFrame:
    """Jobs by status and by a part of their file name (or id), ignoring case."""
    named = F.lower(first_filled(F.col("file_name"), F.col("job_id"))).contains(words.strip().lower())
    return jobs.where(named if status == "todos" else named & (F.col("status") == status))


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "concluido").alias("completed"),
        F.count_if(F.col("status") == "processando").alias("running"), F.count_if(F.col("status") == "erro").alias("failed"),
    )
