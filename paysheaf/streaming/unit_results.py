"""Unit results and job progress as streams into stored tables, and pending units.

A stream keeps no keyed state: each micro-batch is added to the table that it feeds, which folds the rows of a key
with the same fold as the batch operators. What grows is the table, not the stream's memory, and a
stream that is started again on its checkpoint goes on with the files that it has not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import text
from ..operators.state import UNIT
from ..sources.runs import Fold, RunTable


def unit_rows(stream: DataFrame) -> DataFrame:
    """Result rows as the fold takes them: each is one attempt."""
    return stream.select(*UNIT, "page_number", "result_kind", "value", "executed", "completed_at", "seq", F.lit(1).cast("bigint").alias("attempts"))


def fold_units(rows: DataFrame) -> DataFrame:
    """Newest value and number of attempts per unit."""
    at = F.struct("completed_at", "seq")
    rest = F.struct("page_number", "result_kind", "value", "executed", "completed_at", "seq")
    return rows.groupBy(*UNIT).agg(F.max_by(rest, at).alias("r"), F.sum("attempts").alias("attempts")).select(*UNIT, "r.*", "attempts")


def progress_rows(events: DataFrame) -> DataFrame:
    """Progress events as the fold takes them: each part with the place it was last known at, and the log line."""
    parts = {"current": F.col("current").isNotNull(), "total": F.col("total").isNotNull(), "percentage": F.col("percentage").isNotNull(), "message": text(F.col("message")) != ""}
    known = [F.when(k, F.struct(F.col("seq"), F.col(c).alias("is"))).alias(c) for c, k in parts.items()]
    line = F.when(text(F.col("log")) != "", F.array(F.struct("seq", "log")))
    return events.select("job_id", *known, F.coalesce(line, F.array().cast("array<struct<seq:bigint,log:string>>")).alias("logs"))


def fold_progress(rows: DataFrame, limit: int = vocab.LOG_LINES) -> DataFrame:
    """Latest known parts per job and its last ``limit`` log lines."""
    latest = [F.max_by(c, F.col(f"{c}.seq")).alias(c) for c in ("current", "total", "percentage", "message")]
    heads = rows.groupBy("job_id").agg(*latest)
    lines = rows.select("job_id", F.explode("logs").alias("l")).select("job_id", "l.*")
    return heads.join(last_lines(lines, limit), "job_id", "left").withColumn("logs", F.coalesce("logs", F.array().cast("array<struct<seq:bigint,log:string>>")))


def last_lines(lines: DataFrame, limit: int) -> DataFrame:
    ranked = lines.withColumn("_r", F.expr("row_number() over (partition by job_id order by seq desc)")).where(F.col("_r") <= limit)
    return ranked.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "log"))).alias("logs"))


def progress_table(folded: DataFrame) -> DataFrame:
    """The folded table with the columns of ``state.job_progress``."""
    parts = [F.col(f"{c}.is").alias(c) for c in ("current", "total", "percentage", "message")]
    logs = F.transform("logs", lambda r: r["log"])
    return folded.select("job_id", *parts, logs.alias("logs"), F.size("logs").cast("bigint").alias("log_lines"))


def run_to_table(stream: DataFrame, table: str, checkpoint: str, fold: Fold, keys: list[str], buckets: int = 64) -> None:
    """Fold everything available of ``stream`` into ``table`` and stop; both paths lie in a folder that all machines share.

    A micro-batch adds its own rows as one run (see ``sources.runs``). A batch that is run again after a failure replaces what it left
    unfinished, or adds nothing if it counts already, so every row counts once. A table belongs to one stream.
    """
    stored = RunTable(stream.sparkSession, table, fold, keys, buckets)
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(stored.add).trigger(availableNow=True).start()
    query.awaitTermination()


def read_table(spark: SparkSession, table: str, fold: Fold, keys: list[str]) -> DataFrame:
    """Current row of each key."""
    return RunTable(spark, table, fold, keys).read()


def compact(spark: SparkSession, table: str, fold: Fold, keys: list[str]) -> None:
    """Fold all runs of a table into one, between two runs of its stream."""
    RunTable(spark, table, fold, keys).compact()


def pending(units: DataFrame, done: DataFrame) -> DataFrame:
    """Streamed units that have no result in the static table ``done``."""
    keys = done.select(*UNIT).distinct()
    own = units.join(keys, UNIT, "left_anti")
    whole = keys.where(F.col("result_key").rlike("^page:[0-9]+$")).select(
        F.col("job_id").alias("_job"), F.expr("substring(result_key, 6)").try_cast("long").alias("_page")
    )
    return own.join(whole, (F.col("job_id") == F.col("_job")) & (F.col("page_number") == F.col("_page")), "left_anti")
