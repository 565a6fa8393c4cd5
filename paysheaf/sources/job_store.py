"""Jobs and what belongs to them, stored by the day they go, so that a sweep drops days instead of rewriting tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import RunTable

_DAY = "sweep_day"


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "added").alias("r")).select(*keys, "r.*")


class JobStore:
    """Jobs and their rows below ``path``. ``clock`` is the time of a job that sweeps go by: ``expires_at``, or ``created_at`` where an age counts.

    That time is given with a job when it is first added and does not change; jobs without it stay. The rows of a job lie on its day too, whatever job they are added to later.
    """

    def __init__(self, spark: SparkSession, path: str, clock: str = "expires_at", dependant_keys: tuple[str, ...] = ("job_id", "result_key")):
        self.clock = clock
        self.jobs_table = RunTable(spark, f"{path}/jobs", lambda d: _last(d, ["job_id"]), ["job_id"], parts=_DAY)
        keys = list(dependant_keys)
        self.rows_table = RunTable(spark, f"{path}/rows", lambda d: _last(d, keys), keys, parts=_DAY)

    def add(self, jobs: DataFrame, rows: DataFrame) -> None:
        """Add jobs, or newer versions of them, and rows of jobs that are stored or added now; a later row of a key replaces an earlier one."""
        day = F.date_format(self.clock, "yyyy-MM-dd").alias(_DAY)
        added = F.lit(self.jobs_table.manifest().version).cast("bigint").alias("added")
        self.jobs_table.add(jobs.select("*", day, added))
        clocks = self.jobs_table.read().select("job_id", F.col(self.clock).alias("sweep_at"), _DAY)
        self.rows_table.add(rows.join(clocks, "job_id").select(*rows.columns, "sweep_at", _DAY, added))

    def sweep(self, before: datetime) -> list[str]:
        """Drop what goes on a day before that of ``before``: both tables' folders of these days, which it gives. Nothing is read or rewritten."""
        day = before.strftime("%Y-%m-%d")
        gone = lambda part: part != "none" and part < day
        return self.jobs_table.drop_parts(gone) + self.rows_table.drop_parts(gone)

    def read(self, now: Column) -> tuple[DataFrame, DataFrame]:
        """Jobs whose time has not passed at ``now``, and their rows; those of the running day are told apart by the hour."""
        jobs, rows = self.jobs_table.read(), self.rows_table.read()
        kept = lambda at: F.col(at).isNull() | (F.col(at) >= now)
        return jobs.where(kept(self.clock)).drop(_DAY, "added"), rows.where(kept("sweep_at")).drop(_DAY, "added", "sweep_at")
