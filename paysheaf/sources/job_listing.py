"""The list of jobs, newest update first, stored in ranges so that any page reads one of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocab


def _newest_first() -> list:
    return [F.desc("updated_at"), F.asc("job_id")]


class JobListing:
    """A sorted copy of the jobs below ``path``: folders of ``rows_per_range`` jobs or so, and how many jobs and which first one each holds."""

    def __init__(self, spark: SparkSession, path: str, rows_per_range: int = 10_000):
        self.spark, self.path, self.rows_per_range = spark, path.rstrip("/"), rows_per_range

    def write(self, jobs: DataFrame) -> None:
        """Sort and store the jobs; an earlier listing at this path is replaced."""
        n_ranges = max(1, math.ceil(jobs.count() / self.rows_per_range))
        dealt = jobs.repartitionByRange(n_ranges, *_newest_first()).withColumn("range", F.spark_partition_id())
        dealt.sortWithinPartitions("range", *_newest_first()).write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/jobs")
        first = F.min_by(F.struct("updated_at", "job_id"), F.struct(-F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(1 << 62))), "job_id"))
        jobs.limit(0).write.mode("overwrite").parquet(f"{self.path}/columns")
        index = self._jobs().groupBy("range").agg(F.count("*").alias("n"), first.alias("first"))
        index.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index")

    def _jobs(self) -> DataFrame:
        columns = self.spark.read.parquet(f"{self.path}/columns").schema
        return self.spark.read.schema(columns.add("range", "integer")).parquet(f"{self.path}/jobs")

    def _index(self) -> DataFrame:
        """One small row per range; ``upto`` counts its jobs and all before."""
        return self.spark.read.parquet(f"{self.path}/index").withColumn("upto", F.sum("n").over(Window.orderBy("range")))

    def page(self, page: int, size: int = vocab.JOBS_PER_PAGE) -> DataFrame:
        """One page of the list; a page past the end shows the last one. Only the ranges that hold the page are read."""
        index = self._index()
        total = index.agg(F.max("upto")).first()[0] or 0
        skipped = (min(max(page, 1), max(1, -(-total // size))) - 1) * size
        held = index.where((F.col("upto") > skipped) & (F.col("upto") - F.col("n") < skipped + size)).orderBy("range").collect()
        ranges = self._jobs().where(F.col("range").isin([r["range"] for r in held]))
        before = held[0]["upto"] - held[0]["n"] if held else 0
        return ranges.orderBy(*_newest_first()).offset(skipped - before).limit(size).drop("range")

    def after(self, updated_at: str, job_id: str, size: int = vocab.JOBS_PER_PAGE) -> DataFrame:
        """The ``size`` jobs that follow a given one in the list, whatever has been added before it: the range it lies in and, at its end, the next."""
        at = F.lit(updated_at).cast(self._jobs().schema["updated_at"].dataType)
        follows = lambda t, j: (t < at) | t.isNull() | ((t == at) & (j > job_id))
        index = self.spark.read.parquet(f"{self.path}/index")
        begun = index.where(~follows(F.col("first.updated_at"), F.col("first.job_id"))).agg(F.max("range")).first()[0]
        later = index.where(F.col("range") > (-1 if begun is None else begun)).orderBy("range").limit(max(1, -(-size // self.rows_per_range)) + 1)
        ranges = [begun] * (begun is not None) + [r["range"] for r in later.collect()]
        rows = self._jobs().where(F.col("range").isin(ranges)).where(follows(F.col("updated_at"), F.col("job_id")))
        return rows.orderBy(*_newest_first()).limit(size).drop("range")
