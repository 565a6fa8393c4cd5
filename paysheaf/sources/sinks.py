"""Writers of export tables and of unit results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import RunTable

FORMATS = ("xlsx", "csv", "json", "parquet")


def file_name(job_id: str, document_type: str, fmt: str) -> str:
    return f"transcricao_{job_id}_{document_type}.{fmt.lower()}"


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Header and rows, every cell quoted, quotes doubled."""
    cells = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    cells.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def export(df: DataFrame, path: str, fmt: str = "xlsx", mode: str = "error") -> None:
    """Write an export table; a spreadsheet (``xlsx``, also where no format is given) is written as CSV with the same cells."""
    chosen = (fmt or "xlsx").lower()
    if chosen not in FORMATS:
        raise ValueError(f"unknown export format: {fmt}")
    if chosen in ("xlsx", "csv"):
        write_csv(df, path, mode)
    elif chosen == "json":
        write_json(df, path, mode)
    else:
        df.write.mode(mode).parquet(path)


_RESULT = ["job_id", "result_kind"]


def _newest(rows: DataFrame) -> DataFrame:
    """The rows of the last replacement of each job and kind."""
    last = rows.groupBy(*_RESULT).agg(F.max("generation").alias("_last"))
    return rows.join(last, _RESULT).where(F.col("generation") == F.col("_last")).drop("_last")


def result_store(spark: SparkSession, path: str, buckets: int = 64) -> RunTable:
    return RunTable(spark, path, _newest, _RESULT, buckets)


def write_results(results: DataFrame, path: str, buckets: int = 64) -> None:
    """Replace the stored results of the given jobs and kinds; all other jobs keep theirs.

    Only the given rows are written. They count from the moment that their manifest appears; a writer that is killed before
    leaves the old results readable. Rows without a job or kind are an error.
    """
    store = result_store(results.sparkSession, path, buckets)
    for c in _RESULT:
        results = results.withColumn(c, F.coalesce(c, F.raise_error(F.lit(f"result without {c}")).cast("string")))
    store.add(results.withColumn("generation", F.lit(store.manifest().version + 1).cast("bigint")))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The stored results of all jobs."""
    return result_store(spark, path).read().drop("generation")
