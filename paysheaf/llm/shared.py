"""Intermediate tables in the folder that all executors share, and what a Python worker keeps between tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from types import ModuleType
from typing import TypeVar

from pyspark.sql import DataFrame

from ..session import scratch_dir

Made = TypeVar("Made")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so when the driver's collector finds their plans unused."""
    df.sparkSession.sparkContext._jvm.System.gc()


def kept_by_worker(slot: str, key: Hashable, make: Callable[[], Made]) -> Made:
    """What ``make`` gives, made once for all tasks of one Python worker that ask ``slot`` for the same ``key``.

    A slot holds one thing: another key replaces it, so a worker does not grow from run to run. Functions travel to the
    workers by value, with fresh globals for every task, so a module of the interpreter holds what is kept.
    """
    kept = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker")).__dict__
    if slot not in kept or kept[slot][0] != key:
        kept.pop(slot, None)
        kept[slot] = (key, make())
    return kept[slot][1]
