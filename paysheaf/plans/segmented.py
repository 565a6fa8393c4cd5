"""Ordered scans over groups of any size.

A plain window over ``keys`` puts a whole group into one task, so one document
with a third of all rows would decide the run time.  The scans here cut every
group into ordered segments, scan the segments in parallel, and carry one small
row per segment from segment to segment.  The result is the same as that of the
plain window.

``segment`` must be non-decreasing in ``order`` (for example the page number
divided by a block size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGES_PER_SEGMENT = 256


def page_segment(page_ord: str = "page_ord", pages: int = PAGES_PER_SEGMENT) -> Column:
    return F.floor(F.col(page_ord) / pages)


def _before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)


def _join_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    on = [*keys, "_seg"]
    right = carry.select(*[F.col(k).alias(f"_on_{k}") for k in on], "_carry")
    matches = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on]
    return df.join(right, matches, "left").drop(*[f"_on_{k}" for k in on])


def numbered(
    df: DataFrame, keys: list[str], order: list[Column | str], segment: Column, out: str = "rn"
) -> DataFrame:
    """``row_number()`` over ``keys`` by ``order``."""
    # keys and segment as one struct: null keys are equal in it, and the scan and the join with the carry share one shuffle and its sort
    cut = df.withColumn("_seg", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], segment.alias("at")))
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy("_seg").orderBy(*order)))
    # segments are counted, not scanned: the branch needs only the keys
    sizes = cut.groupBy("_seg").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*[f"_seg.k{i}" for i in range(len(keys))]).orderBy("_seg.at").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select("_seg", F.sum("_size").over(before).alias("_carry")).where("_carry > 0")
    return local.join(carry, "_seg", "left").withColumn(out, F.col("_local") + F.coalesce("_carry", F.lit(0).cast("long"))).drop(
        "_seg", "_local", "_carry"
    )


def last_before(
    df: DataFrame, keys: list[str], order: list[str], segment: Column, value: Column, out: str
) -> DataFrame:
    """Last non-null ``value`` strictly before each row, over ``keys`` by ``order``."""
    cut = df.withColumn("_seg", segment).withColumn("_val", value)
    preceding = (
        Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = cut.withColumn("_local", F.last("_val", ignorenulls=True).over(preceding))
    position = F.when(F.col("_val").isNotNull(), F.struct(*order))
    ends = local.groupBy(*keys, "_seg").agg(F.max_by("_val", position).alias("_end"))
    carry = ends.select(*keys, "_seg", F.last("_end", ignorenulls=True).over(_before(keys)).alias("_carry"))
    return _join_carry(local, carry, keys).withColumn(out, F.coalesce("_local", "_carry")).drop(
        "_seg", "_val", "_local", "_carry"
    )
