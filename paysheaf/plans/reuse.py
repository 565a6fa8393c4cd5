"""Results that a plan reads more than once, owned by the caller.

Spark prunes columns separately for every branch of a plan, so two branches of one
expensive frame rarely share a shuffle and the frame would be computed per branch.
Operators mark such frames with ``shared``. Inside a ``scope`` that the caller opens they are kept in
executor memory and on executor disks until the caller closes it; kept partitions that are lost with an
executor are recomputed. Outside of any scope they are written once below ``spark.checkpoint.dir`` and read
back, so that every branch reads rows instead of computing them again.

    with reuse.scope() as kept:
        rows = unify.unified_items(items, records)
    rows.write.parquet(path)
    kept.close()
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from ..session import stored


class _Kept:
    """A kept frame and how many scopes own it."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.owners = df.persist(StorageLevel.MEMORY_AND_DISK), 0


#: Kept frames by application and plan. Spark keeps equal plans once, so they are dropped with their last owner only.
_kept: dict[tuple[str, int], list[_Kept]] = {}


def _own(df: DataFrame) -> tuple[list[_Kept], _Kept]:
    same = _kept.setdefault((df.sparkSession.sparkContext.applicationId, df.semanticHash()), [])
    for kept in same:
        if kept.df.sameSemantics(df):
            return same, kept
    same.append(_Kept(df))
    return same, same[-1]


class Scope:
    """Frames kept for one caller."""

    def __init__(self) -> None:
        self.frames: list[tuple[list[_Kept], _Kept]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        same, kept = _own(df)
        kept.owners += 1
        self.frames.append((same, kept))
        return df

    def close(self) -> None:
        """Drop what no other scope keeps; results that depend on it are recomputed when used again."""
        while self.frames:
            same, kept = self.frames.pop()
            kept.owners -= 1
            if not kept.owners:
                same.remove(kept)
                kept.df.unpersist()


_active: ContextVar[Scope | None] = ContextVar("scope", default=None)


@contextmanager
def scope() -> Iterator[Scope]:
    """Plans built inside keep their shared frames; they stay after the block until ``close``."""
    opened = Scope()
    before = _active.set(opened)
    try:
        yield opened
    finally:
        _active.reset(before)


def shared(df: DataFrame) -> DataFrame:
    active = _active.get()
    if active is not None:
        return active.keep(df)
    # a stream can't be written here, and Parquet has no column without a type
    return df if df.isStreaming or "void" in df.schema.simpleString() else stored(df, "shared")
