"""Near-duplicate document texts by SimHash fingerprints and covering masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import stored

WORDS_PER_SHINGLE = 3
SEED = 42
RADIUS = 2
_PIECE = 1 << 15


def fingerprint(text: str, width: int = WORDS_PER_SHINGLE) -> int:
    """64 majority bits over the XXH64 of every shingle of ``text``, repeats included; no words: 0."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first, last = np.concatenate([[0], ends[:-width]]).tolist(), (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PIECE):
        bits = np.unpackbits(hashes[at : at + _PIECE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "")
        prints = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])


def fingerprints(document_text: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (bigint bit pattern) of each document text; null texts count as empty."""
    kind = document_text.schema["doc_id"].dataType.simpleString()
    return document_text.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fingerprint bigint")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Bit masks such that every two 64-bit numbers with at most ``radius`` different bits agree under one of them.

    Bit ``i`` gets a non-zero vector ``m(i)`` of ``radius + 1`` bits, and mask ``v`` keeps the bits with odd ``m(i) & v``.
    ``radius`` vectors span at most ``radius`` dimensions, so some non-zero ``v`` is orthogonal to all of them and
    its mask leaves out all the different bits.
    """
    space = 1 << (radius + 1)
    vector = [1 + i % (space - 1) for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, space)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def midpoints(prints: DataFrame) -> DataFrame:
    """``fingerprint, midpoint``: each distinct ``fingerprint`` with a neighbour, itself and with one bit turned that a shared table leaves free.

    Two fingerprints within the radius of 2 share a table and so a midpoint, and all fingerprints of one midpoint (65 at most) are within the radius.
    """
    distinct = prints.select("fingerprint").distinct()
    masks = covering_masks()
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
    masked = distinct.select("fingerprint", F.inline(tables))
    crowded = masked.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    free = F.create_map(*[x for t, m in enumerate(masks) for x in (F.lit(t), F.lit(_signed(~m & (1 << 64) - 1)))])
    near = masked.join(crowded, ["t", "key"]).groupBy("fingerprint").agg(F.bit_or(free[F.col("t")]).alias("free"))
    flips = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)),
        lambda bit: F.col("free").bitwiseAND(bit) != 0,
    )
    points = near.select("fingerprint", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), flips)).alias("bit"))
    return points.select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("bit")).alias("midpoint"))


def links(prints: DataFrame) -> DataFrame:
    """``a, b``: links whose components are those of "at most two different bits", over the distinct ``fingerprint``s.

    A fingerprint that shares no masked value with another has no neighbour and leaves. The others
    emit the *midpoints* near them: themselves, and themselves with one bit turned that a shared table
    leaves free. Two fingerprints within the radius of 2 share a table and so a midpoint, and
    all fingerprints of one midpoint (65 at most) are within the radius. So no bucket is ever paired
    with itself, however many fingerprints it holds.
    """
    groups = midpoints(prints).groupBy("midpoint").agg(F.collect_set("fingerprint").alias("members")).where(F.size("members") > 1)
    return groups.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b").distinct()


def near_duplicates(document_text: DataFrame) -> DataFrame:
    """Groups of document texts whose fingerprints are linked by steps of at most two bits.

    Takes ``doc_id`` (integer), ``text``; gives ``doc_id, fingerprint`` (bigint), ``component_id``: the smallest ``doc_id``
    that can be reached, itself included. Null and empty texts have fingerprint 0 and group like any other.
    Repeated rows of one document come back as often; null ``doc_id``s take part in links and count
    as larger than any other. An empty table gives no rows.
    """
    prints = stored(fingerprints(document_text), "fingerprints")
    group = components(links(prints))
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    least = least.join(group, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")
    )
    least = stored(least, "classes")
    first = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(first, "component").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def first_of_groups(document_text: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: the document with the smallest ``doc_id``.

    Of repeated rows of that document one stays. Documents without ``doc_id`` stay only where their group has no other.
    """
    first = near_duplicates(document_text).select(F.col("component_id").alias("_first")).distinct()
    kept = document_text.join(first.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    return kept.dropDuplicates(["doc_id"])
