"""Near-duplicate document texts: SimHash neighbours and shared min-hash bands, by exact similarity of their five-word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .components import components
from .shared import stored
from .simhash import fingerprint, midpoints

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Texts are compared if all min-hashes of a band agree: of pairs with similarity 0.8 about 1 in 14,000 agrees in no band.
BANDS, ROWS = 24, 5
#: Sets that are opened together.
_SET_ROWS = 256
#: Each round takes this many times the pivots of the round before.
GROWTH = 8


def shingle_sets(texts: bytetext.Texts) -> list[np.ndarray]:
    """Sorted distinct hashes of the five-word shingles of each text; a shorter text is one shingle, one without words has none."""
    words, n = texts.hashes(), np.diff(texts.bounds)
    shingle, _ = texts.windows(words, SHINGLE_WORDS)
    out = []
    for at, size in zip(texts.bounds[:-1].tolist(), n.tolist()):
        if size >= SHINGLE_WORDS:
            out.append(np.unique(shingle[at : at + size - SHINGLE_WORDS + 1]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(words[at : at + size].tobytes())] if size else [], np.uint64))
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    odd = bytetext.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    salt = bytetext.mix(np.arange(1, BANDS + 1, dtype=np.uint64) + np.uint64(1 << 32))
    for batch in batches:
        for part in bytetext.chunks(batch):
            sets = shingle_sets(bytetext.parse(part.column("text")))
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64)
            full = np.flatnonzero([len(s) > 0 for s in sets])
            keys = np.zeros((len(sets), BANDS), np.uint64)
            if len(full):
                flat = np.concatenate([sets[i] for i in full])
                first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
                for band in range(BANDS):
                    key = np.full(len(full), salt[band])
                    for row in range(ROWS):
                        key = bytetext.mix(key * np.uint64(0xD1342543DE82EF95) + np.minimum.reduceat(flat * odd[band * ROWS + row], first))
                    keys[full, band] = key
            ends = np.concatenate([[0], np.cumsum(np.where([len(s) > 0 for s in sets], BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].reshape(-1).view(np.int64)))
            prints = np.fromiter((fingerprint(t.as_py() or "") for t in part.column("text")), np.uint64, len(part))
            columns = [part.column("doc_id"), pa.array(node.view(np.int64)), pa.array(prints.view(np.int64)), bands]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "fingerprint", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bytetext.chunks(batch):
            sets = [s.tobytes() for s in shingle_sets(bytetext.parse(part.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(s) for s in sets], pa.uint64()).view(pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for mine, theirs in zip(batch.column("mine"), batch.column("theirs")):
            x, y = np.frombuffer(mine.as_buffer(), np.uint64), np.frombuffer(theirs.as_buffer(), np.uint64)
            if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
                good.append(False)
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(both >= SIMILARITY * (len(x) + len(y) - both))
        kept = batch.filter(pa.array(good, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])


def _each_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), _SET_ROWS):
            part = batch.slice(at, _SET_ROWS)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("shingles")]
            sizes = np.array([len(x) for x in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            columns = [np.repeat(part.column("node").to_numpy(), sizes), np.repeat(sizes, sizes), flat]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "size", "shingle"])


def prefixes(sets: DataFrame) -> DataFrame:
    """``key, node, size, place``: rare shingles of each set and their place in it, of which any two sets with similarity ``SIMILARITY`` share one.

    In one order of all shingles, rarest first, two sets that have enough in common share one of the first ``size - least + 1``
    shingles of each, where ``least`` is what the set must have in common with any other. Shingles of one set only fill places there but link
    nothing. So texts that share a frequent part and not much else never meet.
    """
    each = sets.mapInArrow(_each_shingle, "node bigint, size bigint, shingle bigint")
    counts = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    common = each.join(counts, "shingle")
    rank = F.expr("row_number() over (partition by node order by n, shingle)")
    own = F.expr("size - count(*) over (partition by node)")
    first = F.col("size") - F.ceil(F.col("size") * SIMILARITY - 1e-9) + 1
    kept = common.select("node", "size", "shingle", rank.alias("rank"), own.alias("own")).where(F.col("rank") <= first - F.col("own"))
    return kept.select(F.col("shingle").alias("key"), "node", "size", (F.col("rank") + F.col("own")).alias("place"))


def _can_be_similar(size: Column, place: Column, other_size: Column, other_place: Column) -> Column:
    """Whether two sets can have enough in common if the shingles at these places are the first that they share: that one and what comes after it."""
    least = F.ceil((size + other_size) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)
    return 1 + F.least(size - place, other_size - other_place) >= least


def simhash_keys(signatures: DataFrame) -> DataFrame:
    """``node, key``: fingerprints, and midpoints of those at most two bits apart, of the texts of each node that has words."""
    prints = signatures.where(F.size("bands") > 0).select("node", "fingerprint").distinct()
    points = midpoints(prints).union(prints.select("fingerprint", F.col("fingerprint").alias("midpoint")))
    return prints.join(points.distinct(), "fingerprint").select("node", F.xxhash64(F.lit("simhash"), "midpoint").alias("key"))


class _Groups:
    """Pairs compared so far and the components of those that are similar."""

    def __init__(self, sets: DataFrame):
        self.sets, self.spark = sets, sets.sparkSession
        self.compared = self.spark.createDataFrame([], "a bigint, b bigint")
        self.found, self.group = self.compared, None

    def named(self, rows: DataFrame) -> DataFrame:
        """Adds ``component``, the node itself where nothing is linked to it."""
        if self.group is None:
            return rows.withColumn("component", F.col("node"))
        return rows.join(self.group, "node", "left").withColumn("component", F.coalesce("component", "node"))

    def compare(self, pairs: DataFrame) -> None:
        """Compare pairs of nodes that were not compared before, and link the similar ones."""
        pairs = stored(pairs.distinct().join(self.compared, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            return
        self.compared = self.compared.union(pairs)
        # the set of the pivot, which many pairs may share, comes last and is not moved again
        both = pairs.join(self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("theirs")), "b")
        both = both.join(self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("mine")), "a").select("a", "b", "mine", "theirs")
        similar = stored(both.mapInArrow(_similar, "a bigint, b bigint"), "similar")
        if not similar.isEmpty():
            self.found = self.found.union(similar)
            self.group = stored(components(self.found), "groups")

    def meet(self, rows: DataFrame, rounds: int | None = None) -> None:
        """Compare the nodes of each key with pivots of it: first with its smallest node, in later rounds with about 8, 64, ...
        others, until each two of a key are compared or linked, or for so many ``rounds``. Takes ``key, node``, rows distinct; with ``size`` and
        ``place`` (``prefixes``) two nodes are only compared where they can be similar if the key is the first that they share."""
        placed = [c for c in ("size", "place") if c in rows.columns]
        shared = rows.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
        rows = rows.join(stored(shared, "keys"), "key")
        turn = F.greatest(F.lit(1), F.ceil(F.log(float(GROWTH), F.pmod(F.xxhash64("key", "node"), F.col("n")) + 1) - 1e-9).cast("int"))
        rows = stored(rows.select("key", "node", *placed, F.when(F.col("node") == F.col("least"), 0).otherwise(turn).alias("turn")), "members")
        last = rows.agg(F.max("turn")).first()[0]
        for now in range(-1 if last is None else last + 1 if rounds is None else rounds):
            left = stored(self.named(rows).where(F.col("turn") >= now), "left")
            pivots = left.where(F.col("turn") == now).select("key", F.col("node").alias("p"), F.col("component").alias("of"), *[F.col(c).alias(f"p_{c}") for c in placed])
            wanted = (F.col("component") != F.col("of")) & ((F.col("turn") > now) | (F.col("node") > F.col("p")))
            if placed:
                wanted = wanted & _can_be_similar(F.col("size"), F.col("place"), F.col("p_size"), F.col("p_place"))
            pairs = left.join(pivots, "key").where(wanted)
            self.compare(pairs.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")))


def links(document_text: DataFrame, signatures: DataFrame) -> DataFrame:
    """``node, component`` of nodes (texts with equal shingle sets) that chains of similar texts link.

    Texts whose SimHash fingerprints are at most two bits apart, and texts that share a band, are compared with the smallest node of the midpoint or band, which settles near copies. Where a band still has more than one component, its
    texts may share a part without being similar, and as many as there are could be compared each with each; these meet by ``prefixes`` instead, which part
    them unless they can be similar, with more pivots round after round until each two of a prefix shingle are compared or linked.
    """
    spark = signatures.sparkSession
    rows = stored(signatures.select("node", F.explode("bands").alias("key")).union(simhash_keys(signatures)).distinct(), "bands")
    several = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(several.select("key"), "key", "left_semi")
    first = signatures.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("doc"))
    wanted = rows.select("node").distinct().join(first, "node").select(F.col("doc.doc_id").alias("_id"))
    texts = document_text.select("doc_id", "text").join(wanted.distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = stored(texts.select("text").mapInArrow(_sets, "node bigint, shingles binary").dropDuplicates(["node"]), "shingles")
    groups = _Groups(sets)
    groups.meet(rows, rounds=1)
    named = groups.named(rows)
    mixed = named.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select("key")
    unsettled = stored(named.join(mixed, "key", "left_semi").select("node").distinct(), "unsettled")
    if not unsettled.isEmpty():
        groups.meet(stored(prefixes(sets.join(unsettled, "node", "left_semi")), "prefixes"))
    return spark.createDataFrame([], "node bigint, component bigint") if groups.group is None else groups.group


def near_duplicates(document_text: DataFrame) -> DataFrame:
    """``doc_id, component_id``: the smallest ``doc_id`` that texts with Jaccard similarity of at least ``SIMILARITY`` link to each document.

    Takes ``doc_id`` (integer), ``text``. Words with A-Z in lower case; texts without words are equal. Repeated rows come back as often;
    null ``doc_id``s take part in links and count as larger than any other. An empty table gives no rows.
    """
    kind = document_text.schema["doc_id"].dataType.simpleString()
    signatures = stored(document_text.select("doc_id", "text").mapInArrow(_signatures, f"doc_id {kind}, node bigint, fingerprint bigint, bands array<bigint>"), "signatures")
    group = links(document_text, signatures)
    least = signatures.groupBy("node").agg(F.min("doc_id").alias("least"))
    least = least.join(group, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = stored(least, "classes")
    first = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = least.join(first, "component").select("node", "component_id")
    return signatures.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def first_of_groups(document_text: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: the document with the smallest ``doc_id``.

    Of repeated rows of that document one stays. Documents without ``doc_id`` stay only where their group has no other.
    """
    first = near_duplicates(document_text).select(F.col("component_id").alias("_first")).distinct()
    kept = document_text.join(first.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi")
    return kept.dropDuplicates(["doc_id"])
