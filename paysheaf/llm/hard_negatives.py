"""Hard negatives of anchors by inner product, from packed R-trees.

The payslip records hold no vectors, so the operator is general: it takes rows of ``row_id, vector, label, is_anchor``.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Rows of a leaf box, children of an inner box, rows of the trees of one segment, anchors searched together.
PAGE_ROWS, FANOUT, SEGMENT_ROWS, BLOCK_ANCHORS = 256, 16, 32_768, 256
#: Tasks that a search has at least, where it has as many blocks.
LEAST_TASKS = 24
#: No score lies beyond this on either side.
LARGEST = 1 << 62
NO_ID = (1 << 63) - 1


def packed_pages(points: np.ndarray, ids: np.ndarray, page_rows: int = PAGE_ROWS) -> list[np.ndarray]:
    """Sort-tile-recursive packing: row numbers of pages of ``page_rows`` rows, the last of a slab smaller.

    Rows are sorted by the axis of the largest spread and cut into slabs of whole pages, each slab by the next axis, and so on;
    rows of equal coordinates go by id.
    """
    spread = points.var(axis=0) if len(points) else np.zeros(points.shape[1])
    n_axes = max(1, math.ceil(math.log2(max(2, math.ceil(len(points) / page_rows)))))
    axes = np.argsort(-spread, kind="stable")[:n_axes].tolist()

    def cut(rows: np.ndarray, level: int) -> Iterator[np.ndarray]:
        pages = math.ceil(len(rows) / page_rows)
        if pages <= 1 or level == len(axes):
            for i in range(0, len(rows), page_rows):
                yield rows[i : i + page_rows]
            return
        slabs = math.ceil(pages ** (1 / (len(axes) - level)))
        rows = rows[np.lexsort((ids[rows], points[rows, axes[level]]))]
        step = math.ceil(pages / slabs) * page_rows
        for i in range(0, len(rows), step):
            yield from cut(rows[i : i + step], level + 1)

    return list(cut(np.arange(len(points)), 0))


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(data)))


class Tree:
    """A packed R-tree: pages of rows in order, boxes of pages, and boxes of ``FANOUT`` boxes each up to one root."""

    def __init__(self, data: bytes):
        parts = _unpack(data)
        self.ids, self.labels, self.points = parts["ids"], parts["labels"], parts["points"].astype(np.int64)
        starts = parts["starts"]
        self.ends = np.append(starts[1:], len(self.ids))
        self.starts = starts
        low, high = np.minimum.reduceat(self.points, starts), np.maximum.reduceat(self.points, starts)
        self.low, self.high = [low], [high]
        while len(self.low[-1]) > 1:
            groups = np.arange(0, len(self.low[-1]), FANOUT)
            self.low.append(np.minimum.reduceat(self.low[-1], groups))
            self.high.append(np.maximum.reduceat(self.high[-1], groups))


def exact_type(largest: int, dim: int) -> type:
    """The number type in which inner products of such components are exact."""
    bound = largest * largest * max(dim, 1)
    if bound < 1 << 53:
        return np.float64
    if bound < LARGEST:
        return np.int64
    raise ValueError(f"inner products of components up to {largest} do not fit 64-bit numbers")


class Best:
    """The best ``k`` rows of each anchor and window: larger scores first, ties by smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        n = low.size
        self.k, self.shape = k, low.shape
        self.low, self.high = low, high
        self.scores = np.full((n, k), -LARGEST - 1, np.int64)
        self.ids = np.full((n, k), NO_ID, np.int64)

    def floors(self) -> np.ndarray:
        """Scores below these can't change anything."""
        return np.maximum(self.low, self.scores[:, -1].reshape(self.shape))

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(slots)
        slots = np.concatenate([np.repeat(touched, self.k), slots])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, -scores, slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        first = np.searchsorted(slots, touched)
        place = first[:, None] + np.arange(self.k)
        self.scores[touched], self.ids[touched] = scores[place], ids[place]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.scores >= -LARGEST)
        return slot, self.scores[slot, place], self.ids[slot, place]


def search(trees: list[Tree], block: dict[str, np.ndarray], same_label: bool, k: int) -> Best:
    """Best-first search of a block of anchors: the box with the largest possible score is opened first.

    An anchor leaves a box out if the interval of its inner products lies outside all its windows or strictly below the k-th
    score so far; a box that no anchor needs is never opened.
    """
    best = Best(block["low"], block["high"], k)
    anchors = block["points"].astype(np.int64)
    largest = max([1, *(int(np.abs(p).max()) for p in (anchors, *(t.points for t in trees)) if p.size)])
    kind = exact_type(largest, anchors.shape[1])
    anchors = anchors.astype(kind)
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    n_windows = best.shape[1]
    queue: list[tuple[float, int, Tree, int, int, np.ndarray, np.ndarray]] = []

    def needed(most: np.ndarray, least: np.ndarray) -> np.ndarray:
        return ((most[:, None] >= best.floors()) & (least[:, None] <= best.high)).any(axis=1)

    def offer(tree: Tree, level: int, first: int, last: int) -> None:
        low, high = tree.low[level][first:last].astype(kind).T, tree.high[level][first:last].astype(kind).T
        most, least = up @ high + down @ low, up @ low + down @ high
        for i in range(last - first):
            alive = needed(most[:, i], least[:, i])
            if alive.any():
                heapq.heappush(queue, (-float(most[alive, i].max()), len(offered), tree, level, first + i, most[:, i], least[:, i]))
                offered.append(None)

    offered: list[None] = []
    for tree in trees:
        offer(tree, len(tree.low) - 1, 0, 1)
    while queue:
        _, _, tree, level, at, most, least = heapq.heappop(queue)
        alive = np.flatnonzero(needed(most, least))
        if not len(alive):
            continue
        if level:
            offer(tree, level - 1, at * FANOUT, min((at + 1) * FANOUT, len(tree.low[level - 1])))
            continue
        page = slice(int(tree.starts[at]), int(tree.ends[at]))
        scores = anchors[alive] @ tree.points[page].astype(kind).T
        wanted = tree.labels[page][None, :] == block["labels"][alive][:, None]
        if not same_label:
            wanted = ~wanted
        wanted &= tree.ids[page][None, :] != block["ids"][alive][:, None]
        floors, hits = best.floors()[alive], []
        for w in range(n_windows):
            a, r = np.nonzero(wanted & (scores >= floors[:, w : w + 1]) & (scores <= best.high[alive, w : w + 1]))
            hits.append((alive[a] * n_windows + w, scores[a, r].astype(np.int64), tree.ids[page][r]))
        slots, values, ids = (np.concatenate(x) for x in zip(*hits))
        if len(slots):
            best.add(slots, values, ids)
    return best


def clean_rows(rows: DataFrame) -> DataFrame:
    """Rows that take part, one per id: the one of the smallest label, then vector."""
    good = F.forall("vector", lambda x: x.isNotNull())
    rows = rows.select("row_id", "label", F.col("vector").cast("array<bigint>").alias("vector"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))
    rows = rows.where(F.col("row_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & good)
    kept = rows.groupBy("row_id").agg(F.min(F.struct("label", "vector", "is_anchor")).alias("r"))
    return kept.select("row_id", "r.label", "r.vector", "r.is_anchor")


def _axes(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Number of rows, longest vector, and axes by falling spread: as many rows as the vectors have components."""
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    parts = rows.select(F.posexplode("vector").alias("axis", "x")).groupBy("axis").agg(F.variance("x").alias("v"))
    return n, dim, [r["axis"] for r in parts.orderBy(F.desc("v"), "axis").collect()]


def _dealt(rows: DataFrame, n_parts: int, axes: list[int]) -> DataFrame:
    """Rows in ``n_parts`` partitions of about equal size: slabs of the widest axis, each cut along the second.

    Equal rows are told apart by their ids' hash, so copies of one vector fill as many partitions as they need.
    """
    axis = [F.coalesce(F.get("vector", F.lit(a)), F.lit(0)) for a in (axes + axes + [0, 0])[:2]]
    n_slabs = math.ceil(math.sqrt(n_parts))
    slab = F.lit(0)
    if n_slabs > 1:
        cuts = rows.agg(F.percentile_approx(axis[0], [i / n_slabs for i in range(1, n_slabs)]).alias("c")).first()["c"]
        slab = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < axis[0]))
    keyed = rows.withColumns({"_slab": slab, "_x": axis[1], "_h": F.xxhash64("row_id")})
    return keyed.repartitionByRange(n_parts, "_slab", "_x", "_h").drop("_slab", "_x", "_h")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of one matrix, shorter ones filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _narrow(points: np.ndarray) -> np.ndarray:
    most = int(np.abs(points).max()) if points.size else 0
    return points.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _in_chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, len(batch), rows):
            part = batch.slice(at, rows)
            if held and sum(map(len, held)) + len(part) > rows:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def trees(rows: DataFrame, n_segments: int, dim: int, axes: list[int]) -> DataFrame:
    """``segment, tree``: every row is in one tree; a segment holds a tree, or more if its share of the rows is large."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_chunks(batches, 2 * SEGMENT_ROWS):
            if not part.num_rows:
                continue
            ids, labels = part["row_id"].to_numpy(), part["label"].to_numpy()
            points = _matrix(part["vector"].combine_chunks(), dim)
            pages = packed_pages(points, ids)
            order = np.concatenate(pages)
            starts = np.cumsum([0, *map(len, pages[:-1])])
            data = _pack(ids=ids[order], labels=labels[order], points=_narrow(points[order]), starts=starts)
            yield pa.RecordBatch.from_arrays([pa.array([part["segment"][0].as_py()], pa.int32()), pa.array([data], pa.binary())], ["segment", "tree"])

    dealt = _dealt(rows.select("row_id", "label", "vector"), n_segments, axes).withColumn("segment", F.spark_partition_id())
    return dealt.mapInArrow(build, "segment int, tree binary")


def blocks(anchors: DataFrame, n_anchors: int, dim: int, axes: list[int], percent: tuple[int, int] = (100, 100)) -> DataFrame:
    """``block, anchors``: neighbouring anchors with their windows, ``BLOCK_ANCHORS`` at most.

    Takes ``row_id, label, vector`` and ``scores``: one window of ``percent`` of each of them, or a single open one where it is null.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _in_chunks(batches, BLOCK_ANCHORS):
            if not part.num_rows:
                continue
            scores = part["scores"].to_pylist()
            n = max(1, max(len(s or ()) for s in scores))
            low, high = np.ones((len(scores), n), np.int64), np.zeros((len(scores), n), np.int64)
            for i, row in enumerate(scores):
                if row is None:
                    low[i, 0], high[i, 0] = -LARGEST, LARGEST
                for j, score in enumerate(row or ()):
                    low[i, j], high[i, j] = -(-score * percent[0] // 100), score * percent[1] // 100
            ids = part["row_id"].to_numpy()
            points = _narrow(_matrix(part["vector"].combine_chunks(), dim))
            data = _pack(ids=ids, labels=part["label"].to_numpy(), points=points, low=low, high=high)
            yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])], pa.int64()), pa.array([data], pa.binary())], ["block", "anchors"])

    dealt = _dealt(anchors.select("row_id", "label", "vector", "scores"), max(1, math.ceil(n_anchors / BLOCK_ANCHORS)), axes)
    return dealt.mapInArrow(build, "block bigint, anchors binary")


def best_rows(segments: DataFrame, n_segments: int, asked: DataFrame, n_blocks: int, same_label: bool, k: int) -> DataFrame:
    """``anchor_id, window, row_id, score, rank``: the first ``k`` rows of each anchor and window.

    Every block meets every segment: a task holds the trees of one segment and searches block after block, so nothing but the
    blocks is sent more than once or a few times, and no task holds more than a segment and a block.
    """
    copies = max(1, min(n_blocks, math.ceil(LEAST_TASKS / n_segments)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = segments.select("segment", numbers(copies).alias("copy"), F.lit(0).alias("kind"), F.col("tree").alias("data"))
    sent = asked.select(numbers(n_segments).alias("segment"), F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int").alias("copy"), F.lit(1).alias("kind"), F.col("anchors").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, forest = None, []
        for batch in batches:
            for segment, copy, kind, data in zip(*(batch.column(i) for i in range(4))):
                if (segment.as_py(), copy.as_py()) != key:
                    key, forest = (segment.as_py(), copy.as_py()), []
                if not kind.as_py():
                    forest.append(Tree(data.as_py()))
                elif forest:
                    block = _unpack(data.as_py())
                    best = search(forest, block, same_label, k)
                    slot, scores, ids = best.rows()
                    n = best.shape[1]
                    columns = [block["ids"][slot // n], (slot % n).astype(np.int32), ids, scores]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "window", "row_id", "score"])

    dealt = held.union(sent).repartition(2 * n_segments * copies, "segment", "copy").sortWithinPartitions("segment", "copy", "kind")
    found = dealt.mapInArrow(run, "anchor_id bigint, window int, row_id bigint, score bigint")
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(rows: DataFrame, k_positives: int = 5, k_negatives: int = 5, low_percent: int = 80, high_percent: int = 100) -> DataFrame:
    """Hard negatives of every anchor and positive.

    Takes ``row_id`` (bigint), ``vector`` (array of whole numbers), ``label`` (int), ``is_anchor``; a row's score is its inner product with the
    anchor, larger ones come first, ties by the smaller id. Positives are the anchor's first ``k_positives`` other rows of its label;
    negatives of a positive the first ``k_negatives`` rows of other labels with ``low_percent * positive <= 100 * negative <= high_percent * positive``.
    Gives ``anchor_id, positive_id, rank`` (from 1), ``negative_id, positive_score, negative_score``.

    Rows without id, label or vector, or with a null component, take no part; of rows that share an id the one of the smallest label, then
    vector does. Shorter vectors end in zeros, empty ones are all zeros. Anchors without positives, and windows without rows, give no
    rows; so does an empty table. Inner products beyond 64 bits are an error.
    """
    rows = stored(clean_rows(rows), "vectors")
    n, dim, axes = _axes(rows)
    n_segments = max(1, math.ceil(n / SEGMENT_ROWS))
    segments = stored(trees(rows, n_segments, dim, axes), "trees")
    anchors = rows.where("is_anchor").select("row_id", "label", "vector")
    n_anchors = anchors.count()
    n_blocks = max(1, math.ceil(n_anchors / BLOCK_ANCHORS))
    first = blocks(anchors.withColumn("scores", F.lit(None).cast("array<bigint>")), n_anchors, dim, axes)
    positives = stored(best_rows(segments, n_segments, first, n_blocks, True, k_positives), "positives")
    listed = positives.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("scores"))
    listed = listed.select(F.col("anchor_id").alias("row_id"), F.col("scores.score").alias("scores"))
    asked = blocks(anchors.join(listed, "row_id"), n_anchors, dim, axes, (low_percent, high_percent))
    negatives = best_rows(segments, n_segments, asked, n_blocks, False, k_negatives)
    named = positives.select("anchor_id", (F.col("rank") - 1).alias("window"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.withColumnsRenamed({"row_id": "negative_id", "score": "negative_score"}).join(named, ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
