"""Hard negatives against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paysheaf.llm import hard_negatives
from paysheaf.llm.hard_negatives import mined, packed_pages

SCHEMA = "row_id bigint, vector array<bigint>, label int, is_anchor boolean"


def brute(rows, k=5, low=80, high=100):
    first = {}
    for i, v, label, anchor in sorted((r for r in rows if None not in r[:3] and None not in r[1]), key=lambda r: (r[0], r[2], r[1])):
        first.setdefault(i, (v, label, anchor))
    dim = max((len(v) for v, *_ in first.values()), default=0)
    points = {i: v + [0] * (dim - len(v)) for i, (v, *_) in first.items()}
    out = set()
    for a, (_, label, anchor) in first.items():
        if not anchor:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(points[a], points[i])), i) for i in first if i != a))
        positives = [(-s, i) for s, i in scored if first[i][1] == label][:k]
        for p, i in positives:
            negatives = [(-s, j) for s, j in scored if first[j][1] != label and low * p <= -100 * s <= high * p][:k]
            out |= {(a, i, r + 1, j, p, s) for r, (s, j) in enumerate(negatives)}
    return out


def result(frame):
    return {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in frame.collect()}


def made(seed, n, dim, spread, labels):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [int(x + rng.gauss(0, 20)) for x in c], rng.randrange(labels), i % 9 == 0))
    return rows


@pytest.mark.parametrize("seed, dim, spread, labels", [(1, 5, 60, 4), (2, 16, 10, 3), (3, 3, 0.1, 6)])
def test_against_brute_force(spark, monkeypatch, seed, dim, spread, labels):
    """Many small trees, pages and blocks; small numbers give many ties."""
    for name, value in (("SEGMENT_ROWS", 90), ("PAGE_ROWS", 8), ("FANOUT", 3), ("BLOCK_ANCHORS", 7)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = made(seed, 400, dim, spread, labels)
    rows += [(1000 + i, [30] * dim, i % 2, i % 25 == 0) for i in range(150)]  # one vector holds a large part of the rows
    rows += [(2000, None, 1, True), (2001, [1] * dim, None, True), (None, [1] * dim, 1, True), (2002, [None] + [5] * (dim - 1), 1, True)]
    rows += [(3, [9] * dim, 0, True), (3, [9] * dim, 0, True), (2003, [40], 2, True), (2004, [], 2, True), (2005, [1] * dim, 2, None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"score": F.lit("x"), "rank": F.lit(1), "segment": F.lit(2)}).repartition(5)
    got = result(mined(frame))
    # of the rows with id 3 the first by label and vector is an anchor as itself says
    assert got == brute(rows) and got


def test_no_rows_and_no_anchors(spark):
    assert mined(spark.createDataFrame([], SCHEMA)).collect() == []
    assert mined(spark.createDataFrame([(1, [1, 2], 0, False), (2, [1, 2], 1, False)], SCHEMA)).collect() == []
    assert mined(spark.createDataFrame([(1, [1, 2], 0, True), (2, [1, 2], 1, False)], SCHEMA)).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(0, [1 << 27, 3], 0, True), (1, [1 << 27, 2], 0, False), (2, [1 << 27, -1], 1, False), (3, [1 << 27, 1], 1, False)]
    assert result(mined(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    with pytest.raises(ValueError):
        hard_negatives.exact_type(1 << 31, 64)


def test_packing_keeps_every_row_once():
    rng = np.random.default_rng(4)
    points = rng.integers(-50, 50, (1000, 6))
    pages = packed_pages(points, np.arange(1000), 16)
    assert sorted(np.concatenate(pages).tolist()) == list(range(1000)) and max(map(len, pages)) <= 16 and len(pages) <= 96
    boxes = np.mean([np.ptp(points[p], axis=0).mean() for p in pages])
    loose = np.mean([np.ptp(points[i : i + 16], axis=0).mean() for i in range(0, 1000, 16)])
    assert boxes < 0.8 * loose


def test_boxes_are_pruned():
    """With rows in separate heaps, most pages stay closed."""
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-5, 5, (500, 4)) + c for c in ([200, 0, 0, 0], [0, 200, 0, 0], [0, 0, 200, 0], [-200, 0, 0, 0])])
    ids = np.arange(2000)
    pages = packed_pages(points, ids, 25)
    order = np.concatenate(pages)
    tree = hard_negatives.Tree(hard_negatives._pack(ids=ids[order], labels=ids[order] % 2, points=points[order], starts=np.cumsum([0, *map(len, pages[:-1])])))
    opened = []

    class Counted:
        ids, labels, starts, ends, low, high = tree.ids, tree.labels, tree.starts, tree.ends, tree.low, tree.high

        class points:
            size = 0

            def __class_getitem__(cls, page):
                opened.append(page)
                return tree.points[page]

    block = {"ids": np.array([0]), "labels": np.array([0]), "points": points[:1], "low": np.array([[-(1 << 40)]]), "high": np.array([[1 << 40]])}
    best = hard_negatives.search([Counted], block, True, 5)
    scores = points @ points[0]
    want = sorted((-int(scores[i]), int(i)) for i in ids if i % 2 == 0 and i)[:5]
    assert [(-s, i) for s, i in zip(best.scores[0].tolist(), best.ids[0].tolist())] == want
    assert len(opened) < len(pages) / 4
