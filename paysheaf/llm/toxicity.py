"""Toxicity of texts by a chain of linear classifiers.

The transcribed records carry no such labels, so this works on any texts with labels by ``doc_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .shared import stored

CATEGORIES = ("quality", "toxic")
#: Labelled rows to learn from, at most: those with the smallest hash of ``doc_id``.
MAX_LABELLED = 12_000
FOLDS = 3
BUCKETS = 1 << 20
#: Bytes of the word beginnings that count besides whole words.
BEGINNINGS = (4, 5, 6, 7)
#: A beginning counts once for each of these numbers of distinct words that the text has with it.
TIMES = (1, 2, 4, 8)
#: Marks in fewer labelled texts than this, or that tell less of the category (in standard deviations), have no weight.
MIN_TEXTS, MIN_DEVIATION = 4, 3.0
PENALTY = 2.0
STEPS = 250
WHOLE = -1


def buckets(texts: bytetext.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each mark of each text, by text: its distinct words and the beginnings of those.

    Words are runs of letters and digits, A-Z in lower case.
    """
    hashes, owner, at = texts.distinct(places=True)
    marks, owners = [hashes], [owner]
    starts, ends = texts.starts[at], texts.ends[at]
    for size in BEGINNINGS:
        long = ends - starts >= size
        head = bytetext.seeded(texts.hashes(starts[long], starts[long] + size), size)
        of = owner[long]
        order = np.lexsort((head, of))
        head, of = head[order], of[order]
        edges = np.flatnonzero((np.diff(head, prepend=0) != 0) | (np.diff(of, prepend=-1) != 0))
        runs = np.diff(np.append(edges, len(head)))
        for times in TIMES:
            here = edges[runs >= times]
            marks.append(head[here] + np.uint64(times))
            owners.append(of[here])
    mark, owner = np.concatenate(marks), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (bytetext.mix(mark[order]) % np.uint64(BUCKETS)).astype(np.int64), owner[order]


def _parsed(column: pa.Array) -> bytetext.Texts:
    return bytetext.parse(column, between=bytetext.PUNCTUATION)


def fit(rows: np.ndarray, columns: np.ndarray, extra: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression with squared penalty: weights of buckets, then of ``extra`` columns and the constant.

    ``rows, columns`` are the ones of a sparse matrix. Gradients are scaled by the diagonal of the curvature bound and taken with momentum.
    """
    n, m = extra.shape
    positive, total = max(1.0, y.sum()), max(1, n)
    inside = np.bincount(columns, weights=y[rows], minlength=BUCKETS)
    seen = np.bincount(columns, minlength=BUCKETS)
    share = np.minimum(seen / total, 1.0)
    deviation = np.abs(inside - share * y.sum()) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * positive * max(1.0, total - positive) / total)
    told = (seen >= MIN_TEXTS) & (deviation >= MIN_DEVIATION)
    rows, columns = rows[told[columns]], columns[told[columns]]
    used, columns = np.unique(columns, return_inverse=True)
    dense = np.column_stack([extra, np.ones(n)])
    per_row = np.bincount(rows, minlength=n) + 1.0 + m
    # a bound of each weight's curvature: the sizes of the rows that hold it
    step = 1.0 / (0.25 * np.bincount(columns, weights=per_row[rows], minlength=len(used)) + PENALTY)
    dense_step = 1.0 / (0.25 * (np.abs(dense) * per_row[:, None]).sum(axis=0) + 1e-9)
    w, b = np.zeros(len(used)), np.zeros(m + 1)
    rate = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    b[-1] = np.log(rate / (1 - rate))
    w_old, b_old, w_at, b_at = w, b, w, b
    for t in range(STEPS):
        z = np.bincount(rows, weights=w_at[columns], minlength=n) + dense @ b_at
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        w = w_at - step * (np.bincount(columns, weights=g[rows], minlength=len(used)) + PENALTY * w_at)
        b = b_at - dense_step * (dense.T @ g)
        pull = t / (t + 3)
        w_at, b_at, w_old, b_old = w + pull * (w - w_old), b + pull * (b - b_old), w, b
    out = np.zeros(BUCKETS)
    out[used] = w
    return out, b


def _labelled(document_text: DataFrame, labels: DataFrame, categories: tuple[str, ...], max_labelled: int) -> DataFrame:
    """``doc_id, text``, categories (0 or 1), ``fold`` of the labelled texts to learn from."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    # many labels of one document: its largest
    known = labels.select("doc_id", *categories).dropna().groupBy("doc_id").agg(*[F.max(c).cast("double").alias(c) for c in categories])
    known = known.orderBy(order, "doc_id").limit(max_labelled).withColumn("fold", F.pmod(F.shiftright(order, 8), F.lit(FOLDS)).cast("int"))
    # at most max_labelled rows
    known = F.broadcast(stored(known, "labelled"))
    return document_text.select("doc_id", "text").join(known, "doc_id")


def _features(categories: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytetext.chunks(batch):
                column, owner = buckets(_parsed(part.column("text")))
                ends = np.searchsorted(owner, np.arange(len(part) + 1))
                words = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(column.astype(np.int32)))
                rest = ["doc_id", "fold", *categories]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), words], [*rest, "words"])

    return run


def _sparse(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows["words"]), np.int64, len(rows))
    column = np.concatenate(rows["words"].to_list()) if sizes.sum() else np.zeros(0)
    return np.repeat(np.arange(len(rows)), sizes), column.astype(np.int64)


def _fitted(category: str, earlier: tuple[str, ...]):
    """Fits one model: of a fold (learns from the others, predicts it) or of all rows (gives its weights)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        model = int(rows["model"].iloc[0])
        learn = rows[rows["fold"] != model]
        extra = [f"p_{c}" for c in earlier]
        w, b = fit(*_sparse(learn), learn[extra].to_numpy(float), learn[category].to_numpy(float))
        if model == WHOLE:
            at = np.flatnonzero(w)
            ids = np.concatenate([at, BUCKETS + np.arange(len(b))])
            return pd.DataFrame({"model": model, "id": ids, "value": np.concatenate([w[at], b])})
        out = rows[rows["fold"] == model]
        row, column = _sparse(out)
        z = np.bincount(row, weights=w[column], minlength=len(out)) + out[extra].to_numpy(float) @ b[:-1] + b[-1]
        return pd.DataFrame({"model": model, "id": out["doc_id"].to_numpy(), "value": 1 / (1 + np.exp(-z))})

    return run


@dataclass
class Link:
    """One classifier of the chain: weights of buckets, of the earlier categories' probabilities, a constant, and the probability from which a text counts."""

    category: str
    words: np.ndarray
    earlier: np.ndarray
    constant: float
    threshold: float


def _best_threshold(judged: DataFrame, category: str) -> float:
    """The out-of-fold probability with the best F1; one row per labelled text, ``MAX_LABELLED`` at most."""
    rows = judged.select(f"p_{category}", category).toPandas().sort_values(f"p_{category}", ascending=False)
    p, y = rows[f"p_{category}"].to_numpy(), rows[category].to_numpy()
    if not len(p) or y.sum() in (0, len(y)):
        return 0.5
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    return float((p[best] + (p[best + 1] if best + 1 < len(p) else 0.0)) / 2)


def train(document_text: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, max_labelled: int = MAX_LABELLED) -> list[Link]:
    """The chain: each category is learnt from the words and the earlier categories' out-of-fold probabilities.

    Learns from at most ``max_labelled`` labelled texts. Each of the ``FOLDS + 1`` models of a category is fitted in a task of its own, which reads those rows only.
    """
    kind = document_text.schema["doc_id"].dataType.simpleString()
    known = _labelled(document_text, labels, categories, max_labelled)
    schema = f"doc_id {kind}, fold int, " + ", ".join(f"{c} double" for c in categories) + ", words array<int>"
    rows = stored(known.mapInArrow(_features(categories), schema), "features")
    chain: list[Link] = []
    if rows.isEmpty():
        return [Link(c, np.zeros(BUCKETS), np.zeros(i), -30.0, 0.5) for i, c in enumerate(categories)]
    for i, category in enumerate(categories):
        models = rows.withColumn("model", F.explode(F.array(*map(F.lit, (*range(FOLDS), WHOLE)))))
        result = stored(models.groupBy("model").applyInPandas(_fitted(category, categories[:i]), "model int, id bigint, value double"), "models")
        weights = result.where(F.col("model") == WHOLE).toPandas()
        w, b = np.zeros(BUCKETS), np.zeros(i + 1)
        word = weights["id"] < BUCKETS
        w[weights["id"][word]] = weights["value"][word]
        b[weights["id"][~word] - BUCKETS] = weights["value"][~word]
        judged = result.where(F.col("model") != WHOLE).groupBy(F.col("id").alias("doc_id")).agg(F.max("value").alias(f"p_{category}"))
        rows = stored(rows.join(judged, "doc_id"), "features")
        chain.append(Link(category, w, b[:-1], float(b[-1]), _best_threshold(rows, category)))
    return chain


def chain_scores(texts: bytetext.Texts, links: list[tuple]) -> list[np.ndarray]:
    """Probability of each category of each text."""
    column, owner = buckets(texts)
    out: list[np.ndarray] = []
    for words, earlier, constant in links:
        z = np.bincount(owner, weights=words[column], minlength=len(texts.bounds) - 1) + constant
        for weight, p in zip(earlier, out):
            z = z + weight * p
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return out


def judged(document_text: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id`` and, for each category ``c``, ``p_c`` and the verdict ``c``, of every text.

    Takes ``doc_id, text`` and ``labels`` with ``doc_id`` and a 0/1 column per category, in the order of the chain. Rows with a missing label are not learnt
    from; contradicting labels of a document count as 1. Null texts have no words. Without labels no text has a category. Repeated
    rows come back as often; an empty table gives no rows.
    """
    chain = train(document_text, labels, categories, max_labelled)
    kind = document_text.schema["doc_id"].dataType.simpleString()
    held = document_text.sparkSession.sparkContext.broadcast([(c.words, c.earlier, c.constant) for c in chain])
    thresholds = [c.threshold for c in chain]
    names = ["doc_id", *(x for c in categories for x in (f"p_{c}", c))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytetext.chunks(batch):
                found = chain_scores(_parsed(part.column("text")), held.value)
                columns = [part.column("doc_id"), *(pa.array(x) for p, t in zip(found, thresholds) for x in (p, p >= t))]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"doc_id {kind}, " + ", ".join(f"p_{c} double, {c} boolean" for c in categories)
    return document_text.select("doc_id", "text").mapInArrow(run, schema)
