"""I-Match fingerprints of document texts: hashes of their terms of middling rarity under several random lexicons."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext
from .shared import stored

#: Kept terms stand in at most one of ``MIN_RARITY`` and at least one of ``MAX_RARITY`` documents: a band of inverse document
#: frequencies from log(20) to log(2000). So they are at most ``MAX_RARITY`` times the distinct terms of a mean document.
MIN_RARITY = 20
MAX_RARITY = 2000
#: Lexicon ``k`` keeps a band term with probability ``1 / SHARES[k % len(SHARES)]``.
SHARES = (4, 8, 16, 32, 64, 128)
LEXICONS = 24
EMPTY = "-"


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in bytetext.chunks(batch):
            terms, n = np.unique(bytetext.parse(part.column("text")).distinct()[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])


def document_frequencies(document_text: DataFrame) -> DataFrame:
    """``term`` (a 64-bit hash), ``n``: in how many texts each term stands. Terms are words with A-Z in lower case."""
    return document_text.select("text").mapInArrow(_frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(document_text: DataFrame, min_rarity: int = MIN_RARITY, max_rarity: int = MAX_RARITY) -> np.ndarray:
    """Sorted hashes of the terms in the band.

    A band of inverse document frequencies is a band of shares of all documents, and all terms' frequencies together are the distinct
    terms of all documents. So the band has at most ``max_rarity`` times as many terms as a mean document, at every size of the collection;
    that bound, known from the same counts, is checked before the terms are sent.
    """
    counted = stored(document_frequencies(document_text), "terms")
    documents = document_text.count()
    total = counted.agg(F.sum("n")).first()[0] or 0
    band = counted.where((F.col("n") * min_rarity <= documents) & (F.col("n") * max_rarity >= documents)).select("term")
    if band.count() > max_rarity * max(1.0, total / max(1, documents)):
        raise ValueError("more terms in the band than its bound")
    terms = band.toArrow().column("term").to_numpy()
    return np.sort(terms.view(np.uint64))


def fingerprint_texts(texts: bytetext.Texts, terms: np.ndarray) -> np.ndarray:
    """One row of ``LEXICONS`` hashes per text; 0 where a lexicon keeps none of its terms.

    Texts without a term of the band use all of theirs; a text without words has the hash of nothing everywhere.
    """
    hashes, owner = texts.distinct()
    n_texts = len(texts.bounds) - 1
    at = np.searchsorted(terms, hashes)
    at[at == len(terms)] = 0
    inside = terms[at] == hashes if len(terms) else np.zeros(len(hashes), bool)
    has = np.zeros(n_texts, bool)
    has[owner[inside]] = True
    use = inside | ~has[owner]
    hashes, owner = hashes[use], owner[use]
    out = np.zeros((n_texts, LEXICONS), np.uint64)
    for k in range(LEXICONS):
        draw = bytetext.seeded(hashes, k)
        kept = draw >> np.uint64(32) < np.uint64((1 << 32) // SHARES[k % len(SHARES)])
        value, place = bytetext.mix(hashes[kept]), owner[kept]
        edges = np.flatnonzero(np.diff(place, prepend=-1))
        if len(edges):
            # terms of a text come sorted by hash, each once, so a sum of mixed hashes stands for the sorted list
            out[place[edges], k] = bytetext.mix(np.add.reduceat(value, edges) | np.uint64(1))
    out[np.diff(texts.bounds) == 0] = np.uint64(1)
    return out


def printed(prints: np.ndarray) -> list[str]:
    return ["".join(f"{h >> 32:08x}" if h else EMPTY * 8 for h in row) for row in prints.tolist()]


def likeness(a: str, b: str) -> float:
    """Share of equal hashes among the lexicons that keep a term of either text; equal fingerprints: 1."""
    if a == b:
        return 1.0
    width, blank = 8, EMPTY * 8
    pairs = [(a[i : i + width], b[i : i + width]) for i in range(0, len(a), width)]
    filled = [(x, y) for x, y in pairs if x != blank or y != blank]
    return sum(x == y for x, y in filled) / len(filled) if filled else 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many characters from the start of ``following``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _printed(texts: list[str], terms: np.ndarray) -> list[str]:
    return printed(fingerprint_texts(bytetext.parse(pa.array(texts, pa.string())), terms)) if texts else []


def fingerprints(document_text: DataFrame, terms: np.ndarray | None = None) -> DataFrame:
    """``doc_id, fingerprint`` of each document text, as 8 hexadecimal digits per lexicon (dashes: none of its terms kept).

    Null texts count as empty and all share one fingerprint; equal texts have equal fingerprints. Repeated rows come back as
    often; an empty table gives no rows.
    """
    held = document_text.sparkSession.sparkContext.broadcast(lexicon(document_text) if terms is None else terms)
    kind = document_text.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytetext.chunks(batch):
                prints = printed(fingerprint_texts(bytetext.parse(part.column("text")), held.value))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return document_text.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


#: Documents that one task compares with their followers, about.
ROWS_PER_RUN = 4096


#: Up to this many runs (16 MB of numbers) their bounds are sent to every task; beyond, the texts are shuffled to them once more.
SENT_RUNS = 1_000_000


def in_runs(document_text: DataFrame, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """``run, doc_id, text, guest``: documents by descending ``doc_id`` in runs; each run ends with the first document of the next, as a guest.

    Runs are ranges of ``doc_id``; after the last run comes the first. Bounds are found in two steps, zones of ``doc_id`` and runs in each zone: what the
    driver sees and the plan holds is one number per zone, the square root of the number of runs. The bounds of runs stay a table.
    """
    ids = document_text.select("doc_id")
    n_runs = max(1, ids.count() // rows_per_run)
    n_zones = math.ceil(math.sqrt(n_runs))
    shares = [i / n_zones for i in range(1, n_zones)]
    below = lambda cuts: F.size(F.filter(cuts, lambda c: c < F.col("doc_id")))
    cuts = ids.agg(F.percentile_approx("doc_id", shares).alias("c")).first()["c"] if shares else []
    zone = below(F.array(*[F.lit(c).cast("bigint") for c in cuts])) if cuts else F.lit(0)
    sent = F.broadcast if n_runs <= SENT_RUNS else lambda d: d
    docs = document_text.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), zone.alias("zone"))
    inner = F.lit(0)
    if shares:
        bounds = docs.groupBy("zone").agg(F.percentile_approx("doc_id", shares).alias("cuts"))
        docs = docs.join(sent(stored(bounds, "bounds")), "zone")
        inner = below(F.col("cuts"))
    # numbered from the largest doc_id; rows of one doc_id share a run
    docs = docs.select("doc_id", "text", (-(F.col("zone") * (n_zones + 1) + inner)).alias("run"))
    heads = stored(docs.groupBy("run").agg(F.max("doc_id").alias("top")), "heads")
    # one small row per run is put in order
    before = F.lag("run").over(Window.orderBy("run"))
    last = heads.agg(F.max("run")).first()[0]
    visits = heads.select("top", F.coalesce(before, F.lit(last)).alias("to"))
    own = F.struct(F.col("run").alias("run"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("to").alias("run"), F.lit(True).alias("guest"))
    docs = docs.join(sent(visits), F.col("doc_id") == F.col("top"), "left")
    placed = docs.select("doc_id", "text", F.explode(F.when(F.col("to").isNotNull(), F.array(own, visit)).otherwise(F.array(own))).alias("p"))
    placed = placed.select("p.run", "doc_id", "text", "p.guest")
    return placed.repartitionByRange(n_runs, "run").sortWithinPartitions("run", "guest", F.desc("doc_id"), F.xxhash64("text"))


def compared(document_text: DataFrame, terms: np.ndarray | None = None, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """Each document text's fingerprint against those of its edited text and of the next document by descending ``doc_id``.

    Takes ``doc_id`` (integer), ``text``; gives ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. After
    the last document comes the first; a single document follows itself. Null texts count as empty; rows without ``doc_id`` are left out (they have no
    place in the order); repeated rows follow each other. An empty table gives no rows.
    """
    docs = document_text.where("doc_id is not null").select("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(lexicon(docs) if terms is None else terms)

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        """Results of the rows but the last, guests left out."""
        rows, following = rows[:-1], rows[1:]
        changed = [edited(a[2], b[2]) for a, b in zip(rows, following)]
        prints = _printed(changed, held.value)
        own = [(a, b, c, p) for a, b, c, p in zip(rows, following, changed, prints) if not a[3]]
        columns = list(zip(*[
            (a[1], len(a[2]), hashlib.sha256(c.encode()).hexdigest(), a[4], p, likeness(a[4], p), likeness(a[4], b[4])) for a, b, c, p in own
        ])) or [()] * 7
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            for part in bytetext.chunks(batch):
                prints = printed(fingerprint_texts(bytetext.parse(part.column("text")), held.value))
                rows = [last] if last else []
                rows += zip(part.column("run").to_pylist(), part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("guest").to_pylist(), prints)
                yield finish(rows)
                last = rows[-1]

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_runs(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), rows_per_run).mapInArrow(run, schema)
