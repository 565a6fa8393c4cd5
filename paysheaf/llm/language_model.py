"""Scores of document texts under a bigram model whose counts sit in a log-frequency Bloom filter.

A filter of all counts grows with the corpus, so no worker holds all of it: it is cut into segments by hash, and the n-grams that texts ask for go to the
segments, each once per chunk of texts. The same step counts them, makes the segment's filter, and probes it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext
from .shared import stored

HELD_OUT_MOD, HELD_OUT_REST = 7, 2
#: Hashes of the token after the last word and of the place before the first.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Bits and probes for each entry of the filter: about one in forty absent entries seems present.
BITS_PER_ENTRY, PROBES = 8, 4
#: Weight of the unigram model, in tokens.
PRIOR_TOKENS = 200.0
MAX_LEVEL = 48
#: Documents of a chunk, most tokens of a part of one, tokens of a segment of the filter, about.
CHUNK_ROWS, PART_TOKENS, SEGMENT_TOKENS = 4096, 2_000_000, 1_000_000
#: Bytes of a pair's hash within its segment: of a million pairs about one in ten thousand shares its hash with another, far fewer than seem present in the filter.
PAIR_BYTES = 4
_CHARS_PER_TOKEN = 6


def held_out(doc_id: Column) -> Column:
    """Documents the model does not learn from; those without ``doc_id`` are learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_MOD == HELD_OUT_REST, F.lit(False))


def tokens(texts: bytetext.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts (words, then one end each), the token before each, and the bounds of the texts."""
    n_texts = len(texts.bounds) - 1
    bounds = texts.bounds + np.arange(n_texts + 1)
    out = np.full(bounds[-1], END)
    out[np.arange(len(texts.starts)) + texts.owner] = texts.hashes()
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[bounds[:-1]] = START
    return out, before, bounds


def bigram(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return bytetext.mix(before * np.uint64(0xD1342543DE82EF95) + token)


def level(n: np.ndarray) -> np.ndarray:
    """Quantised logarithm of counts: 1 for 1, 2 up to 3, 3 up to 7, ..."""
    return np.minimum(np.frexp(n.astype(np.float64))[1], MAX_LEVEL)


def quantised(levels: np.ndarray) -> np.ndarray:
    """Middle of the counts of each level; level 0: none."""
    half = np.exp2(levels - 1.0)
    return np.where(levels > 0, (3 * half - 1) / 2, 0.0)


@dataclass
class Filter:
    """Bloom filter of (gram, level) entries: a gram of level ``l`` is entered with each level up to ``l``."""

    bits: np.ndarray
    n_bits: int

    @classmethod
    def of(cls, grams: np.ndarray, levels: np.ndarray) -> Filter:
        """The filter of one segment, as large as its entries ask for."""
        made = cls(np.zeros(0, np.uint8), 8 * max(8, -(-int(levels.sum()) * BITS_PER_ENTRY // 8)))
        flags = np.zeros(made.n_bits, bool)
        for at in range(1, int(levels.max(initial=0)) + 1):
            for i in range(PROBES):
                flags[made._place(grams[levels >= at], at, i)] = True
        made.bits = np.packbits(flags, bitorder="little")
        return made

    def _place(self, grams: np.ndarray, at: int, probe: int) -> np.ndarray:
        h = bytetext.seeded(grams, 2 * at) + np.uint64(probe) * (bytetext.seeded(grams, 2 * at + 1) | np.uint64(1))
        return (h % np.uint64(self.n_bits)).astype(np.int64)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The level of each gram, found by probing level after level until one is absent."""
        out, live = np.zeros(len(grams), np.int64), np.arange(len(grams))
        for at in range(1, MAX_LEVEL + 1):
            for i in range(PROBES):
                place = self._place(grams[live], at, i)
                live = live[self.bits[place >> 3] >> (place & 7) & 1 == 1]
            out[live] = at
            if not len(live):
                break
        return out


def distinct_in_segments(grams: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams by segment, then value, the bounds of the segments, and where each gram of the input is among them."""
    keys, which = np.unique(grams, return_inverse=True)
    segment = (keys % np.uint64(n_segments)).astype(np.int32)
    order = np.argsort(segment, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return keys[order], np.searchsorted(segment[order], np.arange(n_segments + 1)), place[which]


def _packed(keys: np.ndarray, n_segments: int, order: int) -> np.ndarray:
    """Tokens whole; of pairs the lowest bytes of what tells them apart within a segment, one row of bytes each."""
    if order == 1:
        return keys.view(np.uint8).reshape(-1, 8)
    return (keys // np.uint64(n_segments)).view(np.uint8).reshape(-1, 8)[:, :PAIR_BYTES]


def _unpacked(data: bytes, order: int) -> np.ndarray:
    if order == 1:
        return np.frombuffer(data, np.uint64)
    out = np.zeros((len(data) // PAIR_BYTES, 8), np.uint8)
    out[:, :PAIR_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, PAIR_BYTES)
    return out.view(np.uint64).ravel()


def _small(values: np.ndarray) -> bytes:
    """Whole numbers, most of them small and alike, in few bytes; the first byte tells how."""
    most = int(values.max(initial=0))
    width = 1 if most < 1 << 8 else 4 if most < 1 << 32 else 8
    body = values.astype(f"<u{width}").tobytes()
    return bytes([width]) + body if len(body) < 64 else bytes([width | 16]) + zlib.compress(body, 1)


def _large(data: bytes) -> np.ndarray:
    body = zlib.decompress(data[1:]) if data[0] & 16 else data[1:]
    return np.frombuffer(body, f"<u{data[0] & 15}").astype(np.int64)


def _asked(n_segments: int):
    """What each part of a chunk asks: ``segment, ngram, chunk, first_row, grams, counts`` (how often training texts of the part have each gram)."""
    names = ["segment", "ngram", "chunk", "first_row", "grams", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        chunk = first_row = size = 0

        def give() -> Iterator[pa.RecordBatch]:
            token, pair, learnt = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            for order, grams in ((1, token), (2, pair)):
                keys, bounds, place = distinct_in_segments(grams, n_segments)
                counts = np.bincount(place, weights=learnt, minlength=len(keys)).astype(np.int64)
                packed = _packed(keys, n_segments, order)
                full = np.flatnonzero(np.diff(bounds))
                cut = [(int(bounds[s]), int(bounds[s + 1])) for s in full]
                columns = [
                    pa.array(full.astype(np.int32)), pa.array(np.full(len(full), order, np.int32)), pa.array(np.full(len(full), chunk, np.int64)),
                    pa.array(np.full(len(full), first_row, np.int64)), pa.array([packed[a:b].tobytes() for a, b in cut], pa.binary()),
                    pa.array([_small(counts[a:b]) for a, b in cut], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for part in bytetext.chunks(batch):
                rows = part.column("row").to_numpy()
                edges = np.flatnonzero(np.diff(rows // CHUNK_ROWS)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]):
                    if a == b:
                        continue
                    if held and (rows[a] // CHUNK_ROWS != chunk or size > PART_TOKENS):
                        yield from give()
                    if not held:
                        chunk, first_row, size = int(rows[a] // CHUNK_ROWS), int(rows[a]), 0
                    piece = part.slice(a, b - a)
                    token, before, bounds = tokens(bytetext.parse(piece.column("text")))
                    learnt = ~piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                    held.append((token, bigram(before, token), np.repeat(learnt, np.diff(bounds)).astype(np.float64)))
                    size += len(token)
        if held:
            yield from give()

    return run, "segment int, ngram int, chunk bigint, first_row bigint, grams binary, counts binary"


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of tokens, exact, and levels of pairs, from the segment's filter, for each part that asked; one row more per segment with its totals."""
    names = ["chunk", "first_row", "segment", "ngram", "values", "tokens", "vocabulary"]
    key, parts = None, []

    def give() -> Iterator[pa.RecordBatch]:
        segment, order = key
        grams = [_unpacked(p[2], order) for p in parts]
        keys, which = np.unique(np.concatenate(grams), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate([_large(p[3]) for p in parts]), minlength=len(keys)).astype(np.int64)
        if order == 2:
            values = Filter.of(keys[n > 0], level(n[n > 0])).levels(keys)
        else:
            values = n
        ends = np.cumsum([len(g) for g in grams])
        cut = [_small(values[which[b - len(g) : b]]) for g, b in zip(grams, ends.tolist())]
        m = len(parts)
        columns = [
            pa.array([*(p[0] for p in parts), -1], pa.int64()), pa.array([*(p[1] for p in parts), -1], pa.int64()), pa.array([segment] * (m + 1), pa.int32()),
            pa.array([order] * (m + 1), pa.int32()), pa.array([*cut, None], pa.binary()),
            pa.array([0] * m + [int(n.sum()) if order == 1 else 0], pa.int64()), pa.array([0] * m + [int((n > 0).sum()) if order == 1 else 0], pa.int64()),
        ]
        parts.clear()
        yield pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        columns = [batch.column(c) for c in ("segment", "ngram", "chunk", "first_row", "grams", "counts")]
        for segment, order, chunk, first_row, grams, counts in zip(*columns):
            now = segment.as_py(), order.as_py()
            if parts and now != key:
                yield from give()
            key = now
            parts.append((chunk.as_py(), first_row.as_py(), grams.as_py(), counts.as_py()))
    if parts:
        yield from give()


@dataclass
class Totals:
    """Sizes of what was learnt."""

    texts: int
    tokens: int
    vocabulary: int
    prior: float = PRIOR_TOKENS

    def score(self, token: np.ndarray, bounds: np.ndarray, n: np.ndarray, levels: np.ndarray) -> dict[str, np.ndarray]:
        """Sums per text from each token's count and the level of the pair it ends."""
        context = np.empty(len(n), np.float64)
        context[1:] = n[:-1]
        context[bounds[:-1]] = self.texts
        both = np.where((n > 0) & (context > 0), quantised(levels), 0.0)
        base = (n + 1) / (self.tokens + self.vocabulary + 1)
        p = (np.minimum(both, np.minimum(n, context)) + self.prior * base) / (context + self.prior)

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, bounds[:-1]) if len(bounds) > 1 else values[:0]

        return {"n_tokens": np.diff(bounds), "n_known": per_text((n > 0).astype(np.int64)), "base_score": per_text(np.log10(base)), "score": per_text(np.log10(p))}


def _scores(totals: Totals, n_segments: int):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, answers, docs = None, {}, []

        def give() -> Iterator[pa.RecordBatch]:
            """Score the documents held, part by part."""
            whole = pa.Table.from_batches(docs).combine_chunks()
            docs.clear()
            rows = whole["row"].to_numpy()
            firsts = sorted(answers)
            edges = [*np.searchsorted(rows, firsts).tolist(), len(rows)]
            for first, a, b in zip(firsts, edges, edges[1:]):
                part = whole.slice(a, b - a)
                found = [tokens(bytetext.parse(p.column("text"))) for r in part.to_batches() for p in bytetext.chunks(r)]
                token = np.concatenate([f[0] for f in found])
                pair = np.concatenate([bigram(f[1], f[0]) for f in found])
                bounds = np.cumsum([0, *np.concatenate([np.diff(f[2]) for f in found]).tolist()])
                looked = []
                for order, grams in ((1, token), (2, pair)):
                    _, _, place = distinct_in_segments(grams, n_segments)
                    values = np.concatenate([_large(data) for _, data in sorted(answers[first][order])])
                    looked.append(values[place])
                result = totals.score(token, bounds, *looked)
                columns = [part[c].combine_chunks() for c in names[:2]] + [pa.array(result[c]) for c in names[2:]]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            # rows of one chunk follow each other: first the answers, then the documents
            chunks, kinds = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if chunks[a] != chunk:
                    if docs:
                        yield from give()
                    chunk, answers = chunks[a], {}
                part = batch.slice(a, b - a)
                if kinds[a]:
                    docs.append(part.select(["row", "doc_id", "held_out", "text"]))
                    continue
                for first, order, segment, data in zip(*(part.column(c).to_pylist() for c in ("row", "ngram", "segment", "values"))):
                    answers.setdefault(first, {}).setdefault(order, []).append((segment, data))
        if docs:
            yield from give()

    return run


def scored(document_text: DataFrame) -> DataFrame:
    """Log10 probabilities of each document text, learnt from the texts that are not held out.

    Takes ``doc_id, text``; gives ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score`` (unigrams with one added) and ``score``: bigrams whose
    quantised count comes from the filter, smoothed by the unigrams. A pair of an unseen token counts as unseen.
    Null and empty texts are one end token. Repeated rows are learnt from and come back as often; an empty table gives no rows.

    Texts are stored in chunks. A chunk's distinct tokens and pairs go to the segments they belong to; a segment adds up what the training texts have, makes its
    part of the filter, and tells each chunk the counts of its tokens and the levels it probes for its pairs. One way at every size; nothing is gathered or sent to all workers.
    """
    kind = document_text.schema["doc_id"].dataType.simpleString()
    docs = document_text.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.monotonically_increasing_id().alias("row"))
    docs = stored(docs, "rows")
    rows, chars, texts = docs.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
    n_segments = max(16, math.ceil(chars / _CHARS_PER_TOKEN / SEGMENT_TOKENS))
    asked, schema = _asked(n_segments)
    sent = docs.select("row", "text", "held_out").mapInArrow(asked, schema)
    sent = sent.repartition(n_segments, "segment").sortWithinPartitions("segment", "ngram")
    told = stored(sent.mapInArrow(_told, "chunk bigint, first_row bigint, segment int, ngram int, values binary, tokens bigint, vocabulary bigint"), "told")
    n_tokens, vocabulary = told.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("vocabulary"), F.lit(0))).first()
    none = F.lit(None)
    answers = told.where("chunk >= 0").select(
        "chunk", F.lit(0).alias("kind"), F.col("first_row").alias("row"), "ngram", "segment", "values",
        none.cast(kind).alias("doc_id"), none.cast("boolean").alias("held_out"), none.cast("string").alias("text"),
    )
    asking = docs.select(
        F.floor(F.col("row") / CHUNK_ROWS).alias("chunk"), F.lit(1).alias("kind"), "row", none.cast("int").alias("ngram"), none.cast("int").alias("segment"),
        none.cast("binary").alias("values"), "doc_id", "held_out", "text",
    )
    met = answers.union(asking).repartition(2 * (rows // CHUNK_ROWS + 1), "chunk").sortWithinPartitions("chunk", "kind", "row")
    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    out = met.mapInArrow(_scores(Totals(texts, n_tokens, vocabulary), n_segments), schema)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
