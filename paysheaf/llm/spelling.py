"""Spelling variants of the words in payslip texts: misprinted labels and names beside the spelling that is usual."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

# fixed value: what a word is made of
RUN = r"[A-Za-zÀ-ÿ]+"

LEAST_CHARS, LEAST_OCCURRENCES, FORM_FACTOR = 7, 2, 10
#: Words of one index, words searched together in one, words that a task asks of one.
SEGMENT_WORDS, BATCH_WORDS, TASK_WORDS = 32_768, 4_096, 65_536


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(document_text: DataFrame, least_chars: int = 1) -> DataFrame:
    """``doc_id, run``: the maximal runs of letters of each text that have ``least_chars`` or more, A-Z in lower case, repeats included; null texts have none."""
    pattern = RUN if least_chars <= 1 else f"{RUN[:-1]}{{{least_chars},}}"
    found = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(pattern), 0)
    return document_text.select("doc_id", F.explode(found).alias("run"))


def word_counts(runs: DataFrame, least_chars: int = LEAST_CHARS, least_occurrences: int = LEAST_OCCURRENCES) -> DataFrame:
    """``word, n``: distinct runs of at least ``least_chars`` code points and how often they occur, from ``least_occurrences`` on."""
    words = runs.where(F.length("run") >= least_chars).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return words.where(F.col("n") >= least_occurrences)


class Ranks:
    """How often a symbol, and how often smaller ones, occur before a place of a text: a matrix of bit counts, one row per bit."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        symbols = np.arange(n_symbols)
        self.ones, self.zeros, self.first = [], [], []
        first = np.zeros(n_symbols, np.int64)
        for level in reversed(range(self.bits)):
            bit = (text >> level & 1).astype(bool)
            ones = np.zeros(len(text) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(text) - int(ones[-1]))
            self.first.append(first)
            before = ones[first]
            first = np.where(symbols >> level & 1, self.zeros[-1] + before, first - before)
            text = np.concatenate([text[~bit], text[bit]])
        self.last = first

    def before(self, symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        less = np.zeros(len(place), np.int64)
        for row, level in enumerate(reversed(range(self.bits))):
            ones, first = self.ones[row], self.first[row][symbols]
            bit = (symbols >> level & 1).astype(bool)
            counted = ones[place].astype(np.int64)
            less += np.where(bit, place - first - (counted - ones[first]), 0)
            place = np.where(bit, self.zeros[row] + counted, place - counted)
        return place - self.last[symbols], less


def _transformed(text: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Start places of the sorted rotations of a text, and the symbol before each."""
    n, bits = len(text), max(1, int(n_symbols - 1).bit_length())
    width = 62 // bits
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = key << bits | np.roll(text, -i)
    rank = np.unique(key, return_inverse=True)[1]
    while int(rank.max()) < n - 1:
        rank = np.unique(rank * np.int64(n) + np.roll(rank, -width), return_inverse=True)[1]
        width *= 2
    starts = np.empty(n, np.int64)
    starts[rank] = np.arange(n)
    return starts, text[starts - 1]


class WordIndex:
    """Bidirectional FM-index of distinct words, a delimiter before each; the last word is followed by the first.

    An interval of the forward index holds the places where a pattern begins, in the order of what follows; that of the backward index
    the places where it ends, in the order of what stands before, read backwards. Adding a symbol on either side narrows both.
    """

    def __init__(self, forward: np.ndarray, backward: np.ndarray, word_at: np.ndarray, letters: np.ndarray):
        self.letters, self.word_at, self.backward = letters, word_at, backward
        n = len(letters) + 1
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(forward, minlength=n))])
        self.before_front, self.before_back = Ranks(forward, n), Ranks(backward, n)

    @staticmethod
    def pack(words: list[str]) -> bytes:
        joined = np.frombuffer("\0".join(["", *words]).encode("utf-32-le"), "<u4").astype(np.int64)
        letters = np.unique(joined[joined > 0])
        text = np.searchsorted(letters, joined) + 1
        text[joined == 0] = 0
        word = np.cumsum(joined == 0) - 1
        _, forward = _transformed(text, len(letters) + 1)
        starts, backward = _transformed(text[::-1].copy(), len(letters) + 1)
        # a place of the backward index that starts with a delimiter belongs to the word before it
        word_at = (word[len(text) - 1 - starts[: len(words)]] - 1) % len(words)
        kind = np.uint8 if len(letters) < 255 else np.uint32
        out = io.BytesIO()
        np.savez(out, forward=forward.astype(kind), backward=backward.astype(kind), word_at=word_at.astype(np.int32), letters=letters)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> WordIndex:
        parts = np.load(io.BytesIO(data))
        return cls(parts["forward"].astype(np.int64), parts["backward"].astype(np.int64), parts["word_at"], parts["letters"])

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each word in a row, -1 where the index does not know them, and the lengths."""
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        out = np.full((len(words), int(sizes.max()) + 1), -1, np.int64)
        out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = np.where(self.letters[at] == points, at + 1, -1)
        return out, sizes

    def _longer_right(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.starts[symbols]
        return start + self.before_back.before(symbols, low)[0], start + self.before_back.before(symbols, high)[0]

    def _begin_with(self, codes: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows whose first ``exact`` symbols begin a word, and the backward interval of delimiter and symbols.

        The symbols are matched from the last to the first, then the delimiter: to the left, in both intervals.
        """
        q = np.flatnonzero((exact > 0) & (codes[np.arange(len(codes)), exact - 1] > 0))
        c = codes[q, exact[q] - 1]
        low, high = self.starts[c], self.starts[c + 1]
        back = low.copy()
        at = exact[q] - 2
        none = np.flatnonzero(exact == 0)
        done = [(none, np.zeros(len(none), np.int64), np.full(len(none), self.starts[1]))]
        while len(q):
            c = np.where(at >= 0, codes[q, np.maximum(at, 0)], 0)
            good = c >= 0
            q, c, low, high, back, at = (x[good] for x in (q, c, low, high, back, at))
            (n_low, less_low), (n_high, less_high) = self.before_front.before(c, low), self.before_front.before(c, high)
            low, high, back = self.starts[c] + n_low, self.starts[c] + n_high, back + less_high - less_low
            ended = (at < 0) & (high > low)
            done.append((q[ended], back[ended], (back + high - low)[ended]))
            going = (at >= 0) & (high > low)
            q, low, high, back, at = (x[going] for x in (q, low, high, back, at - 1))
        return tuple(np.concatenate(x) for x in zip(*done))

    def one_error(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of a word, number of an indexed word): both begin with the word's first ``exact`` symbols, and the rest differs by one error."""
        codes, sizes = self.codes(words)
        q, low, high = self._begin_with(codes, exact)
        at = exact[q]
        found_q, found_w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def finish(q: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            """Match the rest of each word and the delimiter."""
            while len(q):
                c = np.where(at < sizes[q], codes[q, at], 0)
                good = c >= 0
                q, at, c, low, high = (x[good] for x in (q, at, c, low, high))
                low, high = self._longer_right(c, low, high)
                ended = (at == sizes[q]) & (high > low)
                found_q.append(q[ended])
                found_w.append(self.word_at[low[ended]].astype(np.int64))
                going = (at < sizes[q]) & (high > low)
                q, at, low, high = q[going], at[going] + 1, low[going], high[going]

        n = len(self.letters) + 1
        while len(q):
            inside = at < sizes[q]
            own = np.where(inside, codes[q, at], -1)
            # a symbol less; of equal neighbours the first goes, or the first behind the exact part
            gone = inside & ((at == exact[q]) | (own != codes[q, at - 1]) | (own < 0))
            finish(q[gone], at[gone] + 1, low[gone], high[gone])
            # what may follow: words that begin alike share an interval, and the intervals of one length lie apart
            places, which = np.unique(low << 32 | high, return_inverse=True)
            left, right = places >> 32, places & 0xFFFFFFFF
            width = right - left
            owner = np.repeat(np.arange(len(places)), width)
            rows = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width) + left[owner]
            pairs, many = np.unique(owner * n + self.backward[rows], return_counts=True)
            owner, symbol = pairs // n, pairs % n
            owner, symbol, many = owner[symbol > 0], symbol[symbol > 0], many[symbol > 0]
            below = self.starts[symbol] + self.before_back.before(symbol, left[owner])[0]
            first = np.searchsorted(owner, np.arange(len(places) + 1))
            each = (first[1:] - first[:-1])[which]
            back = np.repeat(np.arange(len(q)), each)
            child = np.arange(len(back)) - np.repeat(np.cumsum(each) - each, each) + first[which[back]]
            same = symbol[child] == own[back]
            other = ~same
            ob, oc = back[other], child[other]
            # a symbol more, then another symbol in place of the word's
            finish(q[ob], at[ob], below[oc], below[oc] + many[oc])
            swap = inside[ob]
            ob, oc = ob[swap], oc[swap]
            finish(q[ob], at[ob] + 1, below[oc], below[oc] + many[oc])
            sb, sc = back[same], child[same]
            q, at, low, high = q[sb], at[sb] + 1, below[sc], below[sc] + many[sc]
        pairs = np.unique(np.concatenate(found_q) << 32 | np.concatenate(found_w))
        return pairs >> 32, pairs & 0xFFFFFFFF


def _segments(words: DataFrame, backwards: bool, n_segments: int) -> DataFrame:
    """``segment, keys, counts, first, last, index``: ranges of the sorted words, or of the words written backwards."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            part = pa.Table.from_batches(held).sort_by("key")
            keys = part["key"].to_pylist()
            columns = [[part["segment"][0].as_py()], [keys], [part["n"].to_pylist()], [keys[0]], [keys[-1]], [WordIndex.pack(keys)]]
            types = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.string(), pa.string(), pa.binary()]
            names = ["segment", "keys", "counts", "first", "last", "index"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    key = F.reverse("word") if backwards else F.col("word")
    dealt = words.select(key.alias("key"), "n").repartitionByRange(n_segments, "key").withColumn("segment", F.spark_partition_id())
    return dealt.mapInArrow(build, "segment int, keys array<string>, counts array<bigint>, first string, last string, index binary")


def _shared_prefixes(segments: DataFrame) -> DataFrame:
    """``prefix, low, high``: beginnings of words that lie in more than one segment, and the range of these.

    The last key of a segment and the first of the next decide: at most their length in rows per segment.
    """
    # range partitions are numbered in order, but some may be empty; one small row per segment is put in order
    order = Window.orderBy("segment")
    follows = segments.select("segment", "last", F.lead("segment").over(order).alias("next"), F.lead("first").over(order).alias("first")).where("next is not null")
    sizes = F.sequence(F.lit(0), F.least(F.length("last"), F.length("first")))
    cut = follows.select("segment", "next", "last", "first", F.explode(sizes).alias("size"))
    prefix = F.substring("last", F.lit(1), F.col("size"))
    same = cut.where(prefix == F.substring("first", F.lit(1), F.col("size")))
    return same.groupBy(prefix.alias("prefix")).agg(F.min("segment").alias("low"), F.max("next").alias("high"))


def _near_pairs(words: DataFrame, n_segments: int, backwards: bool) -> DataFrame:
    segments = stored(_segments(words, backwards, n_segments), "words")
    asked = segments.select("segment", F.explode(F.arrays_zip("keys", "counts")).alias("w")).select("segment", F.col("w.keys").alias("key"), F.col("w.counts").alias("n"))
    half = F.floor(F.length("key") / 2)
    asked = asked.withColumn("exact", (F.length("key") - half if backwards else half).cast("int"))
    wide = stored(_shared_prefixes(segments), "prefixes")
    asked = asked.join(wide, F.substring("key", F.lit(1), F.col("exact")) == wide["prefix"], "left")
    asked = asked.withColumn("segment", F.explode(F.sequence(F.coalesce("low", "segment"), F.coalesce("high", "segment"))))
    asked = stored(asked.select("segment", "key", "n", "exact"), "asked")
    sizes = asked.groupBy("segment").agg(F.ceil(F.count("*") / TASK_WORDS).cast("int").alias("copies"))
    number = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")
    none = F.lit(None)
    held = segments.join(sizes, "segment").select(
        "segment", number, F.lit(0).alias("kind"), none.cast("string").alias("key"), none.cast("bigint").alias("n"), none.cast("int").alias("exact"),
        "index", "keys", "counts",
    )
    sent = asked.join(sizes, "segment").select(
        "segment", F.pmod(F.xxhash64("key"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), "key", "n", "exact",
        none.cast("binary").alias("index"), none.cast("array<string>").alias("keys"), none.cast("array<bigint>").alias("counts"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: WordIndex | None = None
        keys, counts = None, None

        def search(part: pa.RecordBatch) -> pa.RecordBatch:
            own = part.column("key").to_pylist()
            q, w = index.one_error(own, part.column("exact").to_numpy().astype(np.int64))
            if backwards:
                # errors behind the first half are found forwards
                kept = [not keys[j][::-1].startswith(own[i][::-1][: len(own[i]) // 2]) for i, j in zip(q.tolist(), w.tolist())]
                q, w = q[kept], w[kept]
            flip = (lambda x: x[::-1]) if backwards else (lambda x: x)
            columns = [
                pa.array([flip(own[i]) for i in q.tolist()], pa.string()), part.column("n").take(pa.array(q)),
                pa.array([flip(keys[j]) for j in w.tolist()], pa.string()), pa.array(counts[w]),
            ]
            return pa.RecordBatch.from_arrays(columns, ["word", "n", "near", "near_n"])

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(kinds) != 0) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if kinds[a] == 0:
                    last = batch.slice(b - 1, 1)
                    index = WordIndex.unpack(last.column("index")[0].as_py())
                    keys, counts = last.column("keys")[0].as_py(), np.array(last.column("counts")[0].as_py(), np.int64)
                    continue
                for at in range(a, b, BATCH_WORDS):
                    yield search(batch.slice(at, min(BATCH_WORDS, b - at)))

    dealt = held.union(sent).repartition(2 * n_segments, "segment", "copy").sortWithinPartitions("segment", "copy", "kind")
    return dealt.mapInArrow(run, "word string, n bigint, near string, near_n bigint")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: every two words that differ by exactly one inserted, deleted or replaced code point, both ways round.

    Takes ``word, n``, words distinct, not empty. One half of a word stands unchanged in the other: the sorted words are cut into ranges with an index each;
    a word asks the ranges that its first half lies in and lets one error into the rest; the same with all words written backwards finds
    errors in the first half. A beginning that very many words share only makes more ranges and more tasks.
    """
    words = stored(words.select("word", "n"), "vocabulary")
    n_segments = max(1, math.ceil(words.count() / SEGMENT_WORDS))
    return _near_pairs(words, n_segments, False).union(_near_pairs(words, n_segments, True))


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``word, root``: the last form that the forms of each word lead to. Takes ``word, form``, both not null and without circles."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return now
    raise RuntimeError(f"forms did not end in {max_rounds} rounds")


def variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """Each word with the usual spelling it is a variant of.

    Takes ``word, n`` (``word_counts`` of the runs of document texts). A word's ``form`` is its near word of the largest ``n`` (ties: the smallest in code
    point order) where that is at least ``factor`` times its own, else null; ``root`` follows the forms to the last, or is the word itself.
    Gives ``word, n, form, root, n_near`` (near words, 0 if none), ``form_n``. Null and empty words take no part, repeated words count together; other columns
    are left out; an empty table gives no rows.
    """
    words = words.where("word <> '' and n is not null").groupBy("word").agg(F.sum("n").alias("n"))
    words = stored(words, "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best")
    near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    known = -F.col("best.n") >= factor * F.col("n")
    near = near.select("word", "n_near", F.when(known, F.col("best.word")).alias("form"), F.when(known, -F.col("best.n")).alias("form_n"))
    near = stored(near, "near")
    last = roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(last, "word", "left")
    return out.select("word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
