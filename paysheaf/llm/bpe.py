"""Byte-level BPE ids of document texts, with a lexicon of frequent words as a minimal acyclic transducer."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from ..session import scratch_dir
from .shared import kept_by_worker, stored

# fixed value: the split of byte-level BPE
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{LN}]+|\s+(?!\S)|\s+"

# no character below is newer than the oldest Unicode version in use
_HIGH = re.compile("[\u0558-\U0010ffff]")

LEXICON_WORDS = 100_000
#: Words that a worker remembers between batches.
REMEMBERED_WORDS = 200_000
#: Longer words are merged one by one with a heap.
LONG_WORD = 64
BATCH_BYTES = 4 << 20


_SLOT_BITS = 20


def _slot(pairs: np.ndarray, bits: int) -> np.ndarray:
    return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _splitters() -> tuple[regex.Pattern, regex.Pattern, regex.Pattern | None]:
    """The usual split, the exact split, and the characters that need the exact one.

    The tokenizers library and the regex module know different versions of Unicode, so characters that one of them calls a
    letter or a number and Python's own table does not know are asked of the library.
    """
    return kept_by_worker("splitters", None, _make_splitters)


def _make_splitters() -> tuple[regex.Pattern, regex.Pattern, regex.Pattern | None]:
    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    either = regex.compile(r"[\p{L}\p{N}]")
    newer = []
    for c in map(chr, (*range(0x0558, 0xD800), *range(0xE000, 0x110000))):
        if either.match(c) and not c.isalpha() and not c.isnumeric() and len(split.pre_tokenize_str("a" + c)) != 1 and len(split.pre_tokenize_str("1" + c)) != 1:
            newer.append(c)
    usual = regex.compile(SPLIT.format(L=r"\p{L}", N=r"\p{N}", LN=r"\p{L}\p{N}"))
    if not newer:
        return usual, usual, None
    few = "".join(newer)
    exact = regex.compile("(?V1)" + SPLIT.format(L=rf"[\p{{L}}--[{few}]]", N=rf"[\p{{N}}--[{few}]]", LN=rf"[[\p{{L}}\p{{N}}]--[{few}]]"))
    return usual, exact, regex.compile(f"[{few}]")


class Vocabulary:
    """Ids, merges and special tokens of a tokenizers file with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.id_of_byte = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.id_of_byte[b] = vocab[c]
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        key = pairs[:, 0] << 32 | pairs[:, 1]
        self.rank = dict(zip(key.tolist(), zip(range(len(key)), pairs[:, 2].tolist())))
        ranks = np.array([self.rank[k][0] for k in key.tolist()], np.int64)
        self.pair_keys, self.pair_ranks, self.pair_ids = key, ranks, pairs[:, 2]
        # place of each pair by hash; the few pairs whose slot is taken are looked up in order
        self.slots = np.zeros(1 << _SLOT_BITS, np.int32)
        slot = _slot(key, _SLOT_BITS)
        self.slots[slot[::-1]] = np.arange(len(key), dtype=np.int32)[::-1]
        self.met = np.flatnonzero(self.slots[slot] != np.arange(len(key)))
        self.met = self.met[np.argsort(key[self.met])]
        self.doubtful = np.zeros(1 << _SLOT_BITS, bool)
        self.doubtful[slot[self.met]] = True
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def place(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each pair in the table of merges, and whether it is there."""
        at = self.slots[_slot(pairs, _SLOT_BITS)]
        known = self.pair_keys[at] == pairs
        if len(self.met):
            rest = np.flatnonzero(self.doubtful[_slot(pairs, _SLOT_BITS)] & ~known)
            i = np.searchsorted(self.pair_keys[self.met], pairs[rest])
            i[i == len(self.met)] = 0
            hit = self.pair_keys[self.met[i]] == pairs[rest]
            at[rest[hit]], known[rest[hit]] = self.met[i[hit]], True
        return at, known

    def merge_long(self, word: bytes) -> list[int]:
        """Merges of one word, lowest rank first, then leftmost."""
        ids, rank = self.id_of_byte[np.frombuffer(word, np.uint8)].tolist(), self.rank
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []
        for i in range(len(ids) - 1):
            if hit := rank.get(ids[i] << 32 | ids[i + 1]):
                heap.append((hit[0], i, ids[i], ids[i + 1], hit[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if hit := rank.get(new << 32 | ids[after[i]]):
                    heapq.heappush(heap, (hit[0], i, new, ids[after[i]], hit[1]))
            if before[i] >= 0 and (hit := rank.get(ids[before[i]] << 32 | new)):
                heapq.heappush(heap, (hit[0], before[i], ids[before[i]], new, hit[1]))
        return [x for x in ids if x >= 0]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers; all words take one merge per round."""
        out: list[bytes] = [b""] * len(words)
        which = []
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = np.array(self.merge_long(w), "<u4").tobytes()
            elif w:
                which.append(i)
        which = np.array(which, np.int64)
        sizes = np.fromiter((len(words[i]) for i in which), np.int64, len(which))
        symbols = self.id_of_byte[np.frombuffer(b"".join([words[i] for i in which]), np.uint8)]
        while len(which):
            starts = np.cumsum(sizes) - sizes
            pairs = symbols[:-1] << 32 | symbols[1:]
            at, known = self.place(pairs)
            score = np.full(len(symbols), np.iinfo(np.int64).max)
            known[(starts - 1)[starts > 0]] = False
            score[:-1][known] = self.pair_ranks[at[known]] << 32 | np.flatnonzero(known)
            best = np.minimum.reduceat(score, starts)
            done = best == np.iinfo(np.int64).max
            if done.any():
                packed, width = symbols.astype("<u4").tobytes(), 4
                for i, a, n in zip(which[done].tolist(), starts[done].tolist(), sizes[done].tolist()):
                    out[i] = packed[width * a : width * (a + n)]
            place = best[~done] & 0xFFFFFFFF
            symbols[place] = self.pair_ids[at[place]]
            keep = np.repeat(~done, sizes)
            keep[place + 1] = False
            symbols, which, sizes = symbols[keep], which[~done], sizes[~done] - 1
        return out


def compile_lexicon(words: Iterable[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of distinct words: it maps the n-th word in byte order to n.

    Words are added in order; states that no later word can change are shared with equal ones, so suffixes are stored once.
    The numbers on a path add up to the word's number: an arc carries how many words of its state come before it.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    open_arcs: list[dict[int, int]] = [{}]
    open_final = [False]
    last = b""

    def close(depth: int) -> None:
        while len(open_arcs) > depth + 1:
            arcs, final = open_arcs.pop(), open_final.pop()
            shape = (final, tuple(arcs.items()))
            if shape not in register:
                register[shape] = len(states)
                states.append(shape)
            open_arcs[-1][last[len(open_arcs) - 1]] = register[shape]

    for word in words:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        close(common)
        for _ in word[common:]:
            open_arcs.append({})
            open_final.append(False)
        open_final[-1] = True
        last = word
    close(0)
    root = len(states)
    states.append((open_final[0], tuple(open_arcs[0].items())))
    sizes, keys, targets, outputs = [], [], [], []
    for number, (final, arcs) in enumerate(states):
        n = int(final)
        for byte, target in arcs:
            keys.append(number << 8 | byte)
            targets.append(target)
            outputs.append(n)
            n += sizes[target]
        sizes.append(n)
    arrays = {"keys": keys, "targets": targets, "outputs": outputs, "final": [s[0] for s in states], "root": [root]}
    return {k: np.array(v, np.int64) for k, v in arrays.items()}


class Lexicon:
    """A compiled lexicon over one memory-mapped file: arcs in the order of state and byte, then the ids of all words."""

    PARTS = ("keys", "targets", "outputs", "final", "root", "ends", "ids")

    @staticmethod
    def save(path: str, words: list[bytes], vocabulary: Vocabulary) -> None:
        words = sorted(set(words))
        packed = vocabulary.merge(words)
        parts = compile_lexicon(words)
        parts["ends"] = np.cumsum([len(p) // 4 for p in packed], dtype=np.int64) if packed else np.zeros(0, np.int64)
        parts["ids"] = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        head = np.array([len(parts[p]) for p in Lexicon.PARTS], np.int64)
        np.save(path, np.concatenate([head, *(parts[p] for p in Lexicon.PARTS)]))

    def __init__(self, path: str):
        table = np.load(path, mmap_mode="r")
        at = len(self.PARTS)
        for part, n in zip(self.PARTS, table[:at].tolist()):
            setattr(self, part, table[at : at + n])
            at += n

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Packed ids of each word, None for words that are not in the lexicon; all words take one step at a time."""
        n = len(words)
        sizes = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        state, number = np.full(n, self.root[0]), np.zeros(n, np.int64)
        live = np.flatnonzero((sizes > 0) & (len(self.keys) > 0))
        step = 0
        while len(live):
            key = state[live] << 8 | data[starts[live] + step]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            number[live] += self.outputs[at]
            state[live] = self.targets[at]
            step += 1
            live = live[sizes[live] > step]
        good = (state >= 0) & (sizes > 0)
        good[good] = self.final[state[good]] == 1
        out: list[bytes | None] = [None] * n
        number = number[good]
        starts, stops = np.where(number > 0, self.ends[number - 1], 0), self.ends[number]
        for i, a, b in zip(np.flatnonzero(good).tolist(), starts.tolist(), stops.tolist()):
            out[i] = self.ids[a:b].astype("<u4").tobytes()
        return out


def _pieces(vocabulary: Vocabulary, text: str) -> Iterator[tuple[bool, str]]:
    """The text between special tokens and the special tokens themselves."""
    if vocabulary.special_split is None or not any(t in text for t in vocabulary.special):
        yield False, text
        return
    for piece in vocabulary.special_split.split(text):
        if piece:
            yield piece in vocabulary.special, piece


def _split(text: str, splitters: tuple | None = None) -> list[str]:
    usual, exact, newer = splitters or _splitters()
    if newer is not None and not text.isascii() and _HIGH.search(text) and newer.search(text):
        return exact.findall(text)
    return usual.findall(text)


def _vocabulary(path: str) -> Vocabulary:
    return kept_by_worker("vocabulary", path, lambda: Vocabulary(path))


class Coder:
    """Encodes and decodes; remembers words between batches."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known: dict[str, bytes] = {}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in vocabulary.special.items()}

    def learn(self, words: set[str]) -> None:
        new = list(words.difference(self.known))
        raw = [w.encode() for w in new]
        found = self.lexicon.find(raw) if self.lexicon else [None] * len(raw)
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(rest, self.vocabulary.merge([raw[i] for i in rest])):
            found[i] = ids
        self.known.update(zip(new, found))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split = []
        splitters = _splitters()
        for text in texts:
            words: list[str] = []
            marks: dict[int, str] = {}
            for special, piece in _pieces(self.vocabulary, text):
                if special:
                    marks[len(words)] = piece
                    words.append("")
                else:
                    words += _split(piece, splitters)
            split.append((words, marks))
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        self.learn(set().union(*(w for w, _ in split)))
        get = self.known.__getitem__
        out = []
        for words, marks in split:
            ids = list(map(get, words))
            for at, token in marks.items():
                ids[at] = self.special[token]
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> str:
        table = self.vocabulary.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        size = max(1, len(batch) * BATCH_BYTES // max(1, batch.column("text").nbytes))
        for at in range(0, len(batch), size):
            part = batch.slice(at, size)
            yield part, pc.fill_null(part.column("text"), "").to_pylist()


def word_counts(document_text: DataFrame) -> DataFrame:
    """``word, n``: how often each run between spaces occurs, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _batches(batches):
            counts: Counter[str] = Counter()
            for text in texts:
                counts.update(text.split(" "))
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    return document_text.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(document_text: DataFrame, max_words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words with the space before them, ``max_words`` at most; words as rare as the first that no longer fits are left out.

    Runs between spaces that the tokenizer would split are no words.

    A count that one word more would exceed is found from the numbers of words of each count, so only words of the lexicon reach the driver.
    """
    counted = word_counts(document_text).where((F.col("n") > 1) & F.length("word").between(1, LONG_WORD - 1))
    counted = stored(counted, "words")
    sizes = counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    kept, least = 0, None
    for row in sizes.toLocalIterator():
        kept += row["words"]
        if kept > max_words:
            break
        least = row["n"]
    if least is None:
        return []
    runs = [" " + r["word"] for r in counted.where(F.col("n") >= least).select("word").toLocalIterator()]
    return [w for w in runs if _split(w) == [w]]


def ship_lexicon(document_text: DataFrame, vocabulary_path: str, max_words: int = LEXICON_WORDS) -> str:
    """Compile the ``max_words`` most frequent words and send the file to all executors; gives its name there.

    At most ``max_words`` rows reach the driver. Rarer words need no lexicon: they are merged exactly.
    """
    spark = document_text.sparkSession
    words = [w.encode() for w in frequent_words(document_text, max_words)]
    folder = scratch_dir(spark, "lexicon")
    # the driver's own copy; executors get theirs through Spark
    folder = folder.removeprefix("file://") if folder.startswith(("file:///", "/")) else tempfile.mkdtemp(prefix="lexicon-")
    os.makedirs(folder, exist_ok=True)
    name = f"lexicon-{uuid.uuid4().hex}.npy"
    path = f"{folder}/{name}"
    Lexicon.save(path, words, _vocabulary(vocabulary_path))
    spark.sparkContext.addFile(path)
    return name


def encoded(document_text: DataFrame, vocabulary_path: str, max_words: int = LEXICON_WORDS) -> DataFrame:
    """Token ids of each document text, as the tokenizers library encodes it without adding special tokens, and the text they decode to.

    Takes ``doc_id, text`` and the path of a tokenizers file with byte-level BPE, present on every machine; gives ``doc_id``, ``ids`` (binary,
    little-endian 32-bit numbers), ``decoded``. Null and empty texts have no ids. Special tokens in a text are one id each.
    Repeated rows come back as often; an empty table gives no rows.
    """
    kind = document_text.schema["doc_id"].dataType.simpleString()
    return _coded(document_text, vocabulary_path, max_words, f"doc_id {kind}, ids binary, decoded string", lambda ids, text: (ids, text))


def digests(document_text: DataFrame, vocabulary_path: str, max_words: int = LEXICON_WORDS) -> DataFrame:
    """``encoded`` with ``n_tokens`` and SHA-256 digests of ids and decoded text in place of both."""
    kind = document_text.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _coded(document_text, vocabulary_path, max_words, schema, digest)


def digest(ids: bytes, decoded: str) -> tuple[int, str, str]:
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def _coded(document_text: DataFrame, vocabulary_path: str, max_words: int, schema: str, result) -> DataFrame:
    docs = document_text.select("doc_id", "text")
    name = ship_lexicon(docs, vocabulary_path, max_words)
    fields = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int64() if "bigint" in f else pa.binary() if "binary" in f else pa.string() for f in schema.split(", ")][1:]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept_by_worker("coder", (vocabulary_path, name), lambda: Coder(_vocabulary(vocabulary_path), Lexicon(SparkFiles.get(name))))
        for part, texts in _batches(batches):
            rows = [result(ids, coder.decode(ids)) for ids in coder.encode(texts)]
            columns = [pa.array(column, t) for column, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], fields)
        coder.known.clear()

    return docs.mapInArrow(code, schema)
