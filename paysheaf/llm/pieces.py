"""SentencePiece ids of document texts, every piece traced back to the bytes of the text it came from."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .shared import kept_by_worker

# fixed values: the visible space of the pieces, and the kinds of pieces in a model file
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2

#: Words that a worker remembers between batches of one task.
REMEMBERED_WORDS = 200_000
#: Longer words are merged with a heap.
LONG_WORD = 48
NO_PAIR = 1 << 30
BATCH_BYTES = 4 << 20


class CharacterMap:
    """The compiled character map of a model: a double-array trie from byte strings to their replacements.

    A unit of the trie holds a label in its lowest byte (bit 31 is set in units that hold values), a mark in bit 8 that a
    value follows, and the offset to its children above bit 9, in steps of 256 if bit 9 is set.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4)
        self.replacements = blob[4 + size :]
        self._units = self.units.tolist()
        self._offsets = ((self.units >> 10) << ((self.units & 512) >> 6)).tolist()

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that ``data`` has at ``at``."""
        units, offsets = self._units, self._offsets
        found, node = None, offsets[0]
        for i in range(at, len(data)):
            node ^= data[i]
            if units[node] & 0x800000FF != data[i]:
                break
            leaf = units[node] >> 8 & 1
            node ^= offsets[node]
            if leaf:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.replacements[start : self.replacements.index(b"\0", start)]

    def holds_inner_spaces(self) -> bool:
        """Whether some key has a space after its first byte, so that texts can't be cut before spaces."""
        labels = np.arange(1, 256)
        pending, depth = [np.array([self._offsets[0]])], [0]
        while pending:
            states, at = pending.pop(), depth.pop()
            children = (states[:, None] ^ labels).ravel()
            byte = np.tile(labels, len(states))
            good = children < len(self.units)
            children, byte = children[good], byte[good]
            good = (self.units[children] & 0x800000FF) == byte
            children, byte = children[good], byte[good]
            if at and (byte == 32).any():
                return True
            unit = self.units[children].astype(np.int64)
            below = children ^ ((unit >> 10) << ((unit & 512) >> 6))
            for i in range(0, len(below), 2048):
                pending.append(below[i : i + 2048])
                depth.append(at + 1)
        return False


class PieceModel:
    """A SentencePiece model file with BPE pieces: normalisation with alignment, merges, and decoding."""

    def __init__(self, path: str):
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        kinds = {p.type for p in spec.pieces}
        if spec.trainer_spec.model_type != BPE or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models without user-defined and unused pieces are read")
        if spec.trainer_spec.treat_whitespace_as_suffix or not spec.normalizer_spec.escape_whitespaces or spec.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only models with visible spaces before words and without a map for decoding are read")
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        self.squeeze = spec.normalizer_spec.remove_extra_whitespaces
        blob = spec.normalizer_spec.precompiled_charsmap
        self.map = CharacterMap(blob) if blob else None
        self.cut_at_spaces = self.map is None or not self.map.holds_inner_spaces()
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == UNKNOWN)
        self.unknown_text = spec.trainer_spec.unk_surface
        in_bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        self.byte_ids = [in_bytes[b] for b in range(256)] if spec.trainer_spec.byte_fallback else None

        names = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        # symbols are pieces, and after them characters that only occur inside pieces
        self.symbols = dict(names)
        for c in sorted({c for name in names for c in name}):
            self.symbols.setdefault(c, len(spec.pieces) + len(self.symbols))
        self.n_pieces = len(spec.pieces)
        self.name_of = {i: name for name, i in self.symbols.items()}
        # pieces of one score are as good as each other; the better, the smaller the rank
        ranks = {s: r for r, s in enumerate(sorted({spec.pieces[i].score for i in names.values()}, reverse=True))}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for name, i in names.items():
            for cut in range(1, len(name)):
                left, right = self.symbols.get(name[:cut]), self.symbols.get(name[cut:])
                if left is not None and right is not None:
                    self.merges[left, right] = ranks[spec.pieces[i].score], i
        self.symbol_of_point = np.full(0x110000, -1, np.int32)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.symbol_of_point[ord(c)] = i
        pairs = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in self.merges.items()) or [(-1, 0, 0)]
        self.pair_keys, self.pair_ranks, self.pair_ids = np.array(pairs, np.int64).T.copy()
        self.piece_digits = np.array([len(str(i)) for i in range(self.n_pieces)], np.int64)
        self.piece_bytes = np.array([len(p.piece.encode()) for p in spec.pieces], "<i4")
        # no piece joins a space to what stands before it: words with the spaces before them are merged apart
        apart = SPACE in names and not any(re.search(f"[^{SPACE}]{SPACE}", name) for name in names)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else "(?s).+")

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the byte of ``text`` it stands for."""
        data = text.encode()
        if not data:
            return "", np.zeros(1, np.int64)
        if self.map is None and not self.squeeze:
            widths = np.where(np.frombuffer(data, np.uint8) == 32, 3, 1)
            places = np.repeat(np.arange(len(data)), widths)
            out = text.replace(" ", SPACE)
            if self.prefix:
                out, places = SPACE + out, np.concatenate([np.zeros(3, np.int64), places])
            return out, np.append(places, len(data))
        chunks, at = [], 0
        for unit in re.findall("(?s) [^ ]*|[^ ]+", text) if self.cut_at_spaces else [text]:
            for new, length in self._mapped(unit):
                chunks.append((new, at))
                at += length
        return self._assembled(chunks, len(data))

    def _mapped(self, unit: str) -> list[tuple[bytes, int]]:
        """What each longest prefix that the character map knows, or else each character, becomes, with its length in bytes."""
        data, out, at = unit.encode(), [], 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map else None
            if hit is None:
                first = data[at]
                length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                hit = length, data[at : at + length]
            out.append((hit[1], hit[0]))
            at += hit[0]
        return out

    def _assembled(self, chunks: list[tuple[bytes, int]], n_bytes: int) -> tuple[str, np.ndarray]:
        space = SPACE.encode()
        if self.squeeze:
            # spaces at the beginning go with all chunks that are a space; then what is left decides where the text starts
            lead = 0
            while lead < len(chunks) and chunks[lead][0] == b" ":
                lead += 1
            if lead == len(chunks):
                return "", np.zeros(1, np.int64)
            chunks = chunks[lead:]
        out, places = bytearray(), []
        if self.prefix:
            out += space
            places += [chunks[0][1]] * 3
        after_space = self.squeeze
        for new, at in chunks:
            if after_space:
                new = new.lstrip(b" ")
            if new:
                shown = new.replace(b" ", space)
                out += shown
                places += [at] * len(shown)
                after_space = self.squeeze and new.endswith(b" ")
        end = n_bytes
        while self.squeeze and out.endswith(space):
            del out[-3:]
            end = places[len(out)]
            del places[len(out) :]
        return out.decode(), np.array([*places, end], np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words in a row, and how many each has: the best pair first, then the leftmost. Characters of no piece are -1 - code point.

        All words take one merge per round; long ones take theirs from a heap.
        """
        which, long = [], []
        for i, word in enumerate(words):
            (long if len(word) > LONG_WORD else which).append(i)
        done_symbols = [np.array(self._merge_long(self._characters(words[i]).tolist()), np.int64) for i in long]
        done_words, done_sizes = [np.array(long, np.int64)], [np.array([len(s) for s in done_symbols], np.int64)]
        sizes = np.array([len(words[i]) for i in which], np.int64)
        symbols = self._characters("".join([words[i] for i in which]))
        which = np.array(which, np.int64)
        starts = np.cumsum(sizes) - sizes
        ranks, merged = self._pairs(symbols[:-1], symbols[1:])
        ranks, merged = np.append(ranks, NO_PAIR), np.append(merged, 0)
        ranks[starts[1:] - 1] = NO_PAIR
        while len(which):
            best = np.minimum.reduceat(ranks << 32 | np.arange(len(symbols)), starts)
            done = best >> 32 == NO_PAIR
            inside = np.repeat(done, sizes)
            done_symbols.append(symbols[inside])
            done_words.append(which[done])
            done_sizes.append(sizes[done])
            at = best[~done] & 0xFFFFFFFF
            symbols[at] = merged[at]
            keep = ~inside
            keep[at + 1] = False
            at = np.cumsum(keep)[at] - 1
            symbols, ranks, merged = symbols[keep], ranks[keep], merged[keep]
            which, sizes = which[~done], sizes[~done] - 1
            starts = np.cumsum(sizes) - sizes
            if not len(which):
                break
            # only the pairs beside a merge are new; the last pair of a word stays none
            first = np.zeros(len(symbols), bool)
            first[starts] = True
            last = np.append(first[1:], True)
            right, left = at[~last[at]], at[~first[at]] - 1
            ranks[at[last[at]]] = NO_PAIR
            for i in (right, left):
                ranks[i], merged[i] = self._pairs(symbols[i], symbols[i + 1])
        flat, sizes = np.concatenate(done_symbols), np.concatenate(done_sizes)
        # back into the order of the words
        order = np.argsort(np.concatenate(done_words))
        starts, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
        return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))], sizes

    def _characters(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        ids = self.symbol_of_point[points]
        return np.where(ids < 0, -1 - points, ids)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair of neighbours."""
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        known = (self.pair_keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_ranks[at], NO_PAIR), self.pair_ids[at]

    def _merge_long(self, ids: list[int]) -> list[int]:
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            if hit := self.merges.get((ids[i], ids[j])):
                heapq.heappush(heap, (hit[0], i, ids[i], ids[j], hit[1]))

        for i in range(len(ids) - 1):
            offer(i, i + 1)
        gone = [False] * len(ids)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j] = new, True
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x, dead in zip(ids, gone) if not dead]

    def pieces(self, words: list[str]) -> list[tuple[str, bytes, bytes, str]]:
        """Ids of each word, printed and as 32-bit numbers, how many bytes of the normalised text each covers (likewise), and the text they decode to.

        A character of no piece gives one id per byte, the last of which covers it; without such ids a run of them is one unknown piece.
        """
        if not words:
            return []
        flat, sizes = self.merge(words)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        plain = (np.minimum.reduceat(flat, starts) >= 0) & (np.maximum.reduceat(flat, starts) < self.n_pieces)
        # one string of all numbers and one of all words, cut at the words
        known = np.clip(flat, 0, self.n_pieces - 1)
        printed = ",".join(map(str, known.tolist()))
        places = np.concatenate([[0], np.cumsum(self.piece_digits[known] + 1)])
        first, last = places[starts].tolist(), (places[ends] - 1).tolist()
        ids, covers = known.astype("<i4").tobytes(), self.piece_bytes[known].tobytes()
        decoded = "".join(words).replace(SPACE, " ")
        letters = np.cumsum([len(w) for w in words]).tolist()
        out, begin = [], 0
        for a, b, i, j, end in zip(first, last, (4 * starts).tolist(), (4 * ends).tolist(), letters):
            out.append((printed[a:b], ids[i:j], covers[i:j], decoded[begin:end]))
            begin = end
        for k in np.flatnonzero(~plain).tolist():
            found, lengths, surface = self._with_unknown(flat[starts[k] : ends[k]].tolist(), out[k][3])
            out[k] = ",".join(map(str, found)), np.array(found, "<i4").tobytes(), np.array(lengths, "<i4").tobytes(), surface
        return out

    def _with_unknown(self, symbols: list[int], decoded: str) -> tuple[list[int], list[int], str]:
        ids, sizes, surface = [], [], []
        for symbol in symbols:
            name = chr(-1 - symbol) if symbol < 0 else self.name_of[symbol]
            size = len(name.encode())
            if 0 <= symbol < self.n_pieces:
                ids.append(symbol)
                sizes.append(size)
                surface.append(name.replace(SPACE, " "))
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in name.encode()]
                sizes += [0] * (size - 1) + [size]
            elif ids and ids[-1] == self.unknown:
                sizes[-1] += size
            else:
                ids.append(self.unknown)
                sizes.append(size)
                surface.append(self.unknown_text)
        return ids, sizes, decoded if self.byte_ids else "".join(surface)

    def leading_spaces(self, ids: bytes) -> int:
        """How many spaces decoding takes from the beginning: that of the first piece, and where spaces are squeezed that of each piece before other text."""
        spaces = 0
        if self.prefix or self.squeeze:
            for i in range(0, len(ids), 4):
                name = self.name_of.get(int.from_bytes(ids[i : i + 4], "little"), "")
                spaces += name.startswith(SPACE)
                if name != SPACE or not self.squeeze:
                    break
        return spaces


class Encoded:
    """One text: ``ids`` and their printed form, the bytes ``[starts, ends)`` of the text behind each piece, the decoded text."""

    __slots__ = ("ids", "printed", "starts", "ends", "decoded")

    def __init__(self, ids: bytes, printed: str, starts: np.ndarray, ends: np.ndarray, decoded: str):
        self.ids, self.printed, self.starts, self.ends, self.decoded = ids, printed, starts, ends, decoded


class PieceCoder:
    """Encodes texts with a model; remembers words."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.known: dict[str, tuple[str, bytes, bytes, str]] = {}

    def encode(self, texts: list[str]) -> Iterator[Encoded]:
        normalised = [self.model.normalise(text) for text in texts]
        split = [self.model.words.findall(normal) for normal, _ in normalised]
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        new = list(set().union(*split).difference(self.known))
        self.known.update(zip(new, self.model.pieces(new)))
        for (_, places), words in zip(normalised, split):
            printed, packed, covers, surface = zip(*map(self.known.__getitem__, words)) if words else ((),) * 4
            ends = np.cumsum(np.frombuffer(b"".join(covers), "<i4"), dtype=np.int64)
            edges = places[np.concatenate([[0], ends])] if len(ends) else np.zeros(1, np.int64)
            ids = b"".join(packed)
            decoded = "".join(surface)[self.model.leading_spaces(ids) :]
            yield Encoded(ids, ",".join(printed), edges[:-1], edges[1:], decoded)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        size = max(1, len(batch) * BATCH_BYTES // max(1, batch.column("text").nbytes))
        for at in range(0, len(batch), size):
            part = batch.slice(at, size)
            yield part, pc.fill_null(part.column("text"), "").to_pylist()


def _coded(document_text: DataFrame, model_path: str, columns: dict[str, pa.DataType], result: Callable[[str, Encoded], tuple]) -> DataFrame:
    names = {pa.int64(): "bigint", pa.string(): "string", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<bigint>"}
    kind = document_text.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{c} {names[t]}" for c, t in columns.items())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(kept_by_worker("piece model", model_path, lambda: PieceModel(model_path)))
        for part, texts in _texts(batches):
            rows = [result(text, one) for text, one in zip(texts, coder.encode(texts))]
            arrays = [pa.array(column, t) for column, t in zip(zip(*rows), columns.values())] if rows else [pa.array([], t) for t in columns.values()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", *columns])

    return document_text.select("doc_id", "text").mapInArrow(code, schema)


def encoded(document_text: DataFrame, model_path: str) -> DataFrame:
    """Pieces of each document text, as the SentencePiece library encodes it without begin and end ids, and where each comes from.

    Takes ``doc_id, text`` (see ``records.document_text``) and the path of a model file with BPE pieces, present on every machine; gives
    ``doc_id``, ``ids``, ``starts`` and ``ends`` (byte offsets in the UTF-8 text, end exclusive), ``decoded`` (the text of the ids).
    The text is normalised by the longest keys of the model's character map, which keeps the place of every byte; the spans lie
    side by side, and pieces that stand for nothing of the text (an added space, all bytes of a character but its last) are empty.
    Null and empty texts have no ids. Repeated rows come back as often; other columns are left out; an empty table gives no rows.
    """
    columns = {"ids": pa.list_(pa.int32()), "starts": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "decoded": pa.string()}
    return _coded(document_text, model_path, columns, lambda _, e: (np.frombuffer(e.ids, "<i4"), e.starts, e.ends, e.decoded))


def digests(document_text: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with ``n_tokens``, the bytes of the text that spans cover (``n_covered``), and SHA-256 digests in place of the lists.

    ``ids_sha256`` digests the ids in decimal, joined by commas; ``spans_sha256`` the ends of the spans likewise.
    """
    columns = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "n_covered": pa.int64(), "spans_sha256": pa.string()}

    def digest(text: str, e: Encoded) -> tuple[int, str, str, int, str]:
        covered = int((e.ends - e.starts).sum())
        return len(e.ids) // 4, _sha256(e.printed.encode()), _sha256(e.decoded.encode()), covered, _sha256(e.ends.astype("<u4").tobytes())

    return _coded(document_text, model_path, columns, digest)


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def spans(coded: DataFrame) -> DataFrame:
    """One row per piece of ``encoded``: ``doc_id, piece_ord`` (from 1), ``id, start, end``."""
    zipped = F.posexplode(F.arrays_zip("ids", "starts", "ends"))
    out = coded.select("doc_id", zipped.alias("place", "p"))
    return out.select("doc_id", (F.col("place") + 1).alias("piece_ord"), F.col("p.ids").alias("id"), F.col("p.starts").alias("start"), F.col("p.ends").alias("end"))
