"""SentencePiece encoding and decoding: pieces are matched in a batch with a suffix array, the matches relaxed in vocabulary order."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_text
from .memory import Memory

SPACE = "▁"
# Bytes that a Python worker spends on words it remembers, about; words not met for the longest time go first.
REMEMBERED_BYTES = 200_000_000
# Characters that are indexed together, and the longest word that takes part; longer ones go one by one.
BATCH_CHARS, LONG_WORD = 500_000, 64
# Characters of texts that are split into words at a time, besides one whole text.
TEXT_CHARS = 1_000_000


class Vocabulary:
    """The pieces of a byte-pair model file with byte fallback, without white-space rules other than a leading blank."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        from sentencepiece import sentencepiece_model_pb2

        kind = sentencepiece_model_pb2.ModelProto()
        kind.ParseFromString(model.serialized_model_proto())
        normal = kind.normalizer_spec
        if kind.trainer_spec.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not kind.trainer_spec.byte_fallback:
            raise ValueError("only byte-pair models with byte fallback, a leading blank and no normalisation are supported")
        names = [model.id_to_piece(i) for i in range(len(model))]
        plain = [i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece reaches from one word into the next")
        self.bytes = np.zeros(256, np.int32)
        self.out: list[bytes] = [b""] * len(names)
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.bytes[int(name[3:5], 16)] = i
                self.out[i] = bytes([int(name[3:5], 16)])
            elif not model.is_control(i):
                self.out[i] = name.replace(SPACE, " ").encode()
        # pieces in the order in which they win: by score, then by id
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.ids = np.array(order, np.int32)
        self.rank = {names[i]: r for r, i in enumerate(order)}
        self.longest = max(len(x) for x in self.rank)
        # characters of the vocabulary as two bytes, none of them 0, so that fixed-width keys compare like texts
        letters = sorted({c for x in self.rank for c in x})
        self.code = np.zeros(0x110000, np.uint16)
        for n, c in enumerate(letters):
            self.code[ord(c)] = (n // 255 + 1 << 8) + n % 255 + 1
        self.other = np.uint16(0xFE01)  # any character that no piece has
        self.code[self.code == 0] = self.other
        self.keys = self._keys(list(self.rank))
        self.sizes = np.array([len(x) for x in self.rank])
        self.ends = np.array([x + b"\xff\xff" for x in self.keys.tolist()], f"S{2 * self.longest + 2}")

    def _keys(self, texts: list[str]) -> np.ndarray:
        return np.array([self.code[np.array([ord(c) for c in x])].astype(">u2").tobytes() for x in texts], f"S{2 * self.longest}")

    def edges(self, codes: np.ndarray) -> np.ndarray:
        """[place, length - 1]: rank of the piece that stands there in the text of character codes, or a large number.

        The suffixes, as far as the longest piece reaches, are sorted; each piece is a range in their order, found by
        binary search of its two ends.
        """
        padded = np.concatenate((codes, np.zeros(self.longest, np.uint16))).astype(">u2")
        order = self._suffix_order(codes)
        suffixes = np.lib.stride_tricks.sliding_window_view(padded, self.longest)[:len(codes)]
        held = np.ascontiguousarray(suffixes[order]).view(f"S{2 * self.longest}").ravel()
        low, high = np.searchsorted(held, self.keys), np.searchsorted(held, self.ends)
        table = np.full((len(codes), self.longest), np.iinfo(np.int32).max, np.int32)
        counts = high - low
        rank = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        table[order[at], self.sizes[rank] - 1] = rank
        return table

    def _suffix_order(self, codes: np.ndarray) -> np.ndarray:
        """Places in the order of the texts that begin there, as far as the longest piece reaches: by 4 characters, then by prefix doubling."""
        n, reach = len(codes), 4
        ahead = np.concatenate((codes, np.zeros(4, np.uint16))).astype(np.uint64)
        key = ahead[:n] << np.uint64(48) | ahead[1:n + 1] << np.uint64(32) | ahead[2:n + 2] << np.uint64(16) | ahead[3:n + 3]
        order = np.argsort(key)
        while reach < self.longest:
            held = key[order]
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(np.concatenate(([True], held[1:] != held[:-1])))
            key = rank << np.uint64(32)
            key[:max(0, n - reach)] |= rank[reach:]
            order = np.argsort(key)
            reach *= 2
        return order

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as int32 bytes. A word is text in which blanks stand only at the beginning."""
        out: list[bytes] = []
        start = 0
        while start < len(words):
            end, size = start, 0
            while end < len(words) and (size < BATCH_CHARS or end == start):
                size += len(words[end])
                end += 1
            out += self._encode(words[start:end])
            start = end
        return out

    def _encode(self, words: list[str]) -> list[bytes]:
        text = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = self.edges(self.code[text])
        sizes = np.array([len(x) for x in words])
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        merged = [self._one_by_one(table, int(bounds[i]), int(bounds[i + 1])) for i in np.flatnonzero(sizes > LONG_WORD)]
        # the symbols of all other words: first single characters; then in each round every word joins its best pair
        start = np.flatnonzero(np.repeat(sizes <= LONG_WORD, sizes))
        owner = np.repeat(np.arange(len(words)), sizes)[start]
        length = np.ones(len(start), np.int64)
        none = np.iinfo(np.int64).max
        done = []
        while len(start):
            pair = np.full(len(start), none)
            both = length[:-1] + length[1:]
            fits = np.flatnonzero((owner[1:] == owner[:-1]) & (both <= self.longest))
            rank = table[start[fits], both[fits] - 1]
            known = rank < np.iinfo(np.int32).max
            pair[fits[known]] = (rank[known].astype(np.int64) << 32) | fits[known]
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(pair, first)
            active = best < none
            members = np.diff(np.concatenate((first, [len(start)])))
            stay = np.repeat(active, members)
            done.append((start[~stay], length[~stay]))
            left = best[active] & 0xFFFFFFFF  # equal ranks: the leftmost
            length[left] += length[left + 1]
            stay[left + 1] = False
            start, length, owner = start[stay], length[stay], owner[stay]
        starts = np.concatenate([x for x, _ in done] + [x for x, _ in merged])
        lengths = np.concatenate([x for _, x in done] + [x for _, x in merged])
        order = np.argsort(starts, kind="stable")
        return self._named(table, text, starts[order], lengths[order], bounds)

    def _named(self, table: np.ndarray, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Ids of the symbols, cut at the words' bounds; a character that is no piece becomes its UTF-8 bytes."""
        rank = table[starts, lengths - 1]
        unknown = np.flatnonzero(rank == np.iinfo(np.int32).max)
        repeats = np.ones(len(starts), np.int64)
        spelled = [self.bytes[np.frombuffer(chr(text[starts[i]]).encode("utf-8", "surrogatepass"), np.uint8)] for i in unknown]
        repeats[unknown] = [len(x) for x in spelled]
        rank[unknown] = 0
        ids = np.repeat(self.ids[rank], repeats)
        to = np.cumsum(repeats)
        for i, x in zip(unknown, spelled):
            ids[to[i] - len(x):to[i]] = x
        cut = np.concatenate(([0], to))[np.searchsorted(starts, bounds)]
        raw = ids.astype("<i4").tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def _one_by_one(self, table: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (start, length) of one long word: the best pair first, from a heap."""
        none = np.iinfo(np.int32).max
        length = dict.fromkeys(range(begin, end), 1)
        before = {i: i - 1 for i in range(begin + 1, end)}
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            n = length[i] + length.get(i + length[i], self.longest)
            if n <= self.longest and (rank := int(table[i, n - 1])) < none:
                heapq.heappush(heap, (rank, i, n))

        for i in range(begin, end):
            offer(i)
        while heap:
            _, i, n = heapq.heappop(heap)
            if i not in length or n != length[i] + length.get(i + length[i], self.longest):
                continue
            del length[i + length[i]]
            length[i] = n
            if i + n in length:
                before[i + n] = i
            offer(i)
            if i > begin:
                offer(before[i])
        starts = np.array(sorted(length), np.int64)
        return starts, np.array([length[i] for i in starts.tolist()], np.int64)


_WORD = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker and file."""
    return Vocabulary(path)


@lru_cache(maxsize=2)
def remembered(path: str) -> Memory:
    """Ids of words; one memory per worker and file."""
    return Memory(vocabulary(path).encode_words, len, lambda: REMEMBERED_BYTES)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text, as int32 bytes; words that the worker has not met are encoded together."""
    out, start = [], 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (size < TEXT_CHARS or end == start):
            size += len(texts[end])
            end += 1
        words = [_WORD.findall(" " + x) if x else [] for x in texts[start:end]]
        known = remembered(path).of(set().union(*words))
        out += [b"".join(map(known.__getitem__, of)) for of in words]
        start = end
    return out


def decode_ids(ids: np.ndarray, path: str) -> str:
    """The text of some ids; bytes that are no UTF-8 become replacement characters."""
    out = vocabulary(path).out
    text = b"".join(map(out.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode(documents: DataFrame, path: str, verify: bool = False) -> DataFrame:
    """`documents` with the column `ids` (array of int): the ids of the whole text, as the file's own library gives them.

    With `verify` also `round_trip`: whether the ids, decoded in the same task, give the text again.

    The text, with a blank put before it and blanks written as U+2581, falls into words between which no piece
    reaches. The distinct new words of an Arrow batch are written one after the other and indexed by a suffix array;
    every piece is searched in it, and its occurrences are the edges at each position. For a byte-pair vocabulary the
    edges are relaxed by priority: the piece with the best score joins two symbols first, the leftmost of equals. A
    worker remembers words, in about REMEMBERED_BYTES besides a batch's.

    Null or empty text: no ids. Characters that no piece has are spelled in byte pieces. All columns and rows are kept;
    existing columns of these names are replaced. Empty table: empty result.
    """
    small_batches(documents.sparkSession)
    added = ["ids", "round_trip"] if verify else ["ids"]
    rows = documents.select(F.struct(*[c for c in documents.columns if c not in added]).alias("row"), whole_text().alias("text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = encode_texts(texts, path)
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in found]))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
            columns = [batch.column("row"), ids]
            if verify:
                columns.append(pa.array([decode_ids(np.frombuffer(x, "<i4"), path) == t for x, t in zip(found, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, ["row", *added])

    schema = f"row {rows.schema['row'].dataType.simpleString()}, ids array<int>" + (", round_trip boolean" if verify else "")
    return rows.mapInArrow(encoded, schema).select("row.*", *added)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` with the column `decoded`: the text of its `ids`. Null or no ids: empty text. The column is replaced if there."""
    small_batches(encoded.sparkSession)
    rows = encoded.drop("decoded")
    rows = rows.select(F.struct(*rows.columns).alias("row"), "ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(np.array(x or [], np.int64), path) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "decoded"])

    return rows.mapInArrow(decoded, f"row {rows.schema['row'].dataType.simpleString()}, decoded string").select("row.*", "decoded")
