"""Alignment of two tokenizers' tokens over the same bytes: library spans as coarse cuts, refined with decoded bytes."""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, whole_text
from .memory import Memory

# Characters that are encoded at a time, and of texts that are looked at together, besides one whole segment or text. A text
# falls into segments at single blanks between words.
SEGMENT, TEXT_CHARS = 150_000, 1_000_000
# Characters that one call of a library gets, besides one whole segment: both take less time for a character of short texts.
CALL = 1_000
# Bytes that a Python worker spends on segments it remembers, about.
REMEMBERED_BYTES = 150_000_000
_SPACE = "▁"
# The blank comes first, so that the search leaps from blank to blank.
_CUT = re.compile(rf" (?<=[^\s{_SPACE}] )(?=[^\s{_SPACE}])")


def _inner(segment: str) -> bool:
    """Whether a segment begins and ends with letters that are neither white space nor U+2581."""
    if not segment:
        return False
    first, last = segment[0], segment[-1]
    return not (first == _SPACE or last == _SPACE or first.isspace() or last.isspace())


def segments(text: str, least: int = 0) -> list[str]:
    """Parts of a text, of at least so many characters but the last, that with a blank before each make up the text with a blank before it.

    Both tokenizers start a new word at a single blank, whatever stands before and after it but white space and U+2581,
    so the parts have the tokens of the whole.
    """
    if not least:
        return _CUT.split(text)
    out, start = [], 0
    while len(text) - start > least and (cut := _CUT.search(text, start + least)):
        out.append(text[start:cut.start()])
        start = cut.end()
    return [*out, text[start:]]


def byte_alphabet() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the rest follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def refined(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends of tokens, from spans that may be too wide or too narrow and the tokens' numbers of bytes.

    A span as wide as its token is right. The tokens between two of these (parts of one character, bytes of a
    character that no piece has, a blank that the text hasn't) follow each other by their decoded bytes.
    """
    right = ends - starts == sizes
    if right.all():
        return ends
    decoded = np.cumsum(sizes)
    latest = np.maximum.accumulate(np.where(right, np.arange(len(sizes)), -1))
    return decoded + np.where(latest >= 0, (ends - decoded)[latest], 0)


def _joined(found: list[tuple[list[int], list[tuple[int, int]]]], begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the spans (two columns) of several calls, each of which begins at its place."""
    ids = np.array(list(chain.from_iterable(x for x, _ in found)), np.int64)
    spans = np.array(list(chain.from_iterable(x for _, x in found)), np.int64).reshape(-1, 2)
    return ids, spans + np.repeat(begins, [len(x) for x, _ in found])[:, None]


class Tokenizers:
    """A byte-level BPE file (A) and a SentencePiece file with byte fallback (B), and all id pairs that can be linked.

    Tokens that end together have bytes of which one is the end of the other, so the pairs are known from the two
    vocabularies: at most as many as these have bytes (times ids with the same bytes).
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        byte = byte_alphabet()
        names = {i: x for x, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(byte[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.bytes_b = [self._piece(i) for i in range(len(self.b))]
        if any(_SPACE in self.b.id_to_piece(i).lstrip(_SPACE) for i in range(len(self.b))):
            raise ValueError("a piece reaches from one word into the next")
        self.size_a, self.size_b = (np.array([len(x) for x in held], np.int64) for held in (self.bytes_a, self.bytes_b))
        self.pairs = self._pairs()
        # an id with what comes after it: another of its group's side, the other side, the next group
        self.names = [f"{i}{x}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for x in ",|;"]

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return b"" if self.b.is_control(i) else self.b.id_to_piece(i).replace(_SPACE, " ").encode()

    def _pairs(self) -> np.ndarray:
        """Sorted numbers a * (size of B) + b of the pairs that can be linked."""
        def by_bytes(held: list[bytes]) -> dict[bytes, list[int]]:
            out: dict[bytes, list[int]] = {}
            for i, x in enumerate(held):
                if x:
                    out.setdefault(x, []).append(i)
            return out

        of_a, of_b, n = by_bytes(self.bytes_a), by_bytes(self.bytes_b), len(self.bytes_b)
        found = [a * n + b for x, ids in of_a.items() for k in range(len(x)) for b in of_b.get(x[k:], ()) for a in ids]
        found += [a * n + b for x, ids in of_b.items() for k in range(1, len(x)) for a in of_a.get(x[k:], ()) for b in ids]
        return np.unique(np.array(found, np.int64))

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A, their byte ends, ids of B, their byte ends) in the blank and the text; none where either has other bytes."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none, none, none
        parts, base = [], 0
        for segment in segments(text, SEGMENT):
            data, calls = f" {segment}".encode(), segments(segment, CALL)
            begins = np.cumsum([0, *(len(x) + 1 for x in calls[:-1])])  # of each call's blank, as the offsets of A in characters
            a, spans = _joined([((code := self.a.encode(f" {x}", add_special_tokens=False)).ids, code.offsets) for x in calls], begins)
            if len(data) != len(segment) + 1:
                points = np.frombuffer(f" {segment}".encode("utf-32-le"), np.uint32)
                width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
                places = np.concatenate(([0], np.cumsum(width)))
                spans, begins = places[spans], places[begins]
            ends_a = refined(spans[:, 0], spans[:, 1], self.size_a[a])
            # the spans of B are in bytes, and the blank is not in its text
            b, spans = _joined([((found := self.b.encode(x, return_type="offset_mapping", return_bytes=True))["ids"], found["offsets"]) for x in calls], begins + 1)
            ends_b = refined(spans[:, 0], spans[:, 1], self.size_b[b])
            for ids, held, ends in ((a, self.bytes_a, ends_a), (b, self.bytes_b, ends_b)):
                if b"".join(map(held.__getitem__, ids.tolist())) != data or (len(ends) and ends[-1] != len(data)):
                    return none, none, none, none
            parts.append((a, ends_a + base, b, ends_b + base))
            base += len(data)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def groups(self, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last A tokens, last B tokens) of the groups, as places, and the place in `pairs` of each link."""
        if not len(a):
            return a, b, a
        at = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[np.minimum(at, len(b) - 1)] == ends_a)
        last_b = at[last_a]
        return last_a, last_b, np.searchsorted(self.pairs, a[last_a] * len(self.bytes_b) + b[last_b])

    def spelled(self, text: str) -> list[dict]:
        """The groups of a text: byte offsets in the blank and the text, and ids."""
        a, ends_a, b, ends_b = self.tokens(text)
        last_a, last_b, _ = self.groups(a, ends_a, b, ends_b)
        ends = ends_a[last_a].tolist()
        return [
            {"start": s, "end": e, "a": x.tolist(), "b": y.tolist()}
            for s, e, x, y in zip([0, *ends], ends, np.split(a, last_a + 1), np.split(b, last_b + 1))]

    def listed(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """The groups as text, `a1,a2|b1;a3|b2,b3;`, each id with what comes after it."""
        if not len(a):
            return []
        ends = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        ends[0][last_a], ends[1][last_b] = 1, 2
        # tokens of A come after the B tokens of the groups before theirs, those of B after their own group's A tokens
        group = [np.cumsum(x > 0) - (x > 0) for x in ends]
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.concatenate(([0], last_b + 1))[group[0]]] = 3 * a + ends[0]
        out[np.arange(len(b)) + (last_a + 1)[group[1]]] = 3 * b + ends[1]
        return list(map(self.names.__getitem__, out.tolist()))

    def parts(self, found: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, groups as text, links as int32 bytes) of segments; None where the tokens have other bytes.

        Segments that begin and end with no white space are encoded together, one blank between two.
        """
        out: list[tuple | None] = [None] * len(found)
        together, size = [], 0
        for k, segment in enumerate(found):
            if _inner(segment):
                together.append(k)
                size += len(segment) + 1
            else:
                out[k] = self._parts_of([segment])[0]
            if together and (size > SEGMENT or k == len(found) - 1):
                for at, part in zip(together, self._parts_of([found[i] for i in together])):
                    out[at] = part
                together, size = [], 0
        for at, part in zip(together, self._parts_of([found[i] for i in together]) if together else ()):
            out[at] = part
        return out

    def _parts_of(self, found: list[str]) -> list[tuple | None]:
        a, ends_a, b, ends_b = self.tokens(" ".join(found))
        if not len(a) and len(found) > 1:
            return [self._parts_of([x])[0] for x in found]  # one of them spoils the others
        if not len(a):
            return [(0, 0, 0, "", b"") if not found[0] else None]
        last_a, last_b, link = self.groups(a, ends_a, b, ends_b)
        names, raw = self.listed(a, b, last_a, last_b), link.astype("<i4").tobytes()
        # a segment ends where a group does
        upto = np.cumsum([len(x.encode()) + 1 for x in found])
        of_a, of_b, of_groups = (np.searchsorted(x, upto, "right").tolist() for x in (ends_a, ends_b, ends_a[last_a]))
        out, i, j, k = [], 0, 0, 0
        for x, y, z in zip(of_a, of_b, of_groups):
            out.append((x - i, y - j, z - k, "".join(names[i + j:x + y])[:-1], raw[4 * k:4 * z]))
            i, j, k = x, y, z
        return out


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """One pair of vocabularies per worker."""
    return Tokenizers(path_a, path_b)


@lru_cache(maxsize=2)
def remembered(path_a: str, path_b: str) -> Memory:
    """Results of segments; one memory per worker and pair of files."""
    return Memory(tokenizers(path_a, path_b).parts, lambda x: 0 if x is None else 250 + len(x[3]) + len(x[4]), lambda: REMEMBERED_BYTES)


@contextmanager
def uncollected() -> Iterator[None]:
    """Without searches for cycles, of which spans, ids and remembered segments make none, and which would look at all of these."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@uncollected()
def digested(texts: list[str], path_a: str, path_b: str) -> list[tuple]:
    """(n_a, n_b, n_groups, groups_sha256, links as int32 bytes) of each text."""
    out, start = [], 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (size < TEXT_CHARS or end == start):
            size += len(texts[end])
            end += 1
        split = [segments(x) if x else [] for x in texts[start:end]]
        known = remembered(path_a, path_b).of(set().union(*split))
        for of in split:
            parts = list(map(known.__getitem__, of))
            if not parts or None in parts:
                out.append((0, 0, 0, "", b""))
                continue
            n_a, n_b, n_groups, listed, links = zip(*parts)
            out.append((sum(n_a), sum(n_b), sum(n_groups), hashlib.sha256(";".join(listed).encode()).hexdigest(), b"".join(links)))
        start = end
    return out


def token_groups(documents: DataFrame, path_a: str, path_b: str, extra: list[str] = (), with_groups: bool = False) -> DataFrame:
    """The groups and links of every whole text, one row per row of `documents`.

    doc_id, n_a, n_b, n_groups, groups_sha256, links (places in the pairs that the two vocabularies can link, one per
    link), and the columns named in `extra`. With `with_groups` also `groups`: (start, end, a, b) with byte offsets in
    the blank and the text, and the ids. See `align_tokens` for the rows' meaning.
    """
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", whole_text().alias("_text"), *extra)
    kinds = dict(rows.dtypes)
    passed = ["doc_id", *extra]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            n_a, n_b, n_groups, digests, links = zip(*digested(texts, path_a, path_b)) if texts else [()] * 5
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in links]))).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(links), "<i4")))
            columns = [*(batch.column(c) for c in passed), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(digests, pa.string()), found]
            names = [*passed, "n_a", "n_b", "n_groups", "groups_sha256", "links"]
            if with_groups:
                ids = pa.list_(pa.int32())
                groups = [tokenizers(path_a, path_b).spelled(x) for x in texts]
                columns.append(pa.array(groups, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", ids), ("b", ids)]))))
                names.append("groups")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in passed) + ", n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>"
    return rows.mapInArrow(aligned, schema + (", groups array<struct<start:long,end:long,a:array<int>,b:array<int>>>" if with_groups else ""))


def _flat(links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a list column without nulls."""
    return links.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(links.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)


def link_counts(groups: DataFrame) -> DataFrame:
    """(link, n): how many links of all rows join a pair of ids; counted in the batches first, then by Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            link, n = np.unique(_flat(batch.column("links"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(link.astype(np.int32)), pa.array(n.astype(np.int64))], ["link", "n"])

    return groups.select("links").mapInArrow(counted, "link int, n long").groupBy("link").agg(F.sum("n").alias("n"))


def align_tokens(documents: DataFrame, path_a: str, path_b: str, extra: list[str] = (), with_groups: bool = False) -> DataFrame:
    """How the tokens of two tokenizers meet in every whole text, and how usual the meetings are, one row per row.

    A encodes a blank and the text, B the text, to which it adds the blank; special strings are plain text. Where
    tokens of both end at one byte, a group ends, and the two are linked. Returned: doc_id, n_a, n_b, n_groups, n_links,
    n_best (links whose pair comes as often as any pair of its B id), count_sum (over links, how often their pair is
    linked in all rows), groups_sha256 (of `a1,a2|b1;a3|b2,b3`), the columns named in `extra`, and with `with_groups`
    the groups themselves.

    Null or empty text, or one whose tokens have other bytes than a blank and the text (one with U+2581): zeros, and
    an empty groups_sha256. Null doc_id: kept. Repeated rows: each has its row and counts. Empty table: empty result.

    Texts are cut at blanks before which a word ends and after which one begins; a worker encodes each distinct segment
    once, as long as it remembers it. The rows with their links are written to the shared folder. Counts come to the driver and
    go to all tasks: one number for each pair that the vocabularies can link, whatever the table's size.
    """
    spark = documents.sparkSession
    both = tokenizers(path_a, path_b)
    groups = stored(token_groups(documents, path_a, path_b, extra, with_groups), "token-groups")
    total = np.zeros(len(both.pairs), np.int64)
    counts = link_counts(groups).toArrow()
    total[counts.column("link").to_numpy()] = counts.column("n").to_numpy()
    of_b = both.pairs % len(both.bytes_b)
    most = np.zeros(len(both.bytes_b), np.int64)
    np.maximum.at(most, of_b, total)
    held = spark.sparkContext.broadcast((total, total == most[of_b]))
    kinds = dict(groups.dtypes)
    kept = [c for c in groups.columns if c != "links"]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, best = held.value
        for batch in batches:
            link, bounds = _flat(batch.column("links"))
            sums = [np.concatenate(([0], np.cumsum(x[link], dtype=np.int64))) for x in (best, total)]
            n_best, count_sum = (x[bounds[1:]] - x[bounds[:-1]] for x in sums)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(np.diff(bounds)), pa.array(n_best), pa.array(count_sum)],
                [*kept, "n_links", "n_best", "count_sum"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    return groups.mapInArrow(judged, f"{schema}, n_links long, n_best long, count_sum long")
