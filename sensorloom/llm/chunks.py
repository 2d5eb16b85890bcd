"""BPE encoding and decoding with reuse of chunks: texts are cut by a rolling hash, each chunk is encoded once, joins are repaired."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest, small_batches, whole_text
from .hashing import as_bytes, prefix_hash, span_hash
from .memory import Memory

# A cut comes where the hash of the last WINDOW bytes is below a 1 / SPARSE share of all hashes, LEAST bytes after the one before.
WINDOW, SPARSE, LEAST = 16, 4096, 2048
# Words beside a join that are encoded with it, first so many on each side, then so many.
WIDTHS = (1, 3)
# Occurrences in one Arrow batch from which a chunk's references go to several tasks, each with the chunk's text.
HOT, SALTS = 4, 256

# Bytes that a Python worker spends on words it remembers, about.
REMEMBERED_BYTES = 150_000_000

_SYNC = re.compile(r"(?<=\S) (?=\S)")
_CHUNK = ["key", "salt", "content", "n", "chunks", "text"]
_ROW = "key binary, salt int, content binary, n int, chunks int, text binary"
_CODED = ["content", "n", "packed", "front", "back"]
_CODED_ROW = "content binary, n int, packed binary, front string, back string"


def cuts(data: bytes) -> list[int]:
    """Bounds of the chunks of a text in UTF-8; they depend on the bytes around them, not on their place."""
    held = np.frombuffer(data, np.uint8)
    bounds = [0]
    if len(held) > LEAST:
        sums = prefix_hash(held)
        at = np.arange(WINDOW, len(held))
        low = span_hash(sums, at - WINDOW, at) < np.uint64((1 << 64) // SPARSE)
        at = at[low & ((held[WINDOW:] & 0xC0) != 0x80)]  # not inside a character
        k = int(np.searchsorted(at, LEAST))
        while k < len(at):
            bounds.append(int(at[k]))
            k = int(np.searchsorted(at, bounds[-1] + LEAST))
    return [*bounds, len(held)] if len(held) else bounds


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The file's tokenizer; one per worker."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs side by side
    held = Tokenizer.from_file(path)
    held.no_padding()
    held.no_truncation()
    return held


def encoded(texts: list[str], path: str) -> list[np.ndarray]:
    return [np.array(x.ids, "<u4") for x in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def remembered(path: str) -> Memory:
    """Ids of words with the blank before them; one memory per worker and file."""
    return Memory(lambda words: [x.tobytes() for x in encoded([f" {w}" for w in words], path)], len, lambda: REMEMBERED_BYTES)


def encoded_insides(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of texts that begin with a blank and fall into words at single blanks; words are encoded once as long as they are remembered."""
    words = [_SYNC.split(x[1:]) for x in texts]
    known = remembered(path).of(set().union(*words))
    return [np.frombuffer(b"".join(map(known.__getitem__, of)), "<u4") for of in words]


def chunk_rows(texts: DataFrame) -> DataFrame:
    """(key, salt, content, n, chunks, text) of rows (content, text): the chunks, and where they stand.

    A row says that a chunk, under its digest, is the n-th of so many of the text `content`. The first row of a chunk in an Arrow
    batch also gives its bytes, compressed. A batch gives each text once. Rows of a chunk that comes often in a batch
    carry a salt, and one of them the bytes: no task meets all rows of a frequent chunk.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            copies: Counter[bytes] = Counter()
            texts: dict[bytes, bytes] = {}
            for content, text in zip(batch.column("content").to_pylist(), batch.column("text").to_pylist()):
                texts.setdefault(content, as_bytes(text))
                copies[content] += 1
            refs, often, chunks = [], Counter(), {}
            for content, data in texts.items():
                bounds = cuts(data)
                for n, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    key = hashlib.blake2b(data[a:b], digest_size=16).digest()
                    chunks[key] = data[a:b]
                    often[key] += copies[content]
                    refs.append((key, content, n, len(bounds) - 1))
            salt = next(iter(texts), b"\0")[0] % SALTS
            salts = {key: salt + 1 if often[key] >= HOT else 0 for key in chunks}
            rows = []
            for key, content, n, of in refs:
                data = chunks.pop(key, None)
                rows.append((key, salts[key], content, n, of, data if data is None else pack.compress(data)))
            kinds = (pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 6, kinds)], _CHUNK)

    return texts.select("content", "text").mapInArrow(cut, _ROW)


def _parts(text: str) -> tuple[str, str, str] | None:
    """(inside, front, back) of a chunk, None if it has too few words.

    The inside is what lies between blanks before and after which a word ends and begins, so it has the same tokens in
    any text. `front` is what comes before it, a part of a word as a rule, with its first words; `back` its last words
    with what comes after it.
    """
    at = [m.start() for m in _SYNC.finditer(text)]
    most = WIDTHS[-1]
    return (text[at[0]:at[-1]], text[:at[most]], text[at[-1 - most]:]) if len(at) > 2 * most else None


def _results(ids: list[np.ndarray], path: str, digests: bool) -> list[tuple]:
    """(n_tokens, ids, decoded) of texts, or digests of the latter two: see `encode_chunked` and `encode_digests`."""
    out = []
    for x in ids:
        raw, text = x.tobytes(), tokenizer(path).decode(x.tolist(), skip_special_tokens=False)
        out.append((len(x), *(hashlib.sha256(y).hexdigest() for y in (raw, text.encode()))) if digests else (len(x), raw, text))
    return out


def _result_columns(digests: bool) -> tuple[list[str], list[pa.DataType], str]:
    if digests:
        return ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return ["n_tokens", "ids", "decoded"], [pa.int64(), pa.binary(), pa.string()], "n_tokens long, ids binary, decoded string"


def encoded_chunks(rows: DataFrame, path: str, digests: bool) -> DataFrame:
    """The rows of `chunk_rows` with what is known of their chunk: a chunk is encoded once in a task, and once at all unless salted.

    (content, n, packed, front, back, and the results): ids of the chunk's inside, compressed, and the texts at both ends
    of it. A chunk with few words has only `front`, its text. For a text of a single chunk there are the results instead.
    """
    names, kinds, schema = _result_columns(digests)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        now, known = None, None
        for batch in batches:
            held = list(zip(*(batch.column(c).to_pylist() for c in _CHUNK)))
            records = {now: known}
            fresh = {}
            for key, salt, _, _, _, text in held:
                if (key, salt) not in records and (key, salt) not in fresh:
                    fresh[key, salt] = unpack.decompress(text).decode("utf-8", "surrogatepass")
            parts = [_parts(x) for x in fresh.values()]
            ids = iter(encoded_insides([p[0] for p in parts if p], path))
            for place, text, p in zip(fresh, fresh.values(), parts):
                records[place] = (pack.compress(next(ids).astype(_width(path)).tobytes()), *p[1:]) if p else (None, text, None)
            alone = list({(key, salt) for key, salt, _, _, of, _ in held if of == 1})
            whole = [joined([records[x]], _width(path)) for x in alone]
            repair([j for joins, _ in whole for j in joins], path)
            done = dict(zip(alone, _results([put_together(*x) for x in whole], path, digests)))
            out = []
            for key, salt, content, n, of, _ in held:
                now, known = (key, salt), records[key, salt]
                # copies of a text in other batches give the same row, most of them one after the other
                if not out or out[-1][:2] != (content, n):
                    out.append((content, n, None, None, None, *done[now]) if of == 1 else (content, n, *known, None, None, None))
            types = (pa.binary(), pa.int32(), pa.binary(), pa.string(), pa.string(), *kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 8, types)], [*_CODED, *names])

    # rows with a chunk's bytes come first
    met = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", F.col("text").isNull(), "content", "n")
    return met.mapInArrow(coded, f"{_CODED_ROW}, {schema}")


def _width(path: str) -> str:
    return "<u2" if tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


class Join:
    """The text between the insides of two chunks of a text, with the last words of the one and the first words of the other."""

    def __init__(self, text: str, left: str = "", right: str = ""):
        self.text, self.left, self.right = text, left, right
        self.level, self.ids = 0, None
        self.from_left = self.from_right = 0  # ids at the ends of the chunks' insides that the join replaces

    def texts(self) -> list[str]:
        """What has to be encoded: the window, its outer words on both sides, and the words that it takes from the chunks."""
        size, inner = WIDTHS[self.level], WIDTHS[self.level - 1] if self.level else 0
        left, right = (_words(self.left, n, last=True) for n in (size, inner)), (_words(self.right, n) for n in (size, inner))
        (wide_left, near_left), (wide_right, near_right) = left, right
        return [wide_left + self.text + wide_right, wide_left[:len(wide_left) - len(near_left)], wide_right[len(near_right):], near_left, near_right]

    def settle(self, found: np.ndarray, before: np.ndarray, after: np.ndarray, near_left: np.ndarray, near_right: np.ndarray) -> bool:
        """Take the ids of the window if its outer words have their own ids there; else widen it, so that it replaces these words."""
        end = len(found) - len(after)
        if end >= len(before) and np.array_equal(found[:len(before)], before) and np.array_equal(found[end:], after):
            self.ids, self.from_left, self.from_right = found[len(before):end], len(near_left), len(near_right)
            return True
        self.level += 1
        if self.level == len(WIDTHS):
            raise ValueError("ids beside a join depend on more than the words next to it: this tokenizer cannot be used in chunks")
        return False


def _words(text: str, n: int, last: bool = False) -> str:
    """The first or last n of a chunk's words beside a join."""
    if not text or not n:
        return ""
    at = [0, *(m.start() for m in _SYNC.finditer(text)), len(text)]
    return text[at[-1 - n]:] if last else text[:at[n]]


def joined(chunks: list[tuple], kind: str) -> tuple[list[Join], list[np.ndarray]]:
    """(joins, insides) of a text's chunks (ids, front, back); a join stands before each inside and after the last."""
    unpack, joins, insides, text, left = zstandard.ZstdDecompressor(), [], [], "", ""
    for packed, front, back in chunks:
        if packed is None:
            text += front
            continue
        at = _SYNC.search(front).start()
        joins.append(Join(text + front[:at], left, front[at:]))
        insides.append(np.frombuffer(unpack.decompress(packed), kind))
        at = [m.start() for m in _SYNC.finditer(back)][-1]
        text, left = back[at:], back[:at]
    return [*joins, Join(text, left)], insides


def put_together(joins: list[Join], insides: list[np.ndarray]) -> np.ndarray:
    out = [joins[0].ids]
    for before, ids, after in zip(joins, insides, joins[1:]):
        out += [ids[before.from_right:len(ids) - after.from_left], after.ids]
    return np.concatenate(out).astype("<u4")


def repair(joins: list[Join], path: str) -> None:
    """Encode all joins, wider where the words beside them don't agree, until all agree. Equal texts are encoded once."""
    while joins:
        wanted = [j.texts() for j in joins]
        texts = list({t for of in wanted for t in of})
        ids = dict(zip(texts, encoded(texts, path)))
        joins = [j for j, of in zip(joins, wanted) if not j.settle(*(ids[t] for t in of))]


def encoded_texts(chunks: DataFrame, path: str, digests: bool) -> DataFrame:
    """(content and the results), one row per distinct text that isn't empty."""
    names, kinds, schema = _result_columns(digests)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finished(texts: list[tuple[bytes, list[tuple]]]) -> pa.RecordBatch:
            # a text of a single chunk has its results already
            results = [chunks[0][3:] for _, chunks in texts]
            open_ = [k for k, x in enumerate(results) if x[0] is None]
            parts = [joined([c[:3] for c in texts[k][1]], _width(path)) for k in open_]
            repair([j for joins, _ in parts for j in joins], path)
            for k, x in zip(open_, _results([put_together(*x) for x in parts], path, digests)):
                results[k] = x
            columns = [[c for c, _ in texts], *zip(*results)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.binary(), *kinds))], ["content", *names])

        now, chunks, done = None, [], []
        for batch in batches:
            for content, n, *chunk in zip(*(batch.column(c).to_pylist() for c in (*_CODED, *names))):
                if content != now:
                    if chunks:
                        done.append((now, chunks))
                    now, chunks = content, []
                # a row may come from several batches and tasks
                if n == len(chunks):
                    chunks.append(tuple(chunk))
                elif n > len(chunks):
                    raise ValueError("a chunk of a text is missing")
            if done:
                yield finished(done)
                done = []
        if chunks:
            yield finished([(now, chunks)])

    met = chunks.repartition("content").sortWithinPartitions("content", "n")
    return met.mapInArrow(assembled, f"content binary, {schema}")


def with_content(documents: DataFrame) -> DataFrame:
    """`documents` with `text` (null: empty) and its digest `content`."""
    return documents.withColumn("text", whole_text()).withColumn("content", digest(F.col("text")))


def _encoded(documents: DataFrame, path: str, digests: bool) -> DataFrame:
    small_batches(documents.sparkSession)
    rows = with_content(documents.select("doc_id", "text"))
    found = encoded_texts(encoded_chunks(chunk_rows(rows), path, digests), path, digests)
    return rows.select("doc_id", "content").join(found, "content", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))


def encode_chunked(documents: DataFrame, path: str) -> DataFrame:
    """Ids and decoded text of every whole text, one row per row of `documents`: doc_id, n_tokens, ids, decoded.

    The ids are those of the tokenizers library without special tokens added; special strings inside a text are handled
    as its default. `ids` are little-endian unsigned 32-bit integers; `decoded` is what the library makes of them, special
    tokens included.

    Texts are cut by a rolling hash, so that passages that texts share become equal chunks. Distinct chunks are encoded
    once, where they meet by their digests; there, their words come from a memory. At a join, the text between the last
    and first full words is encoded together with a word of each chunk; the ids of these words must be those that the
    chunks have there, else more words take part. A tokenizer for which that does not settle is refused with ValueError.
    Equal texts are put together once.

    Null or empty text: no ids, empty `decoded`. Null doc_id and repeated rows: each row has its result. Other columns
    are not looked at. Empty table: empty result. Words of any length: a chunk without full words is joined as a whole.
    """
    found = _encoded(documents, path, False)
    return found.select("doc_id", "n_tokens", F.coalesce("ids", F.lit(b"")).alias("ids"), F.coalesce("decoded", F.lit("")).alias("decoded"))


def encode_digests(documents: DataFrame, path: str) -> DataFrame:
    """As `encode_chunked`, with SHA-256 digests (lowercase hex) in place of ids and decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Only the chunks of texts that have several are shuffled a second time.
    """
    nothing = F.sha2(F.lit(b""), 256)
    found = _encoded(documents, path, True)
    return found.select("doc_id", "n_tokens", F.coalesce("ids_sha256", nothing).alias("ids_sha256"), F.coalesce("decoded_sha256", nothing).alias("decoded_sha256"))
