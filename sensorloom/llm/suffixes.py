"""Removal of long repeated strings with a sparse suffix array, built in range partitions."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest, shared_path, small_batches, stored, whole_text
from .hashing import mix, prefix_hash, span_hash

# Suffixes with one lead that one task sorts in memory; leads with more go by window digests instead.
GROUP = 20_000
# Suffixes that are sorted at a time, besides the last group.
CHUNK = 20_000


def gram_size(width: int) -> int:
    """Bytes of the gram by which the suffixes of windows of `width` bytes are chosen; their leads have this length."""
    return min(64, max(1, width // 6))


def _covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans; spans that touch are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[fresh], reach[np.concatenate((fresh[1:], [True]))]


def anchors(data: np.ndarray, width: int) -> dict[str, np.ndarray]:
    """The suffixes of a text that stand for all its windows of `width` bytes, and the text's own repeats.

    A window is represented by the suffix at the gram in it with the smallest hash, the leftmost of equals: a choice
    by content, so equal windows have it at the same offset. Returned per suffix: gram (hash), place, and the first
    and last window (low, high) that it stands for. Where windows repeat inside the text, `starts` and `ends` cover
    them, and suffixes whose windows all have an earlier copy in the text are left out.
    """
    none = np.zeros(0, np.int64)
    n, gram = len(data) - width + 1, gram_size(width)
    if n <= 0:
        return {"gram": none, "place": none, "low": none, "high": none, "starts": none, "ends": none}
    sums = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(sums, at, at + gram)
    reach = width - gram + 1
    key = np.full(-(-len(grams) // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
    key[:len(grams)] = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    blocks = key.reshape(-1, reach)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(behind[:n], ahead[reach - 1:reach - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    high = np.concatenate((low[1:], [n])) - 1
    place = chosen[low]
    names = grams[place]
    starts = ends = none
    if len(np.unique(names)) < len(names):  # only then can a window repeat inside the text
        windows = span_hash(sums, at[:n], at[:n] + width)
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        later = twice.copy()
        twice[order[:-1][same]] = True
        at_twice = np.flatnonzero(twice)
        starts, ends = _covered(at_twice, at_twice + width)
        fresh = np.concatenate(([0], np.cumsum(~later)))
        needed = fresh[high + 1] > fresh[low]
        names, place, low, high = names[needed], place[needed], low[needed], high[needed]
    return {"gram": names.view(np.int64), "place": place, "low": low, "high": high, "starts": starts, "ends": ends}


def multikey_order(words: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Multikey quicksort of all runs at once: the order of rows by run, then by their words from left to right.

    Rows that are still tied after some words form a part; all parts are split by their next word together, and
    only parts with two rows or more go on to the word after it. `runs` is ascending.
    """
    order = np.arange(len(runs))
    part = runs.astype(np.int64).copy()
    live = order
    for depth in range(words.shape[1] + 1):
        edge = np.concatenate(([True], part[live][1:] != part[live][:-1], [True]))
        alone = edge[1:] & edge[:-1]
        live = live[~alone]
        if not len(live) or depth == words.shape[1]:
            break
        rows = order[live]
        key = words[rows, depth]
        sort = np.lexsort((key, part[live]))
        order[live] = rows[sort]
        key, old = key[sort], part[live]
        edge = np.concatenate(([True], (old[1:] != old[:-1]) | (key[1:] != key[:-1])))
        part[live] = live[np.flatnonzero(edge)][np.cumsum(edge) - 1]  # a part is named by its first place
    return order


def _matrix(texts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in texts), np.uint8).reshape(len(texts), width)


def _words(matrix: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(matrix).view(">u8").astype(np.uint64)


def _prefixes(matrix: np.ndarray, order: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row in the order with the one before it; -1 where another run begins."""
    lcp = np.full(len(order), -1, np.int64)
    held = matrix[order]
    for at in range(1, len(order), 4096):  # bounds the comparison's memory
        differ = held[at:at + 4096] != held[at - 1:at - 1 + len(held[at:at + 4096])]
        lcp[at:at + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])
    of = runs[order]
    lcp[1:][of[1:] != of[:-1]] = -1
    return lcp


def extents(runs: np.ndarray, suffixes: list[bytes], lefts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in runs of equal leads: how far left and right of its start each is covered by windows that stand at another, too.

    `lefts` are the bytes before each suffix that its windows reach, `suffixes` those from its start on. (0, 0): no
    such window. The windows of a suffix that repeat all contain its start, so they cover one span.
    """
    breadth = -(-width // 8) * 8
    right, left = _matrix(suffixes, breadth), _matrix([x[::-1] for x in lefts], breadth)
    to_right, to_left = np.array([len(x) for x in suffixes]), np.array([len(x) for x in lefts])
    order = multikey_order(np.hstack([_words(right), _words(left)]), runs)
    lcp, lcp_left = _prefixes(right, order, runs), _prefixes(left, order, runs)
    # rows that agree in all their bytes: every window of theirs repeats; one of them is enough for the others
    same = (lcp >= breadth) & (lcp_left >= breadth)
    same[1:] &= (to_right[order[1:]] == to_right[order[:-1]]) & (to_left[order[1:]] == to_left[order[:-1]])
    twin = np.zeros(len(runs), bool)
    twin[order[same]] = True
    first = order[~same]
    twin[order[:-1][same[1:]]] = True
    out_left, out_right = np.where(twin, to_left, 0), np.where(twin, to_right, 0)

    single = np.ones(len(first), bool)
    of = runs[first]
    single[1:] &= of[1:] != of[:-1]
    single[:-1] &= of[1:] != of[:-1]
    rows = np.sort(first[~single])
    if not len(rows):
        return out_left, out_right
    runs, right, left, to_right, to_left = runs[rows], right[rows], left[rows], to_right[rows], to_left[rows]
    by_right, by_left = multikey_order(_words(right), runs), multikey_order(_words(left), runs)
    lcp_right, lcp_left = _prefixes(right, by_right, runs), _prefixes(left, by_left, runs)
    in_right, in_left = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    furthest, nearest = np.full(len(rows), -1), np.full(len(rows), -1)
    for back in range(width - gram_size(width) + 1):
        in_right[by_right] = np.cumsum(lcp_right < width - back)
        in_left[by_left] = np.cumsum(lcp_left < back)
        held = np.flatnonzero((to_left >= back) & (to_right >= width - back))
        window = in_right[held] * (len(rows) + 1) + in_left[held]
        sort = np.argsort(window, kind="stable")
        equal = window[sort[1:]] == window[sort[:-1]]
        twice = held[np.concatenate((sort[1:][equal], sort[:-1][equal]))]
        furthest[twice] = back
        nearest[twice[nearest[twice] < 0]] = back
    found = furthest >= 0
    out_left[rows[found]] = np.maximum(out_left[rows[found]], furthest[found])
    out_right[rows[found]] = np.maximum(out_right[rows[found]], width - nearest[found])
    return out_left, out_right


def repeated_spans(documents: DataFrame, width: int = 400, group: int = GROUP) -> DataFrame:
    """The texts of `documents` with what repeats in them: key, data, copies, spans (array of start, end), one row per distinct text.

    The result is bucketed by key. See `remove_repeats` for the meaning.
    """
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select(whole_text().cast("binary").alias("data")).withColumn("key", digest(F.col("data")))
    distinct = texts.groupBy("key").agg(F.max("data").alias("data"), F.count("*").alias("copies"))
    # kept by key, so that none of the passes below shuffles texts again
    name = f"texts_{uuid.uuid4().hex}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct.write.bucketBy(buckets, "key").option("path", shared_path(spark, "suffix-texts")).saveAsTable(name)
    distinct = spark.table(name)
    distinct.schema  # resolved; the catalog entry of the files has done its work
    spark.sql(f"DROP TABLE {name}")

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"gram": pa.int64(), "place": pa.int32(), "low": pa.int32(), "high": pa.int32(), "starts": pa.int32(), "ends": pa.int32()}
        for batch in batches:
            found = [anchors(np.frombuffer(x, np.uint8), width) for x in batch.column("data").to_pylist()]
            columns = [pa.array([x[k] for x in found], pa.list_(kinds[k])) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], ["key", *kinds])

    lists = ", ".join(f"{k} array<{t}>" for k, t in (("gram", "long"), ("place", "int"), ("low", "int"), ("high", "int"), ("starts", "int"), ("ends", "int")))
    facts = stored(distinct.select("key", "data").mapInArrow(anchored, f"key binary, {lists}"), "suffix-anchors")
    own = facts.where(F.size("starts") > 0).select("key", F.explode(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))).alias("span")).select("key", "span.start", "span.end")

    leads = facts.select("key", F.explode(F.arrays_zip("gram", "place", "low", "high")).alias("a")).select("key", "a.*")
    counts = leads.withColumn("mark", F.xxhash64("key", "place")).groupBy("gram").agg(F.count("*").alias("n"), F.min("mark").alias("a"), F.max("mark").alias("b"))
    shared = leads.join(counts.where("a <> b").select("gram", "n"), "gram")
    shared = stored(shared.groupBy("key").agg(
        F.collect_list(F.when(F.col("n") <= group, F.struct("place", "low", "high"))).alias("cold"),
        F.collect_list(F.when(F.col("n") > group, F.struct("place", "low", "high"))).alias("hot")), "suffix-shared")

    spans = own.union(_cold_spans(distinct, shared, width)).union(_hot_spans(distinct, shared, width))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return distinct.join(spans, "key", "left")


def _cold_spans(distinct: DataFrame, shared: DataFrame, width: int) -> DataFrame:
    """Spans from suffixes that are sorted: range partitions by lead, local multikey quicksort, neighbours compared."""
    gram = gram_size(width)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"lead": [], "suffix": [], "before": [], "key": [], "place": []}
            for key, data, held in zip(*(batch.column(c).to_pylist() for c in ("key", "data", "cold"))):
                for a in held:
                    suffix = data[a["place"]:a["high"] + width]
                    for k, v in zip(out, (suffix[:gram], suffix, data[a["low"]:a["place"]], key, a["place"])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], pa.int32() if k == "place" else pa.binary()) for k in out], list(out))

    suffixes = distinct.select("key", "data").join(shared.where(F.size("cold") > 0).select("key", "cold"), "key")
    suffixes = suffixes.mapInArrow(cut, "lead binary, suffix binary, before binary, key binary, place int")
    # Spark samples the splitters; equal leads fall into one partition, so no group crosses a boundary
    parts = max(8, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = suffixes.repartitionByRange(parts, "lead").sortWithinPartitions("lead")

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("lead", "suffix", "before", "key", "place")
        held: list[list] = [[] for _ in columns]
        for batch in batches:
            for have, c in zip(held, columns):
                have += batch.column(c).to_pylist()
            if len(held[0]) < CHUNK:
                continue
            # the last lead may go on in the next batch
            ready = len(held[0])
            while ready and held[0][ready - 1] == held[0][-1]:
                ready -= 1
            if ready:
                yield spans_of([x[:ready] for x in held])
                held = [x[ready:] for x in held]
        if held[0]:
            yield spans_of(held)

    def spans_of(rows: list[list]) -> pa.RecordBatch:
        lead, suffix, before, key, place = rows
        runs = np.cumsum([0] + [a != b for a, b in zip(lead, lead[1:])])
        left, right = extents(runs, suffix, before, width)
        hit = np.flatnonzero(right)
        place = np.array(place)[hit]
        return pa.RecordBatch.from_arrays(
            [pa.array([key[i] for i in hit], pa.binary()), pa.array(place - left[hit], pa.int32()), pa.array(place + right[hit], pa.int32())], ["key", "start", "end"])

    return ranged.mapInArrow(matched, "key binary, start int, end int")


def _hot_spans(distinct: DataFrame, shared: DataFrame, width: int) -> DataFrame:
    """Spans from suffixes whose lead is too frequent for one task: every window of theirs by its 128-bit digest, pre-aggregated."""
    hot = distinct.select("key", "data").join(shared.where(F.size("hot") > 0).select("key", "hot"), "key")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data, held in zip(*(batch.column(c).to_pylist() for c in ("key", "data", "hot"))):
                sums = prefix_hash(np.frombuffer(data, np.uint8))
                other = prefix_hash(np.frombuffer(data, np.uint8) ^ np.uint8(0x5A))
                at = np.unique(np.concatenate([np.arange(a["low"], a["high"] + 1) for a in held]))
                one, two = span_hash(sums, at, at + width), mix(span_hash(other, at, at + width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array([key] * len(at), pa.binary()), pa.array(at, pa.int32())], ["one", "two", "key", "start"])

    found = hot.mapInArrow(windows, "one long, two long, key binary, start int")
    mark = F.xxhash64("key", "start")
    twice = found.groupBy("one", "two").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a <> b").select("one", "two")
    return found.join(twice, ["one", "two"]).select("key", "start", (F.col("start") + width).alias("end"))


def remove_repeats(documents: DataFrame, width: int = 400, group: int = GROUP, with_text: bool = True) -> DataFrame:
    """Every text of `documents` without the bytes that a string of `width` bytes covers which also starts elsewhere.

    One row per row of `documents`: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary, the
    remaining bytes; only `with_text`), kept_sha256. Elsewhere is any other place of the same or another document, overlaps included;
    matches do not cross documents, and all strings are judged on the input.

    The suffix array is sparse: per text, only suffixes at chosen grams (about one in 170 bytes at width 400), which
    stand for all windows around them, and of these only the ones whose gram occurs twice. They are range-partitioned
    by their leading bytes (64 at width 400) with sampled splitters and sorted in each partition by multikey quicksort, from the
    start to the right and from the start to the left. Common prefixes of neighbours in both orders give the windows
    that two suffixes share. Leads with more than `group` suffixes go by window digests, spread over all tasks.

    Null text: empty, nothing removed. A text shorter than `width` is left whole. Copies (also of a row) are folded
    first; all of a copied text of at least `width` bytes goes. Other columns are not looked at. A single text must fit
    into a task's memory about 40 times. Empty table: empty result.
    """
    spans = repeated_spans(documents, width, group)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
            for data, copies, held in zip(*(batch.column(c).to_pylist() for c in ("data", "copies", "spans"))):
                if copies > 1 and len(data) >= width:
                    starts, ends = np.array([0]), np.array([len(data)])
                else:
                    held = held or []
                    starts, ends = _covered(np.array([x["start"] for x in held], np.int64), np.array([x["end"] for x in held], np.int64))
                kept = b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)]))
                for k, v in zip(out, (len(data) - len(kept), len(starts), kept, hashlib.sha256(kept).hexdigest())):
                    out[k].append(v)
            kinds = {"n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary(), "kept_sha256": pa.string()}
            if not with_text:
                del kinds["kept"]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(out[k], t) for k, t in kinds.items())], ["key", *kinds])

    result = spans.mapInArrow(removed, f"key binary, n_removed long, n_spans long, {'kept binary, ' if with_text else ''}kept_sha256 string")
    ids = documents.select("doc_id", whole_text().alias("text")).select("doc_id", digest(F.col("text")).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"))
    return ids.join(result, "key").drop("key")
