"""Runs of periodic words in texts: common extensions by a difference cover, and an enumeration over a harmonic grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, whole_text
from .hashing import as_bytes

# A run has at least so many words, and at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
# Fixed values, a perfect difference set modulo 31: any two residues differ by two of its members in exactly one way.
CYCLE, COVER = 31, (1, 5, 11, 24, 25, 27)
# Words of texts that are searched together, besides one whole text, and grid points that are looked at together.
TOGETHER, POINTS = 150_000, 400_000

WORD = r"[^\x20\x09-\x0D]+"
_FAR = np.int64(1) << 40


def _shifts() -> np.ndarray:
    """[i, j]: the least d for which i + d and j + d are both in the cover."""
    inside = np.zeros(CYCLE, bool)
    inside[list(COVER)] = True
    table = np.zeros((CYCLE, CYCLE), np.int64)
    for i in range(CYCLE):
        for j in range(CYCLE):
            table[i, j] = next(d for d in range(CYCLE) if inside[(i + d) % CYCLE] and inside[(j + d) % CYCLE])
    return table


SHIFTS = _shifts()


def least_table(values: np.ndarray) -> list[np.ndarray]:
    """The sparse table of minima: row k has the least of each 2**k values in a row."""
    rows = [values]
    while 2 << (len(rows) - 1) <= len(values):
        half = 1 << (len(rows) - 1)
        rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
    return rows


def least(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low:high] for each pair; no range is empty."""
    level = np.frexp(high - low)[1] - 1
    out = np.empty(len(low), table[0].dtype)
    for k in np.unique(level).tolist():
        here = np.flatnonzero(level == k)
        out[here] = np.minimum(table[k][low[here]], table[k][high[here] - (1 << k)])
    return out


class Extensions:
    """Longest common extensions of word numbers, in which every text ends with a number that stands nowhere else.

    Only suffixes at places of the cover are sorted: by two words at a time, beyond 31 by the order of what follows.
    Any two places reach two of these within 31 words, which are compared one by one; from there the least common
    prefix between the two in the sorted order is the rest.
    """

    def __init__(self, words: np.ndarray):
        self.words = np.concatenate((words, [-1], np.full(2 * CYCLE, -2))).astype(np.int64)
        places = np.arange(len(words) + 1)
        inside = np.zeros(CYCLE, bool)
        inside[list(COVER)] = True
        self.number = np.cumsum(inside[places % CYCLE]) - 1  # of the sampled suffix at a place
        self.sampled = places[inside[places % CYCLE]]
        self._sort()

    def _sort(self) -> None:
        at, m = self.sampled, len(self.sampled)
        group = np.zeros(m, np.int64)  # first place of a suffix's group in the order
        common = np.full(m, _FAR)  # with the suffix before it in the order
        active, depth, shift = np.arange(m), 0, CYCLE
        while len(active) > 1:
            doubling = depth >= CYCLE
            if doubling:
                key = group[self.number[at[active] + shift]]
            else:
                key = (self.words[at[active] + depth] << 32) | (self.words[at[active] + depth + 1] & 0xFFFFFFFF)
            order = np.lexsort((key, group[active]))
            active, key, of = active[order], key[order], group[active[order]]
            first = np.concatenate(([True], of[1:] != of[:-1]))
            split = np.flatnonzero(np.concatenate(([False], ~first[1:] & (key[1:] != key[:-1]))))
            if doubling:
                # the two go on in groups that were told apart before
                table = least_table(common)
                upto = shift + least(table, np.minimum(key[split], key[split - 1]) + 1, np.maximum(key[split], key[split - 1]) + 1)
                shift *= 2
            else:
                upto = depth + ((key[split] >> 32) == (key[split - 1] >> 32))
                depth += 2
            place = np.arange(len(active))
            place = of + place - np.maximum.accumulate(np.where(first, place, 0))  # in the whole order
            fresh = first.copy()
            fresh[split] = True
            group[active] = np.maximum.accumulate(np.where(fresh, place, 0))
            common[place[split]] = upto
            last = np.concatenate((fresh[1:], [True]))
            active = active[~(fresh & last)]
        self.rank = group
        self.table = least_table(common)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from places i and j on; i and j differ."""
        shift = SHIFTS[i % CYCLE, j % CYCLE]
        out, going = np.zeros(len(i), np.int64), np.arange(len(i))
        while len(going):
            arrived = out[going] >= shift[going]
            done = going[arrived]
            if len(done):
                a, b = self.rank[self.number[i[done] + shift[done]]], self.rank[self.number[j[done] + shift[done]]]
                out[done] += least(self.table, np.minimum(a, b) + 1, np.maximum(a, b) + 1)
            going = going[~arrived]
            going = going[self.words[i[going] + out[going]] == self.words[j[going] + out[going]]]
            out[going] += 1
        return out


def runs_of(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, sorted, of texts that stand at starts in `words`, each with an own end.

    A run of period q with at least g + q words, g = max(24, 3q) - q, has a word of the grid 0, g, 2g, ... that
    equals the one q words on; the equal words around the two are the run. Of one stretch the least period counts.
    """
    n = len(words)
    found = [np.zeros((0, 4), np.int64)]
    longer = np.flatnonzero(sizes >= LEAST_WORDS)
    most = sizes[longer] // LEAST_PERIODS
    if not len(longer):
        return found[0]
    ahead, back = Extensions(words), Extensions(words[::-1].copy())
    text = np.repeat(longer, most)
    period = np.arange(1, most.sum() + 1) - np.repeat(np.cumsum(most) - most, most)
    step = np.maximum(LEAST_WORDS, LEAST_PERIODS * period) - period
    points = -(-(sizes[text] - period) // step)
    upto = np.cumsum(points)
    cuts = np.unique(np.concatenate((np.searchsorted(upto, np.arange(POINTS, upto[-1], POINTS)), [len(points)])))
    low = 0
    for high in cuts.tolist():
        if high == low:
            continue
        each = points[low:high]
        of = np.repeat(np.arange(low, high), each)
        offset = (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * step[of]
        i = starts[text[of]] + offset
        same = np.flatnonzero(words[i] == words[i + period[of]])
        of, i = of[same], i[same]
        q = period[of]
        right, left = ahead.forward(i, i + q), back.forward(n - i, n - i - q)
        length = left + right + q
        long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        found.append(np.column_stack((text[of], i - left - starts[text[of]], length, q))[long])
        low = high
    rows = np.unique(np.concatenate(found), axis=0)
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, starts, sizes): the words of the texts as numbers one text after the other, each followed by an own number."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(x) for x in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    words = np.empty(int(sizes.sum()) + len(texts) + 1, np.int32)
    for start, held in zip(starts.tolist(), texts):
        words[start:start + len(held)] = [known.setdefault(w, len(known)) for w in held]
    ends = np.concatenate((starts + sizes, [len(words) - 1]))
    words[ends] = len(known) + np.arange(len(ends))
    return words, starts, sizes


def periodic_runs(documents: DataFrame, extra: list[str] = ()) -> DataFrame:
    """The runs of every whole text, one row per row of `documents`: doc_id, n_words, runs, collapsed.

    A run is a stretch of words whose smallest period q fits at least three times and that has at least 24 words; no
    word before or after it goes on with that period. `runs` are (start, length, period), words numbered from 0, by
    start and period. `collapsed` are the words, joined by one blank, without those that a run holds after its
    first q. Words are what stands between ASCII white space. Columns named in `extra` are passed through.

    Null or empty text, or one without words: no runs, empty `collapsed`. A null doc_id is kept, repeated rows have a
    row each. Runs may overlap or lie in one another. An empty table gives an empty result. A text is searched by one
    task, in memory of some hundred bytes a word; nothing is shuffled.
    """
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", whole_text().alias("_text"), *extra)
    kinds = dict(rows.dtypes)
    passed = ["doc_id", *extra]
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                texts, size, high = [], 0, low
                while high < batch.num_rows and (size < TOGETHER or high == low):
                    texts.append(as_bytes(batch.column("_text")[high].as_py()).split())
                    size += len(texts[-1])
                    high += 1
                words, starts, sizes = numbered(texts)
                rows = runs_of(words, starts, sizes)
                bounds = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, starts[rows[:, 0]] + rows[:, 1] + rows[:, 3], 1)
                np.add.at(change, starts[rows[:, 0]] + rows[:, 1] + rows[:, 2], -1)
                stay = np.cumsum(change) == 0
                collapsed = []
                for t, held in enumerate(texts):
                    if bounds[t] < bounds[t + 1]:
                        held = [held[k] for k in np.flatnonzero(stay[starts[t]:starts[t] + sizes[t]]).tolist()]
                    collapsed.append(b" ".join(held).decode("utf-8", "surrogatepass"))
                held_runs = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(low, high - low) for c in passed), pa.array(sizes), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), held_runs).cast(shape), pa.array(collapsed, pa.string())],
                    [*passed, "n_words", "runs", "collapsed"])
                low = high

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in passed)
    return rows.mapInArrow(searched, f"{schema}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def best_run(runs: Column) -> Column:
    """The run with the greatest exponent, length / period; of equals the first, then that of the least period. None: null.

    Quotients of whole numbers below 2**26 are equal as doubles only where they are equal.
    """
    ranked = F.transform(runs, lambda r: F.struct((r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length")))
    best = F.array_max(ranked)
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the best run's start, length, period and exponent_milli, and digests of runs and collapsed text."""
    best = F.col("best")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), (r["period"]).cast("string"))), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best_run(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_repeated_ends(documents: DataFrame) -> DataFrame:
    """(doc_id, text): texts of which every tenth, by crc32 of the id, ends in a repeated stretch of its own words.

    With h = crc32 of doc_id as decimal text and g = floor(h / 10), a text of n words with h % 10 = 0 keeps words before
    a = g % n; word i from there on is word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)). A null id counts as
    the empty text.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # one number per row; only where it is due are words made an array
    words = F.regexp_extract_all(whole_text(), F.lit(WORD), F.lit(0))
    rows = documents.select("doc_id", whole_text().alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    a, p = F.col("a"), F.col("p")
    place = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
    altered = F.array_join(F.transform(place, lambda i: F.get("words", i)), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), altered).otherwise(F.col("text")).alias("text"))
