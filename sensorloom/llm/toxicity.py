"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from labels of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, whole_text
from .hashing import as_bytes, prefix_hash, span_hash

# Labelled documents that a model is fitted on at most, taken by a hash of doc_id; the driver holds some kB of each.
TRAINING_ROWS = 8000
# Words are hashed to this many bits.
BITS = 18
STEPS = 250
# Beginnings of words, in bytes, that are features besides the whole words: compound words share them.
BEGINNINGS = (4, 5, 6, 7, 8, 10)
# Share of false finds among the words whose presence counts as associated with the label (Benjamini and Hochberg).
FALSE_FINDS = 0.02
# Documents of the sample that hold a word at least; what fewer hold could never be told from chance.
SEEN = 3

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B), 0x27, *range(0x80, 0x100)]] = True


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learnt from: crc32 of the id as text is divisible by 5. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sentence_words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, sentence, bounds): the distinct features of each sentence, sentences numbered from 0, and their byte bounds.

    Sentences end at . ! ? or a line's end. Words are letters, digits and apostrophes, ASCII lower-cased; features are
    the words and their beginnings. Sentences without words are left out.
    """
    data = np.frombuffer(as_bytes(text).lower(), np.uint8)
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none.reshape(0, 2)
    inside = np.concatenate(([False], _LETTER[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return none, none, none.reshape(0, 2)
    sums = prefix_hash(data)
    number = np.cumsum(_ENDS[data])[starts]
    _, sentence = np.unique(number, return_inverse=True)
    first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
    last = np.concatenate((first[1:], [len(sentence)])) - 1
    hashes, owners = [span_hash(sums, starts, ends)], [sentence]
    for length in BEGINNINGS:
        longer = ends - starts > length
        # told apart from a whole word of the same bytes
        hashes.append(~span_hash(sums, starts[longer], starts[longer] + length))
        owners.append(sentence[longer])
    feature = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    pairs = np.unique((np.concatenate(owners) << BITS) | feature)
    return pairs & ((1 << BITS) - 1), pairs >> BITS, np.column_stack((starts[first], ends[last]))


@dataclass
class Model:
    weights: np.ndarray  # one per hashed word, float32
    bias: float
    usual: float = 1.0  # sentences of a document of the sample, on average

    def sentences(self, feature: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Probability of each of n sentences.

        With q from the sentence's words alone, q * (s + (1 - s) * q), s as in `usual_share`: in a long document a sentence
        that is hardly toxic counts for as much less as there are more of them, so length alone makes no document toxic;
        one that is toxic by itself counts in any.
        """
        z = np.bincount(sentence, self.weights[feature], minlength=n) + self.bias
        q, s = 1 / (1 + np.exp(-np.clip(z, -40, 40))), usual_share(n, self.usual)
        return q * (s + (1 - s) * q)


def usual_share(n: int | np.ndarray, usual: float) -> float | np.ndarray:
    """1 up to the usual number of sentences, then the usual number divided by n."""
    return np.minimum(1.0, usual / np.maximum(1, n))


def document_score(sentences: np.ndarray) -> float:
    """Noisy-or: the document is toxic if any sentence is. None: 0."""
    return float(-np.expm1(np.log1p(-np.minimum(sentences, 1 - 1e-12)).sum()))


def association(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Likelihood ratio statistic (G squared) of a feature from the numbers of toxic and clean documents that hold it."""
    total, held = n_toxic + n_clean, toxic + clean
    parts = []
    for has, of in ((toxic, n_toxic), (clean, n_clean)):
        for seen, with_it in ((has, held), (F.lit(of) - has, F.lit(total) - held)):
            parts.append(F.when(seen > 0, 2 * seen * F.log(seen * total / (with_it * of))).otherwise(0.0))
    return sum(parts[1:], parts[0])


def associated(statistic: np.ndarray) -> np.ndarray:
    """Places of the statistics (one degree of freedom) that are beyond chance, with FALSE_FINDS of them expected to be false.

    What counts follows the number of features and of labels, so a few labels teach the strongest words.
    """
    chance = np.array([erfc(sqrt(max(x, 0.0) / 2)) for x in statistic.tolist()])
    order = np.argsort(chance, kind="stable")
    within = np.flatnonzero(chance[order] <= FALSE_FINDS * np.arange(1, len(order) + 1) / max(1, len(order)))
    return order[:within[-1] + 1] if len(within) else order[:0]


def fit(documents: list[tuple[np.ndarray, np.ndarray, int, int]], kept: np.ndarray, steps: int = STEPS, penalty: float = 2e-5) -> Model:
    """A model from (features, sentence numbers, number of sentences, label) per document, by gradient steps (Adam) on the likelihood.

    `kept` are the hashed words that may have a weight; a document's features are places in it. Noisy-or gives
    1 - exp(-A), A the sum of -log(1 - p) over a document's sentences; with p = q * (s + (1 - s) * q) and q the logistic
    function of z that is softplus(z) - log(1 + (1 - s) * q). Without labels of both kinds every document
    with a sentence scores 1 or 0 as all labels say.
    """
    labels = np.array([d[3] for d in documents], np.float64)
    share = float(labels.mean()) if len(labels) else 0.0
    weights = np.zeros(1 << BITS, np.float32)
    if not 0 < share < 1:
        return Model(weights, 40.0 if share else -40.0, float("inf"))
    sizes = np.array([d[2] for d in documents])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    feature = np.concatenate([d[0] for d in documents])
    sentence = np.concatenate([d[1] + o for d, o in zip(documents, offsets)])
    owner = np.repeat(np.arange(len(documents)), sizes)
    total = int(offsets[-1])
    usual = max(1.0, total / len(documents))
    rest = 1 - usual_share(sizes, usual)[owner]

    theta = np.zeros(len(kept) + 1)
    theta[-1] = np.log(share / usual)
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        z = np.bincount(sentence, theta[feature], minlength=total) + theta[-1]
        q = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        mass = np.bincount(owner, np.logaddexp(0, z) - np.log1p(rest * q), minlength=len(documents))
        pull = np.where(labels > 0, -1 / np.expm1(np.clip(mass, 1e-9, 500)), 1.0)
        slope = pull[owner] * q * (1 - rest * (1 - q) / (1 + rest * q)) / len(documents)
        gradient = np.concatenate((np.bincount(feature, slope[sentence], minlength=len(kept)), [slope.sum()]))
        gradient[:-1] += penalty * theta[:-1]
        mean, spread = 0.9 * mean + 0.1 * gradient, 0.99 * spread + 0.01 * gradient**2
        theta -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    weights[kept] = theta[:-1]
    return Model(weights, float(theta[-1]), usual)


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """A model from the labelled documents that are not held out; at most `rows` of them, chosen by a hash of doc_id.

    Only words whose presence goes with the label beyond chance (`associated`) get a weight, so that wrong labels are
    not learnt by heart from rare words. They are counted by Spark; what comes to the driver are one number for each
    hashed word (at most 2**BITS) and the places of the chosen ones in the sample. A document with several labels is toxic if one says so; rows without doc_id or label teach
    nothing. The sample's ids are broadcast (at most `rows` of them).
    """
    small_batches(documents.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    held = documents.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    held = stored(held, "toxicity-sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.array(batch.column("toxic").to_pylist())
            found = [np.unique(sentence_words(x)[0]) for x in batch.column("text").to_pylist()]
            both = np.concatenate(found) if found else np.zeros(0, np.int64)
            label = np.repeat(toxic, [len(x) for x in found])
            names, place = np.unique(both, return_inverse=True)
            of_toxic = np.bincount(place, label, minlength=len(names)).astype(np.int64)
            of_all = np.bincount(place, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(of_toxic), pa.array(of_all - of_toxic)], ["feature", "of_toxic", "of_clean"])

    sizes = held.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count("*").alias("n")).first()
    counts = held.mapInArrow(counted, "feature long, of_toxic long, of_clean long").groupBy("feature").agg(F.sum("of_toxic").alias("of_toxic"), F.sum("of_clean").alias("of_clean"))
    n_toxic, n_clean = sizes["toxic"], sizes["n"] - sizes["toxic"]
    counts = counts.where(F.col("of_toxic") + F.col("of_clean") >= SEEN)
    statistic = counts.select("feature", association(F.col("of_toxic"), F.col("of_clean"), n_toxic, n_clean).alias("x")) if n_toxic and n_clean else counts.limit(0).select("feature", F.lit(0.0).alias("x"))
    found = statistic.toArrow()
    kept = np.sort(found.column("feature").to_numpy()[associated(found.column("x").to_numpy())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed: list[list] = [[], [], []]
            for text in batch.column("text").to_pylist():
                feature, sentence, bounds = sentence_words(text)
                there = np.isin(feature, kept)
                for out, x in zip(packed, (np.searchsorted(kept, feature[there]).astype("<i4").tobytes(), sentence[there].astype("<i4").tobytes(), len(bounds))):
                    out.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(packed[0], pa.binary()), pa.array(packed[1], pa.binary()), pa.array(packed[2], pa.int32()), batch.column("toxic")], ["feature", "sentence", "n", "toxic"])

    # the order is made the same for every run
    collected = held.mapInArrow(hashed, "feature binary, sentence binary, n int, toxic int").collect()
    collected.sort(key=lambda r: (bytes(r["feature"]), bytes(r["sentence"]), r["n"], r["toxic"]))
    return fit([(np.frombuffer(r["feature"], "<i4").astype(np.int64), np.frombuffer(r["sentence"], "<i4").astype(np.int64), r["n"], r["toxic"]) for r in collected], kept)


def score_documents(documents: DataFrame, model: Model, extra: list[str] = ()) -> DataFrame:
    """Toxicity of every whole text, one row per row of `documents`: doc_id, held_out, score, predicted, offending.

    score is between 0 and 1, predicted is 1 where it is 0.5 or more; offending lists the sentences that are toxic by
    themselves (start and end byte, score). Columns named in `extra` are passed through.

    Null or empty text, or one without words: score 0. Null doc_id: kept, and held out. Repeated rows: each has its row.
    Empty table: empty result. Only the text enters the score.
    """
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), whole_text().alias("_text"), *extra)
    kinds = dict(rows.dtypes)
    passed = ["doc_id", "held_out", *extra]
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, offending = [], []
            for text in batch.column("_text").to_pylist():
                feature, sentence, bounds = sentence_words(text)
                each = model.sentences(feature, sentence, len(bounds))
                scores.append(document_score(each))
                offending.append([{"start": int(bounds[i, 0]), "end": int(bounds[i, 1]), "score": float(each[i])} for i in np.flatnonzero(each >= 0.5)])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passed), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(offending, shape)],
                [*passed, "score", "predicted", "offending"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in passed)
    return rows.mapInArrow(scored, f"{schema}, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `documents`, all columns, that a model fitted on `labels` doesn't call toxic."""
    model = train(documents, labels)
    rows = documents.select("doc_id", "text", F.struct("*").alias("row"))
    return score_documents(rows, model, ["row"]).where("predicted = 0").select("row.*")
