"""Periodic runs against plain code."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from sensorloom.llm import queries, runs

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words):
    """(start, length, period) of all runs: each period by itself, least periods by trying all smaller ones."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - i
            if length >= max(24, 3 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    gone = {k for start, length, q in found for k in range(start + q, start + length)}
    return b" ".join(w for k, w in enumerate(words) if k not in gone)


def searched(texts):
    rows = runs.runs_of(*runs.numbered(texts))
    return [[tuple(r[1:]) for r in rows.tolist() if r[0] == t] for t in range(len(texts))]


def awkward_texts():
    rng = random.Random(12)
    texts = [[], [b"a"], [b"a"] * 23, [b"a"] * 24, [b"a"] * 500, [b"a", b"b"] * 11 + [b"a"], [b"a", b"b"] * 12, [b"x"] * 30 + [b"y"] + [b"x"] * 30]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(30))]
            block = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.choice([1, 2, 5, 9, 30, 70]))]
            words += (block * 9)[:rng.randrange(1, 9 * len(block) + 1)]
        texts.append(words)
    inner = [b"p"] * 25 + [b"q", b"r"]
    texts += [inner * 4, (inner * 3 + [b"s"]) * 3, [b"a", b"b", b"c"] * 400 + [b"a", b"b"] * 300]
    return texts


def test_runs_against_plain_code():
    texts = awkward_texts()
    assert searched(texts) == [plain_runs(x) for x in texts]


def test_runs_do_not_depend_on_what_is_searched_together(monkeypatch):
    texts = awkward_texts()
    want = searched(texts)
    monkeypatch.setattr(runs, "POINTS", 50)
    assert searched(texts) == want and [searched([x])[0] for x in texts] == want


def test_cover_reaches_every_pair():
    assert runs.SHIFTS.max() < runs.CYCLE and len({(a - b) % 31 for a in runs.COVER for b in runs.COVER}) == 31


def test_extensions_of_long_repeats():
    rng = np.random.default_rng(3)
    block = rng.integers(0, 4, 300)
    words = np.concatenate((np.tile(block, 5), [7], np.tile(block, 3), np.full(400, 2), [8])).astype(np.int32)
    table = runs.Extensions(words)
    i, j = rng.integers(0, len(words) - 1, (2, 3000))
    i, j = i[i != j], j[i != j]
    both = np.concatenate((words, np.arange(9, 9 + len(words))))

    def plain(a, b):
        same = both[a:a + len(words)] == both[b:b + len(words)]
        return int(np.argmin(same))

    assert table.forward(i, j).tolist() == [plain(a, b) for a, b in zip(i.tolist(), j.tolist())]


def test_long_text_of_one_word():
    assert searched([[b"the"] * 200_000]) == [[(0, 200_000, 1)]]


def plain_digests(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(), hashlib.sha256(plain_collapsed(words, found)).hexdigest())


def test_query_against_plain_code(spark, monkeypatch):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) < 6000")
    monkeypatch.setattr(queries, "table", lambda *_: documents)
    got = {tuple(r) for r in queries.op13_periodic_runs(spark, FOLDER).collect()}
    want = {plain_digests(r["doc_id"], r["text"]) for r in documents.collect()}
    assert got == want and sum(r[1] > 0 for r in want) > 10


@pytest.mark.parametrize("texts", [[(1, None), (2, ""), (None, "a " * 30), (None, None), (4, " \t a\x0bb  "), (4, " \t a\x0bb  "), (7, "ü" * 9), (8, "x y " * 40)], []])
def test_awkward_rows(spark, texts):
    df = spark.createDataFrame([(*r, "c", "d") for r in texts], "doc_id long, text string, runs string, collapsed string")
    rows = runs.digests(runs.periodic_runs(df)).collect()
    want = []
    for i, t in texts:
        words = (t or "").encode().split()
        want.append((i, len(plain_runs(words)), *(plain_runs(words) or [(None,) * 3])[0]))
    assert sorted([tuple(r[:5]) for r in rows], key=str) == sorted(want, key=str)
    whole = runs.periodic_runs(df, extra=[]).select("doc_id", "n_words", "collapsed").collect()
    assert len(whole) == len(texts) and all(r["collapsed"] is not None for r in whole)
