"""Chunked BPE encoding against the tokenizers library."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from sensorloom.llm import chunks, queries

FOLDER = "/root/testdata/sf0.001"
PATHS = [public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json")]


def library(path):
    held = Tokenizer.from_file(path)
    held.no_padding()
    held.no_truncation()
    return held


def prose(rng, n):
    return " ".join(rng.choice(["the", "word", "it's", "naïve", "日本語", "ét", "<|endoftext|>", "a-b", "x\n\n", "12", "Shared"]) + rng.choice(["", "", ".", ",", "́"]) for _ in range(n))


def awkward():
    rng = random.Random(7)
    shared = prose(rng, 900)
    texts = [None, "", " \n", "a", "x" * 60_000, "日" * 5000, "ab" * 9000, "many words " * 9000, "<|startoftext|>", prose(rng, 3), prose(rng, 2000)]
    texts += [f"{prose(rng, rng.randrange(60))} {shared} {prose(rng, rng.randrange(60))}" for _ in range(25)]
    return [*enumerate(texts), (None, shared), (None, None), (10, texts[10]), (77, texts[10])]


@pytest.mark.parametrize("path", PATHS)
@pytest.mark.parametrize("sparse", [4096, 24])
def test_equal_to_the_library(spark, monkeypatch, path, sparse):
    monkeypatch.setattr(chunks, "SPARSE", sparse)
    monkeypatch.setattr(chunks, "LEAST", 2048 if sparse > 100 else 30)
    held, rows = library(path), awkward()
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, content string, n int").repartition(3)
    got = chunks.encode_chunked(df, path).collect()
    want = [(i, held.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    assert sorted([(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got], key=str) == sorted(want, key=str)
    assert all(r["n_tokens"] * 4 == len(r["ids"]) and r["decoded"] == held.decode(np.frombuffer(r["ids"], "<u4").tolist(), skip_special_tokens=False) for r in got)
    assert chunks.encode_chunked(df.limit(0), path).count() == 0


def test_query_equals_the_library(spark):
    held = library(PATHS[0])
    want = set()
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect():
        ids = held.encode(r["text"] or "", add_special_tokens=False).ids
        text = held.decode(ids, skip_special_tokens=False)
        want.add((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in queries.op11_chunk_reuse(spark, FOLDER).collect()} == want


def test_shared_passages_become_shared_chunks():
    rng = random.Random(2)
    shared = prose(rng, 9000).encode()
    parts = []
    for _ in range(2):
        data = prose(rng, rng.randrange(300)).encode() + shared
        bounds = chunks.cuts(data)
        assert bounds[0] == 0 and bounds[-1] == len(data) and min(np.diff(bounds[:-1])) >= chunks.LEAST
        parts.append({data[a:b] for a, b in zip(bounds[:-1], bounds[1:])})
    assert len(parts[0] & parts[1]) >= 3


def test_frequent_chunks_are_spread(spark):
    text = prose(random.Random(1), 500)
    df = chunks.with_content(spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string").repartition(4))
    rows = chunks.chunk_rows(df).collect()
    assert all(r["salt"] > 0 for r in rows)
    # a batch gives a text once, and a chunk's bytes once
    assert max(sum(r["key"] == k for r in rows) for k in {r["key"] for r in rows}) <= 4 and all(r["text"] for r in rows)


def each_word(ahead):
    """A tokenizer of words in which a word's id depends on whether one of the next `ahead` words begins with x."""
    def encoded(texts, path):
        out = []
        for t in texts:
            words = re.findall(r"\S+", t)
            out.append(np.array([2 * int(hashlib.md5(w.encode()).hexdigest()[:6], 16) + any(x.startswith("x") for x in words[i + 1:i + 1 + ahead]) for i, w in enumerate(words)], "<u4"))
        return out

    return encoded


def records(text, bounds, encoded):
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        part = chunks._parts(text[a:b])
        out.append((zstandard.compress(encoded([part[0]], "")[0].tobytes()), *part[1:]) if part else (None, text[a:b], None))
    return out


def test_joins_widen_until_they_agree(monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice("abcx") + str(rng.randrange(50)) for _ in range(400))
    bounds = [0, 150, 300, 310, 700, 1000, len(text)]
    for ahead in (0, 1):
        encoded = each_word(ahead)
        monkeypatch.setattr(chunks, "encoded", encoded)
        joins, insides = chunks.joined(records(text, bounds, encoded), "<u4")
        chunks.repair(joins, "")
        assert any(j.level for j in joins) == bool(ahead)
        assert chunks.put_together(joins, insides).tolist() == encoded([text], "")[0].tolist()
    encoded = each_word(50)
    monkeypatch.setattr(chunks, "encoded", encoded)
    joins, _ = chunks.joined(records(text, bounds, encoded), "<u4")
    with pytest.raises(ValueError, match="cannot be used in chunks"):
        chunks.repair(joins, "")
