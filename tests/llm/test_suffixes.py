import hashlib
import random

import numpy as np
import pytest

from sensorloom.llm.queries import op1_suffix_array
from sensorloom.llm.suffixes import multikey_order, remove_repeats


def brute(texts, width):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - width + 1):
            seen.setdefault(t[i:i + width], []).append((d, i))
    hit = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                hit[d][i:i + width] = b"\1" * width
    out = []
    for t, h in zip(texts, hit):
        kept = bytes(b for b, x in zip(t, h) if not x)
        spans = sum(1 for i, x in enumerate(h) if x and (i == 0 or not h[i - 1]))
        out.append((len(t), sum(h), spans, kept))
    return out


def corpus(seed, n=60, alphabet="ab cd"):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randint(20, 90)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [word(rng.randint(0, 60)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts.insert(rng.randint(0, len(parts)), s[a:a + rng.randint(10, 90)])
        texts.append("".join(parts))
    return texts + ["", None, "x", texts[0], texts[0], "ha " * 60, "é" * 40 + "ñ", "q" * 3000, "\0" * 70 + "a", "\0" * 75]


@pytest.mark.parametrize("group", [20_000, 3])
@pytest.mark.parametrize("seed, alphabet", [(1, "ab cd"), (2, "abcdefghijklmno pqrstuvé"), (3, "a")])
def test_against_brute_force(spark, seed, alphabet, group):
    texts = corpus(seed, alphabet=alphabet)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in remove_repeats(df, 24, group).collect()}
    for i, want in enumerate(brute([(t or "").encode() for t in texts], 24)):
        assert got[i] == want, (i, texts[i])


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).count() == 0
    rows = spark.createDataFrame([(1, "z" * 500), (1, "z" * 500), (None, "short"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(rows).collect())
    none = hashlib.sha256(b"").hexdigest()
    assert got == [(0, 0, 0, none), (0, 5, 0, hashlib.sha256(b"short").hexdigest()), (1, 500, 500, none), (1, 500, 500, none)]


def test_planted_passages_of_400_bytes_go_and_shorter_ones_stay(spark, tmp_path):
    rng = random.Random(9)
    words = lambda k, letters="abcdefghijklmnopqrstuvwxyzé": " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(k))
    texts, spans = [words(rng.randint(90, 600)) for _ in range(20)], [0] * 80
    for size in [400, 399, 520, 370, 1300, 390] * 5:  # 30 passages, two documents each
        passage = words(300, "abcdefghijklmnopqrstuvwxyz")[:size]
        assert len(passage.split()) > 50
        for side in "<>", "[]":  # the bytes beside a passage differ from those beside its copy
            spans[len(texts)] = int(size >= 400)
            texts.append(f"{words(rng.randint(0, 300))}{side[0]}{passage}{side[1]}{words(rng.randint(0, 300))}")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op1_suffix_array(spark, str(tmp_path)).collect()}
    want = brute([t.encode() for t in texts], 400)
    assert [w[2] for w in want] == spans and sum(spans) == 30
    assert got == {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in enumerate(want)}


def test_multikey_order_sorts_like_bytes():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    runs = np.sort(rng.integers(0, 20, 500))
    order = multikey_order(words, runs)
    want = sorted(range(500), key=lambda i: (runs[i], *words[i]))
    assert [(runs[i], *words[i]) for i in order] == [(runs[i], *words[i]) for i in want]
