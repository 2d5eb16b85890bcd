"""Operators against brute force, the tokenizer's own library, or held-out labels."""

import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from sensorloom.llm import minhash, pieces, vectors
from sensorloom.llm.common import components
from sensorloom.llm.hashing import shingles
from sensorloom.llm.licenses import TEMPLATES, Scanner, align, words_of
from sensorloom.llm.lines import dedup_lines
from sensorloom.llm.mixing import mix_sources
from sensorloom.llm.pieces import decode_ids, encode_texts
from sensorloom.llm.spots import ANCHORS, fingerprints, spot_links, with_next
from sensorloom.llm.tokens import count_tokens
from sensorloom.llm.toxicity import document_score, fit, score_documents, sentence_words, train

FOLDER = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def closure(nodes, linked):
    lowest = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(lowest[a], lowest[b])
            changed |= lowest[a] != low or lowest[b] != low
            lowest[a] = lowest[b] = low
    return lowest


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closure({x for e in edges for x in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("group", [4000, 6])
def test_minhash_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(minhash, "GROUP", group)
    rng = random.Random(9)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 120))] for _ in range(12)]
    texts = []
    for words in base:
        for _ in range(8):
            words = list(words)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(n := np.intersect1d(sets[i], sets[j])) >= 85 * (len(sets[i]) + len(sets[j]) - len(n))]
    want = closure(range(len(texts)), linked)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, 85).collect()} == want


def plain_signature(held, bands=20, rows=5, seed=1):
    whole = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & whole
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & whole
        return x ^ (x >> 31)

    scattered = [mix((int(x) + seed * 0xD6E8FEB86659FD93) & whole) for x in held]
    out = []
    for band in range(bands):
        value = 0
        for row in range(rows):
            value = mix((value * 0x9E3779B97F4A7C15 + min(mix((x - (band * rows + row + 1)) & whole) for x in scattered)) & whole)
        out.append(value)
    return out


def test_signatures_against_plain_code():
    sets = [shingles(" ".join(f"w{i * k % 97}" for i in range(n))) for k, n in ((1, 1), (3, 5), (5, 40), (7, 200))]
    assert minhash.signatures(sets).tolist() == [plain_signature(x) for x in sets]
    assert [minhash.signatures([x])[0].tolist() for x in sets] == [plain_signature(x) for x in sets]


@pytest.mark.parametrize("limit", [8_000_000, 40])
def test_minhash_with_several_texts_under_one_id(spark, monkeypatch, limit):
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", limit)
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (8, "some other words that stand here alone"), (None, a)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in got) == [(-1, 5, False), (5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True)]
    # the second and third text have nothing in common but the id
    alone = minhash.near_duplicates(spark.createDataFrame([(3, a), (3, b), (2, b)], "doc_id long, text string"), 85).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in alone) == [(2, 2), (3, 2), (3, 2)]


def test_linked_finds_all_components():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(10):
        s = rng.integers(0, 10**6, 60)
        for _ in range(25):  # a chain: ends are far from each other, each step is near
            s = np.where(rng.random(60) < 0.06, rng.integers(0, 10**6, 60), s)
            sets.append(np.unique(s).astype(np.uint64))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(n := np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - len(n))]
    found = minhash.linked(sets, 80)
    assert set(found) <= set(links) | {(b, a) for a, b in links}
    assert closure(range(len(sets)), found) == closure(range(len(sets)), links)


def brute_lines(texts, least):
    runs, where = {}, []
    for d, t in enumerate(texts):
        lines = [(n, x) for n, x in enumerate(t.split("\n")) if x.split()]
        where.append([n for n, _ in lines])
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.split()) for _, x in lines[a:b + 1]) >= least:
                    runs.setdefault(tuple(x for _, x in lines[a:b + 1]), []).append((d, a, b))
    gone = [set() for _ in texts]
    for places in runs.values():
        for d, a, b in places[1:]:
            gone[d] |= set(where[d][a:b + 1])
    return ["\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]) for d, t in enumerate(texts)]


def test_lines_against_brute_force(spark):
    rng = random.Random(8)
    texts = ["\n".join(" ".join(rng.choice("ab") for _ in range(rng.randrange(5))) for _ in range(rng.randrange(9))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [r["text"] for r in dedup_lines(df, 10).orderBy("doc_id").collect()] == brute_lines(texts, 10)


def test_vectors_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 90)
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(300, 16))
    rows = np.vstack([rows, rows[:60] + rng.normal(size=(60, 16)) * 0.08, rows[0] + rng.normal(size=(150, 16)) * 0.05, rows[5:15] * 3])
    label = np.arange(len(rows)) % 2
    u = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    want = closure(range(len(rows)), np.argwhere(near).tolist())
    df = spark.createDataFrame([(i, r.tolist(), int(x)) for i, (r, x) in enumerate(zip(rows, label))], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.embedding_duplicates(df).collect()}
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(len(rows))}


@pytest.mark.parametrize("meeting", [16, 1])
def test_vectors_with_one_id_for_several(spark, monkeypatch, meeting):
    monkeypatch.setattr(vectors, "MEETING", meeting)
    monkeypatch.setattr(vectors, "BLOCK", 1)
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.001]), (2, [-1.0, 0.0]), (3, [0.001, 1.0]), (4, [-1.0, 0.001]), (4, [-1.0, 0.001])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.embedding_duplicates(df).collect())
    assert got == [(0, 1, 0, True), (0, 1, 0, True), (1, 1, 0, False), (2, 2, 2, True), (3, 1, 0, False), (4, 2, 2, False), (4, 2, 2, False)]


def test_graph_recall():
    rng = np.random.default_rng(7)
    held = vectors.unit(list(rng.normal(size=(3000, 24))))
    graph = vectors.Graph.built(held)
    queries = vectors.unit(list(held[:200] + rng.normal(size=(200, 24)) * 0.02))
    truth = [set(np.flatnonzero(held @ q >= 0.7)) for q in queries]
    found = graph.within(queries, 0.7, vectors.BEAM)
    assert sum(len(t & set(f)) for t, f in zip(truth, found)) >= 0.9 * sum(map(len, truth))


def test_pieces_equal_the_library():
    texts = ["", " ", "   a  b ", "a" * 500, "\n\n x\ty", "日本語 テキスト🙂", "the " * 300, "x" * 3 + " " * 40 + "y", "\0a", "http://abc.de/" * 30, "</s> <s> <unk> <0x41>", "Ünïcödé wörds, and more words."]
    rng = random.Random(1)
    texts += ["".join(rng.choice("abcdefgh intheresion.,é\n") for _ in range(rng.randrange(400))) for _ in range(60)]
    library = SentencePieceProcessor(model_file=MODEL)
    ids = [np.frombuffer(x, "<i4") for x in encode_texts(texts, MODEL)]
    assert [x.tolist() for x in ids] == library.encode(texts)
    assert [decode_ids(x, MODEL) for x in ids] == texts


@pytest.mark.parametrize("limit", [0, 3000, 10**8])
def test_remembered_words_are_bounded(monkeypatch, limit):
    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", limit)
    monkeypatch.setattr(pieces, "TEXT_CHARS", 200)
    pieces.remembered.cache_clear()
    rng = random.Random(3)
    texts = [" ".join(f"word{int(rng.paretovariate(0.5))}" for _ in range(12)) for _ in range(80)]
    library = SentencePieceProcessor(model_file=MODEL)
    assert [np.frombuffer(x, "<i4").tolist() for x in encode_texts(texts, MODEL)] == library.encode(texts)
    memory = pieces.remembered(MODEL)
    assert memory.size <= max(limit // 2, 1) and len(memory.young) + len(memory.old) <= limit // 100 + 40
    pieces.remembered.cache_clear()


def test_token_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    texts = ["some words", "some words", None, "", "<s> é 🙂"]
    library = SentencePieceProcessor(model_file=MODEL)
    want = {i: (len((t or "").encode()), len(library.encode(t or ""))) for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for _ in range(2):
        assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in count_tokens(df, MODEL, cache).collect()} == want
        assert spark.read.parquet(cache).count() == 3  # the second run adds nothing
    assert count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), cache).count() == 5
    assert spark.read.parquet(cache).count() == 6


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(40), rng.choice(["a", "b", "c", None])) for i in range(900)] + [(1000, "w " * 5000, "d")]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    for s in size:
        mine = [r for r in out if r["source"] == s]
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mine)
        assert sum(r["target"] for r in mine[:1]) <= 2 * size[s] + 1e-6
        if s != "d":
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 60
    assert sum({r["source"]: r["target"] for r in out}.values()) == pytest.approx(1.5 * sum(size.values()))


def plain_signatures(text):
    words = re.findall(r"[^\W_]+", text.lower())
    if not words:
        return {text} if text else set()
    common = set(ANCHORS)
    at = [-1, *(i for i, w in enumerate(words) if w in common)]  # the beginning is an anchor
    out = []
    for n, i in enumerate(at):
        end = at[n + 4] if n + 4 < len(at) else len(words)
        out.append((words[i] if i >= 0 else None, *[w for w in words[i + 1:end] if w not in common][:2]))
    return numbered(out)


def numbered(signs):
    seen = {}
    return {(s, seen.setdefault(s, []).append(1) or len(seen[s])) for s in signs}


def test_fingerprints_against_plain_code(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "der", "and", "que"] + [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 30, 90, 200]))) + rng.choice(["", ".", "!?"]) for _ in range(60)]
    texts += ["no such words here", "x " * 30, "a brown fox that jumped over the lazy dog and went on to the river with all of its friends, as foxes do in spring"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = fingerprints(df).orderBy("doc_id").collect()
    over = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, r in enumerate(rows):
        nxt, k = texts[(i + 1) % len(texts)], len(texts[i]) // 4
        edited = texts[i][:len(texts[i]) - k] + nxt[:k]
        own = plain_signatures(texts[i])
        assert r["n_chars"] == len(texts[i]) and len(r["fingerprint"]) == 8 * len(own)
        assert r["edited_sha256"] == __import__("hashlib").sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == pytest.approx(over(own, plain_signatures(edited)))
        assert r["near_next"] == pytest.approx(over(own, plain_signatures(nxt)))


def test_spot_links_against_all_pairs(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        words = [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(900)}" for _ in range(rng.randrange(60, 160))]
        for n in range(4):
            texts.append(" ".join(words))
            for _ in range(n):
                words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
    sets = [plain_signatures(t) for t in texts]
    members, links = spot_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    of = {r["doc_id"]: bytes(r["class"]) for r in members.collect()}
    rows = links.collect()
    got = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in rows}
    want = {frozenset((of[i], of[j])) for i in of for j in of if of[i] != of[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    assert got == want, [(r["likeness"], len(sets[i] & sets[j]), len(sets[i] | sets[j])) for r in rows for i in of for j in of if i < j and {of[i], of[j]} == {bytes(r["a"]), bytes(r["b"])} and frozenset((of[i], of[j])) not in want]


def test_signatures_change_little_with_the_text(spark):
    words = [["the", "of", "and"][i % 9 // 3] if i % 3 == 0 else f"w{i}" for i in range(52)]
    few = [["the", "of"][i % 2] if i % 6 == 0 else f"v{i}" for i in range(120)]
    fewer = [f"u{i}" if i in (30, 60) else w for i, w in enumerate(few)]
    texts = [" ".join(x) for x in (words, words[:49], few, fewer)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = {r["doc_id"]: r["near_next"] for r in fingerprints(df).collect()}
    assert near[0] > 0.8 and near[2] > 0.85 and near[1] == near[3] == 0
    members, links = spot_links(df)
    of = {r["doc_id"]: bytes(r["class"]) for r in members.collect()}
    assert {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in links.collect()} == {frozenset((of[0], of[1])), frozenset((of[2], of[3]))}


def test_next_rows_whatever_the_ids(spark):
    rng = random.Random(11)
    ids = [*rng.sample(range(500), 200), 10**12, 10**12 + 5, -7, *[None] * 60, 3, 3, 3]
    rows = [(i, f"the text {rng.randrange(10**6)} of {k}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, __import__("hashlib").sha256(r[1].encode()).hexdigest()))
    want = sorted((a[1], b[1]) for a, b in zip(order, [*order[1:], order[0]]))
    for per_part in (7, 100, 10_000):
        got = with_next(df.withColumn("content", F.unhex(F.sha2("text", 256))), ["text"], per_part=per_part)
        assert sorted((r["text"], r["next_text"]) for r in got.collect()) == want


def test_toxicity_on_held_out_documents(spark):
    documents, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    out = score_documents(documents, train(documents, labels)).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in out) / len(out)
    toxic, clean = ([r["score"] for r in out if r["toxic"] == y] for y in (1, 0))
    better = np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean])
    assert right >= 0.9 and better >= 0.8
    assert sum(x >= 0.5 for x in toxic) >= 0.6 * len(toxic) and sum(x < 0.5 for x in clean) >= 0.97 * len(clean)


def plain_sentences(text):
    """Sets of features of the sentences with words, by regular expressions; a feature's number is taken from a text of that word alone."""
    data = "".join(c.lower() if c < "\x80" else c for c in text or "").encode()
    words = [re.findall(rb"[0-9a-z'\x80-\xff]+", part) for part in re.split(rb"[.!?\n]", data)]
    return [set().union(*(plain_features(w.decode()) for w in of)) for of in words if of]


@lru_cache(maxsize=None)
def plain_features(word):
    return frozenset(sentence_words(word)[0].tolist())


def test_toxicity_against_plain_code(spark):
    folder = "/root/testdata/sf0.001"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = train(documents, labels)
    text = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = [(plain_sentences(text[r["doc_id"]]), r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    # words beyond chance
    held = [(set().union(*s), y) for s, y in rows]
    every, n, n_toxic = Counter(f for h, _ in held for f in h), len(held), sum(y for _, y in held)
    of_toxic = Counter(f for h, y in held if y for f in h)
    chance = []
    for f, k in every.items():
        if k >= 3:
            table = [(of_toxic[f], k, n_toxic), (k - of_toxic[f], k, n - n_toxic), (n_toxic - of_toxic[f], n - k, n_toxic), (n - k - n_toxic + of_toxic[f], n - k, n - n_toxic)]
            chance.append((math.erfc(math.sqrt(max(0, sum(a * math.log(a * n / (b * c)) for a, b, c in table if a)))), f))
    chance.sort()
    last = max((i for i, (p, _) in enumerate(chance) if p <= 0.02 * (i + 1) / len(chance)), default=-1)
    kept = sorted(f for _, f in chance[:last + 1])
    assert kept == np.flatnonzero(model.weights).tolist() and kept
    # the fit, document by document
    usual = max(1, sum(len(s) for s, _ in rows) / n)
    inside = [np.array([[f in x for f in kept] for x in s], float).reshape(-1, len(kept)) for s, _ in rows]
    theta = np.append(np.zeros(len(kept)), math.log(n_toxic / n / usual))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, 251):
        slope = 2e-5 * np.append(theta[:-1], 0)
        for x, (_, y) in zip(inside, rows):
            q, s = 1 / (1 + np.exp(-(x @ theta[:-1] + theta[-1]))), min(1, usual / max(1, len(x)))
            p = q * (s + (1 - s) * q)
            none = np.prod(1 - p)  # no sentence is toxic
            each = q * (1 - q) * (s + 2 * (1 - s) * q) / (1 - p) * (-none / (1 - none) if y else 1) / n
            slope += np.append(each @ x, each.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    assert np.allclose(model.weights[kept], theta[:-1], atol=1e-3) and abs(model.bias - theta[-1]) < 1e-3
    # the scores of all documents
    weight = dict(zip(kept, theta[:-1]))
    for r in score_documents(documents, model).collect():
        s = plain_sentences(text[r["doc_id"]])
        q, share = [1 / (1 + math.exp(-theta[-1] - sum(weight.get(f, 0) for f in x))) for x in s], min(1, usual / max(1, len(s)))
        want = 1 - math.prod(1 - x * (share + (1 - share) * x) for x in q)
        assert r["score"] == pytest.approx(want, abs=1e-3) and r["predicted"] == (r["score"] >= 0.5)


def test_long_clean_documents_are_not_toxic():
    rng = np.random.default_rng(4)
    documents = []
    for i in range(600):
        n = int(rng.integers(5, 60))
        mild = np.flatnonzero(rng.random(n) < (0.1 if i % 8 else 0.2))
        told = rng.integers(0, n, 1) if i % 8 == 0 else mild[:0]
        feature = np.concatenate((np.ones(len(mild), np.int64), np.zeros(len(told), np.int64)))
        # some labels without a telling word
        documents.append((feature, np.concatenate((mild, told)), n, int(i % 8 == 0 or i % 80 == 3)))
    model = fit(documents, np.array([5, 9]))
    for n in (10_000, 40_000):
        clean = np.arange(0, n, 10)
        score = lambda feature, sentence: document_score(model.sentences(feature, sentence, n))
        assert score(clean[:0], clean[:0]) < 0.5 and score(np.full(len(clean), 9), clean) < 0.5
        assert score(np.append(np.full(len(clean), 9), 5), np.append(clean, n // 2)) > 0.5


def test_alignment_and_license_scan():
    a, b = "x the cat sat on the mat y".split(), "the cat sat down on the mat".split()
    assert [a[i] for i, _ in align(a, b)] == "the cat sat on the mat".split()
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    scanner = Scanner(TEMPLATES, 0.8)
    filler = " ".join(f"w{i}" for i in range(400))
    for name, template in TEMPLATES.items():
        text = f"{filler}\n{template}\n{filler} the license under any {filler}"
        assert name in {m["license"] for m in scanner.scan(text)}
        words = template.split()
        words[len(words) // 2] = "altered"
        assert len(words) < 8 or name in {m["license"] for m in scanner.scan(f"{filler} {' '.join(words)} {filler}")}
        assert len([m for m in scanner.scan(f"{template} {filler} {template}") if m["license"] == name]) == 2
    assert scanner.scan(filler + " a license under the public version of it") == []


@pytest.mark.parametrize("name", TEMPLATES)
def test_adjacent_notices(name):
    scanner, template = Scanner(TEMPLATES, 0.8), words_of(TEMPLATES[name])
    size, filler = len(template), [f"w{i}" for i in range(30)]
    for copies, gap in ((2, 0), (3, 0), (2, 3), (5, 1)):
        words = [*filler, *(template + filler[:gap]) * copies, *filler]
        # brute force: all offsets
        want = [i for i in range(len(words)) if words[i:i + size] == template]
        text = " ".join(words)
        begins = [sum(len(w) + 1 for w in words[:i]) for i in want]
        assert sorted(m["start"] for m in scanner.scan(text) if m["license"] == name) == begins and len(begins) == copies
    altered = [*template[:size // 2], "altered", *template[size // 2 + 1:]]
    text = " ".join([*filler, *altered, *template, *altered, *filler])
    assert len([m for m in scanner.scan(text) if m["license"] == name]) == 3
