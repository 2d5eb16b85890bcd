"""Token alignment against plain code over decoded bytes."""

import gc
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sensorloom.llm import queries, spans

FOLDER = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Both libraries' ids, with byte ends from the vocabularies alone."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.of_a = spans.byte_alphabet()

    def bytes_a(self, i):
        return bytes(self.of_a[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def links(self, text):
        """(ids of A, ids of B, pairs linked, groups as text)"""
        if not text:
            return [], [], [], ""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        sides = []
        for ids, name in ((a, self.bytes_a), (b, self.bytes_b)):
            at, ends = 0, {}
            for k, i in enumerate(ids):
                at += len(name(i))
                ends[at] = k
            if b"".join(map(name, ids)) != (" " + text).encode():
                return [], [], [], ""
            sides.append(ends)
        both = sorted(set(sides[0]) & set(sides[1]))
        pairs = [(a[sides[0][e]], b[sides[1][e]]) for e in both]
        out, i, j = [], 0, 0
        for e in both:
            x, y = sides[0][e] + 1, sides[1][e] + 1
            out.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        return a, b, pairs, ";".join(out)

    def table(self, rows):
        found = [(d, self.links(t)) for d, t in rows]
        counts = Counter(p for _, f in found for p in f[2])
        best = Counter()
        for (_, b), n in counts.items():
            best[b] = max(best[b], n)
        return [
            (d, len(a), len(b), len(g.split(";")) if g else 0, len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs),
             hashlib.sha256(g.encode()).hexdigest() if a else "")
            for d, (a, b, pairs, g) in found]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def awkward():
    rng = random.Random(4)
    texts = [None, "", " ", "a", "  a  b ", "日本語 テキスト🙂🙂 é", "▁ marked", "<|endoftext|> and <s> </s> <0x41>", "x" * 700, "tab\tline\n\n\n end ", "\0 nul", "Ä combined é", "𝔘𝔫𝔦 ᚠᛇᚻ"]
    texts += ["".join(rng.choice("abc deé ñ日🙂\n.,'s1234") for _ in range(rng.randrange(300))) for _ in range(40)]
    return [*enumerate(texts), (None, "some words"), (3, "a"), (3, "a")]


def test_against_plain_code(spark):
    rows = awkward()
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, links string").repartition(3)
    got = spans.align_tokens(df, A, B).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(Plain().table(rows), key=str)
    assert spans.align_tokens(df.limit(0), A, B).count() == 0


def test_query_against_plain_code(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_token_spans(spark, FOLDER).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(Plain().table([tuple(r) for r in documents]))


def test_segments_have_the_tokens_of_the_whole(monkeypatch):
    both = spans.tokenizers(A, B)
    texts = [t for _, t in awkward() if t] + ["one two  three,four 5 6 é seven 日本 eight" * 20]
    whole = [both.tokens(t) for t in texts]
    monkeypatch.setattr(spans, "SEGMENT", 12)
    assert len(spans.segments(texts[-1], 12)) > 10
    for t, want in zip(texts, whole):
        assert all(np.array_equal(x, y) for x, y in zip(both.tokens(t), want))


class Seen:
    """A tokenizer that notes the lengths of the texts it gets."""

    def __init__(self, held, most):
        self.held, self.most = held, most

    def encode(self, text, **settings):
        self.most.append(len(text))
        return self.held.encode(text, **settings)


def test_a_call_gets_a_short_text(monkeypatch):
    both = spans.Tokenizers(A, B)
    text = " ".join(t for _, t in awkward() if t and "▁" not in t) + " one two 日本 three é, four 🙂 five" * 400
    monkeypatch.setattr(spans, "CALL", len(text))
    whole = both.tokens(text)
    monkeypatch.setattr(spans, "CALL", 50)
    seen = []
    both.a, both.b = Seen(both.a, seen), Seen(both.b, seen)
    assert len(whole[0]) and all(np.array_equal(x, y) for x, y in zip(both.tokens(text), whole))
    assert len(seen) > 100 and max(seen) <= 50 + max(map(len, spans.segments(text))) + 2


def test_cycles_are_searched_again_afterwards():
    assert gc.isenabled() and spans.digested(["one two"], A, B) and gc.isenabled()
    with pytest.raises(TypeError):
        spans.digested([1], A, B)
    assert gc.isenabled()


@pytest.mark.parametrize("segment, limit", [(250_000, 10**8), (40, 2000), (1, 0)])
def test_remembered_segments_make_the_whole(monkeypatch, segment, limit):
    monkeypatch.setattr(spans, "SEGMENT", segment)
    monkeypatch.setattr(spans, "REMEMBERED_BYTES", limit)
    monkeypatch.setattr(spans, "TEXT_CHARS", 500)
    spans.remembered.cache_clear()
    both, plain = spans.tokenizers(A, B), Plain()
    texts = [t or "" for _, t in awkward()] + ["one two three", "one two ▁ three", "one two three"]
    for t, (n_a, n_b, n_groups, digest, links) in zip(texts, spans.digested(texts, A, B)):
        a, b, pairs, listed = plain.links(t)
        assert (n_a, n_b, n_groups) == (len(a), len(b), len(pairs)) and digest == (hashlib.sha256(listed.encode()).hexdigest() if a else "")
        keys = both.pairs[np.frombuffer(links, "<i4")].tolist()
        assert [divmod(k, len(both.bytes_b)) for k in keys] == pairs
    spans.remembered.cache_clear()


def test_groups_cover_the_text(spark):
    text = "naïve 日本 words, 🙂 end"
    row = spans.token_groups(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B, with_groups=True).first()
    data, plain = f" {text}".encode(), Plain()
    assert [g["start"] for g in row["groups"][1:]] == [g["end"] for g in row["groups"][:-1]] and row["groups"][-1]["end"] == len(data)
    for g in row["groups"]:
        want = data[g["start"]:g["end"]]
        assert b"".join(map(plain.bytes_a, g["a"])) == want == b"".join(map(plain.bytes_b, g["b"]))


def test_refined_spans():
    # characters of 3, 3, 1 and 2 bytes; tokens take 2, 3, 1, 1, 1 and 1 bytes of them
    starts, ends = np.array([0, 0, 3, 6, 7, 7]), np.array([3, 6, 6, 7, 9, 9])
    assert spans.refined(starts, ends, np.array([2, 3, 1, 1, 1, 1])).tolist() == [2, 5, 6, 7, 8, 9]
    assert spans.refined(np.array([1, 2]), np.array([2, 4]), np.array([2, 2])).tolist() == [2, 4]
