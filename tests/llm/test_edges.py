"""Every operator over tables with nulls, empty and long texts, ties, repeated rows and clashing columns, and over empty ones."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sensorloom.llm.chunks import encode_chunked
from sensorloom.llm.licenses import scan_licenses
from sensorloom.llm.lines import dedup_lines
from sensorloom.llm.minhash import near_duplicates, without_near_duplicates
from sensorloom.llm.mixing import mix_sources, mixed_documents
from sensorloom.llm.pieces import decode, encode
from sensorloom.llm.runs import digests, periodic_runs, with_repeated_ends
from sensorloom.llm.spans import align_tokens
from sensorloom.llm.spots import fingerprints, spot_links
from sensorloom.llm.suffixes import remove_repeats
from sensorloom.llm.tokens import count_tokens
from sensorloom.llm.toxicity import score_documents, train, without_toxic
from sensorloom.llm.vectors import embedding_duplicates

MODEL, WORDS, BYTES = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"))
CLASHING = ["key", "content", "node", "component", "ids", "n_gone", "score", "part", "size", "_copy", "signs", "held", "shard", "n", "line", "row", "a", "b", "gone", "words", "copies", "id", "col", "salt", "chunks", "links", "runs", "collapsed", "h", "g", "p"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


@pytest.fixture(scope="module")
def awkward(spark):
    line = "one two three four five six seven eight nine ten eleven"
    texts = [None, "", " \t\n", "word", "a b c", line, line, f"{line}\n{line}\n\nshort", "x" * 200_000, "many words " * 20_000, "ünï çødé 日本 🙂 " * 9, "\u0000 nul", "the the the"]
    rows = [(i, t, None, f"s{i % 3}" if i % 4 else None, None, *["c"] * len(CLASHING)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[0], (None, line, None, None, None, *[None] * len(CLASHING)), (None, None, *[None] * (3 + len(CLASHING)))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "repeats": lambda s, d: remove_repeats(d),
    "lines": lambda s, d: dedup_lines(d),
    "licenses": lambda s, d: scan_licenses(d),
    "toxicity": lambda s, d: score_documents(d, train(d, labels(s, [(1, 1, 1), (2, None, 0), (3, 0, None), (None, 0, 1), (5, 0, 1)]))),
    "fingerprints": lambda s, d: fingerprints(d),
    "minhash": lambda s, d: near_duplicates(d),
    "tokens": lambda s, d: count_tokens(d, MODEL),
    "pieces": lambda s, d: decode(encode(d, MODEL), MODEL),
    "mix": lambda s, d: mix_sources(d),
    "chunks": lambda s, d: encode_chunked(d, WORDS),
    "spans": lambda s, d: align_tokens(d, BYTES, MODEL),
    "runs": lambda s, d: digests(periodic_runs(with_repeated_ends(d))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(spark, awkward, name):
    out = OPERATORS[name](spark, awkward)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.select("doc_id").collect())
    assert ids == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in awkward.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_filters_keep_columns(spark, awkward):
    for stage in (lambda d: without_toxic(d, labels(spark)), without_near_duplicates, mixed_documents):
        out = stage(awkward)
        assert out.columns == awkward.columns
        assert out.count() > 0
        assert stage(spark.createDataFrame([], SCHEMA)).count() == 0


def test_values(spark, awkward):
    got = {r["doc_id"]: r for r in near_duplicates(awkward).where("doc_id is not null").collect()}
    assert [got[i]["n_shingles"] for i in range(6)] == [0, 0, 0, 1, 1, 7]
    assert got[6]["component_id"] == 5 and not got[6]["kept"] and got[5]["kept"] and got[0]["component_id"] == 0
    score = {r["doc_id"]: r["score"] for r in OPERATORS["toxicity"](spark, awkward).collect()}
    assert score[0] == score[1] == score[2] == 0 and all(0 <= x <= 1 for x in score.values())
    lines = {r["doc_id"]: (r["text"], r["n_lines"], r["n_gone"]) for r in dedup_lines(awkward).where("doc_id is not null").collect()}
    assert lines[0] == (None, 0, 0) and lines[1] == ("", 1, 0) and lines[6] == ("", 1, 1) and lines[7] == ("\nshort", 4, 2)
    members, links = spot_links(awkward)
    assert members.where("doc_id in (5, 6)").select("class").distinct().count() == 1 and links.count() >= 0
    trip = decode(encode(awkward, MODEL), MODEL).select((F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same")).collect()
    assert all(r["same"] for r in trip)


def test_embeddings(spark):
    schema = "vec_id long, embedding array<float>, label int, node string, n string, shard string"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1),
            (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (12, [-1.0, 0.0], 1), (0, [1.0, 0.0], 1)]
    out = embedding_duplicates(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)).collect()
    assert len(out) == len(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    assert got[0] == got[1] == got[11] == got[None] == (4, 0)
    assert all(got[i] == (0, i) for i in (2, 3, 4, 5, 6, 7, 8, 9, 10, 12))
    assert embedding_duplicates(spark.createDataFrame([], schema)).count() == 0
