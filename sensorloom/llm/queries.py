"""The registered queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import encode_digests
from .licenses import scan_licenses
from .lines import dedup_lines
from .minhash import near_duplicates
from .mixing import mix_sources
from .pieces import encode
from .runs import digests, periodic_runs, with_repeated_ends
from .spans import align_tokens
from .spots import fingerprints
from .suffixes import remove_repeats
from .tokens import count_tokens
from .toxicity import score_documents, train
from .vectors import embedding_duplicates


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"), width=400, with_text=False)


def op2_vector_graph(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_duplicates(table(spark, folder, "embeddings"), cosine=0.98)


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_gone", F.length("text").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(table(spark, folder, "documents"))
    return found.select("doc_id", F.size("matches").alias("n_matches"), "license", "coverage", F.to_json("matches").alias("matches"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    scored = score_documents(documents, train(documents, table(spark, folder, "labels")))
    return scored.withColumn("n_offending", F.size("offending")).drop("offending")


def op6_spot_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))


def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), percent=85)


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    read = encode(table(spark, folder, "documents").select("doc_id", "text"), path, verify=True)
    return read.select("doc_id", F.size("ids").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), "round_trip")


def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), weights=[3, 1, 2], share=1.5, most=2).drop("copies")


def op11_chunk_reuse(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_token_spans(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return digests(periodic_runs(with_repeated_ends(table(spark, folder, "documents"))))


JOBS = {f.__name__: f for f in (op1_suffix_array, op2_vector_graph, op3_line_dedup, op4_license_scan, op5_toxicity, op6_spot_signatures, op7_minhash, op8_token_counts, op9_pieces, op10_source_mix, op11_chunk_reuse, op12_token_spans, op13_periodic_runs)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

CHECKS = {
    "op2_vector_graph": """
WITH RECURSIVE sound AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum([CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END FOR x IN embedding]) = 0 AND list_max([abs(x) FOR x IN embedding]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
lowest AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = m.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM lowest m""",
    "op3_line_dedup": r"""
WITH lines AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INT) AS line, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
worded AS (SELECT *, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM lines),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i, sum(words) OVER (PARTITION BY doc_id ORDER BY line) AS upto FROM worded WHERE words > 0),
ends AS (SELECT a.doc_id, a.i AS a, min(b.i) AS b FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 9 AND b.upto - a.upto + a.words >= 10 GROUP BY 1, 2
         UNION SELECT a.doc_id, max(a.i), b.i FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 9 AND b.upto - a.upto + a.words >= 10 GROUP BY a.doc_id, b.i),
runs AS (SELECT e.doc_id, e.a, e.b, string_agg(s.x, chr(10) ORDER BY s.i) AS run FROM ends e JOIN seq s ON s.doc_id = e.doc_id AND s.i BETWEEN e.a AND e.b GROUP BY 1, 2, 3),
firsts AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, a) AS n FROM runs),
gone AS (SELECT DISTINCT s.doc_id, s.line FROM firsts f JOIN seq s ON s.doc_id = f.doc_id AND s.i BETWEEN f.a AND f.b WHERE f.n > 1),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_gone, coalesce(string_agg(CASE WHEN g.line IS NULL THEN l.x END, chr(10) ORDER BY l.line), '') AS t
         FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id)
SELECT doc_id, CAST(n_lines AS INT) AS n_lines, CAST(n_gone AS INT) AS n_gone, CAST(length(t) AS INT) AS n_kept_chars, sha256(t) AS kept_sha256 FROM kept""",
    "op7_minhash": f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM sets s JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) m USING (doc_id)""",
    "op10_source_mix": r"""
WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
               md5('7|' || CAST(doc_id AS VARCHAR)) AS place FROM documents),
per AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sizes GROUP BY source),
weighed AS (SELECT *, CAST([3, 1, 2][(n - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS full_size FROM per),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(full_size) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS level
           FROM weighed WINDOW r AS (ORDER BY full_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(full_size, weight * (SELECT level FROM levels WHERE level * weight <= full_size ORDER BY full_size / weight, source NULLS LAST LIMIT 1)) AS target FROM levels),
placed AS (SELECT s.*, t.source_size, t.target, sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) AS upto
           FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
entries AS (SELECT *, (upto + lap * source_size) / target AS finish FROM placed, (VALUES (0), (1)) l(lap)),
queued AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS FIRST, lap, place, doc_id ROWS UNBOUNDED PRECEDING) AS used FROM entries)
SELECT doc_id, source, size, source_size, target, CAST(sum(CASE WHEN used <= (SELECT floor(sum(target) + 1e-6) FROM targets) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM queued GROUP BY ALL""",
}
