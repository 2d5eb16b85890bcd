"""Deletion of repeated line runs: prefix doubling over sequences of line ids, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, stored, whole_text
from .mixing import word_count

# Words that a repeated run must have; shorter repeats (headings, single braces) stay.
RUN_WORDS = 10


def _name(*parts: Column) -> Column:
    """A 128-bit name of some values, as two hashes."""
    return F.struct(F.xxhash64(*parts).alias("x"), F.xxhash64(F.lit("second"), *parts).alias("y"))


def repeated_lines(documents: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, content, gone): for each document that loses lines, the numbers (from 0) of the lines that go. See `dedup_lines`."""
    texts = documents.select("doc_id", whole_text().alias("text")).withColumn("content", digest(F.col("text")))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, n: F.struct(n.alias("line"), _name(x).alias("name"), word_count(x).alias("words"))), lambda s: s["words"] > 0)
    lines = texts.select("doc_id", "content", F.posexplode(lines).alias("i", "l")).select("doc_id", "content", "i", "l.*")
    # level 0 of the doubling: lines that stand once can't be part of a repeated run
    twice = lines.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    lines = stored(lines.join(twice, "name"), "lines-repeated")

    # documents in their order as numbers; a row that repeats doc_id and text is the same document
    order = [F.col("doc_id").asc_nulls_last(), F.col("content")]
    parts = max(8, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = lines.select("doc_id", "content").distinct().repartitionByRange(parts, *order).sortWithinPartitions(*order)
    docs = stored(docs.withColumn("doc", F.monotonically_increasing_id()), "lines-documents")
    same = lines["doc_id"].eqNullSafe(docs["doc_id"]) & (lines["content"] == docs["content"])
    level = stored(lines.join(docs, same).select("doc", "i", "line", "words", "name").distinct(), "lines-level-0")
    base = level

    # Names of runs of 2 ** k lines: a pair of names of half the length, kept where it stands twice. A run of
    # `run_words` lines has that many words for sure, so no longer names are needed.
    levels, k = [level.select("doc", "i", "name").withColumn("k", F.lit(0))], 0
    while 2 << k <= run_words:
        ahead = Window.partitionBy("doc").orderBy("i").rangeBetween(1 << k, 1 << k)
        pairs = level.select("doc", "i", "name", F.first("name").over(ahead).alias("next")).where("next is not null")
        pairs = pairs.select("doc", "i", _name(F.col("name.x"), F.col("name.y"), F.col("next.x"), F.col("next.y")).alias("name"))
        twice = pairs.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
        k += 1
        level = stored(pairs.join(twice, "name").select("doc", "i", "name"), f"lines-level-{k}")
        levels.append(level.withColumn("k", F.lit(k)))
    names = levels[0]
    for other in levels[1:]:
        names = names.unionByName(other)

    # The shortest runs that have the words, seen from their first and from their last line; consecutive lines only.
    stretch = F.col("i") - F.row_number().over(Window.partitionBy("doc").orderBy("i"))
    upto = F.sum("words").over(Window.partitionBy("doc", "stretch").orderBy("i"))
    summed = base.withColumn("stretch", stretch).withColumn("upto", upto)
    near = Window.partitionBy("doc", "stretch").orderBy("i")
    around = summed.select(
        "doc", "i", "upto", "words",
        F.collect_list(F.struct("i", "upto")).over(near.rangeBetween(0, run_words - 1)).alias("ahead"),
        F.collect_list(F.struct("i", "upto", "words")).over(near.rangeBetween(1 - run_words, 0)).alias("behind"))
    start = F.col("upto") - F.col("words")
    forward = F.array_min(F.transform(F.filter("ahead", lambda s: s["upto"] - start >= run_words), lambda s: s["i"]))
    backward = F.array_max(F.transform(F.filter("behind", lambda s: F.col("upto") - s["upto"] + s["words"] >= run_words), lambda s: s["i"]))
    runs = around.select("doc", F.explode(F.array(F.struct(F.col("i").alias("a"), forward.alias("b")), F.struct(backward.alias("a"), F.col("i").alias("b")))).alias("r"))
    runs = runs.where("r.a is not null and r.b is not null").select("doc", "r.a", "r.b").distinct()

    # Equal runs form an interval of suffixes with that common prefix; a run of n lines is named by the two
    # overlapping runs of the largest power of two within n.
    size = F.col("b") - F.col("a") + 1
    power = F.floor(F.log2(size.cast("double")) + F.lit(1e-9)).cast("int")
    runs = runs.withColumn("k", power).withColumn("late", F.col("b") + 1 - F.pow(F.lit(2), F.col("k")).cast("int"))
    head = names.select("doc", "k", F.col("i").alias("a"), F.col("name").alias("head"))
    tail = names.select("doc", "k", F.col("i").alias("late"), F.col("name").alias("tail"))
    named = runs.join(head, ["doc", "k", "a"]).join(tail, ["doc", "k", "late"])
    named = stored(named.select("doc", "a", "b", _name(size, F.col("head.x"), F.col("head.y"), F.col("tail.x"), F.col("tail.y")).alias("run")), "lines-runs")
    first = named.groupBy("run").agg(F.min(F.struct("doc", "a")).alias("first"))
    later = named.join(first, "run").where(F.struct("doc", "a") > F.col("first"))
    gone = later.select("doc", F.explode(F.sequence("a", "b")).alias("i")).distinct()
    gone = gone.join(base.select("doc", "i", "line"), ["doc", "i"]).groupBy("doc").agg(F.array_sort(F.collect_list("line")).alias("gone"))
    return gone.join(docs, "doc").select("doc_id", "content", "gone")


def dedup_lines(documents: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """`documents` without later copies of repeated line runs; all columns, and n_lines, n_gone, and `text` cut down.

    Documents are in the order of doc_id (null last; ties by text). A line goes if it belongs to a run of
    consecutive lines with at least `run_words` words in all that also stands earlier, in the same or a previous
    document; the first copy stays. Repeats are judged on the input. Lines end at \\n and are compared exactly.
    Lines without words are not counted as lines of a run: a run may reach across them, and they stay.

    Null text: stays null, no line. Empty text: one line without words. Rows that repeat doc_id and text are one
    document and get the same result. An existing column n_lines or n_gone is replaced. Empty table: empty result.
    Rows are never dropped, even where no line is left.
    """
    gone = repeated_lines(documents, run_words).withColumnRenamed("content", "in_content")
    # the row apart, so that its columns clash with none
    columns = [c for c in documents.columns if c not in ("n_lines", "n_gone")]
    rows = documents.select(F.struct(*columns).alias("row"), digest(whole_text()).alias("content"))
    joined = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("content") == F.col("in_content")), "left")
    split = F.split("row.text", "\n")
    kept = F.array_join(F.filter(split, lambda x, n: ~F.array_contains(F.col("gone"), n)), "\n")
    return joined.select(
        *[F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in columns],
        F.coalesce(F.size(split), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_gone"))
