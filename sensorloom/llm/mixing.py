"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
# Parts into which the shuffled order of a source and the finish times are cut for running sums.
PARTS = 4096


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Words to take per source: source, source_size, target. One row per source, null as a source of its own.

    Sources in code point order, null last, take the weights in turn and share `share` times all sizes; a target
    stops at `most` times the source's size, and the excess is shared by weight among the rest. With sources in
    the order of size / weight, those that stop are the first ones, so one pass finds the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # over one row per source
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("full", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy(F.lit(0))
    rising = Window.partitionBy(F.lit(0)).orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("full").over(rising), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
    per = per.withColumn("level", level)
    # the first level that its own source does not stop holds for all after it
    lasting = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct(F.col("full") / F.col("weight"), "level"))).over(every)
    return per.select("source", "source_size", F.least(F.col("full"), F.coalesce(lasting["level"] * F.col("weight"), F.col("full"))).alias("target"))


def mix_sources(documents: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """How often the mix takes each document: all columns but `text` that it needs, one row per row of `documents`.

    Returns doc_id, source, size (words), source_size, target, copies (0 to `most`), taken (size * copies). Each
    source is put in a random order that `seed` fixes and read up to `most` times; an entry's virtual finish time
    is the words of its source up to and with it, divided by the source's target. Entries of all sources in the
    order of finish times are taken until the sum of targets is used up. Whole documents only, so a source
    misses its target by about one document.

    Running sums never need a source or the whole table in one task: the order is cut into PARTS by hash (sources)
    or time (finish), the parts are summed, and only inside a part rows are added one by one.

    Null text or one without words: size 0, and never taken words. Null source: a source of its own. Repeated
    rows and null ids are rows like others. Empty table: empty result. Other columns are not looked at.
    """
    rows = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    rows = stored(rows.withColumn("place", mixed).withColumn("part", F.conv(F.substring("place", 1, 3), 16, 10).cast("int")), "mix-sizes")

    targets = source_targets(rows, list(weights), share, most)
    # every source's part sums; at most PARTS rows per source
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    keyed = sums.withColumn("null_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    targets = targets.withColumn("null_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    starts = keyed.join(targets, ["source", "null_source"])

    inside = Window.partitionBy("source", "part").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).withColumn("null_source", F.col("source").isNull())
    placed = placed.withColumn("source", F.coalesce("source", F.lit("")))
    placed = placed.join(starts, ["source", "null_source", "part"]).withColumn("upto", F.col("upto") + F.col("before"))
    placed = placed.select("doc_id", F.when(~F.col("null_source"), F.col("source")).alias("source"), "size", "place", "source_size", "target", "upto")

    def entry(lap: int) -> Column:
        finish = F.coalesce(F.when(F.col("target") > 0, (F.col("upto") + F.lit(lap) * F.col("source_size")) / F.col("target")), F.lit(0.0))
        return F.struct(finish.alias("finish"), F.col("source").alias("source"), F.lit(lap).alias("lap"), F.col("place").alias("place"), F.col("doc_id").alias("doc_id"), F.col("size").alias("size"))

    placed = stored(placed.withColumn("entries", F.array(*[entry(lap) for lap in range(most)])), "mix-order")
    budget = F.floor(F.sum("target") + F.lit(1e-6)).cast("long")
    total = targets.agg(budget.alias("budget")).first()["budget"] or 0
    last = _last_taken(placed.select(F.explode("entries").alias("entry")), total)
    if last is None:
        copies = F.lit(0)
    else:
        cut = F.struct(*[F.lit(last[k]).cast(t).alias(k) for k, t in (("finish", "double"), ("source", "string"), ("lap", "int"), ("place", "string"), ("doc_id", dict(documents.dtypes)["doc_id"]), ("size", "long"))])
        copies = F.size(F.filter("entries", lambda x: x <= cut))
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.cast("int").alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def _last_taken(entries: DataFrame, budget: int):
    """The last entry in the order of finish times up to which the sizes stay within the budget: one row, or None."""
    entries = entries.withColumn("part", F.least(F.col("entry.finish") * F.lit(float(PARTS)), F.lit(4.0 * PARTS)).cast("int"))
    sums = entries.groupBy("part").agg(F.sum("entry.size").alias("words"))  # at most 4 * PARTS + 1 rows
    order = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    # parts that begin within the budget; in all but the last of them every entry is taken
    part = sums.where(F.col("before") <= budget).agg(F.max(F.struct("part", "before")).alias("p")).first()["p"]
    if part is None:
        return None
    held = entries.where(F.col("part") == part["part"])
    upto = F.sum("entry.size").over(Window.partitionBy("part").orderBy("entry").rowsBetween(Window.unboundedPreceding, 0))
    found = held.withColumn("upto", upto + F.lit(part["before"])).where(F.col("upto") <= budget).agg(F.max("entry").alias("e")).first()["e"]
    if found is None:
        found = entries.where(F.col("part") < part["part"]).agg(F.max("entry").alias("e")).first()["e"]
    return found


def mixed_documents(documents: DataFrame, **settings) -> DataFrame:
    """The mix itself: the rows of `documents`, each as often as `mix_sources` takes it, with all its columns.

    Rows that share doc_id, source and number of words count as one when they are looked up. Documents without
    words come at most once, as they add nothing.
    """
    taken = mix_sources(documents, **settings)
    taken = taken.groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    # the row apart, so that its columns clash with none
    rows = documents.select(F.struct("*").alias("row"), word_count(F.col("text")).alias("words"))
    joined = rows.join(taken, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size")))
    copies = F.when(F.col("words") == 0, F.least("copies", F.lit(1))).otherwise(F.col("copies"))
    return joined.select("row", F.explode(F.sequence(F.lit(1), copies))).select("row.*")
