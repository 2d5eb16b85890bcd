"""SpotSigs document fingerprints: chains of content words that follow common words. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest, stored, whole_text

# Common words of English, German, French and Spanish, which anchor the chains. A parameter of all functions.
ANCHORS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "in", "is", "it",
    "not", "of", "on", "or", "she", "that", "the", "their", "they", "this", "to", "was", "we", "were", "which", "will", "with", "you",
    "als", "auch", "auf", "aus", "bei", "das", "dass", "dem", "den", "der", "des", "die", "ein", "eine", "einer", "er", "es", "für",
    "ich", "im", "ist", "mit", "nach", "nicht", "sich", "sie", "sind", "und", "von", "war", "wie", "zu", "zum", "zur",
    "au", "aux", "avec", "ce", "dans", "de", "du", "elle", "en", "est", "et", "il", "je", "la", "le", "les", "mais", "ne", "nous",
    "ou", "par", "pas", "pour", "qui", "que", "sa", "se", "ses", "son", "sur", "un", "une", "vous",
    "al", "con", "como", "del", "el", "las", "lo", "los", "más", "no", "para", "pero", "por", "su", "sus", "una", "y",
]
CHAIN = 2
# Ranges of equal numbers of rows into which ids are cut before they are cut evenly, see `with_next`.
RANGES = 256


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The set of a text's signatures as sorted 32-bit numbers.

    Words are runs of letters and digits in lower case. Each anchor gives one signature: itself and the next `chain`
    words that are no anchors, looked for up to three anchors on. The beginning of a text counts as an anchor, so a text
    with words has a signature whatever its words are; the rule is the same for every text. A signature that comes
    again counts as another one, told apart by its number. A text without words has one signature, itself; the empty
    text none.
    """
    return _set(_chains(text, anchors, chain))


def _chains(text: Column, anchors: list[str], chain: int) -> Column:
    """The chains of a text's anchors as an array of numbers, not sorted."""
    def with_anchors(words: Column) -> Column:
        # anchors are marked and the words joined again; what follows a mark is an anchor and its content words
        marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(anchors), F.concat(F.lit("\x01"), w)).otherwise(w)), " ")
        parts = F.transform(F.split(F.concat(F.lit("\x02 "), marked), "\x01"), lambda p: F.trim(p))
        return _let(parts, lambda p: _let(F.transform(p, content), lambda rest: F.transform(p, lambda part, j: of_anchor(rest, part, j))))

    def content(part: Column) -> Column:
        # null where nothing follows the anchor
        return F.when(F.instr(part, " ") > 0, F.substr(part, F.instr(part, " ") + 1))

    def of_anchor(rest: Column, part: Column, j: Column) -> Column:
        following = F.concat_ws(" ", *[F.get(rest, j + n) for n in range(4)])
        return F.hash(F.substring_index(part, " ", 1), F.substring_index(following, " ", chain))

    none = F.array().cast("array<int>")
    bare = F.when(text == "", none).otherwise(F.array(F.hash(text)))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return _let(words, lambda x: F.when(F.size(x) == 0, bare).otherwise(with_anchors(x)))


def _set(chains: Column) -> Column:
    return F.sort_array(F.array_distinct(_let(F.sort_array(chains), _numbered)))


def _numbered(held: Column) -> Column:
    """Sorted numbers, each with its place among its equals, as one number."""
    runs = F.filter(F.sequence(F.lit(0), F.size(held) - 1), lambda i: (i == 0) | (F.get(held, i - 1) != F.get(held, i)))

    def of_run(begins: Column, begin: Column, j: Column) -> Column:
        end = F.coalesce(F.get(begins, j + 1), F.size(held))
        return F.transform(F.sequence(F.lit(0), end - begin - 1), lambda k: F.hash(F.get(held, begin), k))

    every = _let(runs, lambda begins: F.flatten(F.transform(begins, lambda begin, j: of_run(begins, begin, j))))
    return F.when(F.size(held) == 0, held).otherwise(every)


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(signs: Column) -> Column:
    """The signatures in hexadecimal, eight digits each, in ascending order."""
    return F.array_join(F.transform(signs, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard overlap of two signature sets; two empty ones are equal."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(common / (F.size(a) + F.size(b) - common))


def with_next(rows: DataFrame, columns: list[str], made: dict[str, Column] | None = None, per_part: int = 2000) -> DataFrame:
    """`rows` (doc_id numeric, content, ...) with next_<column>: the values of the next row by doc_id, after the last of the first.

    Ids are cut into parts of about `per_part` rows, one window each; the first row of each part is copied to the end of
    the part before it, so rows are shuffled once and never meet in one task. The parts are RANGES quantiles, each cut
    evenly, so that ids far from the others only widen the parts of their own range. Null ids come last, cut by the
    texts' digests. Columns `made` are computed behind the shuffle and can be among `columns`.
    """
    at = F.col("doc_id").cast("double")
    shares = [k / RANGES for k in range(1, RANGES)]
    bounds = rows.agg(
        F.count("*").alias("n"), F.count_if(at.isNull()).alias("nulls"), F.min(at).alias("low"), F.max(at).alias("high"), F.percentile_approx(at, shares, 10 * RANGES).alias("cuts")).first()
    cuts = sorted({bounds["low"] or 0.0, *(bounds["cuts"] or []), (bounds["high"] or 0.0) + 1})
    ranges = len(cuts) - 1
    each, of_nulls = max(1, -(-(bounds["n"] - bounds["nulls"]) // (per_part * ranges))), max(1, -(-bounds["nulls"] // per_part))
    held = F.array(*map(F.lit, cuts))
    number = F.greatest(F.lit(0), F.size(F.filter(held, lambda x: x <= at)) - 1)
    inside = F.width_bucket(at, F.get(held, number), F.get(held, number + 1), F.lit(each)) - 1
    leading = F.conv(F.substring(F.hex("content"), 1, 8), 16, 10).cast("double")
    of_null = ranges * each + F.width_bucket(leading, F.lit(0.0), F.lit(2.0**32), F.lit(of_nulls))
    dealt = rows.withColumn("_part", F.when(at.isNull(), of_null).otherwise(number * each + inside).cast("long")).withColumn("_copy", F.lit(0))
    # one row per part: its first row, and the part before it; the part after the last is the first
    firsts = dealt.groupBy("_part").agg(F.min(F.struct("doc_id", "content")).alias("_row")).select("_part", F.col("_row.doc_id").alias("_first"), F.col("_row.content").alias("_content"))
    order = Window.partitionBy(F.lit(0)).orderBy("_part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_first", "_content", F.col("_part").alias("_from"), F.coalesce(F.lag("_part").over(order), F.last("_part").over(whole)).alias("_to"))
    firsts = stored(firsts, "next-firsts")
    ghosts = dealt.join(firsts, (F.col("_part") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("content") == F.col("_content")))
    ghosts = ghosts.drop("_part", "_from", "_first", "_content").withColumnRenamed("_to", "_part").withColumn("_copy", F.lit(1)).select(*dealt.columns)
    order = [F.col("_copy"), F.col("doc_id").asc_nulls_last(), F.col("content")]
    line = Window.partitionBy("_part").orderBy(*order)
    joined = dealt.unionAll(ghosts).repartition("_part").sortWithinPartitions("_part", *order).withColumns(made or {})
    return joined.select("*", *[F.lead(c).over(line).alias(f"next_{c}") for c in columns]).where("_copy = 0").drop("_part", "_copy")


def fingerprints(documents: DataFrame, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Fingerprints of every whole text and of an edited one, one row per row of `documents`.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. In the edited
    text the last quarter (rounded down) of the characters is replaced by the first as many of the next document by
    doc_id, or all it has. near_* is the Jaccard overlap of the signature sets (`signatures`), of which the
    fingerprint is the list.

    doc_id must be a number; null ids come last, repeated ids in the order of their texts' digests. Null text: empty,
    with an empty fingerprint; two empty ones are alike (1). A single row follows itself. Other columns are not
    looked at. Empty table: empty result.
    """
    texts = documents.select("doc_id", whole_text().alias("text")).withColumn("content", digest(F.col("text")))
    rows = with_next(texts, ["text", "signs"], {"signs": signatures(F.col("text"), anchors, chain)})
    size = F.length("text")
    cut = F.floor(size / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), size - cut), F.substr("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", "signs", "next_signs", size.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_signs", signatures(F.col("edited"), anchors, chain))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("signs")).alias("fingerprint"),
        fingerprint(F.col("edited_signs")).alias("edited_fingerprint"), likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"))


def spot_links(documents: DataFrame, similarity: float = 0.8, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """Documents whose signature sets overlap by at least `similarity`: (members, links).

    members has doc_id and its class (digest of the set) for every document with signatures; links has pairs (a, b) of
    different classes, a < b, with their likeness. Equal sets are one class, so copies make no pairs. Empty and null
    texts are in no class. Rows and extra columns as in `fingerprints`.

    Sets are partitioned by length: within `similarity`, lengths differ by a factor of 1 / similarity at most, so each
    set meets its own and the neighbouring length class only. There, only sets that share one of their rarest signatures
    are compared (if none of the first (1 - similarity) n + 1 is shared, the overlap can't be reached).
    """
    members = documents.select("doc_id", signatures(whole_text(), anchors, chain).alias("signs")).where(F.size("signs") > 0)
    members = stored(members.withColumn("class", digest(F.array_join("signs", ","))), "spot-sets")
    sets = members.groupBy(F.col("class").alias("key")).agg(F.max("signs").alias("signs"))
    each = sets.select("key", F.explode("signs").alias("sign"))
    rare = each.groupBy("sign").agg(F.count("*").alias("uses"))
    ranked = each.join(rare, "sign").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("uses", "sign"))).alias("ranked"))
    ranked = ranked.withColumn("n", F.size("ranked"))
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / similarity)) + 1e-9).cast("int")
    probes = stored(ranked.select("key", "n", step.alias("step"), F.explode(F.slice("ranked", F.lit(1), first)).alias("r")).select("key", "n", "step", "r.sign"), "spot-probes")
    ours = probes.select(F.col("key").alias("a"), F.col("n").alias("n_a"), "step", "sign")
    theirs = probes.select(
        F.col("key").alias("b"), F.col("n").alias("n_b"), F.explode(F.array(F.col("step"), F.col("step") - 1)).alias("step"), "sign")
    # each pair once: the shorter set (ties: the smaller key) is `ours`
    shorter = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    near = shorter & (F.col("n_a") >= F.col("n_b") * similarity - 1e-9)
    pairs = ours.join(theirs, ["step", "sign"]).where(near).select("a", "b").distinct()
    left = sets.select(F.col("key").alias("a"), F.col("signs").alias("signs_a"))
    right = sets.select(F.col("key").alias("b"), F.col("signs").alias("signs_b"))
    met = pairs.join(left, "a").join(right, "b").withColumn("likeness", likeness(F.col("signs_a"), F.col("signs_b"))).where(F.col("likeness") >= similarity - 1e-9)
    links = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
    return members.select("doc_id", "class"), links
