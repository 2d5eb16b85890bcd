"""Which formula uses which: references, order, cycles and needed sensors."""

from __future__ import annotations

import uuid
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.categories import clean_formula_id
from sensorloom.functions.ids import canonical_serial_id
from sensorloom.operators.skew import FREQUENT, look_up
from sensorloom.session import cut, shared_folder, shuffled

# Names that are neither formulas nor sensors.
RESERVED = (
    "window_avg window_max window_min abs sqrt round floor ceil min max pow log sin cos "
    "value true false null undefined NaN Infinity Math"
).split()

DEFAULT_PRIMARY = "sensor_000"

FEW_REFERENCES = 2_000  # formulas of a table that is fetched in one go

_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
_SERIAL = r"(?i)^(?:P_|SN_)\d+$"
_SENSOR = r"(?i)^(?:sensor_\d+|[A-Z0-9_]+_sensor|[A-Z0-9_]+_stream)$"


def formula_references(formulas: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows (src, kind, ref, pos): the sensors and formulas named by each formula.

    `known` gives the formulas that names may mean, by default the same table. `pos` is
    the place of the first mention.
    """
    known = formulas if known is None else known
    names = F.posexplode(F.regexp_extract_all(F.col("expression"), F.lit(_NAME), F.lit(0))).alias("pos", "token")
    tokens = formulas.select(F.col("id").alias("src"), names).filter(~F.col("token").isin(RESERVED))
    tokens = tokens.groupBy("src", "token").agg(F.min("pos").alias("pos"))
    by_id = known.select(F.col("id").alias("_id")).distinct()
    by_serial = (
        known.filter(F.col("serial") != 0).groupBy(F.col("serial").cast("string").alias("_digits"))
        .agg(F.max("id").alias("_owner"))
    )
    serial = F.col("token").rlike(_SERIAL)
    found = (
        tokens.join(by_id, F.col("token") == F.col("_id"), "left")
        .withColumn("_wanted", F.when(serial, canonical_serial_id(F.col("token"), ignore_case=True)))
        .join(by_serial, F.col("_wanted") == F.col("_digits"), "left")
    )
    sensor = F.struct(F.lit("sensor").alias("kind"), F.coalesce(F.col("_wanted"), F.col("token")).alias("ref"))
    owner = F.struct(F.lit("formula").alias("kind"), F.col("_owner").alias("ref"))
    named = F.struct(F.lit("formula").alias("kind"), F.col("_id").alias("ref"))
    meaning = (
        F.when(serial & F.col("_owner").isNotNull(), owner)
        .when(serial | F.col("token").rlike(_SENSOR), sensor)
        .when(F.col("_id").isNotNull(), named)
        .when(F.col("token").startswith("sensor_"), sensor)
    )
    return (
        found.withColumn("_meaning", meaning).filter(F.col("_meaning").isNotNull())
        .groupBy("src", F.col("_meaning.kind").alias("kind"), F.col("_meaning.ref").alias("ref"))
        .agg(F.min("pos").alias("pos"))
    )


def edges(formulas: DataFrame) -> DataFrame:
    """Rows (src, dst, pos): formula src uses formula dst."""
    uses = formula_references(formulas).filter(F.col("kind") == "formula")
    return uses.select("src", F.col("ref").alias("dst"), "pos")


def dependents(formulas: DataFrame) -> DataFrame:
    """Rows (id, dependent): the other formulas that use a formula directly."""
    used = edges(formulas).filter(F.col("src") != F.col("dst"))
    return used.select(F.col("dst").alias("id"), F.col("src").alias("dependent"))


def self_references(formulas: DataFrame) -> DataFrame:
    """Formulas that name themselves."""
    return edges(formulas).filter(F.col("src") == F.col("dst")).select(F.col("src").alias("id"))


def _peeled(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take away, round by round, the links to formulas that have no links of their own left.

    Returns the links taken away with their `round`, and those that stay for ever, which
    belong to formulas that reach a cycle.
    """
    left, gone, number = cut(links.select("src", "dst", "pos")), None, 0
    while True:
        users = left.select(F.col("src").alias("_user")).distinct()
        marked = cut(left.join(users, F.col("dst") == F.col("_user"), "left"))
        free = marked.filter(F.col("_user").isNull()).drop("_user").withColumn("round", F.lit(number))
        gone = free if gone is None else gone.unionByName(free)
        if free.isEmpty():
            return gone, left
        left, number = marked.filter(F.col("_user").isNotNull()).drop("_user"), number + 1


def formula_levels(formulas: DataFrame) -> DataFrame:
    """(id, level): 0 without uses, else one above the highest used formula; null on the way to a cycle."""
    gone, stuck = _peeled(edges(formulas))
    above = gone.groupBy(F.col("src").alias("id")).agg((F.max("round") + 1).alias("_above"))
    circular = stuck.select(F.col("src").alias("id")).distinct().withColumn("_circular", F.lit(True))
    ids = formulas.select("id").distinct().join(above, "id", "left").join(circular, "id", "left")
    return ids.select("id", F.when(F.col("_circular").isNull(), F.coalesce("_above", F.lit(0))).alias("level"))


def _onward(pointers: DataFrame, other: DataFrame) -> DataFrame:
    """Pointers (at, to) that go on by those of `other`; one that meets none stays."""
    following = other.select(F.col("at").alias("_at"), F.col("to").alias("_to"))
    return pointers.join(following, F.col("to") == F.col("_at"), "left").select("at", F.coalesce("_to", "to").alias("to"))


def leading_to_cycles(links: DataFrame) -> DataFrame:
    """(id): the formulas of links (src, dst) from which a cycle can be reached.

    Chains of formulas that use one other each are followed to their ends first, with steps that grow fourfold each
    round; a walk that is still on such a formula after as many steps as there are goes round in circles. What is
    left, formulas with several uses, is peeled level by level.
    """
    links = cut(links.select("src", "dst").distinct())
    uses = links.groupBy("src").agg(F.count("*").alias("n"), F.max("dst").alias("to"))
    single = cut(uses.filter("n = 1").select(F.col("src").alias("at"), "to"))
    total, steps, pointers = single.count(), 1, single
    while steps <= total:
        twice = _onward(pointers, pointers)
        pointers, steps = cut(_onward(twice, twice)), 4 * steps
    ends = pointers.join(single.select(F.col("at").alias("_on")), F.col("to") == F.col("_on"), "left")
    ends = cut(ends.select("at", "to", F.col("_on").isNotNull().alias("circular")))
    several = links.join(uses.filter("n > 1").select("src"), "src", "left_semi")
    # a use that leads into a circle becomes a use of itself, which is never peeled
    aim = F.when(F.col("circular"), F.col("src")).otherwise(F.coalesce("to", "dst")).alias("dst")
    short = several.join(ends, F.col("dst") == F.col("at"), "left").select("src", aim, F.lit(0).alias("pos")).distinct()
    _, stuck = _peeled(short)
    stuck = stuck.select(F.col("src").alias("id")).distinct()
    follow = ends.join(stuck, F.col("to") == F.col("id"), "left").filter(F.col("circular") | F.col("id").isNotNull())
    return stuck.union(follow.select("at"))


def _with_path(walks: DataFrame, other: DataFrame) -> DataFrame:
    """Open walks (id, path, next) with the path of the formula they come to; closed ones, without `next`, as they are.

    A path that meets a formula again ends there.
    """
    following = other.select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("next").alias("_next"))
    both = walks.join(following, F.col("next") == F.col("_id"), "left")
    whole = F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path"))
    both = both.select("id", whole.alias("path"), "_next").withColumn("_met", F.size(F.array_distinct("path")))
    closed = F.col("_met") < F.size("path")
    return both.select(
        "id", F.when(closed, F.slice("path", F.lit(1), F.col("_met") + 1)).otherwise(F.col("path")).alias("path"),
        F.when(~closed, F.col("_next")).alias("next"),
    )


def find_cycles(formulas: DataFrame) -> DataFrame:
    """(id, has_cycle, cycle_path) of every formula.

    The path follows the first use that leads to a cycle until a formula comes again. Paths grow fourfold each round, so
    a path of n formulas takes about log4 n of them.
    """
    ids = formulas.select("id").distinct()
    links = cut(edges(formulas))
    stuck = cut(leading_to_cycles(links))
    inner = links.join(stuck, F.col("src") == F.col("id"), "left_semi").join(stuck, F.col("dst") == F.col("id"), "left_semi")
    first = inner.groupBy(F.col("src").alias("id")).agg(F.min_by("dst", "pos").alias("next"))
    walks = cut(first.select("id", F.array("id").alias("path"), "next"))
    while not walks.filter(F.col("next").isNotNull()).isEmpty():
        twice = _with_path(walks, walks)
        walks = cut(_with_path(twice, twice))
    return ids.join(walks, "id", "left").select("id", F.col("path").isNotNull().alias("has_cycle"), F.col("path").alias("cycle_path"))


def _reached_in_cycles(links: DataFrame, fresh: DataFrame) -> DataFrame:
    """(target, id) reached from the pairs `fresh` over links between formulas that lead to cycles, step by step."""
    fresh = cut(fresh.distinct())
    reached = fresh
    while not fresh.isEmpty():
        following = fresh.join(links, F.col("id") == F.col("src")).select("target", F.col("dst").alias("id")).distinct()
        fresh = cut(following.join(reached, ["target", "id"], "left_anti"))
        reached = reached.unionByName(fresh)
    return reached


def closure(formulas: DataFrame, targets: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """(target, id): every formula that a target uses directly or not, itself included.

    Pairs are made from the highest level of formulas down. What uses a formula stands above it, so when a level's turn
    comes all its pairs are known: it is read once, and the uses of its formulas are written once, to the levels
    below. Formulas that lead to cycles have no level; they come first, step by step. `levels` saves computing them.
    """
    spark = formulas.sparkSession
    levels = cut(formula_levels(formulas) if levels is None else levels)
    links = cut(edges(formulas).select("src", "dst").join(levels.select(F.col("id").alias("dst"), "level"), "dst").select("src", "dst", "level"))
    begun = targets.select(F.col("id").alias("target"), "id").join(levels, "id").select("target", "id", "level").distinct()
    folder = f"{shared_folder(spark)}/closure-{uuid.uuid4().hex}"
    schema = begun.schema

    def written(pairs: DataFrame) -> None:
        pairs.filter(F.col("level").isNotNull()).write.mode("append").partitionBy("level").parquet(folder)

    def used_by(pairs: DataFrame) -> DataFrame:
        return pairs.select("target", F.col("id").alias("src")).join(links, "src").select("target", F.col("dst").alias("id"), "level").distinct()

    written(begun)
    circular = links.filter(F.col("level").isNull()).select("src", "dst")
    reached = _reached_in_cycles(circular, begun.filter(F.col("level").isNull()).select("target", "id"))
    written(used_by(reached))
    held = spark.read.schema(schema).option("recursiveFileLookup", "false")
    highest = levels.agg(F.max("level")).first()[0]
    for level in range(highest or 0, 0, -1):
        written(used_by(held.parquet(folder).filter(F.col("level") == level)))
    return held.parquet(folder).select("target", "id").distinct().unionByName(reached.select("target", "id"))


def evaluation_order(formulas: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id, level) of what each target needs; sorted by level, uses come first.

    A null level says that there is no order, as the formula leads to a cycle.
    """
    levels = cut(formula_levels(formulas))
    return closure(formulas, targets, levels).join(levels, "id").select("target", "id", "level")


def formula_tree(formulas: DataFrame, target: str) -> tuple[list, list[str]]:
    """Formula rows of one target in evaluation order, and the sensors they name.

    This is what a plan for the target is made from, so it comes to the driver: the tree
    of one formula, fetched level by level, or from the whole table if it is small.
    """
    references = formula_references(formulas)
    small = formulas.limit(FEW_REFERENCES + 1).collect()
    by_source: dict[str, list] = {}
    if few := len(small) <= FEW_REFERENCES:
        for row in references.collect():
            by_source.setdefault(row["src"], []).append(row)

    def mentions(sources: list[str]) -> list:
        if few:
            return [row for name in sources for row in sorted(by_source.get(name, []), key=lambda r: r["pos"])]
        return references.filter(F.col("src").isin(sources)).orderBy("src", "pos").collect()

    uses, sensors, frontier = {target: []}, [], [target]
    while frontier:
        following = []
        for row in mentions(frontier):
            if row["kind"] == "sensor":
                sensors.append(row["ref"])
                continue
            uses[row["src"]].append(row["ref"])
            if row["ref"] not in uses:
                uses[row["ref"]] = []
                following.append(row["ref"])
        frontier = following
    wanted = formulas.sparkSession.createDataFrame([(x,) for x in uses], "id string")
    found = small if few else formulas.join(wanted, "id", "left_semi").collect()
    rows = {row["id"]: row for row in found}
    try:
        order = list(TopologicalSorter(uses).static_order())
    except CycleError as error:
        path = error.args[1][::-1]
        raise ValueError(f"formula {path[-1]} is part of a cycle: {' > '.join(path)}") from error
    return [rows[name] for name in order if name in rows], list(dict.fromkeys(sensors))


def required_sensors(formulas: DataFrame, targets: DataFrame, primary: str | None = None) -> DataFrame:
    """(target, sensor): the primary sensor, and all target sensors and sensor mentions of the tree."""
    members = closure(formulas, targets)
    aims = formulas.select("id", "target_sensor")
    own = members.filter(F.col("target") == F.col("id")).join(aims, "id").select("target", F.coalesce(
        F.lit(primary), F.col("target_sensor"), F.lit(DEFAULT_PRIMARY),
    ).alias("sensor"))
    aimed = members.join(aims, "id").filter(F.col("target_sensor") != "").select("target", F.col("target_sensor").alias("sensor"))
    mentions = formula_references(formulas).filter(F.col("kind") == "sensor").select(F.col("src").alias("id"), "ref")
    named = members.join(mentions, "id").select("target", F.col("ref").alias("sensor"))
    return own.unionByName(aimed).unionByName(named).distinct()


def blocked_deletes(formulas: DataFrame, deletes: DataFrame) -> DataFrame:
    """(id, dependent): formulas on the delete list, and each formula that uses them."""
    return dependents(formulas).join(deletes.select("id").distinct(), "id", "left_semi")


def delete_formulas(formulas: DataFrame, deletes: DataFrame) -> DataFrame:
    """The formulas without those on the delete list that nothing uses."""
    free = deletes.select("id").distinct().join(blocked_deletes(formulas, deletes).select("id"), "id", "left_anti")
    return formulas.join(free, "id", "left_anti")


def formula_aliases(formulas: DataFrame) -> DataFrame:
    """(alias, id): id, code and the three spellings of the serial of each formula."""
    code = F.col("sensor_code") if "sensor_code" in formulas.columns else F.lit(None).cast("string")
    serial = F.when(F.col("serial") != 0, F.col("serial").cast("string"))
    spellings = F.array(F.col("id"), code, serial, F.concat(F.lit("P_"), serial), F.concat(F.lit("SN_"), serial))
    listed = formulas.select("id", F.posexplode(spellings).alias("_rank", "alias")).filter(F.col("alias").isNotNull())
    return listed.groupBy("alias").agg(F.min_by("id", F.struct("_rank", "id")).alias("id"))


def find_formulas(formulas: DataFrame, requests: DataFrame, column: str = "name", split_rows: int = FREQUENT) -> DataFrame:
    """Requests with `formula_id`: by any alias as written, else by the cleaned name.

    Each distinct name is looked up once; a name of more than `split_rows` requests does not gather them in one task.
    """
    aliases = formula_aliases(formulas)
    exact = aliases.select(F.col("alias").alias(column), F.col("id").alias("_exact"))
    cleaned = aliases.select(F.col("alias").alias("_clean"), F.col("id").alias("_cleaned"))
    names = requests.select(column).filter(F.col(column).isNotNull()).distinct()
    known = (
        names.join(shuffled(exact), column, "left")
        .withColumn("_clean", clean_formula_id(F.col(column))).join(shuffled(cleaned), "_clean", "left")
        .select(column, F.coalesce("_exact", "_cleaned").alias("formula_id"))
    )
    return look_up(requests, known, column, split_rows)
