"""Candidates of the detectors: moved methods, extracted classes, type checks, extracted slices; and how they are ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import identifier_words
from ..functions.sets import distance_of_sizes
from .cluster import concepts, hierarchical
from .facts import Thresholds
from .graph import settled
from .metrics import modal


def move_methods(accesses: DataFrame, applicable: DataFrame | None = None, ancestors: DataFrame | None = None, bound: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """source, entity, target, source_deps, target_deps of methods that use another class more than their own.

    accesses: entity, source (its class), owner, member, distinct. Targets are tried in order of their counts, all of one
    count together. A target is found if it is applicable (entity, target in `applicable`, if given) and used as much as the
    source; the search stops after the count at which one is found or the source stands. A row also needs few source
    dependencies, fewer than the target's, and a target that isn't an ancestor (class, ancestor) of another accessed class.
    Entities in `bound` (the same columns as the result) take those rows alone.
    """
    n = accesses.select("entity", "source", "owner", "member").distinct().groupBy("entity", "source", "owner").agg(F.count(F.lit(1)).alias("n"))
    own = n.filter("owner = source").select("entity", F.col("n").alias("source_n"))
    x = n.join(own, "entity", "left").fillna(0, ["source_n"])
    if applicable is not None:
        x = x.join(applicable.select("entity", F.col("target").alias("owner"), F.lit(True).alias("ok")), ["entity", "owner"], "left").fillna(False, ["ok"])
    else:
        x = x.withColumn("ok", F.lit(True))
    is_source = F.col("owner") == F.col("source")
    x = x.withColumn("found", ~is_source & F.col("ok") & (F.col("n") >= F.col("source_n")))
    if ancestors is not None:
        over = ancestors.select(F.col("class").alias("owner"), F.col("ancestor"))
        covered = n.join(over, "owner").select("entity", F.col("ancestor").alias("owner")).distinct().withColumn("covered", F.lit(True))
        x = x.join(covered, ["entity", "owner"], "left").withColumn("found", F.col("found") & F.col("covered").isNull()).drop("covered")
    stop = F.max((F.col("found") | is_source).cast("int")).over(W.partitionBy("entity").orderBy(F.desc("n")).rangeBetween(W.unboundedPreceding, -1))
    x = x.withColumn("stopped", F.coalesce(stop, F.lit(0))).filter((F.col("stopped") == 0) & F.col("found"))
    out = x.filter((F.col("source_n") <= t.move_method_source) & (F.col("source_n") < F.col("n"))).select("source", "entity", F.col("owner").alias("target"), F.col("source_n").alias("source_deps"), F.col("n").alias("target_deps"))
    if bound is not None:
        out = out.join(bound.select("entity").distinct(), "entity", "left_anti").select(*out.columns).unionByName(bound.select(*out.columns))
    return out


def conceptual_bindings(parameters: DataFrame, associations: DataFrame, calls: DataFrame) -> DataFrame:
    """entity, target: a parameter of the target's type is passed to a call on a container field of the target."""
    held = associations.filter("is_container").select(F.col("from_class").alias("target"), F.col("field"), F.col("to_class").alias("held_type"))
    return parameters.join(calls, ["entity", "parameter"]).join(held, (F.col("receiver_field") == F.col("field")) & (F.col("type") == F.col("held_type"))).select("entity", "target").distinct()


def ranked(candidates: DataFrame, target: str = "target_deps", ties: tuple[str, ...] = ("source", "entity", "target"), tasks: int | None = None) -> DataFrame:
    """With their rank: fewest source dependencies, most target dependencies, then names, so that no two are equal.

    The rank is a position in one order of all rows, computed over candidates, which are few beside the facts; where they aren't,
    by so many tasks.
    """
    order = ["source_deps", F.desc(target), *ties]
    if tasks is None:
        return candidates.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    # A row's number within its range, and the rows of the ranges before.
    dealt = settled(settled(candidates).repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r["part"]: r["n"] for r in dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    first = F.element_at(F.array(*map(F.lit, before or [0])), (part + 1).cast("int"))
    return dealt.select(*candidates.columns, (first + within + 1).cast("int").alias("rank"))


def most_used(targets: DataFrame) -> DataFrame:
    """Of targets (source, entity, target, source_deps, target_deps), all of which an entity may move to and uses more than its
    source: those that it uses most. No target before them stops the search, nor does the source, which comes later."""
    most = F.max("target_deps").over(W.partitionBy("entity"))
    return targets.withColumn("most", most).filter("target_deps = most").drop("most")


def pair_distances(sets: DataFrame, group: str = "class") -> DataFrame:
    """group, a, b, dist of entities (group, entity, full_set) of one group that share an element; all others are 1 apart."""
    x = sets.select(group, "entity", F.size("full_set").alias("n"), F.explode("full_set").alias("e"))
    y = x.select(group, F.col("entity").alias("b"), F.col("n").alias("m"), "e")
    common = x.join(y, [group, "e"]).filter("entity < b").groupBy(group, F.col("entity").alias("a"), "b", "n", "m").agg(F.count(F.lit(1)).alias("c"))
    return common.select(group, "a", "b", distance_of_sizes(F.col("c"), F.col("n"), F.col("m")).alias("dist"))


def extract_classes(entities: DataFrame, sets: DataFrame, accesses: DataFrame, names: DataFrame, stop_words: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """class, candidate, concept, entities, source_deps, extracted_deps, topics.

    entities: class, entity, position, kind; sets: class, entity, full_set; accesses: src, dst; names: entity, name.
    """
    clusters = hierarchical(entities.select("class", "entity", "position"), pair_distances(sets))
    parts = clusters.select("class", "cluster", F.explode("entities").alias("entity")).join(entities.select("class", "entity", "kind"), ["class", "entity"])
    fit = parts.groupBy("class", "cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "method").alias("methods")).filter("n > 2 AND methods > 0")
    inside = parts.join(fit.select("class", "cluster"), ["class", "cluster"], "left_semi")
    used = inside.filter("kind = 'method'").select("class", "cluster", F.col("entity").alias("src")).join(accesses.select("src", "dst").distinct(), "src")
    used = used.join(entities.select("class", F.col("entity").alias("dst")), ["class", "dst"], "left_semi")
    here = inside.select("class", "cluster", F.col("entity").alias("dst"), F.lit(True).alias("own"))
    deps = used.select("class", "cluster", "dst").distinct().join(here, ["class", "cluster", "dst"], "left").groupBy("class", "cluster").agg(F.count_if(F.col("own").isNull()).alias("source_deps"), F.count_if("own").alias("extracted_deps"))
    good = deps.filter((F.col("source_deps") <= t.extract_class_source) & (F.col("source_deps") < F.col("extracted_deps")))
    chosen = inside.join(good, ["class", "cluster"]).withColumn("candidate", F.concat_ws("#", "class", F.lpad(F.col("cluster").cast("string"), 6, "0")))
    concept = concepts(chosen.select("candidate", "entity"))
    words = chosen.join(concept, "candidate").join(names, "entity").select("concept", F.explode(identifier_words(F.col("name"))).alias("word"))
    if stop_words is not None:
        words = words.join(stop_words.select("word"), "word", "left_anti")
    topics = modal(words, ["concept"], "word").select("concept", F.col("terms").alias("topics"))
    rows = chosen.groupBy("class", "candidate").agg(F.array_sort(F.collect_list("entity")).alias("entities"), F.first("source_deps").alias("source_deps"), F.first("extracted_deps").alias("extracted_deps"))
    return rows.join(concept, "candidate").join(topics, "concept", "left")


def type_check_groups(checks: DataFrame) -> DataFrame:
    """group, size_system, avg_size_class, avg_statements of candidates (group, class, candidate, statements: an average)."""
    per_class = checks.groupBy("group", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("statements").alias("s"))
    return per_class.groupBy("group").agg(F.sum("n").alias("size_system"), F.avg("n").alias("avg_size_class"), (F.sum("s") / F.sum("n")).alias("avg_statements"))


def rank_type_checks(groups: DataFrame) -> DataFrame:
    return groups.withColumn("rank", F.row_number().over(W.orderBy(F.desc("size_system"), F.desc("avg_size_class"), F.desc("avg_statements"), "group")))


def rank_slices(groups: DataFrame) -> DataFrame:
    """Slice groups (avg_ratio, avg_duplicated, max_extracted, avg_extracted, name): least duplicated first; where nothing is duplicated, most extracted."""
    none = F.col("avg_ratio") == 0
    order = ["avg_ratio", F.when(none, 0).otherwise(F.col("avg_duplicated")), F.desc(F.when(none, F.col("max_extracted")).otherwise(0)), F.desc("avg_extracted"), "name"]
    return groups.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def detected_move_methods(accesses: DataFrame, judged: DataFrame, ancestors: DataFrame | None = None, bound: DataFrame | None = None, t: Thresholds = Thresholds()) -> DataFrame:
    """The whole detector: `judged` (method, target, applicable: from rules.move_method_rules) decides which targets count while
    they are tried, and what is found is ranked. accesses as in move_methods, entities being methods."""
    fit = judged.filter("applicable").select(F.col("method").alias("entity"), "target").distinct()
    return ranked(move_methods(accesses, fit, ancestors, bound, t))


def detected_extract_classes(parts: DataFrame, accesses: DataFrame, homes: DataFrame, judged: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """class, candidate, size, source_deps, extracted_deps, best, rank of applicable candidates, ranked within the system.

    parts: class, candidate, entity, kind. accesses: src, dst. homes: class, entity (all of a class). judged: candidate,
    applicable (from rules.extract_class_rules). Dependencies are distinct entities of the class that the candidate's methods
    use, outside and inside the candidate; few outside, and fewer than inside, are asked for. Candidates go by most inside, then
    fewest outside; `best` is the position of a class by its best candidate, then its name.
    """
    x = parts.join(judged.filter("applicable").select("candidate"), "candidate", "left_semi").select("class", "candidate", "entity", "kind").distinct()
    used = x.filter("kind = 'method'").select("class", "candidate", F.col("entity").alias("src")).join(accesses.select("src", "dst").distinct(), "src").select("class", "candidate", F.col("dst").alias("entity")).distinct()
    used = used.join(homes.select("class", "entity").distinct(), ["class", "entity"], "left_semi").join(x.select("candidate", "entity", F.lit(True).alias("own")), ["candidate", "entity"], "left")
    deps = used.groupBy("candidate").agg(F.count_if(F.col("own").isNull()).alias("source_deps"), F.count_if("own").alias("extracted_deps"))
    size = x.groupBy("class", "candidate").agg(F.count(F.lit(1)).alias("size"))
    return ranked_extract_classes(size.join(deps, "candidate"), t)


def ranked_extract_classes(counts: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The same of applicable candidates whose class, candidate, size, source_deps and extracted_deps are counted already (by
    rules.extract_class_counts)."""
    good = counts.select("class", "candidate", "size", "source_deps", "extracted_deps").filter((F.col("source_deps") <= t.extract_class_source) & (F.col("source_deps") < F.col("extracted_deps")))
    order = [F.desc("extracted_deps"), "source_deps"]
    top = F.first(F.struct("extracted_deps", "source_deps")).over(W.partitionBy("class").orderBy(*order, "candidate"))
    best = F.dense_rank().over(W.orderBy(F.desc("top.extracted_deps"), "top.source_deps", "class"))
    return good.withColumn("top", top).withColumn("best", best).drop("top").withColumn("rank", F.row_number().over(W.orderBy(*order, "candidate")))


def rank_clusters(clusters: DataFrame) -> DataFrame:
    """clusters (class, cluster, size) with their rank in the class: the largest first, then by number."""
    return clusters.withColumn("rank", F.row_number().over(W.partitionBy("class").orderBy(F.desc("size"), "cluster")))


def rank_checks(checks: DataFrame) -> DataFrame:
    """checks (group, class, candidate, statements: an average) with their rank in the group: those of classes with most checks
    of the group first, then by most statements, then by candidate."""
    n = F.count(F.lit(1)).over(W.partitionBy("group", "class"))
    x = checks.withColumn("class_size", n)
    return x.withColumn("rank", F.row_number().over(W.partitionBy("group").orderBy(F.desc("class_size"), F.desc("statements"), "candidate")))


def static_field_groups(members: DataFrame) -> DataFrame:
    """n, classes: classes (sorted) by their number of static fields; members: class, kind, is_static. Those without count as 0."""
    n = members.groupBy("class").agg(F.count_if((F.col("kind") == "field") & F.col("is_static")).alias("n"))
    return n.groupBy("n").agg(F.array_sort(F.collect_list("class")).alias("classes"))
