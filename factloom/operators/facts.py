"""Predicates and projections of source-code facts.

Tables: classes(class, superclass, interfaces, kind, access, is_abstract, is_static, comments); members(member, class, kind,
name, type, params, access, is_static, is_abstract, is_accessor, has_body); accesses(src, dst, src_class, dst_class, mode,
receiver); associations(from_class, to_class, field, is_container).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import is_generated, owner_of
from .graph import settled


@dataclass(frozen=True)
class Thresholds:
    """Settings with their defaults."""

    min_slice: int = 0
    max_slice_slack: int = 0
    max_duplication: int = 100
    max_duplication_ratio: float = 1.0
    min_method_size: int = 0
    call_depth: int = 3
    alias_analysis: bool = True
    unit_cache: int = 20
    library_cache: int = 50
    usage_reporting: bool = False
    source_reporting: bool = False
    move_method_source: int = 2
    extract_class_source: int = 2


@dataclass
class FactBase:
    """The catalog: a bundle of lazy tables."""

    classes: DataFrame
    members: DataFrame
    accesses: DataFrame
    associations: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> FactBase:
        return cls(*(spark.read.parquet(f"{folder}/{n}") for n in ("classes", "members", "accesses", "associations")))

    def scope(self, prefix: str) -> FactBase:
        """Classes whose qualified name begins so (a root, a package, a type with what is nested in it): pushed to the scan."""
        inside = lambda c: (F.col(c) == prefix) | F.col(c).startswith(prefix + ".")
        return FactBase(self.classes.filter(inside("class")), self.members.filter(inside("class")), self.accesses.filter(inside("src_class")), self.associations)

    def number_of_units(self) -> int:
        return self.classes.count()


def flatten_nested(types: DataFrame) -> DataFrame:
    """Types (type, parent) with the path from their outermost type: a join for each level of nesting, whatever their number."""
    level = out = settled(types.filter("parent IS NULL").select("type", F.array("type").alias("path")))
    inner = types.filter("parent IS NOT NULL").select("type", "parent")
    while True:
        above = level.select(F.col("type").alias("parent"), "path")
        level = settled(inner.join(above, "parent").select("type", F.concat("path", F.array("type")).alias("path")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def eligible_classes(classes: DataFrame) -> DataFrame:
    return classes.filter(~F.col("kind").isin("enum", "interface") & ~is_generated(F.col("comments")))


def is_test(superclass: Column, annotations: Column) -> Column:
    return F.coalesce(superclass == "junit.framework.TestCase", F.lit(False)) | F.exists(annotations, lambda a: a.rlike(r"(^|\.)Test$"))


def body_counts(accesses: DataFrame) -> DataFrame:
    """member with its numbers of reads, writes and calls, for predicates about a method's body."""
    n = lambda m: F.count_if(F.col("mode") == m).alias(f"n_{m}s")
    return accesses.groupBy(F.col("src").alias("member")).agg(n("read"), n("write"), n("call"))


def is_getter(statement: Column, params: Column, reads: Column, writes: Column, calls: Column, locals_: Column) -> Column:
    return (statement == "return") & (F.size(params) == 0) & (reads == 1) & (writes == 0) & (calls == 0) & (locals_ == 0)


def is_setter(statement: Column, params: Column, reads: Column, writes: Column, calls: Column) -> Column:
    return (statement == "assignment") & (F.size(params) == 1) & (reads == 0) & (writes == 1) & (calls == 0)


#: What adds to a collection, and the types of receivers that count as collections.
ADDERS = ("add", "addElement", "addAll")
COLLECTIONS = ("java.util.Collection", "java.util.AbstractCollection", "java.util.List", "java.util.AbstractList", "java.util.ArrayList", "java.util.LinkedList", "java.util.Set", "java.util.AbstractSet", "java.util.HashSet", "java.util.LinkedHashSet", "java.util.SortedSet", "java.util.TreeSet", "java.util.Vector")


def is_collection_adder(params: Column, reads: Column, calls: Column, called: Column, receiver: Column, declared: Column, locals_used: Column) -> Column:
    """A body of one statement that adds its one parameter to a field: no local declared, one local (the parameter) used."""
    return (F.size(params) == 1) & (reads == 1) & (calls == 1) & (declared == 0) & (locals_used == 1) & called.isin(*ADDERS) & F.regexp_replace(receiver, "<.*>", "").isin(*COLLECTIONS)


def is_delegate(statement: Column, calls: Column, receiver: Column) -> Column:
    return statement.isin("return", "expression") & (calls == 1) & receiver.isin("field", "parameter", "this", "getter")


def valid_targets(candidates: DataFrame, reachable: DataFrame, local_types: DataFrame) -> DataFrame:
    """Candidates (method, target) whose target is the type of a parameter or field it reaches, and not of a declared local."""
    return candidates.join(reachable.select("method", "target").distinct(), ["method", "target"], "left_semi").join(local_types.select("method", "target"), ["method", "target"], "left_anti")


def one_to_many(accesses: DataFrame, associations: DataFrame) -> DataFrame:
    """Accesses to fields that hold many objects of the target."""
    many = associations.filter("is_container").select(F.col("field").alias("dst"), F.col("from_class").alias("src_class")).distinct()
    return accesses.join(many, ["dst", "src_class"], "left_semi")


def used_outside(accesses: DataFrame, members: DataFrame) -> DataFrame:
    """Members (member, class) called or used by another class."""
    a = accesses.select(F.col("dst").alias("member"), "src_class")
    return members.join(a, (members["member"] == a["member"]) & (a["src_class"] != members["class"]), "left_semi")


def private_helpers(accesses: DataFrame, members: DataFrame) -> DataFrame:
    """method, helper: private methods that only this method calls and that touch no member of the system."""
    calls = accesses.filter("mode = 'call'")
    private = members.filter("kind = 'method' AND access = 'private'").select(F.col("member").alias("helper"))
    callers = calls.groupBy(F.col("dst").alias("helper")).agg(F.count_distinct("src").alias("n"), F.min("src").alias("method")).filter("n = 1")
    touching = accesses.select(F.col("src").alias("helper")).distinct()
    return callers.join(private, "helper", "left_semi").join(touching, "helper", "left_anti").select("method", "helper")


def passes(names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for n in names:
        out &= F.coalesce(F.col(n), F.lit(True))
    return out


def violations(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks; a rule is a boolean column that is true where it is broken."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))


def class_sets(members: DataFrame, references: DataFrame) -> DataFrame:
    """class, eset: its attributes that aren't references to classes, and its methods."""
    return members.join(references.select("member"), "member", "left_anti").groupBy("class").agg(F.array_sort(F.collect_set("member")).alias("eset"))


def method_sets(members: DataFrame, accesses: DataFrame, references: DataFrame) -> DataFrame:
    """member, class, eset (accessed attributes that aren't references, called methods but itself), full_set (itself and all)."""
    methods = members.filter("kind = 'method'").select("member", "class")
    a = accesses.select(F.col("src").alias("member"), "dst").distinct().join(references.select(F.col("member").alias("dst"), F.lit(True).alias("ref")), "dst", "left")
    sets = a.groupBy("member").agg(F.collect_set("dst").alias("every"), F.collect_set(F.when(F.col("ref").isNull() & (F.col("dst") != F.col("member")), F.col("dst"))).alias("some"))
    none = F.array().cast("array<string>")
    return methods.join(sets, "member", "left").select("member", "class", F.array_sort(F.coalesce("some", none)).alias("eset"), F.array_sort(F.array_union(F.array("member"), F.coalesce("every", none))).alias("full_set"))


def attribute_sets(members: DataFrame, accesses: DataFrame, references: DataFrame) -> DataFrame:
    """member, class, eset (methods that access it, none for a reference), full_set (itself and they)."""
    fields = members.filter("kind = 'field'").select("member", "class").join(references.select("member", F.lit(True).alias("ref")), "member", "left")
    by = accesses.groupBy(F.col("dst").alias("member")).agg(F.collect_set("src").alias("users"))
    none = F.array().cast("array<string>")
    users = F.coalesce("users", none)
    return fields.join(by, "member", "left").select("member", "class", F.array_sort(F.when(F.col("ref").isNull(), users).otherwise(none)).alias("eset"), F.array_sort(F.array_union(F.array("member"), users)).alias("full_set"))


def system(members: DataFrame, with_static: bool = False) -> DataFrame:
    """Members that take part in distances: no accessors or delegates, and no static ones unless asked for."""
    return members.filter(~F.col("is_accessor") & (F.lit(with_static) | ~F.col("is_static")))


def access_map(sets: DataFrame, superclasses: DataFrame | None = None) -> DataFrame:
    """entity, owner, members: an entity's set by the class that owns them; a subclass's list takes in its direct superclass's."""
    own = sets.select("entity", F.explode("eset").alias("member")).withColumn("owner", owner_of(F.col("member")))
    if superclasses is not None:
        up = own.join(superclasses.select("class", F.col("superclass").alias("owner")), "owner").select("entity", "member", F.col("class").alias("owner"))
        up = up.join(own.select("entity", "owner").distinct(), ["entity", "owner"], "left_semi")
        own = own.unionByName(up)
    return own.groupBy("entity", "owner").agg(F.array_sort(F.collect_set("member")).alias("members"))


def annotation(accessed: DataFrame) -> DataFrame:
    """entity, text: the members that an entity accesses, owner by owner."""
    one = F.concat(F.col("owner"), F.lit(": "), F.array_join("members", ", "))
    return accessed.withColumn("line", one).groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("line")), "; ").alias("text"))


def associations(fields: DataFrame, classes: DataFrame) -> DataFrame:
    """from_class, to_class, field, is_container: fields typed by a class of the system, in an array, or in a generic type.

    Names are taken out of the type's text and joined by equality, so no pair of field and class is tried in vain.
    """
    names = F.explode(F.array_distinct(F.regexp_extract_all(F.col("type"), F.lit(r"([\w.$]+)"), F.lit(1))))
    f = fields.select(F.col("class").alias("from_class"), F.col("member").alias("field"), "type", names.alias("to_class"))
    return f.join(classes.select(F.col("class").alias("to_class")), "to_class", "left_semi").select("from_class", "to_class", "field", F.col("type").rlike(r"[<\[]").alias("is_container"))


def adder_associations(fields: DataFrame, adders: DataFrame, classes: DataFrame) -> DataFrame:
    """from_class, to_class, field of untyped collections whose adder method (class, field, element_type) takes a class of the system."""
    known = classes.select(F.col("class").alias("to_class"))
    pairs = fields.select(F.col("class").alias("from_class"), F.col("member").alias("field")).join(adders.select(F.col("class").alias("from_class"), "field", F.col("element_type").alias("to_class")), ["from_class", "field"])
    return pairs.join(known, "to_class", "left_semi").groupBy("from_class", "field").agg(F.min("to_class").alias("to_class")).select("from_class", "to_class", "field", F.lit(True).alias("is_container"))


def constants_of_subclasses(constants: DataFrame, subclasses: DataFrame) -> DataFrame:
    """constant, class: constants of a type check and subclasses with the same name but for case and underscores."""
    plain = lambda c: F.lower(F.regexp_replace(F.substring_index(c, ".", -1), "_", ""))
    return constants.select("constant", plain(F.col("constant")).alias("k")).join(subclasses.select("class", plain(F.col("class")).alias("k")), "k").select("constant", "class")


def friends(accesses: DataFrame, ancestors: DataFrame) -> DataFrame:
    """class, friend: classes that use a member of the class or of one of its superclasses (type, ancestor)."""
    used = accesses.filter("src_class <> dst_class").select(F.col("src_class").alias("friend"), F.col("dst_class").alias("class")).distinct()
    up = used.join(ancestors.select(F.col("ancestor").alias("class"), F.col("type").alias("sub")), "class").select("friend", F.col("sub").alias("class"))
    return used.unionByName(up).filter("friend <> class").select("class", "friend").distinct()


def comments_of_types(comments: DataFrame, types: DataFrame) -> DataFrame:
    """comment, type: comments (comment, file, start, end) inside a type (type, file, start, end), or in the file named as it."""
    from .joins import contained

    inside = contained(comments, types, ["file"]).select(F.col("i_comment").alias("comment"), F.col("o_type").alias("type"))
    simple = F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1)
    named = comments.select("comment", "file", simple.alias("name")).join(types.select("type", "file", F.substring_index("type", ".", -1).alias("name")), ["file", "name"]).select("comment", "type")
    return inside.unionByName(named).distinct()
