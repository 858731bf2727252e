"""Names, types, variable paths, versions and buckets, all as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of parser generators in comments; a comment holds all strings of a mark.
GENERATED = (("Generated By:JavaCC",), ("Generated By:JJTree",), ("Generated from", "by ANTLR"), ("generated by JFlex",), ("generated by CUP",), ("created by jay",))
#: Methods whose shape is prescribed by the platform, as name(parameters): result.
WELL_KNOWN = (
    "readObject(java.io.ObjectInputStream):void", "writeObject(java.io.ObjectOutputStream):void", "equals(java.lang.Object):boolean", "hashCode():int",
    "toString():java.lang.String", "clone():java.lang.Object", "compareTo(java.lang.Object):int",
)


def attribute_id(owner: Column, kind: Column, name: Column) -> Column:
    return F.concat(owner, F.lit("::"), kind, F.lit(" "), name)


def method_id(owner: Column, name: Column, params: Column, result: Column) -> Column:
    """Class::name(p1, p2):result; the class is left out where the method has its name (a constructor)."""
    simple = F.substring_index(owner, ".", -1)
    signature = F.concat(name, F.lit("("), F.array_join(params, ", "), F.lit(")"), F.when(result.isNotNull(), F.concat(F.lit(":"), result)).otherwise(F.lit("")))
    return F.when(name == simple, signature).otherwise(F.concat(owner, F.lit("::"), signature))


def owner_of(entity: Column) -> Column:
    return F.split_part(entity, F.lit("::"), F.lit(1))


def member_of(entity: Column) -> Column:
    return F.split_part(entity, F.lit("::"), F.lit(2))


def camel_words(name: Column) -> Column:
    """Lower-case words of an identifier: runs of single capitals are one word, digits go."""
    tokens = F.regexp_extract_all(name, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+)"), F.lit(1))
    return F.transform(tokens, lambda t: F.lower(t))


def identifier_words(name: Column) -> Column:
    """Words of an identifier split at underscores and capitals."""
    return F.flatten(F.transform(F.split(name, "[_ ]+"), camel_words))


def type_parts(name: Column) -> Column:
    """class_type, generic_type, dimensions of a qualified type name such as a.B<c.D>[][]."""
    bare = F.regexp_replace(name, r"\[\]", "")
    generic = F.regexp_extract(bare, r"(<.*>)\s*$", 1)
    return F.struct(
        F.trim(F.regexp_replace(bare, r"<.*>\s*$", "")).alias("class_type"), F.when(generic != "", generic).alias("generic_type"),
        ((F.length(name) - F.length(F.replace(name, F.lit("[]"), F.lit("")))) / 2).cast("int").alias("dimensions"),
    )


def same_type(a: Column, b: Column) -> Column:
    """Equality of type_parts that takes single letters for type parameters, which equal anything."""
    free = lambda t: F.length(t["class_type"]) == 1
    generic = a["generic_type"].eqNullSafe(b["generic_type"]) | a["generic_type"].isNull() | b["generic_type"].isNull() | a["generic_type"].rlike(r"\b[A-Z]\b") | b["generic_type"].rlike(r"\b[A-Z]\b")
    return (free(a) | free(b) | ((a["class_type"] == b["class_type"]) & generic)) & (a["dimensions"] == b["dimensions"])


def path_starts_with(path: Column, prefix: Column) -> Column:
    """Whether a variable path (an array of names) begins with another."""
    return F.slice(path, F.lit(1), F.size(prefix)) == prefix


def path_contains(path: Column, name: Column) -> Column:
    return F.array_contains(path, name)


def path_left(path: Column) -> Column:
    """Without its last name."""
    return F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))


def path_right(path: Column) -> Column:
    """Without its first name."""
    return F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0)))


def path_final(path: Column) -> Column:
    return F.element_at(path, -1)


def extracted_name(owner: Column, taken: Column) -> Column:
    """A name for a class taken out of owner: owner + Product, or Product2 if that exists."""
    name = F.concat(F.substring_index(owner, ".", -1), F.lit("Product"))
    return F.when(F.array_contains(taken, name), F.concat(name, F.lit("2"))).otherwise(name)


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")


def hexadecimal(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def version_key(version: Column) -> Column:
    """An array to sort versions by: numbers as numbers, before words, and prefixes before what they begin."""
    parts = F.filter(F.split(version, r"[._\-# ]|(?<=\D)(?=\d)|(?<=\d)(?=\D)"), lambda p: p != "")
    number = lambda p: F.try_to_number(p, F.lit("999999999999999999")).cast("long")
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d{1,18}$"), 0).otherwise(1).alias("word"), F.when(p.rlike(r"^\d{1,18}$"), number(p)).alias("number"), p.alias("text")))


def severity(count: Column) -> Column:
    """1 to 5: at most 1, 2, 3 to 4, 5 to 6, 7 and more."""
    return F.when(count <= 1, 1).when(count == 2, 2).when(count <= 4, 3).when(count <= 6, 4).otherwise(5)


def depth(name: Column) -> Column:
    """Dots in a package name."""
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))


def shift_status(original: Column, updated: Column) -> Column:
    return F.when(updated == -1, "tampered").when(updated == original, "original").otherwise("shifted")


def is_generated(comments: Column) -> Column:
    def marked(c: Column) -> Column:
        return reduce(Column.__or__, (reduce(Column.__and__, (c.contains(x) for x in mark)) for mark in GENERATED))

    return F.exists(F.coalesce(comments, F.array().cast("array<string>")), marked)


def is_well_known(name: Column, params: Column, result: Column) -> Column:
    return F.concat(name, F.lit("("), F.array_join(params, ", "), F.lit("):"), result).isin(*WELL_KNOWN)
