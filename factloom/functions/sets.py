"""Set algebra on array columns (duplicates don't count) and on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a & b| / |a | b|; two empty sets are as far apart as can be."""
    return distance_of_sizes(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))


def distance_of_sizes(common: Column, n: Column, m: Column) -> Column:
    """The Jaccard distance of sets of these sizes."""
    return F.when(n + m == 0, F.lit(1.0)).otherwise(1.0 - common / (n + m - common))


def contains_all(a: Column, b: Column) -> Column:
    """Whether a holds every element of b."""
    return F.size(F.array_except(b, a)) == 0


def union_rows(a: DataFrame, b: DataFrame, bag: bool = False) -> DataFrame:
    out = a.unionByName(b)
    return out if bag else out.distinct()


def slice_measures(slices: Column, length: Column) -> dict[str, Column]:
    """Tightness, coverage and overlap of a list of statement sets in a method of some length."""
    common = F.aggregate(F.slice(slices, 2, F.greatest(F.lit(1), F.size(slices))), slices[0], lambda a, x: F.array_intersect(a, x))
    n = F.size(slices)
    mean = lambda f: F.aggregate(F.transform(slices, f), F.lit(0.0), lambda a, x: a + x) / n
    return {
        "tightness": F.size(common) / length,
        "coverage": mean(lambda s: F.size(s) / length),
        "overlap": mean(lambda s: F.size(common) / F.size(s)),
    }


def common_counts(rows: DataFrame, key: str, element: str) -> DataFrame:
    """a, b, common of keys a < b that share elements (rows: key, element; repeats and nulls don't count).

    The keys of an element are one row, and each key gets the list of those after it, so a pair that shares many elements is
    shuffled as numbers in lists. Lists are dealt by a, where the pairs are counted as they are read.
    """
    keys = rows.filter(F.col(element).isNotNull()).groupBy(element).agg(F.array_sort(F.collect_set(key)).alias("keys"))
    lists = keys.select(F.posexplode("keys").alias("at", "a"), "keys").select("a", F.slice("keys", F.col("at") + 2, F.size("keys")).alias("after")).filter(F.size("after") > 0)
    return lists.repartition("a").select("a", F.explode("after").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
