"""Measures between consecutive versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.edits import token_distance
from ..functions.names import version_key


def discover(projects: DataFrame, name: str) -> DataFrame:
    """Projects whose name up to the first digit is the same, in the order of their versions; names without a digit have none."""
    prefix = F.regexp_extract(F.col(name), r"^(\D*)\d", 1)
    return projects.filter(F.col(name).rlike(r"\d")).withColumn("family", prefix).withColumn("version_key", version_key(F.regexp_extract(F.col(name), r"(\d.*)$", 1)))


def between(df: DataFrame, entity: list[str], order: list, value: str) -> DataFrame:
    """Each version with the value of the one before."""
    return df.withColumn("before", F.lag(value).over(W.partitionBy(*entity).orderBy(*order)))


def change(distance: Column, n: Column, m: Column) -> tuple[Column, Column]:
    """similarity and change: (max - d) / max and d / max; null where a side is missing."""
    top = F.greatest(n, m)
    return F.when(n.isNotNull() & m.isNotNull() & (top > 0), (top - distance) / top), F.when(n.isNotNull() & m.isNotNull() & (top > 0), distance / top)


def token_evolution(df: DataFrame, entity: list[str], order: list, tokens: str) -> DataFrame:
    """distance, similarity and change of token lists between consecutive versions."""
    x = between(df, entity, order, tokens).withColumn("distance", token_distance(F.col("before"), F.col(tokens)))
    n, m = F.when(F.col("before").isNotNull(), F.size("before")), F.when(F.col(tokens).isNotNull(), F.size(tokens))
    similarity, changed = change(F.col("distance"), n, m)
    return x.withColumns({"similarity": similarity, "change": changed})


def envy_evolution(before: Column, now: Column, accessible_before: Column, accessible_now: Column) -> Column:
    """1 - |change of envied elements| / the larger number of accessible members."""
    top = F.greatest(accessible_before, accessible_now)
    return F.when(top > 0, 1 - F.abs(now - before) / top)


def group_evolution(before: Column, now: Column) -> Column:
    """|change of size| / the larger size; null if both are 0."""
    top = F.greatest(before, now)
    return F.when(top > 0, F.abs(now - before) / top)
