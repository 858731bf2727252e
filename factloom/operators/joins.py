"""Joins that are not plain equi-joins: intervals, nearest row, division, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def contained(inner: DataFrame, outer: DataFrame, keys: list[str], start: str = "start", end: str = "end", bin_width: int | None = None) -> DataFrame:
    """Pairs (i_*, o_*) of intervals of the same keys with inner inside outer (ends included).

    With bin_width an outer interval is dealt to the bins it covers and an inner one to the bin of its start, so that a
    hot key doesn't meet in one task; the bins of an outer interval are as many as it is long, so no row multiplies beyond that.
    """
    i = inner.select(*(F.col(c).alias(f"i_{c}") for c in inner.columns))
    o = outer.select(*(F.col(c).alias(f"o_{c}") for c in outer.columns))
    on = [F.col(f"i_{k}") == F.col(f"o_{k}") for k in keys]
    if bin_width:
        i = i.withColumn("__bin", F.floor(F.col(f"i_{start}") / bin_width))
        o = o.withColumn("__obin", F.explode(F.sequence(F.floor(F.col(f"o_{start}") / bin_width), F.floor(F.col(f"o_{end}") / bin_width))))
        on.append(F.col("__bin") == F.col("__obin"))
    on += [F.col(f"o_{start}") <= F.col(f"i_{start}"), F.col(f"i_{end}") <= F.col(f"o_{end}")]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    return i.join(o, condition).drop("__bin", "__obin")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], order: list[str], start: str = "start", end: str = "end", bin_width: int | None = None) -> DataFrame:
    """For each row of points the shortest span around it (ties by `order` of the span)."""
    both = contained(points, spans, keys, start, end, bin_width)
    by = [f"i_{c}" for c in points.columns]
    w = W.partitionBy(*by).orderBy(F.col(f"o_{end}") - F.col(f"o_{start}"), *(f"o_{c}" for c in order))
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def preceding(df: DataFrame, keys: list[str], order: list[str], when: Column, value: Column) -> Column:
    """The value of the nearest earlier row of the key for which `when` holds: an as-of join of a table with itself."""
    return F.last(F.when(when, value), ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))


def following(df: DataFrame, keys: list[str], order: list[str], when: Column, value: Column) -> Column:
    return F.first(F.when(when, value), ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(1, W.unboundedFollowing))


def divide(rows: DataFrame, group: str, element: str, divisor: DataFrame, by: str | None = None) -> DataFrame:
    """Groups that have every element of the divisor (for each value of `by`, if given)."""
    need = divisor.select(*([by] if by else []), element).distinct()
    have = rows.select(group, element).distinct()
    met = have.join(need, element).groupBy(*([by] if by else []), group).agg(F.count(F.lit(1)).alias("__met"))
    total = need.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("__all"))
    out = met.join(total, by) if by else met.join(F.broadcast(total))  # one row without `by`
    return out.filter("__met = __all").drop("__met", "__all")


def upsert(table: DataFrame, key: list[str], removed: DataFrame | None = None, changed: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """The table after a delta: removed keys go, changed rows take the place of old ones, added rows come in."""
    out = table
    for gone in (removed, changed):
        if gone is not None:
            out = out.join(gone.select(*key).distinct(), key, "left_anti")
    for new in (changed, added):
        if new is not None:
            out = out.unionByName(new.select(*table.columns))
    return out


def require_none(df: DataFrame, what: str) -> DataFrame:
    """Raises if df has a row: validation before a scan goes on."""
    row = df.limit(1).collect()
    if row:
        raise ValueError(f"{what}: {row[0].asDict()}")
    return df
