"""Cohesion, coupling and dependency measures over fact tables.

members(class, member, kind): kind is 'field' or 'method'. uses(class, method, field): distinct or not, direct or through an
accessor. calls(class, caller, callee).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lack_of_cohesion(fields: DataFrame, methods: DataFrame, uses: DataFrame) -> DataFrame:
    """class, m, a, lcom2, lcom3. With m methods, a fields and u distinct uses: 1 - u / (m a) and (m - u / a) / (m - 1).

    lcom2 is null without a field or a method, lcom3 also with one method; lcom3 may exceed 1.
    """
    m = methods.groupBy("class").agg(F.count_distinct("method").alias("m"))
    a = fields.groupBy("class").agg(F.count_distinct("field").alias("a"))
    u = uses.select("class", "method", "field").distinct().groupBy("class").agg(F.count(F.lit(1)).alias("u"))
    x = m.join(a, "class", "full").join(u, "class", "left").fillna(0, ["m", "a", "u"])
    return x.select(
        "class", "m", "a",
        F.when((F.col("m") > 0) & (F.col("a") > 0), 1 - F.col("u") / (F.col("m") * F.col("a"))).alias("lcom2"),
        F.when((F.col("m") > 1) & (F.col("a") > 0), (F.col("m") - F.col("u") / F.col("a")) / (F.col("m") - 1)).alias("lcom3"),
    )


def system_average(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row: the mean over what is defined, 0 if nothing is."""
    return df.agg(F.coalesce(F.avg(column), F.lit(0.0)).alias(name))


def shared_bits(row: np.ndarray, code: np.ndarray, left: np.ndarray, right: np.ndarray, wide: int = 16384, room: int = 1 << 25) -> int:
    """Ordered pairs of a left and a right row (masks) with a code in common; row, code: the codes of each row, by row.

    Each code has the bits of the right rows that hold it; a left row's bits are those of its codes together. Arrays stay within
    some multiple of `room` bytes.
    """
    place = np.cumsum(right) - 1
    mine = left[row]
    total, n = 0, int(right.sum())
    width = max(64, min(wide, room * 8 // (int(code.max(initial=0)) + 1)) // 64 * 64)
    for begin in range(0, n, width):
        here = right[row] & (place[row] >= begin) & (place[row] < begin + width)
        known, at = np.unique(code[here], return_inverse=True)
        p = place[row[here]] - begin
        bits = np.zeros((len(known), width // 8), np.uint8)
        np.bitwise_or.at(bits, (at, p >> 3), np.left_shift(1, p & 7).astype(np.uint8))
        bits = bits.view(np.uint64)
        use = mine & np.isin(code, known)
        r, c = row[use], np.searchsorted(known, code[use])
        first = np.flatnonzero(np.diff(r, prepend=-1))
        step = max(1, room // (width // 8))
        k = 0
        while k < len(first):
            # As many rows as have `step` codes together, one at least.
            upto = max(k + 1, int(np.searchsorted(first, first[k] + step, "right")) - 1) if first[k] + step < len(r) else len(first)
            last = first[upto] if upto < len(first) else len(r)
            total += int(np.bitwise_count(np.bitwise_or.reduceat(bits[c[first[k] : last]], first[k:upto] - first[k], axis=0)).sum())
            k = upto
    return total


def sharing_pairs(uses: DataFrame, block: int = 200_000) -> DataFrame:
    """class, c: pairs of methods of a class that use a field in common (uses: class, method, field; distinct, none null).

    Counting them is quadratic in a class's methods, but no pair is ever a row: methods are dealt to blocks of some `block` uses,
    two blocks meet in one task, and pairs are bits there. A class costs its uses times its number of blocks in shuffled rows.
    """
    n = uses.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / block).alias("n"))
    sets = uses.groupBy("class", "method").agg(F.collect_list("field").alias("fields")).join(n, "class")
    dealt = sets.select("class", "fields", F.pmod(F.xxhash64("method"), "n").alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    met = dealt.select("class", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "fields")

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        fields, at, i, j = t["fields"].combine_chunks(), t["at"].to_numpy(), t["i"][0].as_py(), t["j"][0].as_py()
        row = pc.list_parent_indices(fields).to_numpy().astype(np.int64)
        code = pc.dictionary_encode(fields.flatten()).indices.to_numpy().astype(np.int64)
        c = shared_bits(row, code, at == i, at == j)
        return pa.table({"class": t["class"].slice(0, 1), "c": pa.array([(c - len(at)) // 2 if i == j else c], pa.int64())})

    kind = uses.schema["class"].dataType.simpleString()
    return met.groupBy("class", "i", "j").applyInArrow(run, f"class {kind}, c long").groupBy("class").agg(F.sum("c").alias("c"))


def connectivity(methods: DataFrame, uses: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """class, connectivity: cohesive pairs of methods over all pairs; null for fewer than two methods.

    A pair is cohesive if both use a field of the class or one calls the other. Pairs that share a field are counted by blocks;
    those of calls are rows, and count where they share none.
    """
    u = uses.select("class", "method", "field").dropna().distinct()
    c = sharing_pairs(u)
    if calls is not None:
        least, most = F.least("caller", "callee"), F.greatest("caller", "callee")
        called = calls.filter("class IS NOT NULL AND caller <> callee").select("class", least.alias("method"), most.alias("other")).distinct()
        sharing = called.join(u, ["class", "method"]).join(u.withColumnRenamed("method", "other"), ["class", "other", "field"], "left_semi").select("class", "method", "other")
        more = called.join(sharing, ["class", "method", "other"], "left_anti").groupBy("class").agg(F.count(F.lit(1)).alias("c"))
        c = c.unionByName(more).groupBy("class").agg(F.sum("c").alias("c"))
    n = methods.groupBy("class").agg(F.count_distinct("method").alias("m"))
    m = F.col("m")
    return n.join(c, "class", "left").select("class", F.when(m > 1, 2 * F.coalesce("c", F.lit(0)) / (m * (m - 1))).alias("connectivity"))


def coupling_matrix(classes: DataFrame, accesses: DataFrame) -> DataFrame:
    """src, dst, n for every ordered pair of classes: accesses from one to the other, 0 where there are none.

    The grid of all pairs is what is asked for here; its input is the list of classes, not the accesses.
    """
    names = classes.select("class").distinct()
    grid = names.select(F.col("class").alias("src")).crossJoin(names.select(F.col("class").alias("dst")))
    n = accesses.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["src", "dst"], "left").fillna(0, ["n"])


def average_coupling(classes: DataFrame, accesses: DataFrame) -> DataFrame:
    """class, coupling: accesses to other classes over their number; null in a system of one class. No grid is built."""
    names = classes.select("class").distinct()
    total = names.agg((F.count(F.lit(1)) - 1).alias("others"))
    out = accesses.filter("src <> dst").groupBy(F.col("src").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return names.join(out, "class", "left").join(F.broadcast(total)).select("class", F.when(F.col("others") > 0, F.coalesce("n", F.lit(0)) / F.col("others")).alias("coupling"))


def dependencies(accesses: DataFrame, by: list[str], inside: str = "inside") -> DataFrame:
    """Internal and external counts of distinct fields and calls; `inside` is a boolean column, `member` and `mode` the rest."""
    # The kinds of use that a member has are one number, so no member is expanded into a row for each count.
    names = {(m, a): f"{'internal' if a else 'external'}_{m}s" for m in ("call", "read", "write") for a in (True, False)}
    bit = F.lit(0)
    for k, (m, a) in enumerate(names):
        bit = F.when((F.col("mode") == m) & (F.col(inside) == F.lit(a)), 1 << k).otherwise(bit)
    place = F.when(F.col(inside), 64).when(~F.col(inside), 128).otherwise(0)
    d = accesses.select(*by, "member", bit.bitwiseOR(place).alias("uses")).groupBy(*by, "member").agg(F.bit_or("uses").alias("uses"))
    has = lambda b: F.col("uses").bitwiseAND(F.lit(b)) != 0
    known = F.col("member").isNotNull()
    return d.groupBy(*by).agg(*(F.count_if(has(1 << k)).alias(n) for k, n in enumerate(names.values())), F.count_if(known & has(64)).alias("source_deps"), F.count_if(known & has(128)).alias("target_deps"))


def dependency_histogram(accesses: DataFrame, by: list[str]) -> DataFrame:
    """How often each member is called, read or written."""
    return accesses.groupBy(*by, "mode", "member").agg(F.count(F.lit(1)).alias("n"))


def group_averages(rows: DataFrame, group: list[str], values: list[str], kept: str) -> DataFrame:
    """Means over a group's kept rows, divided by the number of all its rows, kept or not, and maxima of the kept."""
    aggs = []
    for v in values:
        x = F.when(F.col(kept), F.col(v))
        aggs += [(F.coalesce(F.sum(x), F.lit(0)) / F.count(F.lit(1))).alias(f"avg_{v}"), F.max(x).alias(f"max_{v}")]
    return rows.groupBy(*group).agg(*aggs, F.count_if(kept).alias("n_kept"))


def modal(rows: DataFrame, group: list[str], term: str) -> DataFrame:
    """All terms of a group that are as frequent as its most frequent one, sorted."""
    n = rows.groupBy(*group, term).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*group).agg(F.max("n").alias("top"))
    return n.join(best, group).filter("n = top").groupBy(*group).agg(F.array_sort(F.collect_list(term)).alias("terms"), F.first("top").alias("n"))


def weighted_differences(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: by, difference, kind, weight, left, right. Sums with and without repetitions and type mismatches, and edit distances."""
    plain = F.col("kind") != "TYPE_MISMATCH"
    names = F.col("kind").isin("VARIABLE_NAME_MISMATCH", "LITERAL_VALUE_MISMATCH", "METHOD_INVOCATION_NAME_MISMATCH")
    every = rows.groupBy(*by).agg(
        F.sum("weight").alias("all_weight"), F.sum(F.when(plain, F.col("weight")).otherwise(0)).alias("all_plain_weight"),
        F.sum(F.when(names, F.levenshtein("left", "right")).otherwise(0)).alias("edit_distance"),
    )
    once = rows.select(*by, "difference", "kind", "weight").distinct().groupBy(*by).agg(F.sum("weight").alias("distinct_weight"), F.sum(F.when(plain, F.col("weight")).otherwise(0)).alias("distinct_plain_weight"))
    return every.join(once, by)


def access_buckets(accesses: DataFrame) -> DataFrame:
    """entity, n, owners: the classes that an entity uses n members of."""
    n = accesses.select("entity", "owner", "member").distinct().groupBy("entity", "owner").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("entity", "n").agg(F.array_sort(F.collect_list("owner")).alias("owners"))


def slice_group_measures(members: DataFrame) -> DataFrame:
    """members (group, slice, element) -> group, slices, total (elements over all slices), common (elements of every slice) and
    overlap (the mean share of a slice that is common): by counts, so that no group is gathered in a row."""
    x = members.select("group", "slice", "element").distinct()
    sizes = x.groupBy("group", "slice").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.groupBy("group").agg(F.count(F.lit(1)).alias("slices"), F.sum("n").alias("total"), F.avg(1 / F.col("n")).alias("mean"))
    shared = x.groupBy("group", "element").agg(F.count(F.lit(1)).alias("k")).join(groups.select("group", "slices"), "group").filter("k = slices")
    common = shared.groupBy("group").agg(F.count(F.lit(1)).alias("common"))
    out = groups.join(common, "group", "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return out.select("group", "slices", "total", "common", (F.col("common") * F.col("mean")).alias("overlap"))
