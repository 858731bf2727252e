"""Clone groups: exact copies, contained groups, near copies, types and refactorings, and the mapping of two graphs."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .graph import settled
from .joins import contained


def exact_groups(rows: DataFrame, key: str, item: str) -> DataFrame:
    """key, n, first: groups of two and more rows with the same key. Keys are compared whole, so none collide."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first")).filter("n > 1")


def relative_location(instances: DataFrame, group: str = "group_id", file: str = "file", method: str = "method") -> DataFrame:
    """Whether a group lies in one method, one file, or several files."""
    f, m = F.count_distinct(file), F.count_distinct(F.struct(file, method))
    return instances.groupBy(group).agg(F.when(m == 1, "same method").when(f == 1, "same file").otherwise("different files").alias("location"))


def sub_instances(instances: DataFrame, bin_width: int | None = None) -> DataFrame:
    """Pairs of instances of different groups (group_id, instance_id, file, start, end), the first inside the second."""
    return contained(instances, instances, ["file"], bin_width=bin_width).filter("i_group_id <> o_group_id")


def sub_groups(instances: DataFrame, bin_width: int | None = None) -> DataFrame:
    """group_id, parent: every instance of the group lies in some instance of the parent; first_parent marks the least one.

    Groups with the same intervals are one group here, its least id.
    """
    shape = instances.groupBy("group_id").agg(F.array_sort(F.collect_set(F.struct("file", "start", "end"))).alias("shape"), F.count(F.lit(1)).alias("size"))
    least = shape.groupBy("shape").agg(F.min("group_id").alias("group_id"), F.first("size").alias("size")).drop("shape")
    rows = instances.join(least.select("group_id"), "group_id", "left_semi")
    met = sub_instances(rows, bin_width).groupBy(F.col("i_group_id").alias("group_id"), F.col("o_group_id").alias("parent")).agg(F.count_distinct("i_instance_id").alias("met"))
    out = met.join(least, "group_id").filter("met = size").select("group_id", "parent")
    return out.withColumn("first_parent", F.min("parent").over(W.partitionBy("group_id")) == F.col("parent"))


def similar_sets(rows: DataFrame, key: str, element: str, similarity: float, within: list[str] | None = None) -> DataFrame:
    """a, b, common, distance of keys whose sets of elements (a row each) are at least so similar. Each candidate pair carries both
    sets; where these are long, as words of texts are, similar_arrays takes less."""
    by = within or []
    sets = rows.select(*by, key, element).dropna().groupBy(*by, key).agg(F.collect_set(element).alias("s"))
    return similar_arrays(sets, key, "s", similarity, by, grouped=False)


#: Places that elements are counted in (for their order alone), bits of a filter of keys, keys of a side that are compared together.
SLOTS, FILTER_BITS, SIDE = 1 << 22, 1 << 22, 512


def similar_arrays(sets: DataFrame, key: str, elements: str, similarity: float, within: list[str] | None = None, marks: DataFrame | None = None, grouped: bool = True) -> DataFrame:
    """a, b, common, distance of keys whose sets of elements (an array; a key's arrays together) are at least so similar.

    With marks (within, key, mark; any number of rows for a key) also mark_a and mark_b, a row for each pair of them.

    Equal sets are one set, named by its least key, until the end. Elements are put in one order, rare ones first; two sets with
    Jaccard similarity s must share one of their first n - ceil(s n) + 1 elements, so only those are joined, and what follows the
    first that they share must be able to make up s. Pairs whose sketches differ too much leave. Here elements are hashes: equal ones
    can only bring more candidates.
    Candidates are then compared by the elements themselves, if grouped in groups of neighbours, so that a set is sent once for a
    group and not for each pair. Whole sets are read from the source again, never kept as a table.
    """
    by = within or []
    whole = (F.array_compact(elements) if sets.schema[elements].dataType.containsNull else F.col(elements)).cast("array<string>")
    rows = sets.select(*by, F.col(key).alias("k"), whole.alias("s")).dropna(subset=[*by, "k"])
    many = settled(rows.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(*by, "k"))
    if not many.isEmpty():
        together = rows.join(many, [*by, "k"], "left_semi").groupBy(*by, "k").agg(F.flatten(F.collect_list("s")).alias("s"))
        rows = rows.join(many, [*by, "k"], "left_anti").select(*by, "k", "s").unionByName(together)
    rows = rows.withColumn("s", F.sort_array(F.array_distinct("s")))
    shape = rows.schema
    keys = StructType([shape[c] for c in [*by, "k"]])
    hashed = F.transform("s", lambda e: F.xxhash64(e)).alias("h")

    first = settled(_first_elements(rows.select(*by, "k", "s", hashed), keys, similarity, _commonness(sets.select(F.transform(elements, lambda e: F.xxhash64(e.cast("string"))).alias("h")))))
    reps = first.groupBy(*by, "digest").agg(F.min("k").alias("rep"))
    named = settled(first.select(*by, "k", "n", "digest").join(reps, [*by, "digest"]).select(*by, "k", "n", "rep"))
    prefix = first.join(named.filter("k = rep").select(*by, "k"), [*by, "k"], "left_semi").select(*by, F.col("k").alias("x"), F.col("n").alias("nx"), F.posexplode("prefix").alias("rx", "e"))
    other = prefix.select(*by, "e", F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("rx").alias("ry"))
    sized = (F.col("nx") >= similarity * F.col("ny") - 1e-9) & (F.col("ny") >= similarity * F.col("nx") - 1e-9)
    enough = F.least(F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry")) >= similarity / (1 + similarity) * (F.col("nx") + F.col("ny")) - 1e-9
    met = prefix.join(other, [*by, "e"]).filter((F.col("x") < F.col("y")) & sized & enough).select(*by, "x", "y", "nx", "ny").distinct()
    met = settled(_not_far(met, first.select(*by, "k", "sketch"), by, similarity))
    alike = (_common_elements(met, rows, by, keys) if grouped else _common_arrays(met, rows, by)).filter(F.col("common") / (F.col("nx") + F.col("ny") - F.col("common")) >= similarity - 1e-9)

    several = named.filter("k <> rep").select(*by, F.col("rep").alias("k")).distinct()
    equal = named.join(several, [*by, "k"], "left_semi").select(*by, F.col("k").alias("x"), F.col("k").alias("y"), F.col("n").alias("nx"), F.col("n").alias("ny"), F.col("n").alias("common"))
    names, said = named.select(*by, "k", "rep"), []
    if marks is not None:
        names, said = names.join(marks.select(*by, F.col(key).alias("k"), "mark"), [*by, "k"]), ["mark"]
    member = lambda c, k: names.select(*by, F.col("rep").alias(c), F.col("k").alias(k), *(F.col(m).alias(f"{m}_{k}") for m in said))
    pairs = alike.unionByName(equal).join(member("x", "p"), [*by, "x"]).join(member("y", "q"), [*by, "y"]).filter("x <> y OR p < q")
    sim = F.col("common") / (F.col("nx") + F.col("ny") - F.col("common"))
    of = [F.when(F.col("p") < F.col("q"), F.col(f"{m}_{one}")).otherwise(F.col(f"{m}_{two}")).alias(f"{m}_{c}") for m in said for c, one, two in (("a", "p", "q"), ("b", "q", "p"))]
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "common", (1 - sim).alias("distance"), *of)


def _commonness(hashes: DataFrame) -> np.ndarray:
    """How often elements occur, for each of SLOTS places that their hashes (h: arrays) fall to, as eighths of its logarithm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False) & (SLOTS - 1), minlength=SLOTS)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            some = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["at", "c"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(c).to_numpy(zero_copy_only=False).astype(t).tobytes()], pa.binary()) for c, t in (("at", np.int32), ("level", np.uint8))], names=["at", "level"])

    counts = hashes.mapInArrow(run, "at int, c long").groupBy("at").agg(F.sum("c").alias("c")).select("at", F.floor(8 * F.log2("c")).cast("int").alias("level"))
    level = np.zeros(SLOTS, np.uint8)
    for r in counts.mapInArrow(pack, "at binary, level binary").collect():
        level[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["level"], np.uint8)
    return level


def _first_elements(rows: DataFrame, keys: StructType, similarity: float, level: np.ndarray) -> DataFrame:
    """keys, n, digest (of the elements themselves), sketch, prefix (the first hashes, of the least common elements) of rows (keys, s, h).

    A sketch has about a bit for each element, which every element that falls to it turns over; two sketches differ in no more bits
    than their sets in elements. The number of its bits is a power of two, so the longer of two can be folded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                b = b.filter(pc.greater(pc.list_value_length(b.column("h")), 0))
                s, h = b.column("s"), b.column("h")
                n = pc.list_value_length(h).to_numpy(zero_copy_only=False).astype(np.int64)
                h, row = h.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
                wide = 2 ** np.maximum(6, np.ceil(np.log2(n))).astype(np.int64)
                ends = np.cumsum(wide)
                bits = np.bincount((ends - wide)[row] + (h & (wide - 1)[row]), minlength=int(wide.sum())) & 1
                bits = np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()
                sketch = [bits[e - w : e] for e, w in zip((ends // 8).tolist(), (wide // 8).tolist(), strict=True)]
                h = h[np.lexsort((h, row * 256 + level[h & (SLOTS - 1)]))]
                size = n - np.ceil(n * similarity - 1e-9).astype(np.int64) + 1
                begin = np.cumsum(n) - n
                kept = np.arange(len(h)) - np.repeat(begin, n) < np.repeat(size, n)
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(h[kept]))
                digest = [hashlib.sha256(p).digest() for p in _packed(s)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys.names), pa.array(n), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary()), prefix], names=[*keys.names, "n", "digest", "sketch", "prefix"])

    return rows.mapInArrow(run, StructType([*keys, StructField("n", LongType()), StructField("digest", BinaryType()), StructField("sketch", BinaryType()), StructField("prefix", ArrayType(LongType()))]))


def _not_far(met: DataFrame, sketches: DataFrame, by: list[str], similarity: float) -> DataFrame:
    """met (by, x, y, nx, ny) without the pairs whose sketches (by, k, sketch) differ in more bits than alike sets do in elements."""
    of = lambda c: sketches.select(*by, F.col("k").alias(c), F.col("sketch").alias(f"s{c}"))

    columns = met.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for nx, ny, one, two in zip(*(b.column(c).to_pylist() for c in ("nx", "ny", "sx", "sy")), strict=True):
                one, two = sorted((one, two), key=len)
                x, y, bits = int.from_bytes(one, "little"), int.from_bytes(two, "little"), 8 * len(two)
                while bits > 8 * len(one):
                    bits //= 2
                    y = (y >> bits) ^ (y & ((1 << bits) - 1))
                near.append((x ^ y).bit_count() <= (nx + ny) * (1 - similarity) / (1 + similarity) + 1e-9)
            yield b.filter(pa.array(near, pa.bool_())).select(columns)

    return met.join(of("x"), [*by, "x"]).join(of("y"), [*by, "y"]).select(*met.columns, "sx", "sy").mapInArrow(run, met.schema)


def _packed(arrays: pa.Array) -> Iterator[bytes]:
    """Each array of strings as one string of bytes: their number, their lengths, and their bytes one after another."""
    texts = arrays.flatten()
    texts = texts.cast(pa.string()) if pa.types.is_large_string(texts.type) else texts
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2]) if texts.buffers()[2] is not None else memoryview(b"")
    at = 0
    for n in pc.list_value_length(arrays).to_pylist():
        lengths = np.diff(ends[at : at + n + 1])
        yield np.int32(n).tobytes() + lengths.tobytes() + bytes(data[ends[at] : ends[at + n]])
        at += n


def _unpacked(packed: bytes) -> set[bytes]:
    n = int(np.frombuffer(packed, np.int32, 1)[0])
    ends = np.cumsum(np.frombuffer(packed, np.int32, n, 4)).tolist()
    begin = 4 + 4 * n
    return {packed[begin + s : begin + e] for s, e in zip([0, *ends], ends, strict=False)}


def _common_arrays(met: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    side = lambda c: rows.select(*by, F.col("k").alias(c), F.col("s").alias(f"s{c}"))
    both = met.join(side("x"), [*by, "x"]).join(side("y"), [*by, "y"])
    return both.select(*by, "x", "y", "nx", "ny", F.size(F.array_intersect("sx", "sy")).cast("long").alias("common"))


def _common_elements(met: DataFrame, rows: DataFrame, by: list[str], keys: StructType) -> DataFrame:
    """met (by, x, y, nx, ny) with `common`, the number of elements that both sets (rows: by, k, s) have.

    A key's least neighbour names its group. A pair of groups with more than SIDE keys on a side is cut into parts of so many.
    """
    ends = met.select(*by, F.col("x").alias("k"), F.col("y").alias("o")).unionByName(met.select(*by, F.col("y").alias("k"), F.col("x").alias("o")))
    label = settled(ends.groupBy(*by, "k").agg(F.min("o").alias("o")).select(*by, "k", F.least("k", "o").alias("label")))
    named = lambda c: label.select(*by, F.col("k").alias(c), F.col("label").alias(f"l{c}"))
    pairs = settled(met.join(named("x"), [*by, "x"]).join(named("y"), [*by, "y"]))
    group = [*by, "lx", "ly"]
    large = pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > SIDE).select(*group)
    # Settled, so that a large group's rows can be dealt to several tasks when they meet its sizes.
    sizes = settled(pairs.join(large, group, "left_semi").groupBy(*group).agg(*(F.ceil(F.count_distinct(c) / SIDE).alias(f"m{c}") for c in ("x", "y"))))
    part = lambda c: F.pmod(F.xxhash64(c), F.coalesce(f"m{c}", F.lit(1))).alias(f"i{c}")
    pairs = settled(pairs.join(sizes, group, "left").select(*group, part("x"), part("y"), "x", "y", "nx", "ny"))
    group = [*group, "ix", "iy"]

    # Sets that are in no candidate aren't sent: their keys miss a filter of fixed size.
    bit = F.pmod(F.xxhash64(*by, "k"), F.lit(FILTER_BITS))
    words = label.select(bit.alias("b")).groupBy(F.expr("b div 32").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 32 AS INT))")).alias("m")).collect()
    bits = np.zeros(FILTER_BITS // 32, np.int64)
    bits[[r["w"] for r in words]] = [r["m"] for r in words]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.column("bit").to_numpy(zero_copy_only=False)
            some = whole.filter(pc.and_(pa.array((bits[at // 32] >> (at % 32)) & 1 == 1), pc.greater(pc.list_value_length(whole.column("s")), 0)))
            for k in range(0, some.num_rows, 1000):
                b = some.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys.names), pa.array([zlib.compress(p, 1) for p in _packed(b.column("s"))], pa.binary())], names=[*keys.names, "packed"])

    packed = rows.select(*by, "k", "s", bit.alias("bit")).mapInArrow(pack, StructType([*keys, StructField("packed", BinaryType())]))
    held = pairs.select(*group, F.col("x").alias("k")).unionByName(pairs.select(*group, F.col("y").alias("k"))).distinct().join(packed.hint("merge"), [*by, "k"])
    kind = keys["k"].dataType
    one = held.select(*group, F.col("k").alias("x"), F.lit(None).cast(kind).alias("y"), F.lit(0).cast("long").alias("nx"), F.lit(0).cast("long").alias("ny"), "packed")
    two = pairs.select(*group, "x", "y", "nx", "ny", F.lit(None).cast("binary").alias("packed"))
    out = [*by, "x", "y", "nx", "ny", "common"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known = None, {}
        for b in batches:
            cols = [b.column(c).to_pylist() for c in (*group, "x", "y", "packed")]
            kept, common = [], []
            for i, (*g, x, y, p) in enumerate(zip(*cols, strict=True)):
                if g != here:
                    here, known = g, {}
                if p is not None:
                    known[x] = _unpacked(zlib.decompress(p))
                else:
                    kept.append(i)
                    common.append(len(known[x] & known[y]))
            some = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in out[:-1]), pa.array(common, pa.int64())], names=out)

    dealt = one.unionByName(two).repartition(*group).sortWithinPartitions(*group, F.col("packed").isNull())
    return dealt.mapInArrow(count, StructType([*(met.schema[c] for c in out[:-1]), StructField("common", LongType())]))


def clone_type(gaps: Column, differences: Column, kinds_beyond_names: Column) -> Column:
    """1: no difference; 2: differing names, literals or types alone; 3: gaps or other differences; null counts give unknown."""
    return F.when(gaps.isNull() | differences.isNull(), "unknown").when((gaps > 0) | (kinds_beyond_names > 0), "type 3").when(differences > 0, "type 2").otherwise("type 1")


#: Where the common code of two fragments can go.
OUTCOMES = (
    "EXTRACT_LOCAL_METHOD", "PULL_UP_TO_EXISTING_SUPERCLASS", "PULL_UP_TO_NEW_INTERMEDIATE_SUPERCLASS_EXTENDING_COMMON_INTERNAL_SUPERCLASS",
    "PULL_UP_TO_NEW_INTERMEDIATE_SUPERCLASS_IMPLEMENTING_COMMON_INTERNAL_INTERFACE", "PULL_UP_TO_NEW_SUPERCLASS_EXTENDING_COMMON_EXTERNAL_SUPERCLASS",
    "PULL_UP_TO_NEW_SUPERCLASS_IMPLEMENTING_COMMON_EXTERNAL_INTERFACE", "PULL_UP_TO_NEW_SUPERCLASS_EXTENDING_OBJECT", "EXTRACT_STATIC_METHOD_TO_NEW_UTILITY_CLASS", "INFEASIBLE",
)


def refactoring_type(pairs: DataFrame) -> DataFrame:
    """pairs with `outcome`, one of OUTCOMES.

    Columns: class_a, class_b, super_a, super_b (direct superclasses), supertype (common, or null), supertype_kind (class or
    interface), is_internal (the supertype belongs to the system), is_tagging (an interface without members), subtypes (all
    subtypes of the supertype), is_leaf (neither class has subtypes), uses_members (fragments use instance fields or methods),
    signatures_match (all methods they call match), is_static (either method is static), is_mapped (something else than
    predicates without their statements), is_anonymous (either class is). Null flags count as false.
    """
    flag = lambda n: F.coalesce(F.col(n), F.lit(False))
    same = lambda x, y: F.coalesce(F.col(x) == F.col(y), F.lit(False))
    kind, internal = F.col("supertype_kind"), flag("is_internal")
    is_class, is_interface = kind == "class", kind == "interface"
    root = F.col("supertype") == "java.lang.Object"
    below = same("super_a", "supertype") & same("super_b", "supertype")
    rooted = F.coalesce(F.col("super_a") == "java.lang.Object", F.lit(False)) & F.coalesce(F.col("super_b") == "java.lang.Object", F.lit(False))
    alone = ~root & (F.size("subtypes") == 2) & F.array_contains("subtypes", F.col("class_a")) & F.array_contains("subtypes", F.col("class_b")) & flag("is_leaf")
    one_of_both = same("class_a", "supertype") | same("class_b", "supertype")
    pull_up = internal & is_class & (~flag("uses_members") | F.coalesce(alone, F.lit(False)) | one_of_both | ~below)
    utility = ~flag("uses_members") & (is_interface | flag("is_static"))
    stuck = (is_interface & (~rooted | (flag("is_tagging") & ~flag("signatures_match")))) | (is_class & ~below)
    local, existing, inner_class, inner_interface, outer_class, outer_interface, new_root, static, infeasible = (F.lit(o) for o in OUTCOMES)
    outcome = (
        F.when(~flag("is_mapped") | flag("is_anonymous"), infeasible).when(same("class_a", "class_b"), local).when(F.col("supertype").isNull(), infeasible)
        .when(pull_up, existing).when(utility, static).when(stuck, infeasible).when(internal & is_class, inner_class).when(internal & is_interface, inner_interface)
        .when(~internal & is_class & ~root, outer_class).when(~internal & is_interface, outer_interface).otherwise(new_root)
    )
    return pairs.withColumn("outcome", outcome)


def common_supertype(pairs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """a, b, supertype: the ancestor of both (type, ancestor, depth) with the least depths; by name among equals."""
    x, y = (ancestors.select(F.col("type").alias(n), F.col("ancestor").alias("supertype"), F.col("depth").alias(f"d_{n}")) for n in ("a", "b"))
    both = pairs.join(x, "a").join(y, ["b", "supertype"])
    w = W.partitionBy("a", "b").orderBy(F.col("d_a") + F.col("d_b"), "supertype")
    return both.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("a", "b", "supertype")


def best_mapping(states: DataFrame, by: list[str], state: str) -> DataFrame:
    """The best state of each: most pairs mapped, then fewest differences in the stated order, then the least id."""
    order = [F.desc("size"), "distinct_plain_weight", "all_plain_weight", "all_weight", "id_shift", "edit_distance", state]
    return states.withColumn("rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("rn = 1").drop("rn")


def best_match(pairs: DataFrame, left: str, order: list) -> DataFrame:
    """For each left row its first partner in this order."""
    return pairs.withColumn("rn", F.row_number().over(W.partitionBy(left).orderBy(*order))).filter("rn = 1").drop("rn")


def map_graphs(one: list[tuple[int, int, str]], two: list[tuple[int, int, str]], kinds1: dict[int, str], kinds2: dict[int, str], most: int | None = None) -> tuple[list[tuple[int, int]], bool]:
    """A largest common sub-graph of two dependence graphs: pairs of nodes of like kind, grown edge by edge.

    A branch ends where even all nodes of like kind that are left would not make it larger than the best so far. Nodes with the
    same kind and the same neighbours are interchangeable: they are mapped in order alone. With `most` the search ends after so
    many states with the best so far, and False; without it the result is always a largest one.
    """
    out1: dict[tuple[int, str], list[int]] = {}
    out2: dict[tuple[int, str], list[int]] = {}
    for edges, out in ((one, out1), (two, out2)):
        for s, d, k in edges:
            out.setdefault((s, k), []).append(d)
            out.setdefault((d, "<" + k), []).append(s)
    labels = sorted({k for _, k in (*out1, *out2)})

    def before(kinds: dict[int, str], out: dict[tuple[int, str], list[int]]) -> dict[int, set[int]]:
        """For each node the smaller ones that it could be swapped with."""
        alike: dict[tuple, list[int]] = {}
        for n in sorted(kinds):
            alike.setdefault((kinds[n], tuple(tuple(sorted(out.get((n, k), ()))) for k in labels)), []).append(n)
        return {n: set(group[:i]) for group in alike.values() for i, n in enumerate(group)}

    before1, before2 = before(kinds1, out1), before(kinds2, out2)
    total1, total2 = Counter(kinds1.values()), Counter(kinds2.values())

    def most_left(m: frozenset) -> int:
        used = Counter(kinds1[a] for a, _ in m)
        return sum(min(n, total2[k]) - used[k] for k, n in total1.items())

    seeds = sorted((a, b) for a in kinds1 for b in kinds2 if kinds1[a] == kinds2[b])
    best: list[tuple[int, int]] = []
    seen: set[frozenset] = set()
    states = 0
    todo = [frozenset([s]) for s in reversed(seeds)]
    while todo:
        m = todo.pop()
        if m in seen:
            continue
        seen.add(m)
        if len(m) + most_left(m) <= len(best):
            continue
        states += 1
        if most is not None and states > most:
            return best, False
        if len(m) > len(best):
            best = sorted(m)
        left, right = {a for a, _ in m}, {b for _, b in m}
        grown = set()
        for a, b in m:
            for k in labels:
                for x in out1.get((a, k), ()):
                    for y in out2.get((b, k), ()):
                        if x not in left and y not in right and kinds1.get(x) == kinds2.get(y) and before1[x] <= left and before2[y] <= right:
                            grown.add((x, y))
        # Extensions that exclude no other are taken together.
        free = [p for p in grown if not any(p != q and (p[0] == q[0] or p[1] == q[1]) for q in grown)]
        if free:
            todo.append(m | frozenset(free))
        else:
            todo.extend(m | {p} for p in sorted(grown, reverse=True))
    return best, True


def mapped_pairs(pairs: DataFrame, most: int | None = None, parts: int = 1) -> DataFrame:
    """pairs (pair, nodes1, edges1, nodes2, edges2) -> pair, mapping, complete. nodes: (id, kind); edges: (src, dst, dep).

    Pairs of equal graphs have one mapping: they are gathered, in so many parts, and each part is searched once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps, whole = [], []
            for n1, e1, n2, e2 in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                got, done = map_graphs([(e["src"], e["dst"], e["dep"]) for e in e1], [(e["src"], e["dst"], e["dep"]) for e in e2], {n["id"]: n["kind"] for n in n1}, {n["id"]: n["kind"] for n in n2}, most)
                maps.append([{"a": x, "b": y} for x, y in got])
                whole.append(done)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(maps, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(whole)], names=["same", "mapping", "complete"])

    graphs = ["nodes1", "edges1", "nodes2", "edges2"]
    x = pairs.select(F.struct(F.col("pair").cast("long").alias("pair")).alias("p"), *graphs)
    alike = x.groupBy(*graphs, F.pmod(F.xxhash64("p"), F.lit(parts)).alias("part")).agg(F.collect_list("p").alias("same")).select("same", *graphs)
    found = alike.mapInArrow(run, "same array<struct<pair:long>>, mapping array<struct<a:int,b:int>>, complete boolean")
    return found.select(F.explode("same").alias("p"), "mapping", "complete").select("p.pair", "mapping", "complete")


def without_subsumed(solutions: DataFrame, key: str, elements: str, wide: int = 64) -> DataFrame:
    """Solutions (key, elements: an array) that aren't part of a larger one, nor equal to one with a smaller key.

    A larger one holds the solution's two rarest elements, so solutions meet at that pair, and are then compared as arrays.
    Of a larger one with more than `wide` elements the pairs aren't listed: it is met at the single rarest element.
    Solutions of one element need a look at that element alone. Empty solutions are part of any other.
    """
    sets = solutions.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(elements)).alias("s")).withColumn("n", F.size("s"))
    flat = sets.select("k", "n", F.explode("s").alias("e"))
    df = flat.groupBy("e").agg(F.count(F.lit(1)).alias("df"), F.max("n").alias("most"), F.min(F.when(F.col("n") == 1, F.col("k"))).alias("first"))
    known = flat.join(df, "e")
    single = known.filter("n = 1 AND (most > 1 OR first < k)").select("k")
    two = known.filter("n > 1").groupBy("k").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "e"))), 1, 2)["e"].alias("r"))
    small = sets.filter("n > 1").join(two, "k").select("k", "s", "n", F.array_sort("r").alias("r"), F.col("r")[0].alias("e"))
    larger = sets.select(F.col("k").alias("k2"), F.col("s").alias("s2"), F.col("n").alias("n2"))
    places = F.sequence(F.lit(1), F.col("n2") - 1)
    listed = larger.filter((F.col("n2") > 1) & (F.col("n2") <= wide)).withColumn("i", F.explode(places)).select("k2", "s2", "n2", F.col("s2")[F.col("i") - 1].alias("x"), F.explode(F.slice("s2", F.col("i") + 1, F.col("n2"))).alias("y"))
    by_pair = small.join(listed, (F.col("r")[0] == F.col("x")) & (F.col("r")[1] == F.col("y"))).select("k", "s", "n", "k2", "s2", "n2")
    by_one = small.join(larger.filter(F.col("n2") > wide).withColumn("x", F.explode("s2")), F.col("e") == F.col("x")).select("k", "s", "n", "k2", "s2", "n2")
    before = (F.col("n2") > F.col("n")) | ((F.col("n2") == F.col("n")) & (F.col("k2") < F.col("k")))
    inside = by_pair.unionByName(by_one).filter((F.col("k") != F.col("k2")) & before & (F.size(F.array_except("s", "s2")) == 0)).select("k")
    gone = single.unionByName(inside).distinct().select(F.col("k").alias(key))
    out = solutions.join(gone, key, "left_anti")
    empty = sets.agg(F.max("n").alias("top"), F.min(F.when(F.col("n") == 0, F.col("k"))).alias("least"))
    return out.join(F.broadcast(empty)).filter((F.size(elements) > 0) | ((F.col("top") == 0) & (F.col(key) == F.col("least")))).drop("top", "least")
