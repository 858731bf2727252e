"""N-gram Jaccard join (operator 4): MinHash LSH forest over 5-word shingles, then exact verification.

1. Texts with the same words are copies; one stands for all, and counts for as many links.
2. Each distinct text gets a signature of DEPTH minima in each of TREES trees, of 16 bits each, and four bits of every minimum
   as a sketch.
3. Each tree's signatures are range-partitioned and sorted, which is its trie in order: texts that share a prefix are side by
   side. The least prefix is `prefix_length`: at that length the chance that a pair at the limit of similarity shares one of
   TREES prefixes, 1 - (1 - s^k)^TREES, reaches the target recall. Within a run of texts that share it, prefixes are
   shortened from DEPTH as far as a text needs: it is tied to the first text of the shortest prefix to which its sketch is
   near; those that are near no first text are compared with all others of the run. Two sketches are near unless they differ
   more than those of a pair at the limit do in one of a million cases (`least_agreeing`).
4. The components of these ties are the units of verification; boilerplate that merely shares prefixes doesn't tie. A large
   component is dealt into blocks; a text goes to those blocks that hold a text with a prefix of its own, so a chain of
   texts costs work in proportion to its length. Intersections are counted exactly by shingle within a pair of blocks: bounded
   memory, none emitted; only a text's number of links and one link to hold it come out.
5. The components of the verified links are the classes.

A run of more than MOST_RUN texts, or one that may go on in another partition, is tied to its first text without a look at
sketches, and ends of partitions are tied by one row each: that may add candidates, never lose one.

Two texts are linked if the Jaccard similarity of their sets of shingles is at least 0.8. A text of 1 to 4 words is one
shingle. Defined results: null and empty texts and those without words have no links and are their own class; null doc_ids
belong to classes, whose id is the least doc_id that isn't null; repeated rows and ties are copies; columns beside doc_id and
text aren't looked at, so their names can't clash; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import P, mix64, multipliers, partitions, table, text_of, written
from .components import components
from .shingles import fingerprints, pieces, shingle_hashes, word_hashes

SIMILARITY, RECALL, TREES, DEPTH = 0.8, 0.99, 10, 8
#: A block of a component holds some so many texts and shingles.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 750_000
MOST_RUN = 1 << 16
#: Copies of a prefix's list of blocks, so that no task meets all texts of a hot prefix.
SALT = 16


def prefix_length(similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """The longest prefix that reaches the recall."""
    for k in range(DEPTH, 1, -1):
        if 1 - (1 - similarity**k) ** TREES >= recall:
            return k
    return 1


def least_agreeing(similarity: float = SIMILARITY) -> int:
    """The agreeing fields of two sketches that a pair at the limit of similarity falls below once in a million times."""
    n, p = TREES * DEPTH, similarity + (1 - similarity) / 16
    below, term = 0.0, (1 - p) ** n
    for k in range(n + 1):
        below += term
        if below > 1e-6:
            return k
        term *= (n - k) / (k + 1) * p / (1 - p) if p < 1 else 0.0
    return n


def signatures(shingles: np.ndarray, bounds: np.ndarray, seed: int = 4) -> np.ndarray:
    """(texts with a shingle, TREES, DEPTH): each minimum, mixed to 64 bits."""
    mult, add = multipliers(seed, TREES * DEPTH)
    out = np.zeros((len(bounds), TREES * DEPTH), np.uint64)
    work = np.empty_like(shingles)
    for j in range(TREES * DEPTH):
        np.multiply(shingles, mult[j], out=work)
        work += add[j]
        work >>= np.uint64(20)  # the low bits of a product are the weak ones
        out[:, j] = np.minimum.reduceat(work, bounds)
    return mix64(out).reshape(-1, TREES, DEPTH)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(2).to_pylist()
        for at, to in pieces(texts):
            words, bounds = word_hashes(texts[at:to])
            s, sb = shingle_hashes(words, bounds)
            prints = fingerprints(words, bounds)
            some = np.flatnonzero(np.diff(sb))
            has = np.zeros(to - at, bool)
            has[some] = True
            sig, sketch = np.zeros((to - at, 2 * TREES * DEPTH), np.uint8), np.zeros((to - at, TREES * DEPTH // 2), np.uint8)
            if len(some):
                m = signatures(s, sb[:-1][some]).reshape(len(some), -1)
                sig[some] = (m >> np.uint64(48)).astype(">u2").view(np.uint8).reshape(len(some), -1)
                low = (m & np.uint64(15)).astype(np.uint8)
                sketch[some] = low[:, ::2] << 4 | low[:, 1::2]
            binary = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(at, to - at), b.column(1).slice(at, to - at), binary(prints), pa.array(np.diff(sb).astype(np.int64)), binary(sig), binary(sketch), pa.array(has)],
                names=["doc", "th", "fp", "n", "sig", "sketch", "has"],
            )


SIGNED = "doc long, th long, fp binary, n long, sig binary, sketch binary, has boolean"


def agreeing(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The number of fields (four bits each) in which rows of packed sketches agree."""
    x = one ^ two
    return ((x & 15) == 0).sum(-1) + ((x >> 4) == 0).sum(-1)


def tie_runs(sig: np.ndarray, sketch: np.ndarray, k: int, least: int) -> np.ndarray:
    """For rows sorted by sig (2 bytes a minimum), the row that each is tied to: itself or an earlier one.

    From the shortest prefix, whose first row most are near, to the longest; what is left is compared with the whole run.
    """
    n = len(sig)
    place = np.arange(n)
    tied, left = place.copy(), np.ones(n, bool)
    same = (sig[1:] == sig[:-1]).reshape(n - 1, -1, 2).all(2) if n > 1 else np.zeros((0, sig.shape[1] // 2), bool)
    run = None
    for depth in range(k, same.shape[1] + 1):
        head = np.maximum.accumulate(np.where(np.concatenate([[True], ~same[:, :depth].all(1)]), place, 0))
        run = head if run is None else run
        rows = np.flatnonzero(left & (head < place))
        if not len(rows):
            continue
        near = np.concatenate([np.zeros(0, bool), *(agreeing(sketch[r], sketch[head[r]]) >= least for r in np.array_split(rows, len(rows) // 65536 + 1))])
        tied[rows[near]] = head[rows[near]]
        left[rows[near]] = False
    while True:  # heads may be tied themselves
        far = tied[tied]
        if (far == tied).all():
            break
        tied = far
    roots = np.flatnonzero((tied == place) & (run < place))  # texts of a run that its first text isn't near to
    ends = np.append(np.flatnonzero(np.diff(run)) + 1, n) if n else place
    for start in np.unique(run[roots]).tolist():
        end = int(ends[np.searchsorted(ends, start, "right")])
        label = tied[start:end]
        size = np.bincount(label - start, minlength=end - start)
        size[int(size.argmax())] = 0  # the texts of all components but the largest meet all others
        few = np.flatnonzero(size[label - start] > 0)
        if len(few) * (end - start) > 1 << 24:
            tied[start:end] = start
            continue
        for r in few.tolist():
            near = np.flatnonzero(agreeing(sketch[start:end], sketch[start + r][None, :]) >= least)
            joined = np.unique(label[near])
            label[np.isin(label, joined)] = joined[0]
    return tied


def _ties(batches: Iterator[pa.RecordBatch], k: int, least: int) -> Iterator[pa.RecordBatch]:
    """Rows s (tree, then signature), fp, sketch sorted by s and fp: (0, null, fp, fp that it is tied to); (1, s, first fp) of the
    runs of equal prefixes at the partition's ends."""
    names = ["kind", "k", "a", "b"]
    cut = 1 + 2 * k
    held: list[pa.RecordBatch] = []
    size, opening, hot = 0, True, None  # hot: the prefix and the first fp of a run too long to be held

    def ends(prefix: bytes, fp: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([prefix], pa.binary()), pa.array([fp], pa.binary()), pa.array([None], pa.binary())], names=names)

    def star(fps: pa.Array, first: bytes) -> pa.RecordBatch:
        n = len(fps)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.binary()), fps, pa.array([first] * n, pa.binary())], names=names)

    def tied(b: pa.RecordBatch) -> pa.RecordBatch:
        whole = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
        sketch = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
        # The tree's number takes a byte in front of the minima.
        wide = np.concatenate([np.zeros((len(whole), 1), np.uint8), whole], axis=1)
        to = tie_runs(wide, sketch, k + 1, least)
        rows = np.flatnonzero(to != np.arange(len(to)))
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.binary()), b.column(1).take(pa.array(rows)), b.column(1).take(pa.array(to[rows]))], names=names)

    def together() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        held.append(pa.RecordBatch.from_arrays([c.cast(pa.binary()) for c in b.columns], names=["s", "fp", "sketch"]))
        size += b.num_rows
        b = together()
        s = b.column(0)
        prefix = s[len(s) - 1].as_py()[:cut]
        at = b.num_rows  # where the last run begins
        lo, hi = 0, at
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if s[mid].as_py()[:cut] >= prefix else (mid + 1, hi)
        at = lo
        done = b.slice(0, at)
        if done.num_rows and (opening or hot):
            # The first run may have begun in another partition: a plain star.
            first = s[0].as_py()[:cut]
            lo, hi = 0, at
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if s[mid].as_py()[:cut] <= first else (lo, mid)
            if opening:
                head = b.column(1)[0].as_py()
                yield ends(first, head)
                yield star(b.column(1).slice(1, lo - 1), head)
                opening, done = False, done.slice(lo)
            elif hot and hot[0] == first:
                yield star(b.column(1).slice(0, lo), hot[1])
                done = done.slice(lo)
            hot = None
        if done.num_rows:
            yield tied(done)
        rest = b.slice(at)
        if rest.num_rows > MOST_RUN or (hot and hot[0] == prefix):
            if not hot:
                hot = (prefix, rest.column(1)[0].as_py())
                if opening:
                    yield ends(*hot)
                    opening = False
            yield star(rest.column(1), hot[1])
            rest = rest.slice(rest.num_rows)
        held, size = ([rest] if rest.num_rows else []), rest.num_rows
    if held or hot:
        if held:
            b = together()
            prefix, head = b.column(0)[0].as_py()[:cut], b.column(1)[0].as_py()
            if hot and hot[0] == prefix:
                head = hot[1]
            yield star(b.column(1), head)
        else:
            prefix, head = hot
        yield ends(prefix, head)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, fp, comp, copies, blocks -> fp, comp, copies, blocks, sorted distinct shingles; rows whose text has another fp go."""
    for b in batches:
        texts = b.column(0).to_pylist()
        for at, to in pieces(texts):
            words, bounds = word_hashes(texts[at:to])
            s, sb = shingle_hashes(words, bounds)
            prints = fingerprints(words, bounds)
            keep = [r for r, want in enumerate(b.column(1).slice(at, to - at).to_pylist()) if prints[r].tobytes() == want]
            sets = [np.unique(s[sb[r] : sb[r + 1]]) for r in keep]
            offsets = np.cumsum([0, *(len(x) for x in sets)], dtype=np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(j).slice(at, to - at).take(rows) for j in (1, 2, 3, 4)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["fp", "comp", "copies", "blocks", "s"],
            )


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The exact sizes of the intersections of all pairs of sets.

    Shingles of few sets add to the pairs of their holders; the others are columns of a matrix that is multiplied with
    itself, a slice at a time.
    """
    m = len(sets)
    out = np.zeros((m, m), np.int32)
    if m == 2:
        out[0, 1] = out[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    df = np.bincount(column)
    wide = df[column] > 24
    few = ~wide & (df[column] > 1)
    c, o = column[few], owner[few]
    flat_out = out.ravel()
    for d in range(1, 24):
        if d >= len(c):
            break
        same = c[d:] == c[:-d]
        if not same.any():
            break
        both, count = np.unique(o[:-d][same].astype(np.int64) * m + o[d:][same], return_counts=True)
        flat_out[both] += count.astype(np.int32)
    for lo in range(0, m, 256):  # by tiles: both halves, without a copy of the whole
        for to in range(lo, m, 256):
            upper, lower = out[lo : lo + 256, to : to + 256], out[to : to + 256, lo : lo + 256]
            if lo == to:
                upper += upper.T.copy()
            else:
                lower += upper.T
                upper[:] = lower.T
    c, o = column[wide], owner[wide]
    if len(c):
        c = np.unique(c, return_inverse=True)[1]
        for lo in range(0, int(c[-1]) + 1, 1024):
            part = slice(*np.searchsorted(c, [lo, lo + 1024]))
            x = np.zeros((m, min(1024, int(c[-1]) + 1 - lo)), np.float32)
            x[o[part], c[part] - lo] = 1
            for t in range(0, m, 256):
                out[t : t + 256] += (x[t : t + 256] @ x.T).astype(np.int32)
    return out


def linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The symmetric matrix of pairs whose Jaccard similarity reaches the limit; a set isn't its own partner."""
    both = intersections(sets)
    n = np.asarray([len(s) for s in sets])
    out = np.zeros(both.shape, bool)
    for t in range(0, len(sets), 256):
        part = both[t : t + 256]
        out[t : t + 256] = part >= similarity * (n[t : t + 256, None] + n[None, :] - part) - 1e-9
    np.fill_diagonal(out, False)
    return out


def _hubs(link: np.ndarray) -> np.ndarray:
    """The first member of each text's component."""
    m = len(link)
    label = np.arange(m)
    while True:
        new = label.copy()
        for t in range(0, m, 256):
            new[t : t + 256] = np.minimum(new[t : t + 256], np.where(link[t : t + 256], label[None, :], m).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows comp, lo, hi, own, fp, copies, s sorted by the first three -> fp, links, hub for the texts with links."""
    fps: list[bytes] = []
    key, own, copies, sets = None, [], [], []
    out: list[tuple[bytes, int, bytes]] = []

    def close() -> None:
        if len(sets) < 2:
            return
        link = linked(sets, similarity)
        if key[1] != key[2]:  # two blocks: pairs within one belong to its own task
            side = np.asarray(own) == key[1]
            link &= side[:, None] != side[None, :]
        hub, weight = _hubs(link), np.asarray(copies, np.int64)
        for r in np.flatnonzero(link.any(1)).tolist():
            out.append((fps[r], int(weight[link[r]].sum()), fps[hub[r]]))

    def flush() -> pa.RecordBatch:
        a, n, h = zip(*out, strict=True) if out else ([], [], [])
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(n, pa.int64()), pa.array(h, pa.binary())], names=["fp", "links", "hub"])

    for b in batches:
        lists = b.column(6)
        flat, offsets = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        for r, row in enumerate(zip(*(b.column(j).to_pylist() for j in range(6)), strict=True)):
            if row[:3] != key:
                close()
                key = row[:3]
                fps, own, copies, sets = [], [], [], []
            if fps and row[4] == fps[-1]:
                continue  # a repeated row of the same text
            own.append(row[3])
            fps.append(row[4])
            copies.append(row[5])
            sets.append(flat[offsets[r] : offsets[r + 1]].copy())
        if len(out) > 10_000:
            yield flush()
    close()
    yield flush()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, th (xxhash64 of the text), class_id, n_links, first: a row for each row of docs.

    class_id is the least doc_id of the class; n_links counts the other rows linked to this one; first marks the class's
    first text, by doc_id and th.
    """
    k, least = prefix_length(similarity, recall), least_agreeing(similarity)
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text_of()).alias("th"), text_of().alias("text"))
    signed = written(base.mapInArrow(_signed, SIGNED), "signed")
    texts = written(
        signed.filter("has").groupBy("fp")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "th")).alias("rep"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"), F.any_value("sketch").alias("sketch")),
        "texts",
    )
    # The forest: a tree's number and its minima, as one sortable key.
    trees = [F.concat(F.lit(bytes([t])), F.substring("sig", 1 + 2 * DEPTH * t, 2 * DEPTH)) for t in range(TREES)]
    sorted_ = texts.select(F.explode(F.array(*trees)).alias("s"), "fp", "sketch").repartitionByRange(partitions(docs), "s", "fp").sortWithinPartitions("s", "fp")
    runs = written(sorted_.mapInArrow(lambda it: _ties(it, k, least), "kind int, k binary, a binary, b binary"), "runs")
    ends = runs.filter("kind = 1").select("k", F.col("a").alias("end"))
    ties = ends.join(ends.groupBy("k").agg(F.min("end").alias("first")), "k").filter("end <> first").select(F.col("end").alias("a"), F.col("first").alias("b"))
    candidates = components(runs.filter("kind = 0").select("a", "b").unionByName(ties))
    # Blocks of components, by their texts and shingles.
    members = texts.select("fp", "copies", "n", "rep", "sig").join(candidates.select(F.col("node").alias("fp"), F.col("label").alias("comp")), "fp")
    sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "comp").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # A text of a large component goes to the blocks that hold a text with one of its prefixes.
    prefixes = F.array(*(F.concat(F.lit(bytes([t])), F.substring("sig", 1 + 2 * DEPTH * t, 2 * k)) for t in range(TREES)))
    keyed = written(dealt.filter("blocks > 1").select("comp", "fp", "own", F.explode(prefixes).alias("key")), "keyed")
    held = keyed.select("comp", "key", F.col("own").alias("j")).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    goes = keyed.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int")).join(held, ["comp", "key", "salt"]).filter("own <> j")
    goes = goes.groupBy(F.col("fp").alias("fp3")).agg(F.collect_set("j").alias("others"))
    wanted = dealt.join(goes, F.col("fp") == F.col("fp3"), "left").select(
        F.col("rep.doc").alias("doc2"), F.col("rep.th").alias("th2"), "fp", "comp", "copies", F.struct("own", F.coalesce("others", F.array().cast("array<int>")).alias("others")).alias("blocks")
    )
    same = base["doc"].eqNullSafe(F.col("doc2")) & (base["th"] == F.col("th2"))
    sets = base.join(wanted, same).select("text", "fp", "comp", "copies", "blocks").mapInArrow(_sets, "fp binary, comp binary, copies long, blocks struct<own:int,others:array<int>>, s array<long>")
    pairs = sets.select("fp", "comp", "copies", "s", F.col("blocks.own").alias("own"), F.explode(F.concat(F.array("blocks.own"), F.col("blocks.others"))).alias("j"))
    pairs = pairs.select("comp", F.least("own", "j").alias("lo"), F.greatest("own", "j").alias("hi"), "own", "fp", "copies", "s")
    by = ["comp", "lo", "hi"]
    found = written(pairs.repartition(partitions(docs), *by).sortWithinPartitions(*by, "fp").mapInArrow(lambda it: _verified(it, similarity), "fp binary, links long, hub binary"), "links")
    classes = components(found.select(F.col("fp").alias("a"), F.col("hub").alias("b")))
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    labelled = (
        texts.select("fp", "copies", "rep").join(classes.select(F.col("node").alias("fp"), "label"), "fp", "left").join(links, "fp", "left")
        .select("fp", "rep", F.coalesce("label", "fp").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    )
    least = labelled.groupBy("label").agg(F.min("rep").alias("least"))
    by_text = labelled.join(least, "label").select(F.col("fp").alias("fp2"), "links", "least")
    out = signed.join(by_text, F.col("has") & (F.col("fp") == F.col("fp2")), "left")
    first = F.col("least").isNull() | (F.col("least.doc").eqNullSafe(F.col("doc")) & (F.col("least.th") == F.col("th")))
    return out.select(F.col("doc").alias("doc_id"), "th", F.when(F.col("least").isNull(), F.col("doc")).otherwise(F.col("least.doc")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), first.alias("first"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each class: the first by doc_id; texts without words all stay."""
    others = near_duplicates(docs, similarity).filter(~F.col("first")).select(F.col("doc_id").alias(f"{P}doc"), F.col("th").alias(f"{P}th")).distinct()
    left = docs.withColumn(f"{P}h", F.xxhash64(text_of()))
    return left.join(others, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{P}doc")) & (F.col(f"{P}h") == F.col(f"{P}th")), "left_anti").select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")


#: All links by shared shingles, whatever the forest finds, and classes by following them.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS n FROM w),
v AS (SELECT doc_id, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle FROM u),
s AS (SELECT DISTINCT doc_id, shingle FROM v WHERE pos = 0 OR pos + 5 <= n),
c AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 5 * shared >= 4 * (x.c + y.c - shared)),
r AS (SELECT a, b FROM links UNION SELECT r.a, links.b FROM r JOIN links ON links.a = r.b)
SELECT d.doc_id, least(d.doc_id, coalesce(m.least, d.doc_id)) AS class_id, coalesce(n.n, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) m ON m.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = d.doc_id
"""
