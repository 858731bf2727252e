"""Benchmark decontamination (operator 1): passages of documents within a small edit distance of a benchmark item.

The CGK embedding is a random walk over a sequence: at step j it writes the symbol it stands on and moves on by a random
bit of (j, symbol). Sequences at a small edit distance get walks that soon meet again, so the embeddings are at a small
Hamming distance, for which sampling of positions is a locality-sensitive hash. Here symbols are words. Items fall in size
classes; every item-sized window of a document is hashed in TABLES tables, each with its own walk and SAMPLED positions of it,
and windows that share a key with an item are verified by the exact edit distance of words.

A walk of as many steps as the class's shortest item has words crosses about half of a window, so one half of the tables walk
from a window's first word on and the other half from its last word back: the embedding covers the whole window, needs no
padding, and a window of any size in the class has the same key. Edits that crowd one half leave the other half's walks
alone, so edits spread evenly are the hardest case.

TABLES comes from the target recall: a table misses a window at the limit of similarity with 1 - AGREE, AGREE being the share of
tables in which SAMPLED positions of the walks of a window at the limit, edits spread evenly, agree as measured (0.24), so
TABLES = ln(1 - RECALL) / ln(1 - AGREE), made even.

Two lower bounds of the edit distance spare most windows the walk and lose none: each word that no item has costs an edit,
and so does each rare word (in at most RARE of the items) by which the window has fewer than the item.

Benchmark items are a stated set of queries: they go to all tasks in blocks of at most some BLOCK items. With several blocks,
each makes its own pass over the documents and its hits are written before the next is read, so the driver and the tasks
hold one block at a time.

Items of fewer than LEAST words allow no edit at this similarity: their windows are looked up by a hash and compared word by word.

Words are lower-cased runs without ASCII blanks and punctuation. Defined results: items without a word (null and empty ones
among them) match nothing; those of fewer than LEAST words match equal windows alone, at any similarity, where `shortest` admits them (the query admits
all; the default is LEAST, since a filter by single words would take clean documents); a text shorter than an item is compared as a whole; null and empty texts have no
passages; of the windows near an item the one at the smallest distance, then the first, is reported, once for each
document and item; repeated rows report each for itself; repeated item_ids are items each; an input column with the name of
the output is replaced, others stay; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import P, mix64, multipliers, table, text_of, written

SIMILARITY, RECALL, AGREE, SAMPLED, LEAST, BLOCK = 0.8, 0.985, 0.24, 3, 5, 20_000
TABLES = 2 * math.ceil(math.log(1 - RECALL) / math.log(1 - AGREE) / 2)
#: Sizes in a class are within this factor.
RATIO = 1.2
#: Bytes of random bits that a worker keeps.
KEPT = 32 << 20
#: Words of at most this share of the items are rare; items that need so many of them form classes of their own.
RARE, NEED = 0.03, 2
PIECE = 1 << 20
SPLITS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
BLANKED = bytes.maketrans(SPLITS, b" " * len(SPLITS))


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(BLANKED).split()


def edit_distances(windows: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The Levenshtein distance of each row to the item: row by row of the table, for all windows at once."""
    steps = np.arange(len(item) + 1, dtype=np.int32)
    row = np.broadcast_to(steps, (len(windows), len(steps))).copy()
    for k in range(windows.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = k + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (windows[:, k : k + 1] != item[None, :]))
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[:, -1]


def allowed(n: int, similarity: float) -> int:
    """The most edits at which 1 - distance / n is at least the similarity."""
    return int(math.floor(n * (1 - similarity) + 1e-9))


@dataclass
class Classes:
    """The items of a size class: sizes, the most edits, the rare words needed, and for each table the keys of its items."""

    least: int
    longest: int
    most: int
    rare: int
    items: np.ndarray
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


class Index:
    """LSH tables of a block of items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, tables: int = TABLES, sampled: int = SAMPLED, seed: int = 1, shortest: int = LEAST):
        self.similarity, self.tables, self.sampled, self.seed = similarity, tables, sampled, seed
        every = sorted(((i, w) for i, t in items if len(w := words(t or "")) >= max(1, shortest)), key=lambda x: (len(x[1]), x[1], x[0] is None, x[0]))
        self.vocabulary: dict[bytes, int] = {}
        for _, w in every:
            for x in w:
                self.vocabulary.setdefault(x, len(self.vocabulary) + 1)
        self.short = [self._short([x for x in every if len(x[1]) == n]) for n in range(max(1, shortest), LEAST)]
        texts = [x for x in every if len(x[1]) >= LEAST]
        self.ids = [i for i, _ in texts]
        self.seqs = [np.fromiter((self.vocabulary[x] for x in w), np.int32, len(w)) for _, w in texts]
        sizes = np.asarray([len(s) for s in self.seqs])
        self.gap = allowed(int(sizes[-1]), similarity) + 1 if len(sizes) else 1
        self.symbols = np.arange(len(self.vocabulary) + 1, dtype=np.uint64)
        counts = np.bincount(np.concatenate([*(np.unique(s) for s in self.seqs), [0]]), minlength=len(self.vocabulary) + 1)
        self.is_rare = (counts > 0) & (counts <= max(1, int(RARE * len(self.seqs))))
        needs = np.asarray([int(self.is_rare[s].sum()) - allowed(len(s), similarity) for s in self.seqs])
        self.classes: list[Classes] = []
        at = 0
        while at < len(sizes):
            to = int(np.searchsorted(sizes, int(sizes[at] * RATIO), "right"))
            inside = np.arange(at, to)
            for items in (inside[needs[at:to] >= NEED], inside[needs[at:to] < NEED]):
                if len(items):
                    self._add(items, sizes[items], max(0, int(needs[items].min())))
            at = to

    def _short(self, texts: list[tuple[int, list[bytes]]]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The item_ids, words and keys of items of one small size, in order of key."""
        rows = np.asarray([[self.vocabulary[x] for x in w] for _, w in texts], np.int32)
        key = self._key(rows.T) if len(rows) else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        return [texts[k][0] for k in order], rows[order], key[order]

    @staticmethod
    def _key(columns: list[np.ndarray]) -> np.ndarray:
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
        return key

    def _equal(self, seq: np.ndarray, starts: np.ndarray, base: int, out: list) -> None:
        """The first equal window of each short item in each text. Gaps between texts hold no item's words."""
        for ids, rows, keys in self.short:
            if not ids:
                continue
            n = rows.shape[1]
            key = self._key([seq[k : len(seq) - n + 1 + k] for k in range(n)])
            lo = np.searchsorted(keys, key, "left")
            at = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == key)
            lo = lo[at]
            # Equal items follow one another; each text takes part once for each run of them, by its first window.
            doc = np.searchsorted(starts, at, "right") - 1
            first = np.unique(np.stack([doc, lo]), axis=1, return_index=True)[1]
            at, lo, doc = at[first], lo[first], doc[first]
            for s, item, d, to in zip(at.tolist(), lo.tolist(), doc.tolist(), np.searchsorted(keys, key[at], "right").tolist(), strict=True):
                for k in range(item, to):
                    if (seq[s : s + n] == rows[k]).all():
                        out[base + d].append((ids[k], s - int(starts[d]), n, 0))

    def _add(self, items: np.ndarray, sizes: np.ndarray, rare: int) -> None:
        c = Classes(int(sizes[0]), int(sizes[-1]), allowed(int(sizes[-1]), self.similarity), rare, items)
        end = np.cumsum(sizes)
        for _, key in self._walks(np.concatenate([self.seqs[k] for k in items]), end - sizes, end - 1, c.least):
            order = np.argsort(key, kind="stable")
            c.keys.append((key[order], items[order]))
        self.classes.append(c)

    def _bits(self, t: int, j: int) -> np.ndarray:
        """The random bit of each symbol at step j of the walk of table t; tables of bits are kept while they are small."""
        kept = self.__dict__.setdefault("_kept", {})
        if (t, j) in kept:
            return kept[t, j]
        mult, add = multipliers(self.seed * 1000 + t, 1024)
        turn = j // 1024 + 1
        bits = (mix64(self.symbols * mult[j % 1024] + add[j % 1024] * np.uint64(turn)) >> np.uint64(63)).astype(np.uint8)
        if len(kept) * len(bits) < KEPT:
            kept[t, j] = bits
        return bits

    def _walks(self, seq: np.ndarray, first: np.ndarray, last: np.ndarray, steps: int):
        """For each table, whether it walks back, and the keys of the walks from these first or last words of windows."""
        for t in range(self.tables):
            back = t % 2 == 1
            taken = set(np.random.Generator(np.random.Philox([self.seed, t])).permutation(steps)[: self.sampled].tolist())
            at = (last if back else first).copy()
            key = np.full(len(at), t + 1, np.uint64)
            for j in range(max(taken) + 1):
                symbol = seq.take(at)
                if j in taken:
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + symbol.astype(np.uint64) + np.uint64(j) * np.uint64(1 << 40))
                if back:
                    at -= self._bits(t, j).take(symbol)
                else:
                    at += self._bits(t, j).take(symbol)
            yield back, key

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}

    def hits(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """For each text, (item_id, first word, words, distance) of the passages near an item."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        if not self.vocabulary:
            return out
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < PIECE):
                size += len(texts[to])
                to += 1
            self._piece(texts[at:to], at, out)
            at = to
        return out

    def _piece(self, texts: list[str], base: int, out: list) -> None:
        get, parts, starts, pos = self.vocabulary.get, [np.zeros(self.gap, np.int32)], [], self.gap
        gap = np.zeros(self.gap, np.int32)
        for t in texts:
            w = words(t)
            starts.append(pos)
            parts += [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)), gap]
            pos += len(w) + self.gap
        seq = np.concatenate([*parts, np.zeros(len(self.seqs[-1]) + 1 if self.seqs else 1, np.int32)])
        starts = np.asarray(starts)
        self._equal(seq, starts, base, out)
        foreign = np.concatenate([[0], np.cumsum(seq == 0, dtype=np.int32)])
        rare = np.concatenate([[0], np.cumsum(self.is_rare[seq], dtype=np.int32)])
        found: set[tuple[int, int]] = set()
        sizes = np.asarray([len(x) for x in self.seqs])
        for c in self.classes:
            # Windows by their first words, and by the words behind their last.
            near = foreign[c.least : pos + c.least] - foreign[:pos] <= c.most
            back = foreign[c.least : pos + 1] - foreign[: max(0, pos + 1 - c.least)] <= c.most
            if c.rare:
                near &= rare[c.longest : pos + c.longest] - rare[:pos] >= c.rare
                back &= rare[c.least : pos + 1] - rare[np.maximum(np.arange(c.least, pos + 1) - c.longest, 0)] >= c.rare
            first, last = np.flatnonzero(near), np.flatnonzero(back) + c.least - 1
            if not len(first) and not len(last):
                continue
            for (keys, items), (backward, key) in zip(c.keys, self._walks(seq, first, last, c.least), strict=True):
                lo = np.searchsorted(keys, key, "left")
                rows = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == key)
                lo = lo[rows]
                n = np.searchsorted(keys, key[rows], "right") - lo
                which = items[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                start = np.repeat(last[rows], n) + 1 - sizes[which] if backward else np.repeat(first[rows], n)
                found.update((s, i) for s, i in zip(start.tolist(), which.tolist(), strict=True) if s >= 0)
        if found:
            self._verify(seq, starts, np.asarray(sorted(found, key=lambda x: (x[1], x[0]))), base, out)

    def _verify(self, seq: np.ndarray, starts: np.ndarray, found: np.ndarray, base: int, out: list) -> None:
        """Exact distances of the windows found and of those that start a few words away."""
        cuts = np.flatnonzero(np.diff(found[:, 1])) + 1
        for group in np.split(found, cuts):
            item = int(group[0, 1])
            target, n = self.seqs[item], len(self.seqs[item])
            most = allowed(n, self.similarity)
            best: dict[int, tuple[int, int]] = {}
            at = group[:, 0]
            equal = at[(seq[at[:, None] + np.arange(n)[None, :]] == target[None, :]).all(1)]
            for s, doc in zip(equal.tolist(), (np.searchsorted(starts, equal, "right") - 1).tolist(), strict=True):
                best.setdefault(doc, (0, s - int(starts[doc])))
            # A text without an equal window may have a nearer one a few words from those that pass.
            left = at[~np.isin(self._owner(at, n, starts), np.fromiter(best, np.int64, len(best)))]
            passed = self._near(seq, left, target, most)[0]
            near = np.unique((passed[:, None] + np.arange(-most, most + 1)[None, :]).ravel())
            near = near[(near >= starts[0] - self.gap) & (near + n <= len(seq))]
            p, d = self._near(seq, near, target, most)
            for s, x, doc in zip(p.tolist(), d.tolist(), self._owner(p, n, starts).tolist(), strict=True):
                best[doc] = min(best.get(doc, (most + 1, 0)), (x, max(0, s - int(starts[doc]))))
            for doc, (d, s) in best.items():
                out[base + doc].append((self.ids[item], s, n, d))

    @staticmethod
    def _near(seq: np.ndarray, at: np.ndarray, target: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows at these positions that are within so many edits, and their distances."""
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        for k in range(0, len(at), 8192):
            p = at[k : k + 8192]
            windows = seq[p[:, None] + np.arange(len(target))[None, :]]
            few = (windows == 0).sum(1) <= most
            p, d = p[few], edit_distances(windows[few], target)
            kept.append((p[d <= most], d[d <= most]))
        return tuple(np.concatenate(x) for x in zip(*kept, strict=True))

    @staticmethod
    def _owner(at: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
        """The text of a window: the next one if it starts in the gap before that."""
        doc = np.maximum(np.searchsorted(starts, at, "right") - 1, 0)
        after = np.append(starts, np.iinfo(np.int64).max)[doc + 1]
        return doc + (at + n > after)


PASSAGE = StructType([StructField("item_id", LongType()), StructField("start", IntegerType()), StructField("n_words", IntegerType()), StructField("distance", IntegerType())])


def passages(text: Column, index: Index) -> Column:
    """The passages of the whole text that are near an item of the index: array of item_id, start, n_words, distance."""

    @F.arrow_udf(ArrayType(PASSAGE))
    def found(t: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("distance", pa.int32())]))
        hits = index.hits([x or "" for x in t.to_pylist()])
        names = ("item_id", "start", "n_words", "distance")
        return pa.array([[dict(zip(names, h, strict=True)) for h in sorted(hs, key=lambda x: (x[0] is None, x[0], x[1]))] for hs in hits], kind)

    return found(text)


def indexes(benchmark: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, shortest: int = LEAST) -> Iterator[Index]:
    """An index for each block of at most some `block` items; one block is on the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    n = max(1, -(-items.count() // block))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        yield Index([(r["item_id"], r["text"]) for r in items.filter(part == k).collect()], similarity, shortest=shortest)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, out: str = "passages", block: int = BLOCK, shortest: int = LEAST) -> DataFrame:
    """docs with the passages of each text that are near a benchmark item of at least `shortest` words."""
    # One text's passages serve all its copies, so blocks meet by a digest that tells any two texts apart.
    th, found, single = F.sha2(text_of(), 256), [], None
    for index in indexes(benchmark, similarity, block, shortest):
        if single is None:
            single = index
            continue
        if not found:
            found.append(_hits(docs, th, single))
        found.append(_hits(docs, th, index))
    if not found:
        return docs.withColumn(out, passages(text_of(), single))
    hits = reduce(DataFrame.unionByName, found).groupBy(f"{P}t").agg(F.flatten(F.collect_list(f"{P}p")).alias(f"{P}p"))
    joined = docs.withColumn(f"{P}h", th).join(hits, F.col(f"{P}h") == F.col(f"{P}t"), "left")
    return joined.withColumn(out, F.coalesce(f"{P}p", F.array().cast(ArrayType(PASSAGE)))).drop(f"{P}h", f"{P}t", f"{P}p")


def _hits(docs: DataFrame, th: Column, index: Index) -> DataFrame:
    """The digest and the passages of each text that has some, written."""
    one = docs.select(th.alias(f"{P}t"), passages(text_of(), index).alias(f"{P}p")).filter(F.size(f"{P}p") > 0)
    return written(one.dropDuplicates([f"{P}t"]), "hits")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contaminated(docs, table(spark, sf_dir, "benchmark"), shortest=1)
    return out.select("doc_id", F.explode("passages").alias("p")).select("doc_id", "p.item_id", F.col("p.start").alias("start_word"), "p.n_words", "p.distance")
