"""Toxicity (operator 8): a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

Features are the distinct character 3- to 5-grams of the lower-cased whole text, hashed to 2^20 buckets. From the labelled
sample, r = ln((p + 1) / (|p| + buckets)) - ln((q + 1) / (|q| + buckets)) is each bucket's log-count ratio, p and q being the
toxic and other texts that hold it. The FEATURES buckets whose counts differ most (by |r| times the root of their count) are
kept, and a logistic regression is fitted on them with the value r where present and 0 elsewhere.

The classifier is fitted on a bounded sample: the SAMPLE rows of each class with the smallest hash of doc_id, weighted back
to the classes' true shares. All else covers every row; texts are scored whole, in pieces of a batch.

Defined results: null and empty texts get the score that the intercept gives; without labels of both classes the score is
the share of toxic labels (0 without any); repeated rows get equal scores; null labels aren't used; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import P, multipliers, table, text_of, written

SIZES = (3, 4, 5)
BUCKETS = 1 << 20
FEATURES = 4096
SAMPLE = 4000
THRESHOLD = 0.3
PIECE = 1 << 18


def hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For pieces of the texts: the first position of each text, and for each n the bucket of the n-gram at each position.

    Each text is followed by as many zeros as keep n-grams of two texts apart.
    """
    gap = "\0" * (SIZES[-1] - 1)
    mult, add = multipliers(8, SIZES[-1])
    mult = (mult >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    c = np.frombuffer("".join(t.lower() + gap for t in texts).encode("utf-32-le"), np.uint32)
    h = np.zeros(len(c), np.uint32)
    for n in range(SIZES[-1]):
        h[: len(c) - n] += c[n:] * mult[n]
        if n + 1 in SIZES:
            x = h + np.uint32(add[n] & np.uint64(0xFFFFFFFF))
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(13)
            yield x & np.uint32(BUCKETS - 1)


def starts(texts: list[str]) -> np.ndarray:
    return np.cumsum([0] + [len(t.lower()) + SIZES[-1] - 1 for t in texts])


def pieces(texts: list[str]) -> Iterator[list[str]]:
    """Whole texts together, PIECE characters or one text at a time."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > PIECE:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def present(texts: list[str], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, feature) pairs; slot maps buckets to features, -1 for none."""
    rows, feats, base = [], [], 0
    for group in pieces(texts):
        at = starts(group)
        found = []
        for x in hashed(group):
            f = slot[x]
            hit = np.flatnonzero(f >= 0)
            found.append((np.searchsorted(at, hit, "right") - 1) * np.int64(len(slot)) + f[hit])
        both = np.unique(np.concatenate(found))
        rows.append(both // len(slot) + base)
        feats.append(both % len(slot))
        base += len(group)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *rows]), np.concatenate([empty, *feats])


@dataclass
class Model:
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    intercept: float = -50.0

    def slot(self) -> np.ndarray:
        if "_slot" not in self.__dict__:
            self._slot = np.full(BUCKETS, -1, np.int32)
            self._slot[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        return self._slot

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_slot"}

    def scores(self, texts: list[str]) -> np.ndarray:
        rows, feats = present(texts, self.slot())
        z = self.intercept + np.bincount(rows, self.weights[feats].astype(np.float64), len(texts)) if len(rows) else np.full(len(texts), self.intercept)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of toxic and other texts that hold each bucket, for this task."""
    df = np.zeros((2, BUCKETS), np.uint32)
    n = [0, 0]
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            df[y, np.unique(np.concatenate(list(hashed([text]))))] += 1
            n[y] += 1
    yield pa.RecordBatch.from_arrays([pa.array([n[0]]), pa.array([n[1]]), pa.array([df.tobytes()], pa.binary())], names=["n0", "n1", "df"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All tasks' counts -> the texts of each class, the buckets kept and their log-count ratios."""
    n, df = np.zeros(2), np.zeros((2, BUCKETS))
    for b in batches:
        for n0, n1, one in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n += (n0, n1)
            df += np.frombuffer(one, np.uint32).reshape(2, BUCKETS)
    if not n.all():
        return
    # As if both classes were equally large; 1 is the prior count.
    p, q = df[1] / n[1] * n.max() + 1, df[0] / n[0] * n.max() + 1
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r -= np.log(q.sum() / p.sum())
    seen = df.sum(0)
    worth = np.where(seen >= 3, np.abs(r) * np.sqrt(seen), 0)
    buckets = np.sort(np.lexsort((np.arange(BUCKETS), -worth))[:FEATURES])
    buckets = buckets[worth[buckets] > 0]
    yield pa.RecordBatch.from_arrays([pa.array([int(n[0])]), pa.array([int(n[1])]), pa.array([buckets.tolist()], pa.list_(pa.int32())), pa.array([r[buckets].tolist()], pa.list_(pa.float64()))], names=["n0", "n1", "buckets", "ratios"])


def _rows(batches: Iterator[pa.RecordBatch], buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
    slot = Model(buckets=buckets).slot()
    for b in batches:
        rows, feats = present(b.column(0).to_pylist(), slot)
        cut = np.searchsorted(rows, np.arange(b.num_rows + 1))
        yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feats, pa.int32()))], names=["y", "id", "feats"])


def _fitted(batches: Iterator[pa.RecordBatch], share: tuple[float, float], ratios: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The features of the whole sample, at most 2 * SAMPLE texts of FEATURES each -> the weights and the intercept."""
    got = sorted((y, i, f) for b in batches for y, i, f in zip(*(c.to_pylist() for c in b.columns), strict=True))
    y = np.asarray([x[0] for x in got], float)
    weights, intercept = fit_logistic([np.asarray(x[2], np.int64) for x in got], y, np.where(y == 1, share[1], share[0]), ratios)
    yield pa.RecordBatch.from_arrays([pa.array([weights.tolist()], pa.list_(pa.float64())), pa.array([intercept])], names=["weights", "intercept"])


def fit_logistic(feats: list[np.ndarray], y: np.ndarray, weight: np.ndarray, scale: np.ndarray, l2: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights of the scaled features, by gradient steps with Adam; the same result for the same rows."""
    lengths = np.asarray([len(f) for f in feats])
    flat = np.concatenate([*feats, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(feats)), lengths)
    x = scale[flat]
    share = float((weight * y).sum() / weight.sum())
    w, b = np.zeros(len(scale)), float(np.log(share / (1 - share)))
    m, v, mb, vb, total = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, weight.sum()
    for k in range(1, rounds + 1):
        z = b + np.bincount(owner, w[flat] * x, len(feats))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / total
        gw, gb = np.bincount(flat, g[owner] * x, len(scale)) + l2 * w / len(scale), g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        step = 0.05 * np.sqrt(1 - 0.999**k) / (1 - 0.9**k)
        w -= step * m / (np.sqrt(v) + 1e-8)
        b -= step * mb / (vb**0.5 + 1e-8)
    return w * scale, b


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 8) -> Model:
    """Fit on rows of labels (doc_id, toxic 0/1): at most `sample` of each class, by the hash of doc_id.

    One task adds up the bucket counts, of fixed size for each of four tasks, and one fits the sample's features; to the
    driver come FEATURES numbers.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        share = min(max(shares.get(1, 0) / max(1, sum(shares.values())), 1e-9), 1 - 1e-9)
        return Model(intercept=float(np.log(share / (1 - share))) if shares else -50.0)
    order = [F.xxhash64(F.col("doc_id"), F.lit(seed)), F.col("doc_id")]
    picked = known.filter("y = 0").orderBy(*order).limit(sample).unionAll(known.filter("y = 1").orderBy(*order).limit(sample))
    picked = F.broadcast(picked.withColumnRenamed("doc_id", f"{P}id"))  # 2 * sample ids at most
    base = docs.select("doc_id", text_of().alias("text"))
    rows = written(base.join(picked, base["doc_id"] == F.col(f"{P}id")).select("text", "y", F.col("doc_id").alias("id")), "sample")
    counts = rows.coalesce(4).mapInArrow(_counts, "n0 long, n1 long, df binary")
    chosen = counts.repartition(1).mapInArrow(_chosen, "n0 long, n1 long, buckets array<int>, ratios array<double>").head()
    if chosen is None:
        return Model()
    buckets, ratios = np.asarray(chosen["buckets"], np.uint32), np.asarray(chosen["ratios"], float)
    share = (shares[0] / chosen["n0"], shares[1] / chosen["n1"])
    featured = rows.mapInArrow(lambda it: _rows(it, buckets), "y int, id long, feats array<int>")
    fitted = featured.repartition(1).mapInArrow(lambda it: _fitted(it, share, ratios), "weights array<double>, intercept double").head()
    return Model(buckets, np.asarray(fitted["weights"], np.float32), fitted["intercept"])


def score(text: Column, model: Model) -> Column:
    """The probability, from 0 to 1, that the whole text is toxic."""

    @F.arrow_udf(DoubleType())
    def scored(t: pa.Array) -> pa.Array:
        return pa.array(model.scores([x or "" for x in t.to_pylist()]), pa.float64())

    return scored(text)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    model = train(docs, labels)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(text_of(), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
