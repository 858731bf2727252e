"""Ranked lexical search (operator 12): every item against all documents, as a blocked sparse matrix product.

A first pass turns each text into a row of term counts, for the terms of the items alone, and sums up what the weights need:
documents, terms in all, documents of each term. The second pass takes documents in blocks. Within a block the counts become
a term-document matrix of int64 impacts; an item is a row of term multiplicities, and its row of the product is the sum of
the impact rows of its terms, each added to a dense accumulator over the block (Gustavson's row merging). Each block keeps
the best `top` documents of each item, those of a task are merged on the way, and row_number ranks what is left.

Items come in blocks of some BLOCK_BYTES of text; each block makes its own pass, so neither the driver nor a task holds more
items or terms than that. Documents never meet each other, and no term's postings meet in one task.

Terms are maximal runs of bytes that are letters A-Z, a-z, digits, or not ASCII, with A-Z in lower case.

Defined results: a null or empty text, or one without a term, has no score and counts for nothing; every row of the documents
is a document, so repeated rows rank one after another; a null doc_id comes last among equal scores; every row of the items is
an item of its own, even where item_ids repeat or are null; an item without terms, an empty table of items or of documents
gives no rows; other columns aren't read. A text is split as a whole; beyond MOST_BYTES piece by piece at separators.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import P, table, written

BLOCK_BYTES, DOCS, MOST_BYTES, TOP = 16 << 20, 8192, 4 << 20, 10
#: Every ASCII byte but letters and digits is a blank; A-Z are lower case.
FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
#: Weighting: parts a thousand of a term's rarity, and how much of a document's length counts, in parts a hundred.
SCALE, LENGTH = 1000, 75


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    data = text.encode().translate(FOLD)
    at = 0
    while len(data) - at > MOST_BYTES:
        # A term longer than a piece stays whole.
        cut = data.rfind(b" ", at, at + MOST_BYTES)
        cut = cut if cut > at else data.find(b" ", at + MOST_BYTES)
        if cut < 0:
            break
        yield data[at:cut].split()
        at = cut
    yield data[at:].split()


class Items:
    """The rows of a block of items: places in its sorted vocabulary, with multiplicities."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        counts = [Counter(t for part in terms_of(text or "") for t in part) for _, text in rows]
        self.ids = [i for i, _ in rows]
        self.terms = {t: k for k, t in enumerate(sorted(set().union(*counts)))}
        self.rows = [sorted((self.terms[t], n) for t, n in c.items()) for c in counts]


COUNTS = "doc_id long, n long, terms array<int>, tf array<long>"


def term_counts(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n (all terms of the document), terms and tf: the sparse row of each document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = items.terms
        for b in batches:
            ids, ns, terms, tfs, ends = [], [], [], [], [0]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                n, found = 0, Counter()
                for part in terms_of(text.as_py() or ""):
                    n += len(part)
                    for t, tf in Counter(part).items():
                        if (k := place.get(t)) is not None:
                            found[k] += tf
                if n:
                    ids.append(doc)
                    ns.append(n)
                    terms.extend(found)
                    tfs.extend(found.values())
                    ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, COUNTS)


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def relative_lengths(n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """100 for a document of mean length; Python's integers, since the product can pass 64 bits in a large corpus."""
    return np.array([100 - LENGTH + LENGTH * x * n_docs // length for x in n.tolist()], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The int64 impact of a count in a document of a length, before its term's weight; m from `relative_lengths`."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def block_scores(items: Items, starts: np.ndarray, cols: np.ndarray, values: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each item: its number, the columns (documents of the block) it meets, and their scores.

    The term-document matrix is in compressed rows: row t holds cols[starts[t]:starts[t + 1]], each column once.
    """
    total = np.zeros(size, np.int64)
    for i, row in enumerate(items.rows):
        met = []
        for t, times in row:
            a, b = starts[t], starts[t + 1]
            if a < b:
                total[cols[a:b]] += times * values[a:b]
                met.append(cols[a:b])
        if met:
            total_of = np.unique(np.concatenate(met)) if len(met) > 1 else met[0]
            yield i, total_of, total[total_of]
            total[total_of] = 0


def best(top: int, item: np.ndarray, doc: np.ndarray, null: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the first `top` rows of each item: highest score, then doc_id, nulls last."""
    order = np.lexsort((doc, null, -score, item))
    sorted_item = item[order]
    first = np.flatnonzero(np.r_[True, sorted_item[1:] != sorted_item[:-1]]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < top]


def _task_best(batches: Iterator[pa.RecordBatch], items: Items, weight: np.ndarray, n_docs: int, length: int, top: int) -> Iterator[pa.RecordBatch]:
    kept = [np.zeros(0, np.int64)] * 4
    for b in batches:
        for at in range(0, b.num_rows, DOCS):
            part = b.slice(at, DOCS)
            doc = part.column(0)
            null = np.asarray(doc.is_null()).astype(np.int64)
            doc = np.asarray(doc.fill_null(0))
            n, lists = np.asarray(part.column(1)), part.column(2)
            row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
            term, tf = np.asarray(lists.flatten()), np.asarray(part.column(3).flatten())
            value = weight[term] * impacts(tf, relative_lengths(n, n_docs, length)[row])
            order = np.argsort(term, kind="stable")
            starts = np.searchsorted(term[order], np.arange(len(items.terms) + 1))
            found = [kept]
            for i, cols, score in block_scores(items, starts, row[order], value[order], part.num_rows):
                cols, score = cols[score > 0], score[score > 0]
                if len(score) > 4 * top:
                    # All that tie with the last place stay until doc_ids decide.
                    least = np.partition(score, len(score) - top)[len(score) - top]
                    cols, score = cols[score >= least], score[score >= least]
                found.append([np.full(len(cols), i), doc[cols], null[cols], score])
            joined = [np.concatenate(x) for x in zip(*found, strict=True)]
            keep = best(top, *joined)
            kept = [x[keep] for x in joined]
    item, doc, null, score = kept
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=null.astype(bool)), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])


def _block_search(docs: DataFrame, items: Items, top: int) -> DataFrame | None:
    spark = docs.sparkSession
    counts = written(term_counts(docs, items), "counts")
    sums = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, length = sums[0], sums[1]
    if not n_docs or not items.terms:
        return None
    df = np.zeros(len(items.terms), np.int64)
    for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r["t"]] = r["count"]
    weight = weights(n_docs, df)
    held = counts.select("doc_id", "n", "terms", "tf").filter(F.size("terms") > 0)
    some = held.mapInArrow(lambda it: _task_best(it, items, weight, n_docs, length, top), "item int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    schema = f"{P}item int, item_id long"
    names = spark.createDataFrame(list(enumerate(items.ids)), schema)
    return ranked.join(F.broadcast(names), F.col("item") == F.col(f"{P}item")).select("item_id", "rank", "doc_id", "score")


def item_blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[Items]:
    """Items in blocks of at most some `most` bytes; one block is on the driver at a time. An item is never cut."""
    rows = items.select(F.col("item_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64)).first()[0] or 0
    n = max(1, -(-size // most))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        got = [(r["item_id"], r["text"]) for r in (rows if n == 1 else rows.filter(part == k)).collect()]
        if got:
            yield Items(got)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of each item, by falling score and rising doc_id."""
    out = None
    for block in item_blocks(items, most):
        found = _block_search(docs, block, top)
        if found is not None:
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{TERM}') AS terms FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM lengths),
i AS (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM benchmark),
wanted AS (SELECT item, item_id, term, count(*) AS times FROM i GROUP BY ALL),
posting AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) SEMI JOIN wanted USING (term) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM posting GROUP BY term), corpus),
impact AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // length)))) AS v
    FROM posting JOIN weight USING (term) JOIN lengths USING (r), corpus),
scores AS (SELECT item, item_id, doc_id, r, CAST(sum(times * v) AS BIGINT) AS score FROM wanted JOIN impact USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
