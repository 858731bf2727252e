"""Line deduplication (operator 9).

Lines are hashed to 128 bits, range-partitioned by hash and sorted within each partition by document and position. One
pass streams the runs of equal hashes and emits the occurrences that go; positions travel, texts don't. The result is a
compressed bitmap of kept lines for each document that loses any, which `apply_bitmaps` applies to the texts.

A hash with very many lines spreads over several partitions, since the range also covers the document. The two runs at
the ends of a partition may go on in the next one: they are decided from the sums of at most two rows a partition.

Defined results: a null text is one empty line; an empty key is never dropped; rows that agree in doc_id and text count
as one document and share its bitmap; null doc_ids are documents like others; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import P, partitions, table, text_of, written

BLANK = b" \t\n\x0b\x0c\r"
#: Bitmaps are packed bits, most significant first, compressed by zlib at this level.
LEVEL = 6


def line_key(line: str) -> bytes:
    """The line without blanks at its ends, A-Z in lower case; bytes.lower leaves all but ASCII alone."""
    return line.encode().strip(BLANK).lower()


def pack(keep: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(keep).tobytes(), LEVEL)


def unpack(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def _line_rows(batches: Iterator[pa.RecordBatch], min_chars: int = 1) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests, rows, pos, counts = [], [], [], []
        for r, text in enumerate(b.column(2).to_pylist()):
            lines = text.split("\n")
            counts.append(len(lines))
            for k, line in enumerate(lines):
                key = line_key(line)
                if len(key) >= min_chars and (min_chars == 1 or len(key.decode()) >= min_chars):
                    digests.append(xxhash.xxh3_128_digest(key))
                    rows.append(r)
                    pos.append(k)
        h = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
        at = pa.array(rows, pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[:, 0]), pa.array(h[:, 1]), b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int32()), pa.array(counts, pa.int32()).take(at)],
            names=["h1", "h2", "doc", "th", "pos", "n"],
        )


ROWS = "h1 long, h2 long, doc long, th long, pos int, n int"
#: kind 0: this line goes; 1: it goes if its hash has enough documents over all partitions; 2: the documents (in pos) and
#: the first occurrence of a run at an end of a partition.
DECIDED = "kind int, h1 long, h2 long, doc long, th long, pos int, n int"


def _streamed(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Decide each run of equal hashes in rows sorted by hash, document and position.

    A run with enough documents here has enough anywhere, so its rows go out at once; until then the rows of fewer than
    min_docs documents wait. What is left open is only the first and the last run of the partition.
    """
    out: list[tuple] = []
    waiting: list[tuple] = []
    key, docs, last, head, opening = None, 0, None, None, True

    def close(at_end: bool) -> None:
        if key is not None and (opening or at_end):
            out.append((2, *key, *head[:2], docs, head[2]))
            out.extend((1, *key, *w) for w in waiting)
            if keep_first and opening:
                out.append((1, *key, *head))
        waiting.clear()

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 7
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["kind", "h1", "h2", "doc", "th", "pos", "n"])
        out.clear()
        return batch

    for b in batches:
        if not b.num_rows:
            continue
        # A run that begins and ends in this batch with fewer lines than min_docs keeps them all; only the others are looked at.
        h = [c.to_numpy() for c in b.columns[:2]]
        new = np.flatnonzero(np.concatenate([[True], (h[0][1:] != h[0][:-1]) | (h[1][1:] != h[1][:-1])]))
        size = np.diff(np.append(new, b.num_rows))
        some = size >= min_docs
        some[[0, -1]] = True
        rows = pa.array(np.flatnonzero(np.repeat(some, size)))
        for h1, h2, doc, th, pos, n in zip(*(c.take(rows).to_pylist() for c in b.columns), strict=True):
            row, first = (doc, th, pos, n), False
            if (h1, h2) != key:
                close(False)
                opening = key is None
                key, docs, last, head, first = (h1, h2), 0, None, row, True
            if (doc, th) != last:
                docs, last = docs + 1, (doc, th)
                if docs == min_docs:
                    out.extend((0, *key, *w) for w in waiting)
                    waiting.clear()
            if first and keep_first:
                continue
            if docs >= min_docs:
                out.append((0, *key, *row))
            else:
                waiting.append(row)
        if len(out) > 20_000:
            yield flush()
    close(True)
    yield flush()


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_chars: int = 1) -> DataFrame:
    """doc long, th long, n_lines int, n_dropped int, keep binary for each document that loses a line.

    A line goes if its key (see `line_key`) has min_chars code points and lies in min_docs documents; keep_first spares
    the first occurrence in order of doc_id, text hash and position. docs has doc_id and text; other columns don't matter.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text_of()).alias("th"), text_of().alias("text"))
    rows = written(base.mapInArrow(lambda it: _line_rows(it, min_chars), ROWS), "lines")
    by = ["h1", "h2", "doc", "th"]
    ordered = rows.repartitionByRange(partitions(docs), *by).sortWithinPartitions(*by, "pos")
    decided = written(ordered.mapInArrow(lambda it: _streamed(it, min_docs, keep_first), DECIDED), "drops")
    # Two rows at most from each partition.
    ends = (
        decided.filter("kind = 2").groupBy("h1", "h2")
        .agg(F.sum("pos").alias("docs"), F.min(F.struct("doc", "th", F.col("n").alias("pos"))).alias("first"))
        .filter(F.col("docs") >= min_docs)
    )
    held = decided.filter("kind = 1").join(ends, ["h1", "h2"])
    if keep_first:
        held = held.filter(~(F.col("first.doc").eqNullSafe(F.col("doc")) & (F.col("first.th") == F.col("th")) & (F.col("first.pos") == F.col("pos"))))
    cols = ["doc", "th", "pos", "n"]
    drops = decided.filter("kind = 0").select(*cols).unionByName(held.select(*cols))
    return drops.groupBy("doc", "th").agg(F.max("n").alias("n"), F.collect_set("pos").alias("pos")).mapInArrow(_packed, "doc long, th long, n_lines int, n_dropped int, keep binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        maps, sizes = [], []
        for n, pos in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[pos] = False
            maps.append(pack(keep))
            sizes.append(len(pos))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary())], names=["doc", "th", "n_lines", "n_dropped", "keep"])


@F.arrow_udf(StringType())
def _kept(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    out = []
    for t, m in zip(text.to_pylist(), bitmap.to_pylist(), strict=True):
        if m is None:
            out.append(None)
            continue
        lines = t.split("\n")
        out.append("\n".join(x for x, k in zip(lines, unpack(m, len(lines)), strict=True) if k))
    return pa.array(out, pa.string())


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the lines that their bitmap keeps, and n_dropped; only texts that lose lines reach Python."""
    maps = bitmaps.select(F.col("doc").alias(f"{P}doc"), F.col("th").alias(f"{P}th"), F.col("keep").alias(f"{P}keep"), F.col("n_dropped").alias(f"{P}dropped"))
    left = docs.withColumn(f"{P}h", F.xxhash64(text_of()))
    joined = left.join(maps, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{P}doc")) & (F.col(f"{P}h") == F.col(f"{P}th")), "left")
    hit = F.col(f"{P}keep").isNotNull()
    new = F.when(hit, _kept(F.when(hit, text_of()), F.col(f"{P}keep"))).otherwise(F.col("text"))
    return joined.withColumns({"text": new, f"{P}dropped": F.coalesce(f"{P}dropped", F.lit(0))}).drop(f"{P}h", f"{P}doc", f"{P}th", f"{P}keep")


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_chars: int = 1) -> DataFrame:
    """docs with the same columns, without the lines that repeat over documents; every row stays, if only with an empty text."""
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_docs, keep_first, min_chars))
    return out.select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n_lines", F.size(F.split(text_of(), "\n", -1)).cast("long"))
    out = apply_bitmaps(counted, keep_bitmaps(docs))
    return out.select("doc_id", "n_lines", F.col(f"{P}dropped").cast("long").alias("n_dropped"), F.sha2(text_of().cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT d.doc_id, d.pos, d.line, f.k IS NOT NULL AS gone FROM keyed d LEFT JOIN frequent f ON d.k = f.k
)
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
