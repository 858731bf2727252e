"""Cost-balanced packing of documents into training sequences (operator 13).

A document of n tokens costs n + QUADRATIC * n * n: matrix work grows with its tokens, attention with their square. Within a
block of some BLOCK tokens, documents are taken by falling cost; each goes to the sequence of the lowest cost that still has
room for it. Where none has, the document is cut to what the emptiest sequence can hold, and its rest is placed next. A block
has as many sequences as its tokens fill, so all of them end up full, and what is left over goes to the next block.
Documents longer than a sequence first give whole sequences of their own; their ends are packed like others.

A task packs its partition block by block and holds one block. What is left at its end, less than a sequence, goes into
sequences whose lengths are powers of two (the binary digits of the rest), which need no padding. So nothing is shuffled, no
token passes the driver, and a partition of any size costs at most `bits` short sequences.

sequence_id is the partition's number times 2**36 plus a count. A task that runs again gives the same sequences, if its
input comes in the same order again, as that of a scan does; write a shuffled input before packing it.

Defined results: a null text is an empty text, which has the end id alone; every row is a document, so repeated rows and
equal or null doc_ids are packed each for itself; equal costs go by the order of the rows; an empty table gives no rows; a
text is encoded whole, however long; columns besides doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of
from .wordmemo import WordBpe

SEQUENCE, BLOCK = 4096, 1 << 21
#: Share of a token's cost that one more token before it adds: attention against matrix work in a model 1024 wide.
QUADRATIC = 1 / 6144
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cost(tokens: np.ndarray, quadratic: float = QUADRATIC) -> np.ndarray:
    return tokens + quadratic * tokens.astype(np.float64) ** 2


def assign(lengths: list[int], room: np.ndarray, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(piece, its tokens taken before, tokens, sequence) until every sequence is full or nothing is left.

    lengths: tokens of each piece; room: what each sequence can hold. The order of a sequence's pieces is that of the list.
    """
    room, spent, out = room.astype(np.int64), np.zeros(len(room)), []
    for piece in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at, left = 0, lengths[piece]
        while left:
            fits = room >= left
            if fits.any():
                to, n = int(np.where(fits, spent, np.inf).argmin()), left
            else:
                most = room.max()
                if not most:
                    return out
                to, n = int(np.where(room == most, spent, np.inf).argmin()), int(most)
            out.append((piece, at, n, to))
            room[to] -= n
            spent[to] += n + quadratic * n * n
            at, left = at + n, left - n
    return out


class Packer:
    """Takes documents one by one and gives rows of PIECES by blocks."""

    def __init__(self, part: int, size: int, block: int, quadratic: float):
        self.size, self.block, self.quadratic = size, max(block, size), quadratic
        self.next, self.pool, self.held, self.rows = part << 36, [], 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, at = len(ids) // 4, 0
        while n - at >= self.size:
            self.rows.append((doc_id, at, self.size, ids[4 * at : 4 * (at + self.size)], n, self.next, 0))
            self.next += 1
            at += self.size
        if at < n:
            self.pool.append((doc_id, at, ids[4 * at :] if at else ids, n))
            self.held += n - at

    def _place(self, room: np.ndarray) -> None:
        taken, ends = assign([len(p[2]) // 4 for p in self.pool], room, self.quadratic), np.zeros(len(room), np.int64)
        done = [0] * len(self.pool)
        for piece, at, n, to in taken:
            doc_id, start, ids, whole = self.pool[piece]
            self.rows.append((doc_id, start + at, n, ids[4 * at : 4 * (at + n)], whole, self.next + to, int(ends[to])))
            ends[to] += n
            done[piece] = at + n
        self.next += len(room)
        self.pool = [(d, s + k, ids[4 * k :], n) for (d, s, ids, n), k in zip(self.pool, done, strict=True) if 4 * k < len(ids)]
        self.held = sum(len(p[2]) for p in self.pool) // 4

    def pack(self) -> None:
        self._place(np.full(self.held // self.size, self.size))

    def end(self) -> None:
        if self.held >= self.size:
            self.pack()
        if self.held:
            self._place(np.array([1 << k for k in range(self.held.bit_length() - 1, -1, -1) if self.held >> k & 1]))

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = sorted(self.rows, key=lambda r: (r[5], r[6])), []
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordBpe:
    return WordBpe(path)


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], end_id: int = 2, size: int = SEQUENCE, block: int = BLOCK, quadratic: float = QUADRATIC) -> DataFrame:
    """The pieces of all documents (PIECES): ids as little-endian u32, at `offset` of their sequence, `start` of their document.

    encoder: makes, within a task, what gives a text its ids as little-endian u32. size: tokens of a sequence, a power of two.
    """
    if size & (size - 1) or size < 1:
        raise ValueError("a sequence's size must be a power of two")
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer, waiting = encoder(), Packer(TaskContext.get().partitionId(), size, block, quadratic), 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py()) + end
                packer.add(doc_id, ids)
                waiting += len(ids) // 4
                if packer.held >= packer.block:
                    packer.pack()
                if waiting >= packer.block:
                    yield packer.taken()
                    waiting = 0
        packer.end()
        yield packer.taken()

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, PIECES)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    out = pack(table(spark, sf_dir, "documents"), lambda: _encoder(path))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
