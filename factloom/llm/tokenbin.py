"""Token ids as binary shards (operator 3).

Documents are range-partitioned by doc_id; each task writes one shard of ids. A shard is cut into blocks of BLOCK ids; the
bytes (or bits) of a block's ids are transposed into planes, each plane is compressed by zstandard, and a chunk index at
the end of the file says where each plane of each block lies. Any block can be read by itself.

Shard: b"FLTB" | version u8 | kind u8 (0 bytes, 1 bits) | u16 0 | planes ... | offsets u64 (blocks * planes + 1) |
document lengths (u32 each, zstd) | its size u64 | documents u64 | ids u64 | blocks u64 | planes u64 | b"FLTE". All little-endian.

A task writes under a name of its own attempt and then renames; a second attempt of the same task writes the same bytes,
so a lost executor costs one task. Readers take paths from the manifest table only.

Defined results: a null text is an empty text, which has the end id alone; null doc_ids come first; rows with the same
doc_id are in order of their text's hash; an empty table gives no shard and no row.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import P, crc32, files_at, partitions, shared_dir, table, text_of, written
from .wordmemo import ByteBpe

BLOCK, VERSION, LEVEL = 1 << 16, 1, 1
TAIL = struct.Struct("<QQQQQ4s")


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The bytes of little-endian u32 ids by significance, or their bits, lowest first."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [p.tobytes() for p in raw.T]
    return [p.tobytes() for p in np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    wide = np.unpackbits(np.stack([np.frombuffer(p, np.uint8) for p in planes]), axis=1, count=n).T
    return np.packbits(wide, axis=1, bitorder="little").reshape(-1).view("<u4")


class ShardWriter:
    """Holds one block of ids at a time, and the lengths of documents."""

    def __init__(self, sink, bits: bool = False, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.rest, self.held, self.n, self.at = [], 0, 0, 0
        self.offsets, self.lengths = [], []
        self._write(b"FLTB" + bytes([VERSION, bits, 0, 0]))

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, ids: bytes, lengths: list[int]) -> None:
        """ids: little-endian u32 of whole documents, of these lengths."""
        self.lengths.append(np.asarray(lengths, "<u4"))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block:
            data, size = b"".join(self.rest), 4 * self.block
            whole = len(data) // size * size
            for k in range(0, whole, size):
                self._block(np.frombuffer(data, "<u4", self.block, k))
            self.rest, self.held = [data[whole:]], len(data) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        for plane in to_planes(ids, self.bits):
            self.offsets.append(self.at)
            self._write(self.zip.compress(plane))

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        if self.held:
            self._block(np.frombuffer(b"".join(self.rest), "<u4"))
        planes = 32 if self.bits else 4
        blocks = len(self.offsets) // planes
        self._write(np.asarray([*self.offsets, self.at], "<u8").tobytes())
        lengths = np.concatenate(self.lengths) if self.lengths else np.zeros(0, "<u4")
        self._write(small := self.zip.compress(lengths.tobytes()))
        self._write(TAIL.pack(len(small), len(lengths), self.n, blocks, planes, b"FLTE"))
        return len(lengths), self.n


class ShardReader:
    """Random access to the blocks of a shard; one block is in memory at a time."""

    def __init__(self, source, block: int = BLOCK):
        size = source.size()
        small, self.docs, self.n, self.blocks, self.planes, magic = TAIL.unpack(source.read_at(TAIL.size, size - TAIL.size))
        head = source.read_at(8, 0)
        if magic != b"FLTE" or head[:4] != b"FLTB" or head[4] != VERSION:
            raise ValueError("not a shard of token ids, or one of another version")
        self.source, self.block, self.bits = source, block, bool(head[5])
        count = self.blocks * self.planes + 1
        at = size - TAIL.size - small
        self.offsets = np.frombuffer(source.read_at(8 * count, at - 8 * count), "<u8")
        self.unzip = zstandard.ZstdDecompressor()
        self.lengths = np.frombuffer(self.unzip.decompress(source.read_at(small, at), max_output_size=max(1, 4 * self.docs)), "<u4")

    def ids(self, k: int) -> np.ndarray:
        n = min(self.block, self.n - k * self.block)
        at = self.offsets[k * self.planes : (k + 1) * self.planes + 1].astype(np.int64)
        data = self.source.read_at(int(at[-1] - at[0]), int(at[0]))
        width = -(-n // 8) if self.bits else n
        planes = [self.unzip.decompress(data[a - at[0] : b - at[0]], max_output_size=width) for a, b in zip(at[:-1], at[1:], strict=True)]
        return from_planes(planes, n, self.bits)

    def documents(self) -> Iterator[bytes]:
        """The ids of each document, as little-endian u32."""
        k, data, at = 0, b"", 0
        for n in self.lengths.tolist():
            parts, need = [], 4 * n
            while need > len(data) - at:
                parts.append(data[at:])
                need -= len(data) - at
                data, at = self.ids(k).tobytes(), 0
                k += 1
            parts.append(data[at : at + need])
            at += need
            yield b"".join(parts)


@lru_cache(maxsize=2)
def _encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


MANIFEST = "shard string, first long, docs long, ids long, part int"


def _write_shards(batches: Iterator[pa.RecordBatch], folder: str, encoder: Callable[[list[str]], list[bytes]], end: bytes, bits: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    final = f"{folder}/part-{part:06d}.fltb"
    fs, path = files_at(final)
    own, writer, sink, doc_ids = f"{path}.{uuid.uuid4().hex}.tmp", None, None, []
    for b in batches:
        if b.num_rows and writer is None:
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            writer = ShardWriter(sink := fs.open_output_stream(own), bits)
        if b.num_rows:
            ids = [x + end for x in encoder(b.column(1).to_pylist())]
            writer.add(b"".join(ids), [len(x) // 4 for x in ids])
            doc_ids.append(b.column(0).cast(pa.int64()))
    if writer is None:
        return
    n_docs, n_ids = writer.close()
    sink.close()
    fs.move(own, path)
    # The doc_ids lie beside the shard, in its order.
    names = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(names) as f:
        import pyarrow.parquet as pq

        pq.write_table(pa.table({"doc_id": pa.concat_arrays(doc_ids)}), f)
    fs.move(names, f"{path}.docs")
    yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([0], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([part], pa.int32())], names=["shard", "first", "docs", "ids", "part"])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, bits: bool = False, folder: str | None = None) -> DataFrame:
    """Encode whole texts and write shards in ascending doc_id order; returns their manifest, itself a written table.

    tokenizer: file of the tokenizers library (byte-level BPE).
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark) + "-shards"
    end = int(end_id).to_bytes(4, "little")
    by = [F.col("doc_id"), F.col(f"{P}h")]
    ordered = (
        docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.xxhash64(text_of()).alias(f"{P}h"))
        .repartitionByRange(partitions(docs), *by).sortWithinPartitions(*by).drop(f"{P}h")
    )
    manifest = written(ordered.mapInArrow(lambda it: _write_shards(it, folder, lambda x: _encoder(tokenizer)(x), end, bits), MANIFEST), "manifest")
    # One row for each shard: their sums are far smaller than any shard.
    before = F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return manifest.withColumn("first", F.coalesce(before, F.lit(0)).cast("long"))


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq

    for b in batches:
        for shard, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            fs, path = files_at(shard)
            with fs.open_input_file(f"{path}.docs") as f:
                doc_ids = pq.read_table(f).column(0).combine_chunks()
            with fs.open_input_file(path) as f:
                reader = ShardReader(f)
                starts = first + np.concatenate([[0], np.cumsum(reader.lengths.astype(np.int64))])[:-1]
                crcs, at = [], 0
                for k, ids in enumerate(reader.documents()):
                    crcs.append(crc32(ids))
                    if len(crcs) == 50_000 or k + 1 == reader.docs:
                        to = at + len(crcs)
                        yield pa.RecordBatch.from_arrays(
                            [doc_ids[at:to], pa.array(starts[at:to]), pa.array(reader.lengths[at:to].astype(np.int64)), pa.array(crcs, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        at, crcs = to, []


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files: a task for each shard."""
    n = max(1, partitions(manifest))
    return manifest.select("shard", "first").repartition(n, "shard").mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
