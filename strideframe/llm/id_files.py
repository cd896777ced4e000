"""Token ids in files: blocks of one concatenated id array with Elias-Fano coded document boundaries.

Layout of a folder: `blocks` (Parquet) has a row for each block: shard, block, start (ids of the shard before the
block), n_docs, n_ids, n_null (documents without an id, which come first), first_id, doc_ids and ends (both
Elias-Fano coded), ids (little-endian integers of `width` bytes). Shards follow the order of doc_id. `shards` has
the ids before each shard. A boundary costs about 2 + log2(mean length) bits instead of 64.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideframe.llm.frames import batch, in_batches, keyed
from strideframe.llm.text import pieces
from strideframe.llm.tokens import codec

#: Bits of the upper part for which the number of ones before is stored.
SUPER = 512


class EliasFano:
    """Ascending integers from 0 on (equal neighbours allowed), in near-minimal space, with `select`."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1 if bits else np.zeros((n, 0), np.uint8)
        ones = np.zeros(-(-(n + (top >> bits) + 1) // SUPER) * SUPER, np.uint8)
        ones[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        per = ones.reshape(-1, SUPER).sum(1)
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(ones, bitorder="little"), np.concatenate([[0], np.cumsum(per)[:-1]]).astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.ranks.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, bits, a, b = struct.unpack_from("<QBQQ", raw)
        at = struct.calcsize("<QBQQ")
        return cls(n, bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u4", -1, at + a + b))

    def _low_of(self, i: int) -> int:
        at = np.arange(i * self.low_bits, (i + 1) * self.low_bits)
        return int((((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum()) if self.low_bits else 0

    def select(self, i: int) -> int:
        """Value number i, from one stretch of SUPER bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        s = int(np.searchsorted(self.ranks, i, "right")) - 1
        ones = np.flatnonzero(np.unpackbits(self.high[s * SUPER // 8 : (s + 1) * SUPER // 8], bitorder="little"))
        return (int(ones[i - int(self.ranks[s])]) + s * SUPER - i << self.low_bits) | self._low_of(i)

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        low = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


BLOCKS = "shard int, block int, start long, n_docs long, n_ids long, n_null long, first_id long, width int, doc_ids binary, ends binary, ids binary"


def _block(shard: int, number: int, start: int, docs: list, ids: list[np.ndarray], lengths: list[int], width: int) -> pa.RecordBatch:
    known = np.array([d for d in docs if d is not None], np.int64)
    first = int(known[0]) if len(known) else 0
    ends = np.cumsum(np.array(lengths, np.int64))
    return batch(
        shard=pa.array([shard], pa.int32()), block=pa.array([number], pa.int32()), start=[start], n_docs=[len(docs)], n_ids=[int(ends[-1])],
        n_null=[len(docs) - len(known)], first_id=pa.array([first], pa.int64()), width=pa.array([width], pa.int32()),
        doc_ids=pa.array([EliasFano.of(known.astype(np.uint64) - np.uint64(first & (1 << 64) - 1)).to_bytes()], pa.binary()),
        ends=pa.array([EliasFano.of(ends).to_bytes()], pa.binary()), ids=pa.array([np.concatenate(ids).tobytes()], pa.binary()))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, block_ids: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text (null: empty), appends `end_id`, and writes the files to `path`.

    Documents come in ascending order of `id_col` (a long), those without one first, ties by a hash of the text.
    A block ends with the document that reaches `block_ids`. An empty table makes a folder without blocks.
    A text of any length is one document of one block; repeated rows are as many documents; further columns are left out.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, shard = codec(tokenizer), TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], c.width)
        held, ids, lengths, size, number, start = [], [], [], 0, 0, 0
        for b in pieces(batches, most=2 << 20):
            flat, at = c.encode(b.column("text"))
            for doc, i, j in zip(b.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                held.append(doc)
                ids += [flat[i:j], end]
                lengths.append(j - i + len(end))
                size += lengths[-1]
                if size >= block_ids:
                    yield _block(shard, number, start, held, ids, lengths, c.width.itemsize)
                    number, start = number + 1, start + size
                    held, ids, lengths, size = [], [], [], 0
        if held:
            yield _block(shard, number, start, held, ids, lengths, c.width.itemsize)

    ordered = keyed(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    in_batches(ordered, encode, BLOCKS).write.option("compression", "zstd").option("maxRecordsPerFile", 64).parquet(f"{path}/blocks")
    spark = docs.sparkSession
    by_shard = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))  # a row for each task that wrote
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    by_shard.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before")).write.parquet(f"{path}/shards")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (binary, `width` bytes each), width."""
    shards = spark.read.parquet(f"{path}/shards")  # as many rows as tasks wrote, so the driver has held more for each
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(shards), "shard")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                ends = EliasFano.from_bytes(row["ends"]).all().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                known = (EliasFano.from_bytes(row["doc_ids"]).all() + np.uint64(row["first_id"] & (1 << 64) - 1)).view(np.int64)
                width = row["width"]
                offsets = np.concatenate([starts, ends[-1:]]) * width
                yield batch(
                    doc_id=pa.array([None] * row["n_null"] + known.tolist(), pa.int64()), start=starts + row["start"] + row["before"], n_tokens=ends - starts,
                    ids=pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(row["ids"])]),
                    width=pa.array([width] * len(ends), pa.int32()))

    return in_batches(blocks, decode, "doc_id long, start long, n_tokens long, ids binary, width int")


def crc32_of_ids(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what `read_ids` returns."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                wide = [zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4")) for x, w in zip(b.column("ids").to_pylist(), b.column("width").to_pylist())]
                yield batch(doc_id=b.column("doc_id"), start=b.column("start"), n_tokens=b.column("n_tokens"), ids_crc32=pa.array(wide, pa.int64()))

    return in_batches(rows, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
