"""Token ids of a corpus in wavelet matrices, one compressed file image per shard.

A wavelet matrix keeps a sequence as one bit plane per bit of its ids, the highest first.
Each plane lists that bit of every id in the order the planes above leave: stably, zeros
first. A rank directory on each plane then answers, from the file alone: the id at a place,
how often an id occurs before a place, and the place of its n-th occurrence, each by one
step per plane. Planes are cut into blocks, compressed one by one, so a step opens one block.

Documents are put in ascending doc_id order by ranges; a task turns its range into shards as
it reads, so that it holds one shard at a time, and the shards are written as rows of a Parquet
folder. Where a document starts in the whole corpus is known from the ranges' totals.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallycast.llm.common import table
from tallycast.llm.tokens import token_ids
from tallycast.storage import scratch_path

SHARD = 1 << 18  # ids of a shard, about: it is closed after the document that reaches them
BLOCK = 1 << 15  # bits of a block
MAGIC = b"WVM1"
_HEAD = "<4sIQII"  # magic, planes, ids, bits of a block, blocks of a plane


def build(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The file image of a sequence of unsigned ids.

    Header; zeros of each plane; per plane and block the ones before it, and the end of its
    compressed bytes; the compressed blocks.
    """
    import zstandard

    now = np.ascontiguousarray(ids, dtype=np.uint32)
    planes = int(now.max()).bit_length() if len(now) else 0
    if planes <= 16:
        now = now.astype(np.uint16)  # moves half the bytes on each plane
    blocks = -(-len(now) // block)
    zeros, before, ends, parts, written = [], [], [], [], 0
    pack = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True).compress
    for plane in range(planes):
        bits = (now & now.dtype.type(1 << (planes - 1 - plane))).astype(bool)
        packed = np.packbits(bits, bitorder="little")
        data = packed.tobytes()
        counts = np.bitwise_count(np.pad(packed, (0, -len(packed) % (block // 8))))
        ones = counts.reshape(blocks, -1).sum(axis=1, dtype=np.int64)
        before.append(np.concatenate(([0], np.cumsum(ones)[:-1])))
        for at in range(0, len(data), block // 8):
            parts.append(pack(data[at : at + block // 8]))
            written += len(parts[-1])
            ends.append(written)
        low, high = np.flatnonzero(~bits), np.flatnonzero(bits)
        zeros.append(len(low))
        now = np.concatenate((now.take(low), now.take(high)))
    index = (np.array(zeros, "<u8"), np.concatenate(before or [[]]).astype("<u8"), np.array(ends, "<u8"))
    return b"".join([struct.pack(_HEAD, MAGIC, planes, len(ids), block, blocks), *(x.tobytes() for x in index), *parts])


class Matrix:
    """Reads a file image; blocks are opened when a question needs them."""

    def __init__(self, image: bytes):
        import zstandard

        magic, self.planes, self.size, self.block, self.blocks = struct.unpack_from(_HEAD, image)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        at, n = struct.calcsize(_HEAD), self.planes * self.blocks
        self.zeros = np.frombuffer(image, "<u8", self.planes, at).astype(np.int64)
        self.before = np.frombuffer(image, "<u8", n, at + 8 * self.planes).astype(np.int64)
        self.ends = np.frombuffer(image, "<u8", n, at + 8 * (self.planes + n)).astype(np.int64)
        self._data = memoryview(image)[at + 8 * (self.planes + 2 * n) :]
        self._open = zstandard.ZstdDecompressor().decompress
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint8))

    def _bits(self, plane: int, number: int) -> np.ndarray:
        """The bits of one block."""
        k = plane * self.blocks + number
        if self._last[0] != k:
            packed = self._open(self._data[self.ends[k - 1] if k else 0 : self.ends[k]])
            count = min(self.block, self.size - number * self.block)
            self._last = (k, np.unpackbits(np.frombuffer(packed, np.uint8), count=count, bitorder="little"))
        return self._last[1]

    def _ones(self, plane: int, at: int) -> int:
        """Ones of a plane before a place."""
        if at >= self.size:
            return int(self.size - self.zeros[plane])
        number, rest = divmod(at, self.block)
        return int(self.before[plane * self.blocks + number]) + int(np.count_nonzero(self._bits(plane, number)[:rest]))

    def _place(self, plane: int, bit: int, nth: int) -> int:
        """Place of the n-th (from 0) one or zero of a plane: its select."""
        first = self.before[plane * self.blocks : (plane + 1) * self.blocks]
        if not bit:
            first = np.arange(self.blocks, dtype=np.int64) * self.block - first
        number = int(np.searchsorted(first, nth, side="right")) - 1
        inside = np.flatnonzero(self._bits(plane, number) == bit)
        return number * self.block + int(inside[nth - first[number]])

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for plane in range(self.planes):
            number, rest = divmod(at, self.block)
            bit = int(self._bits(plane, number)[rest])
            ones = self._ones(plane, at)
            at = int(self.zeros[plane]) + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, end: int) -> int:
        """How often an id occurs before a place."""
        low, high = 0, max(0, min(end, self.size))
        if value < 0 or value.bit_length() > self.planes:
            return 0
        for plane in range(self.planes):
            a, b = self._ones(plane, low), self._ones(plane, high)
            if value >> (self.planes - 1 - plane) & 1:
                low, high = int(self.zeros[plane]) + a, int(self.zeros[plane]) + b
            else:
                low, high = low - a, high - b
        return high - low

    def count(self, value: int) -> int:
        """How often an id occurs."""
        return self.rank(value, self.size)

    def locate(self, value: int, nth: int) -> int:
        """Place of the n-th (from 0) occurrence of an id."""
        if not 0 <= nth < self.count(value):
            raise IndexError(nth)
        start = 0
        for plane in range(self.planes):
            ones = self._ones(plane, start)
            start = int(self.zeros[plane]) + ones if value >> (self.planes - 1 - plane) & 1 else start - ones
        at = start + nth
        for plane in reversed(range(self.planes)):
            if value >> (self.planes - 1 - plane) & 1:
                at = self._place(plane, 1, at - int(self.zeros[plane]))
            else:
                at = self._place(plane, 0, at)
        return at

    def ids(self) -> np.ndarray:
        """The whole sequence, plane by plane from the lowest."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        values = np.zeros(self.size, dtype=kind)
        for plane in reversed(range(self.planes)):
            bits = [self._bits(plane, number) for number in range(self.blocks)]
            set_ = np.concatenate(bits).view(bool)
            above = np.empty_like(values)
            above[np.flatnonzero(~set_)] = values[: self.zeros[plane]]
            above[np.flatnonzero(set_)] = values[self.zeros[plane] :] | kind(1 << (self.planes - 1 - plane))
            values = above
        return values.astype(np.uint32)


def encode(docs: DataFrame, vocabulary: str, end: int = 0, shard_ids: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(part, number, first, n_ids, doc_ids, lengths, image): the shards of all rows, in ascending doc_id order.

    A document is its ids followed by ``end``; a null or empty text is that id alone. ``part``
    is a range of doc_ids, ``number`` the shard in it, ``first`` its first id's place in the range.
    A document lies in one shard. Rows of equal doc_id are ordered by a hash of the text; null ids
    come first; an empty table has no shards. Other columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("version"))
    order = [F.asc_nulls_first("doc_id"), F.asc("version")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    final = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = token_ids(vocabulary)
        part, number, first, count, held, names, lengths = TaskContext.get().partitionId(), 0, 0, 0, [], [], []

        def close():
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            columns = {"part": [part], "number": [number], "first": [first], "n_ids": [len(ids)]}
            return pd.DataFrame({**columns, "doc_ids": [list(names)], "lengths": [list(lengths)], "image": [build(ids, block)]})

        for batch in batches:
            named = [None if pd.isna(i) else i for i in batch["doc_id"].tolist()]
            for name, ids in zip(named, encoder.encode(batch["text"])):
                held.append(ids + final)
                names.append(name)
                lengths.append(len(held[-1]) // 4)
                count += lengths[-1]
                if count >= shard_ids:
                    yield close()
                    number, first, count = number + 1, first + count, 0
                    held, names, lengths = [], [], []
        if held:
            yield close()

    schema = f"part int, number int, first long, n_ids long, doc_ids array<{kind}>, lengths array<long>, image binary"
    return ordered.select("doc_id", "text").mapInPandas(run, schema)


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 0, **sizes: int) -> None:
    """Write the shards of ``docs`` as Parquet; see ``encode``."""
    encode(docs, vocabulary, end, **sizes).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The written shards with ``start``, the place of each shard's first id in the whole corpus.

    Only the totals of the ranges, as many as the writing shuffle had, are summed in one task.
    """
    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return shards.join(F.broadcast(bases), "part").select("*", (F.col("base") + F.col("first")).alias("start")).drop("base")


def documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the ids in the images."""
    kind = next(f.dataType.elementType for f in shards.schema.fields if f.name == "doc_ids").simpleString()
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, names, lengths, image in zip(batch["start"], batch["doc_ids"], batch["lengths"], batch["image"]):
                ids = Matrix(image).ids().astype("<u4", copy=False)
                stops = np.cumsum(lengths)
                starts = stops - lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), stops.tolist())]
                named = pd.Series(list(names), dtype=object)
                yield pd.DataFrame({"doc_id": named, "start": start + starts, "n_tokens": lengths, "ids_crc32": crc})

    return shards.select("start", "doc_ids", "lengths", "image").mapInPandas(run, schema)


def occurrences(shards: DataFrame, values: list[int]) -> DataFrame:
    """(value, place): every place in the corpus of the ids asked for, answered by rank and select alone."""
    asked = sorted(set(values))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, image in zip(batch["start"], batch["image"]):
                matrix = Matrix(image)
                for value in asked:
                    places = [start + matrix.locate(value, n) for n in range(matrix.count(value))]
                    yield pd.DataFrame({"value": value, "place": np.array(places, dtype=np.int64)})

    return shards.select("start", "image").mapInPandas(run, "value long, place long")


def op11(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "wavelet")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    write(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return documents(read(spark, path))
