"""Token ids in seekable zstandard shards.

A shard is a run of independent zstandard frames and, last, a skippable frame with the seek table of the public seekable
format: for each frame its compressed and decompressed size and the low 32 bits of the XXH64 of its content. Frame 0 is the directory: a byte
with the width of an id, then the 64-bit id of the document in each further frame. A reader finds the table from the
shard's end and decompresses the directory and the frames of the documents that it was asked for, and no other.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.session import share

SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_BYTES, LEVEL = 4 << 20, 3


class ShardWriter:
    """Collects the documents of one shard."""

    def __init__(self, width: int, level: int = LEVEL) -> None:
        self.width, self.coder = width, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.ids: list[int] = []
        self.counts: list[int] = []
        self.frames: list[tuple[bytes, int, int]] = []
        self.size = 0

    def _frame(self, raw: bytes) -> tuple[bytes, int, int]:
        return self.coder.compress(raw), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF

    def add(self, doc_id: int, tokens: np.ndarray) -> None:
        self.frames.append(self._frame(tokens.astype("<u2" if self.width == 2 else "<u4").tobytes()))
        self.ids.append(doc_id)
        self.counts.append(len(tokens))
        self.size += len(self.frames[-1][0])

    def finish(self) -> bytes:
        frames = [self._frame(bytes([self.width]) + np.array(self.ids, "<i8").tobytes()), *self.frames]
        table = b"".join(struct.pack("<III", len(data), n, check) for data, n, check in frames) + struct.pack("<IBI", len(frames), CHECKSUMS, SEEKABLE)
        return b"".join(data for data, _, _ in frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


class ShardReader:
    """Reads single documents of a shard; data is its bytes or a memory map of them."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        if len(data) < 17 or struct.unpack("<I", self.data[-4:])[0] != SEEKABLE:
            raise ValueError("no seek table")
        n, flags = struct.unpack("<IB", self.data[-9:-4])
        if not flags & CHECKSUMS:
            raise ValueError("the seek table has no checksums")
        table = np.frombuffer(self.data[-9 - 12 * n : -9], "<u4").reshape(n, 3).astype(np.int64)
        self.starts, self.table, self.decompressed = np.concatenate([[0], np.cumsum(table[:, 0])]), table, 0
        directory = self.frame(0)
        self.width, self.ids = directory[0], np.frombuffer(directory, "<i8", offset=1)

    def frame(self, k: int) -> bytes:
        raw = zstandard.ZstdDecompressor().decompress(self.data[self.starts[k] : self.starts[k + 1]], max_output_size=int(self.table[k, 1]))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        self.decompressed += 1
        return raw

    def read(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(id, tokens) of each frame of those documents, in the shard's order."""
        for k in np.flatnonzero(np.isin(self.ids, list(doc_ids))):
            yield int(self.ids[k]), np.frombuffer(self.frame(int(k) + 1), "<u2" if self.width == 2 else "<u4").astype(np.int64)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, shard_bytes: int = SHARD_BYTES, level: int = LEVEL) -> DataFrame:
    """A row for each shard: shard, doc_ids, n_tokens, data.

    shard is a name made of the content, so a task that runs again makes the same. A null or empty text has a frame of no tokens; rows with
    a null id are left out; rows that repeat an id have a frame each. A text of any length is one frame, and must fit a worker. Other columns are not read. No rows make no shard.
    """
    ranks = share(docs.sparkSession, load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        known = ranks()
        coder = tiktoken.Encoding("frames", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        width = 2 if max(known.values()) < 1 << 16 else 4

        def row(w: ShardWriter) -> pa.RecordBatch:
            data = w.finish()
            return pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh128_hexdigest(data)]), pa.array([w.ids], pa.list_(pa.int64())), pa.array([w.counts], pa.list_(pa.int32())), pa.array([data], pa.binary())],
                names=["shard", "doc_ids", "n_tokens", "data"],
            )

        shard = ShardWriter(width, level)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                shard.add(doc_id, np.array(coder.encode_ordinary(text.as_py() or ""), np.uint32))
                if shard.size >= shard_bytes:
                    yield row(shard)
                    shard = ShardWriter(width, level)
        if shard.ids:
            yield row(shard)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "shard string, doc_ids array<long>, n_tokens array<int>, data binary")


def write_files(shards: DataFrame, folder: str) -> DataFrame:
    """Writes each shard as <shard>.tok.zst in a folder that all executors share; returns (shard, doc_ids, n_tokens), which is read to write them.

    A file appears whole or not at all, under a name made of its content, so tasks may run twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, data in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist()):
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as file:
                    file.write(data)
                os.replace(part, os.path.join(folder, f"{name}.tok.zst"))
            yield batch.select(["shard", "doc_ids", "n_tokens"])

    return shards.mapInArrow(run, "shard string, doc_ids array<long>, n_tokens array<int>")
