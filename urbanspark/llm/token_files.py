"""Token ids in Arrow files: fixed-size lists of ids and masks, read without copying.

Documents are dealt to shards by ranges of their key and sorted within; a shard holds about SHARD_BYTES of text, so their
number grows with the input. A shard is one Arrow file of record batches whose two columns are fixed-size lists, the ids
(`input_ids`: uint16 where the vocabulary allows, else uint32) of its documents one after the other, each with the end
id, and `mask`, one bit an id; only the last sequence is padded, where the mask is 0. Beside it stands an index file (key,
start in the shard, n_tokens). Any sequence is at a known place: `sequence()` returns numpy views of the mapped file. A
shard is written under a name of its own by each attempt, and only the names that successful tasks return are read.

The driver gets one row a shard. Edge cases: null and empty texts are one end id. Null keys come first. Rows with equal
keys stand in the order of a hash of their texts, and may be dealt to several shards. Texts of any length are written
whole. An empty table gives no rows. Other columns are not read. Keys are cast to long.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_dir, shuffle_partitions, small_batches
from .tokens import encoder

SEQUENCE = 2048
#: bytes of text in a shard, about
SHARD_BYTES = 256 << 20
_BATCH = 128
_INDEX = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(length: int, ids: pa.DataType) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a Hadoop path, and the path in it; s3a and s3n are Hadoop's names for s3."""
    scheme, found, rest = folder.partition("://")
    if not found:
        return fs.LocalFileSystem(), folder.removeprefix("file:")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + found + rest)


class _ShardWriter:
    def __init__(self, files: fs.FileSystem, path: str, length: int, narrow: bool):
        self.length, self.type = length, np.dtype("<u2" if narrow else "<u4")
        self.schema = _schema(length, pa.uint16() if narrow else pa.uint32())
        self.sinks = [files.open_output_stream(f"{path}.arrow"), files.open_output_stream(f"{path}.index.arrow")]
        self.ids, self.index = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], _INDEX)
        self.rest, self.held, self.total = [], 0, 0

    def add(self, keys: list[int | None], ids: list[bytes]) -> None:
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        starts = self.total + np.cumsum(sizes) - sizes
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts), pa.array(sizes)], schema=_INDEX))
        self.total += int(sizes.sum())
        for x in ids:
            self.rest.append(x)
            self.held += len(x) // 4
            if self.held >= _BATCH * self.length:
                self._flush(self.held // self.length)

    def _flush(self, sequences: int, pad: int = 0) -> None:
        flat = np.frombuffer(b"".join(self.rest) + b"\0" * (4 * pad), "<u4").astype(self.type)
        mask = np.ones(len(flat), bool)
        mask[len(flat) - pad :] = False
        end = sequences * self.length
        for at in range(0, end, _BATCH * self.length):
            to = min(end, at + _BATCH * self.length)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x[at:to]), self.length) for x in (flat, mask)]
            self.ids.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.rest, self.held = ([flat[end:].astype("<u4").tobytes()], len(flat) - end) if end < len(flat) else ([], 0)

    def close(self) -> None:
        if self.held:
            sequences = -(-self.held // self.length)
            self._flush(sequences, sequences * self.length - self.held)
        for x in (self.ids, self.index, *self.sinks):
            x.close()


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", length: int = SEQUENCE) -> list[tuple[str, int, int]]:
    """Write docs in ascending key order; (path, first token, tokens) of each shard in order. length: a multiple of 8."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    files, local = _filesystem(folder)
    files.create_dir(local)
    end = int(end_id).to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, local = _filesystem(folder)
        shard, writer = TaskContext.get().partitionId(), None
        path = f"{local}/part-{shard:05d}-{uuid.uuid4().hex}"
        for batch in batches:
            if batch.num_rows:
                encode = encoder(tokenizer)
                writer = writer or _ShardWriter(files, path, length, max(encode.largest, end_id) < 1 << 16)
                for at in range(0, batch.num_rows, 512):
                    rows = batch.slice(at, 512)
                    writer.add(rows.column(0).to_pylist(), [x + end for x in encode.encode(rows.column(1).to_pylist())])
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n": [writer.total]})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-size // SHARD_BYTES))
    tie = F.xxhash64("text")
    dealt = rows.repartitionByRange(shards, "key", tie).sortWithinPartitions("key", tie)
    shards = sorted(dealt.mapInArrow(write, "shard long, path string, n long").collect())
    out, start = [], 0
    for s in shards:
        out.append((s["path"], start, s["n"]))
        start += s["n"]
    return out


def _open(folder: str, path: str) -> pa.ipc.RecordBatchFileReader:
    files, _ = _filesystem(folder)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int, length: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Ids of sequence i and its mask, eight ids a byte from the low bit on: views of the file's bytes."""
    batch = reader.get_batch(i // _BATCH)
    at = i % _BATCH * length
    bits = np.frombuffer(batch.column(1).values.buffers()[1], np.uint8)
    return batch.column(0).values.to_numpy(zero_copy_only=True)[at : at + length], bits[at // 8 : (at + length) // 8]


def read_shards(spark, shards: list[tuple[str, int, int]]) -> DataFrame:
    """key, start, n_tokens and ids_crc32 of every document, from the files."""
    folder = scratch_dir(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, first in (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            ids, index = _open(folder, f"{path}.arrow"), _open(folder, f"{path}.index.arrow")
            at, held, flat = -1, 0, np.empty(0, np.uint16)  # batch, its first token, its ids
            for k in range(index.num_record_batches):
                rows = index.get_batch(k)
                crcs = []
                for start, n in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    crc, done = 0, 0
                    while done < n:
                        while start + done >= held + len(flat):
                            held, at = held + len(flat), at + 1
                            flat = ids.get_batch(at).column(0).values.to_numpy(zero_copy_only=True)
                        part = flat[start + done - held : start + n - held]
                        crc, done = zlib.crc32(part.astype("<u4").tobytes(), crc), done + len(part)
                    crcs.append(crc)
                starts = pa.array(rows.column(1).to_numpy() + first)
                yield pa.RecordBatch.from_arrays([rows.column(0), starts, rows.column(2), pa.array(crcs, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame([(p, s) for p, s, _ in shards], "path string, first long")
    return listed.repartition(max(1, len(shards))).mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", length: int = SEQUENCE) -> DataFrame:
    """Write the files and return, read back from them, key, start, n_tokens, ids_crc32."""
    shards = write_shards(docs, tokenizer, end_id, key, text, length)
    return read_shards(docs.sparkSession, shards).withColumnRenamed("key", key)
