"""Token ids in length-delimited binary files, with an offset index beside them.

A file `part-NNNNN-NNN-*.ids` starts with 8 bytes: the magic `RPID`, the version, the bytes of an id (2 or 4), two zeros. A record follows
for each document, all numbers little-endian: payload length (8 bytes), masked checksum of those 8 bytes (4), payload (packed ids),
masked checksum of the payload (4). The checksum is CRC-32 of zlib, masked as ((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2**32. The
index is a Parquet table (doc_id, part, file, offset, n_tokens), so that single records can be read in any order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import encoders
from .common import in_arrow

MAGIC, VERSION = b"RPID", 1
HEADER = 8
INDEX_SCHEMA = "doc_id long, part long, file string, offset long, n_tokens long"
#: A task begins another file beyond this size.
FILE_BYTES = 256 << 20


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes | memoryview) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(stream) -> Iterator[bytes]:
    """Payloads of a stream after its header; ValueError at a wrong checksum or a cut record."""
    while head := stream.read(12):
        if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
            raise ValueError("a record's length is damaged")
        size = struct.unpack("<Q", head[:8])[0]
        body = stream.read(size + 4)
        if len(body) < size + 4 or masked(memoryview(body)[:size]) != struct.unpack("<I", body[size:])[0]:
            raise ValueError("a record's payload is damaged")
        yield body[:size]


def file_system(uri: str):
    """pyarrow's file system of a URI and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts of docs and write them in ascending order of id under path (`data/` and `index/`).

    tokenizer: a `tokenizers` file with word ends; end_id is appended to each document. Rows are dealt by ranges of id, so the order
    holds across files too; equal ids follow each other by text, null ids come first, null texts are empty. A task writes a file of
    a name of its own and moves it into place when whole; only files that the index names count, so a task that runs again or twice
    does no harm. An empty table gives an empty index and no files.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoders.shared(encoders.WordEnds, tokenizer)
        end, task, tag = struct.pack("<H", end_id), TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        disk, at = file_system(path)
        disk.create_dir(f"{at}/data", recursive=True)
        out, name, made, offset, index = None, "", 0, HEADER, []

        def close() -> Iterator[pa.RecordBatch]:
            """Move the file into place, then say what it holds."""
            out.close()
            disk.move(f"{at}/data/.{name}", f"{at}/data/{name}")
            for ids, offsets, counts in index:
                n = len(offsets)
                columns = [ids, pa.array([(task << 20) + made] * n, pa.int64()), pa.array([name] * n), pa.array(offsets, pa.int64()), pa.array(counts, pa.int64())]
                yield pa.record_batch(columns, ["doc_id", "part", "file", "offset", "n_tokens"])

        try:
            for batch in batches:
                if out is not None and offset > FILE_BYTES:
                    yield from close()
                    out, made, index = None, made + 1, []
                if out is None:
                    name, offset = f"part-{task:05d}-{made:03d}-{tag}.ids", HEADER
                    out = disk.open_output_stream(f"{at}/data/.{name}")
                    out.write(MAGIC + bytes([VERSION, 2, 0, 0]))
                offsets, counts = [], []
                for raw in encoder.each(batch.column(1)):
                    payload = b"".join((raw, end))
                    record = frame(payload)
                    out.write(record)
                    offsets.append(offset)
                    counts.append(len(payload) // 2)
                    offset += len(record)
                index.append((batch.column(0), offsets, counts))
            if out is not None:
                yield from close()
                out = None
        finally:
            if out is not None:
                out.close()

    in_arrow(ordered, run, INDEX_SCHEMA).write.parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def _open(disk, at: str, name: str):
    stream = disk.open_input_stream(f"{at}/data/{name}", buffer_size=1 << 20)
    head = stream.read(HEADER)
    if head[:5] != MAGIC + bytes([VERSION]):
        raise ValueError(f"{name} isn't such a file")
    return stream, f"<u{head[5]}"


def _index_order(raw: DataFrame) -> DataFrame:
    """One row a file with the ids in all files before it. The window runs over a row a file, not over documents."""
    files = raw.groupBy("part", "file").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("part", "file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("before"))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids before the document's, over all files), n_tokens, ids_crc32 (of uint32 ids), [ids] read from the files.

    The index is dealt by file and read in the order of offsets, a row at a time beside the file's stream, so that a task holds one
    record, not a file's index. Every checksum is checked.
    """
    index = read_index(spark, path)
    rows = index.join(_index_order(index), ["part", "file"]).select("part", "file", "before", "offset", "doc_id")
    plan = rows.repartition("part", "file").sortWithinPartitions("part", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, at = file_system(path)
        current, stream, out, held = None, None, [], 0
        for batch in batches:
            for name, before, expected, doc_id in zip(*(batch.column(c).to_pylist() for c in ("file", "before", "offset", "doc_id")), strict=True):
                if name != current:
                    _ended(stream)
                    (stream, kind), current, start, offset = _open(disk, at, name), name, before, HEADER
                    records = unframe(stream)
                payload = next(records, None)
                if payload is None or expected != offset:
                    raise ValueError("the index and the file don't agree")
                ids = np.frombuffer(payload, kind).astype("<u4")
                out.append((doc_id, start, len(ids), zlib.crc32(ids), ids if with_ids else None))
                start, offset, held = start + len(ids), offset + len(payload) + 16, held + len(payload) * with_ids
                if len(out) >= 10_000 or held > 8_000_000:
                    yield _batch(out, with_ids)
                    out, held = [], 0
        _ended(stream)
        if out:
            yield _batch(out, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return in_arrow(plan, run, schema)


def _ended(stream) -> None:
    """Close a stream of which all records have been read."""
    if stream is not None:
        if stream.read(1):
            raise ValueError("a file holds more than the index says")
        stream.close()


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
    if with_ids:
        columns.append(pa.array([r[4].astype(np.int64) for r in rows], pa.list_(pa.int64())))
    return pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """doc_id, ids of every record in an order by seed: each is found by its offset in the index, no file is read from its start."""
    order = read_index(spark, path).withColumn("key", F.xxhash64("doc_id", "file", "offset", F.lit(seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, at = file_system(path)
        opened: dict[str, tuple] = {}
        for batch in batches:
            found = []
            for name, offset, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "n_tokens")), strict=True):
                if name not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened)))[0].close()
                    f = disk.open_input_file(f"{at}/data/{name}")
                    opened[name] = f, f"<u{f.read(HEADER)[5]}"
                f, kind = opened[name]
                f.seek(offset)
                found.append(np.frombuffer(next(unframe(_Once(f, 16 + n * int(kind[2:])))), kind).astype(np.int64))
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "ids"])

    ordered = order.repartitionByRange("key").sortWithinPartitions("key").select("doc_id", "file", "offset", "n_tokens")
    return in_arrow(ordered, run, "doc_id long, ids array<long>")


class _Once:
    """The next `size` bytes of a file as a stream."""

    def __init__(self, file, size: int):
        self.data, self.at = file.read(size), 0

    def read(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += n
        return out
