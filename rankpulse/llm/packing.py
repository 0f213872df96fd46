"""Packing of token sequences into windows of a fixed length, online and in bounded space.

Each task keeps at most `open_windows` windows open. A document's ids are cut at whole windows; what is left goes into the open
window that it fills best, or else into a new one; with all open and none that takes it, the fullest is emitted: topped up with
the head of the piece if its gap is `min_cut` or more. Windows still open at a task's end are merged with those of neighbouring
tasks, again best fit, on their lengths alone.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoders
from .common import in_arrow, stored

#: Tasks whose leftovers are merged by one task.
MERGE = 256
#: Sequence ids are task << SHIFT | number; merged ones follow from the high bit.
SHIFT, MERGED = 32, 1 << 61


class Open:
    """The open windows of a task, ordered by fill."""

    def __init__(self, size: int, most: int, min_cut: int):
        self.size, self.most, self.min_cut = size, most, min_cut
        self.fills: list[tuple[int, int]] = []  # (fill, window), sorted
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, length: int) -> list[tuple[int, int, int]]:
        """(window, offset, length) of each piece that `length` ids (up to a window) are cut into."""
        out = []
        if length == self.size:
            return [(self.new(), 0, length)]
        i = bisect.bisect_right(self.fills, (self.size - length, 1 << 60)) - 1
        if i < 0 and len(self.fills) >= self.most:
            fill, window = self.fills.pop()
            if (gap := self.size - fill) >= self.min_cut and length - gap >= self.min_cut:
                out.append((window, fill, gap))
                return out + self.place(length - gap)
        if i >= 0:
            fill, window = self.fills.pop(i)
        else:
            fill, window = 0, self.new()
        if fill + length < self.size:
            bisect.insort(self.fills, (fill + length, window))
        return [*out, (window, fill, length)]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, window long, offset long, ids binary"


def pack(
    docs: DataFrame, tokenizer: str, ranks: str, pattern: str, end_id: int, size: int = 2048, open_windows: int = 64, min_cut: int = 16,
    with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset [, ids] of each piece of every row's ids.

    Ids come from a byte-level `tokenizers` file, end_id follows each document's. No rows are shuffled but the leftovers' numbers: at
    most open_windows a task. A null or empty text packs its end id; null ids of documents stay; repeated rows are packed each; an
    empty table gives no rows. ids: the piece's ids as packed uint32, if asked for.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoders.shared(encoders.ByteLevel, tokenizer, ranks, pattern)
        task, end = TaskContext.get().partitionId(), struct.pack("<I", end_id)
        windows = Open(size, open_windows, min_cut)
        for batch in batches:
            found: list[tuple] = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), encoder.each(batch.column(1)), strict=True):
                raw = memoryview(b"".join((raw, end)))
                total, start = len(raw) // 4, 0
                while start < total:
                    for window, offset, length in windows.place(min(size, total - start)):
                        piece = raw[4 * start : 4 * (start + length)]
                        found.append((doc_id, start, length, zlib.crc32(piece), total, task, window, offset, bytes(piece) if with_ids else None))
                        start += length
            yield pa.record_batch([pa.array(c, pa.binary() if i == 8 else pa.int64()) for i, c in enumerate(zip(*found, strict=True))], [c.split()[0] for c in PIECES.split(", ")])
        if windows.fills:  # said by rows of length 0
            left = [(None, None, 0, None, None, task, window, fill, None) for fill, window in windows.fills]
            yield pa.record_batch([pa.array(c, pa.binary() if i == 8 else pa.int64()) for i, c in enumerate(zip(*left, strict=True))], [c.split()[0] for c in PIECES.split(", ")])

    pieces = stored(in_arrow(rows, run, PIECES), "packing")
    left = pieces.where("length = 0").select("task", "window", F.col("offset").alias("fill"))
    moved = left.withColumn("share", F.floor(F.col("task") / MERGE)).groupBy("share").applyInPandas(
        lambda group: merge(group, size), "task long, window long, sequence_id long, shift long"
    )
    own = F.shiftleft("task", SHIFT).bitwiseOR(F.col("window"))
    return pieces.where("length > 0").join(moved, ["task", "window"], "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.coalesce("sequence_id", own).alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset"), *(["ids"] if with_ids else []),
    )


def merge(left: pd.DataFrame, size: int) -> pd.DataFrame:
    """Where leftover windows (task, window, fill) of neighbouring tasks go: longest first, each into the window that it fills best."""
    left = left.sort_values(["fill", "task", "window"], ascending=[False, True, True])
    share = int(left["share"].iloc[0])
    fills: list[tuple[int, int]] = []
    out, made = [], 0
    for task, window, fill in left[["task", "window", "fill"]].itertuples(index=False):
        i = bisect.bisect_right(fills, (size - fill, 1 << 60)) - 1
        at, into = fills.pop(i) if i >= 0 else (0, made)
        made += i < 0
        bisect.insort(fills, (at + fill, into))
        out.append((task, window, MERGED | share << SHIFT | into, at))
    return pd.DataFrame(out, columns=["task", "window", "sequence_id", "shift"]).astype(np.int64)
