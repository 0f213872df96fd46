"""Byte-level BPE by a rank file, encoded through a sentencepiece model that is serialised from the vocabulary."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import encoders
from .common import arrow_map


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (packed little-endian uint32). Null texts are empty; each row gives one, in any order; no shuffle."""

    def start():
        encoder = encoders.shared(encoders.RankedBytes, ranks, pattern)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([batch.column(0), pa.array([bytes(x) for x in encoder.each(batch.column(1))], pa.binary())], ["doc_id", "ids"])

        return one

    return arrow_map(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "doc_id long, ids binary", start)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, text_bytes of the rows of encode(), by the inverse mapping of ids to bytes."""

    def start():
        encoder = encoders.shared(encoders.RankedBytes, ranks, pattern)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [bytes(encoder.decode(np.frombuffer(x or b"", "<u4"))) for x in batch.column("ids").to_pylist()]
            return pa.record_batch([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "text_bytes"])

        return one

    return arrow_map(encoded.select("doc_id", "ids"), "doc_id long, text_bytes binary", start)


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (what the ids decode to) of every row.

    The same encoder and decoder as encode() and decode(), in one pass. Null and empty texts have no ids: both digests are those
    of nothing. Null ids of documents stay null; repeated rows give a row each; other columns are dropped.
    """

    def start():
        encoder = encoders.shared(encoders.RankedBytes, ranks, pattern)
        names = np.array([f"{i}," for i in range(len(encoder.tokens))])
        names = pa.array(names.tolist(), pa.binary())

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, of_ids, of_text = [], [], []
            for raw in encoder.each(batch.column(1)):
                ids = np.frombuffer(raw, "<u4")
                said = names.take(pa.array(ids)).buffers()[2] if len(ids) else None
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(memoryview(said)[:-1] if said else b"").hexdigest())
                of_text.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            return pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return one

    return arrow_map(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", start)
