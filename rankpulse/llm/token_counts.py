"""Token counts with a digest cache.

The cache is a Parquet table (text_digest, version_digest, n_tokens). A run joins digests of its texts to it, encodes each distinct
text that it lacks once, and appends those counts; texts are shuffled once, and copies are merged before that shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encoders
from .common import arrow_map, stored, work_dir

CACHE_SCHEMA = "text_digest binary, version_digest string, n_tokens long"


def version_digest(path: str) -> str:
    """SHA-256 of a tokenizer file: counts of another version are other rows of the cache."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    docs: any columns besides the two named; they are not kept. tokenizer: a sentencepiece file. cache: path of the cache, read if
    it exists and appended to; None is one for this run alone. Nulls and empty texts count 0 bytes and tokens; a null id is kept;
    repeated rows give a row each; an empty table gives none.
    """
    spark = docs.sparkSession
    version, cache = version_digest(tokenizer), cache or work_dir(spark, "token-counts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_digest"))
    known = _read(spark, cache, version)
    distinct = rows.groupBy("text_digest").agg(F.first("text").alias("text"))
    if known is not None:
        distinct = distinct.join(known, "text_digest", "left_anti")

    def start():
        encoder = encoders.shared(encoders.PieceCounts, tokenizer)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = pa.array(np.array(encoder.counts(batch.column("text")), dtype=np.int64))
            return pa.record_batch([batch.column("text_digest"), pa.array([version] * batch.num_rows), counts], ["text_digest", "version_digest", "n_tokens"])

        return one

    arrow_map(distinct.select("text_digest", "text"), CACHE_SCHEMA, start).write.mode("append").parquet(cache)
    counts = stored(_read(spark, cache, version), "token-counts")  # so that the join below may split a hot digest
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("text_digest"))
    return sizes.join(counts, "text_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _read(spark, cache: str, version: str) -> DataFrame | None:
    """The cache's counts of one version; None if there is no cache yet. Rows that two runs appended at once are merged."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    kept = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version_digest") == version)
    return kept.groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))
