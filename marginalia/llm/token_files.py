"""Token ids in ORC files.

A document is a row: its id, the ids of its text with the end id, and the count.
ORC stores integers in run-length encoding, keeps row indexes with smallest and
largest values and a Bloom filter on ``doc_id`` for each stripe, so tasks read
stripe by stripe and a lookup by id skips the stripes that can't hold it. Files
are written in ascending ``doc_id`` order, by ranges that Spark samples.

Nulls: a null text is empty (just the end id); rows with a null ``doc_id`` come
first. Rows that repeat an id keep a row each, ordered by digest and text; ranges
are cut by the digest too, so very many rows of one id are no single range.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_batches, texts
from .tokens import encoder


def with_end(df: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids) of each row: the ids of the whole text and ``end_id`` after them."""
    end = np.array([end_id], "<i4").tobytes()

    @by_batches
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer)
        parts = [enc.encode(x) for x in texts(batch.column(1))]
        counts = np.array([len(x) // 4 + 1 for x in parts])
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<i4")
        packed = b"".join(itertools.chain.from_iterable((x, end) for x in parts))
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), len(packed) // 4, [None, pa.py_buffer(packed)]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), ids], ["doc_id", "n_tokens", "ids"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>")


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int, stripe_mb: int = 16, rows_per_index: int = 1000) -> None:
    """Write ``df(doc_id, text)`` as ORC token files in ascending ``doc_id`` order. Texts are dealt by range before they are encoded, so only texts move."""
    keyed = df.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    ranged = keyed.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text")
    (
        with_end(ranged, tokenizer, end_id)
        .write.option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(rows_per_index))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) with the columns and row ranges that are asked for; a filter on ``doc_id`` reaches stripe statistics and Bloom filters."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path)


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): where each document lies in the running row of all ids, and a checksum of its stored ids.

    Row counts and sums by file come from one narrow column; within a file the
    rows are already in order. Each file's rows are summed in one group, files by one row each.
    """
    rows = read_token_files(spark, path).select("doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))

    @by_batches
    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(2)
        offsets, values = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[3:], pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "file", "block", "at", "ids_crc32"])

    checked = rows.mapInArrow(check, "doc_id long, n_tokens long, file string, block long, at long, ids_crc32 long")
    files = read_token_files(spark, path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n_tokens").alias("in_file"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")  # files are numbered in the order of their ranges
    before = files.select("file", (F.sum("in_file").over(Window.orderBy(number, "file")) - F.col("in_file")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("block", "at")) - F.col("n_tokens")
    return checked.withColumn("inside", inside).join(before.hint("shuffle_merge"), "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
