"""Packing documents into training sequences.

A document is the ids of its text and a separator id. Only a document longer
than a sequence is cut: from its end into full pieces, so the first piece may be
shorter. Groups of pieces are packed by best-fit decreasing. Dual feasible
functions give a lower bound for each group's number of sequences; a group that
meets its bound is certified and done. The documents of the others are dealt out
anew among fewer, differently mixed groups and packed again, and so are, at the
end, the documents in half-empty sequences of all groups.

Nulls: a null text is empty and gives one piece, the separator alone. Rows with
a null or repeated ``doc_id`` are packed like any other: pieces are dealt by a row
number, so very many equal ones are no single group.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, saved, texts
from .tokens import encoder

GROUP = 40_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_KEPT = f"{PIECES}, row long"


def token_pieces(df: DataFrame, tokenizer: str, separator: int, capacity: int) -> DataFrame:
    """The pieces of every document, without their ids: where they start, how long they are and their checksum."""
    last = np.array([separator], "<u4").tobytes()

    @by_batches
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, rows = encoder(tokenizer), []
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            ids = enc.encode(text) + last
            n = len(ids) // 4
            edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
            rows += [(doc, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(cut, PIECES)


@functools.lru_cache(16)
def _bound_functions(capacity: int) -> np.ndarray:
    """Dual feasible functions at each length, scaled to integers: bins >= sum of a row / its value at full capacity (last column)."""
    x = np.arange(capacity + 1, dtype=np.int64)
    rows = [x]
    for eps in sorted({*range(1, capacity // 2 + 1, max(1, capacity // 128)), capacity // 3, capacity // 2}):
        if eps:
            rows.append(np.where(x > capacity - eps, capacity, np.where(x < eps, 0, x)))
    for k in range(1, 33):
        whole = (k + 1) * x % capacity == 0
        rows.append(np.where(whole, x * k, capacity * ((k + 1) * x // capacity)))
    return np.stack(rows)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing of these lengths has fewer sequences."""
    return lower_bound_of_counts(np.bincount(np.asarray(lengths, np.int64), minlength=capacity + 1), capacity)


def lower_bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """As ``lower_bound``, from the number of pieces of each length."""
    values = _bound_functions(capacity)
    sums = values @ counts
    return int((-(-sums // values[:, -1])).max())


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length: longest first, each into the fullest bin that still takes it. Bins of equal room are alike, so rooms are kept in a bit set."""
    order = np.argsort(-lengths, kind="stable")
    bins, free, rooms, used = np.empty(len(lengths), np.int64), [[] for _ in range(capacity + 1)], 0, 0
    for at, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                rooms &= ~(1 << room)
        else:
            room, b, used = capacity, used, used + 1
        bins[at] = b
        if left := room - length:
            free[left].append(b)
            rooms |= 1 << left
    return bins


def _pack_groups(df: DataFrame, capacity: int, groups: int, turn: int) -> DataFrame:
    """Pack each of ``groups`` groups by itself; adds sequence_id, offset, used (of the sequence), gap (of the group)."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32", "row"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins = best_fit_decreasing(lengths, capacity)
        used = np.bincount(bins, weights=lengths).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        offset = np.empty(len(rows), np.int64)
        offset[order] = before - np.concatenate([[0], np.cumsum(used)])[bins[order]]
        sequence = (turn << 52) + (int(key[0]) << 26) + bins
        return rows.drop(columns="bucket").assign(sequence_id=sequence, offset=offset, used=used[bins], gap=len(used) - lower_bound(lengths, capacity))

    bucket = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups))
    return df.select("doc_id", "piece", "start", "length", "ids_crc32", "row", bucket.alias("bucket")).groupBy("bucket").applyInPandas(pack, f"{_KEPT}, sequence_id long, offset long, used long, gap long")


def pack_pieces(pieces: DataFrame, capacity: int, group: int = GROUP, turns: int = 3) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of saved ``pieces(..., row)``. ``group`` is the usual number of pieces that a task packs."""
    rest, done, count = pieces, [], pieces.count()
    for turn in range(turns):
        groups = max(1, -(-count // group))
        packed = saved(_pack_groups(rest, capacity, groups, turn), "packed")
        done.append(packed.where(F.col("gap") == 0))
        rest = packed.where(F.col("gap") > 0)
        if groups == 1 or not (count := rest.count()):
            break
    whole = functools.reduce(DataFrame.unionByName, [*done, rest])
    open_ = F.col("used") <= capacity * 7 // 8
    count, before = whole.where(open_).agg(F.count("*"), F.count_distinct("sequence_id")).first()
    if before > 1:
        again = saved(_pack_groups(whole.where(open_), capacity, -(-count // group), turns), "packed")
        if again.agg(F.count_distinct("sequence_id")).first()[0] < before:
            whole = whole.where(~open_).unionByName(again)
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(df: DataFrame, tokenizer: str, separator: int, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Pack ``df(doc_id, text)``: pieces are made and saved once, then only their lengths move."""
    pieces = token_pieces(df, tokenizer, separator, capacity).withColumn("row", F.monotonically_increasing_id())
    return pack_pieces(saved(pieces, "pieces"), capacity, group)


def certificate(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row (sequences, bound, pieces) of packed pieces: how many sequences there are, and that no packing of all pieces has fewer than ``bound``. Only sums by length reach the driver, as many rows as a sequence has tokens."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in packed.groupBy("length").count().collect():
        counts[length] = n
    sequences = packed.agg(F.count_distinct("sequence_id")).first()[0]
    return packed.sparkSession.createDataFrame([(sequences, lower_bound_of_counts(counts, capacity), int(counts.sum()))], "sequences long, bound long, pieces long")
