"""Exact nearest neighbours by cells around pivots.

1. A pivot is a row of the base; each key has one for ``ROWS_A_CELL`` rows, ``MOST_CELLS`` at
   most, one of each range of the vectors' digests. So cells keep their size as the base grows.
2. Each row of the base belongs to the cell of its nearest pivot. A cell keeps its rows' least
   and greatest coordinates, and how near and how far they lie from the pivot.
3. A query first meets up to ``ROWS_A_CELL`` rows in the cell of its own nearest pivot. These and
   the pivots of the other cells are rows of the base, so its k-th neighbour is no farther than
   the k-th of them. A cell holds no row nearer than its box, and by the triangle inequality none
   nearer than max(distance to the pivot - far, near - distance). So a query goes only to cells
   that this bound reaches; there it meets all rows, in blocks of bounded size.
4. The k best of each cell are ranked once more.

The result is that of comparing every query with every row, ties by id included.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.sources.scratch import saved

from .classify import as_arrays, nearest_neighbours, packed

#: Bounds are compared with this relative slack, for the sums' rounding.
SLACK = 1e-9
ROWS_A_CELL = 256
MOST_CELLS = 2048
#: A key's cells are given to its blocks of rows in as many copies, so that many tasks share a key.
SHARES = 16
#: Rows of a block that are held against all cells at once.
CHUNK = 512


def _pivots(base: DataFrame, keys: list[str], pivots: int | None) -> DataFrame:
    """(keys, pivots): the vectors of one row of each range of digests."""
    if pivots:
        dealt = base.withColumn("n", F.lit(pivots))
    else:
        sizes = base.groupBy(*keys).agg(F.least(F.ceil(F.count("*") / ROWS_A_CELL), F.lit(MOST_CELLS)).alias("n"))
        dealt = base.join(sizes.hint("shuffle_merge"), keys)
    slots = dealt.groupBy(*keys, F.pmod(F.xxhash64("v"), F.col("n")).alias("slot")).agg(F.min_by("v", F.struct(F.xxhash64("v", F.lit(1)), "v")).alias("v"))
    return saved(slots.groupBy(*keys).agg(F.array_sort(F.collect_set("v")).alias("pivots")), "pivots")


def _by_blocks(df: DataFrame, fields: Sequence[str], given: DataFrame, keys: list[str], work: Callable[..., pa.RecordBatch], made: str) -> DataFrame:
    """(keys, ``made``): what ``work`` makes of each block of ``df`` and the row of ``given`` with its key."""
    blocks = packed(df, keys, fields, "rows", 4096).withColumn("__share", F.pmod("__block", F.lit(SHARES))).drop("__block")
    copies = given.withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    met = blocks.join(copies.hint("shuffle_merge"), [*keys, "__share"]).drop("__share")
    others = [c for c in given.columns if c not in keys]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                found = work(batch.column("rows")[r].values, *(batch.column(c)[r].values for c in others))
                same = pa.array(np.full(found.num_rows, r))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(same) for c in keys), *found.columns], [*keys, *found.schema.names])

    kinds = "".join(f"`{c}` {met.schema[c].dataType.simpleString()}, " for c in keys)
    return met.mapInArrow(each, kinds + made)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _distances(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """From each row to each box; a point is a box from itself to itself."""
    squares = np.zeros((len(rows), len(low)))
    for j in range(rows.shape[1]):
        x = rows[:, j, None]
        squares += np.maximum(np.maximum(low[:, j] - x, x - high[:, j]), 0.0) ** 2
    return np.sqrt(squares)


def _place(rows: pa.StructArray, pivots: pa.ListArray) -> pa.RecordBatch:
    """Rows with the cell of their nearest pivot, and how far off it is."""
    _, _, v = as_arrays(rows)
    p, cell, off = _matrix(pivots), np.zeros(len(v), np.int32), np.zeros(len(v))
    for i in range(0, len(v), CHUNK):
        d = _distances(v[i : i + CHUNK], p, p)
        cell[i : i + CHUNK], off[i : i + CHUNK] = d.argmin(axis=1), d.min(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(cell), rows.field("id"), rows.field("label"), rows.field("v"), pa.array(off)], ["cell", "id", "label", "v", "off"])


def _reach(rows: pa.StructArray, pivots: pa.ListArray, boxes: pa.StructArray) -> pa.RecordBatch:
    """A row for each query and cell that may hold one of its k nearest; ``close`` has the distances of k rows of the query's own cell, infinite where it has fewer."""
    _, _, v = as_arrays(rows)
    own, close, p = rows.field("cell").to_numpy(zero_copy_only=False), _matrix(rows.field("close")), _matrix(pivots)
    low, high = (_matrix(boxes.field(c)) for c in ("low", "high"))
    near, far = (boxes.field(c).to_numpy(zero_copy_only=False) for c in ("near", "far"))
    k, at, cells = close.shape[1], [], []
    for i in range(0, len(v), CHUNK):
        x = v[i : i + CHUNK]
        d = _distances(x, p, p)
        others = d.copy()
        others[np.arange(len(x)), own[i : i + CHUNK]] = np.inf  # its rows are in ``close``
        bound = np.partition(np.hstack([close[i : i + CHUNK], others]), k - 1)[:, k - 1, None]
        least = np.maximum(_distances(x, low, high), np.maximum(d - far, near - d))
        q, c = np.nonzero(least <= bound + SLACK * (1 + bound + d))
        at.append(q + i)
        cells.append(c)
    at = pa.array(np.concatenate(at))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).astype(np.int32)), rows.field("id").take(at), rows.field("v").take(at)], ["cell", "id", "v"])


def cells(queries: DataFrame, base: DataFrame, k: int, keys: list[str], pivots: int | None = None, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Saved (keys, cell, id, label, v) of the base, and (keys, cell, id, v) of the queries: one row for each cell that may hold one of a query's k nearest."""
    chosen = _pivots(base, keys, pivots)
    row, made = ("id", F.col("label").cast("int").alias("label"), "v"), "cell int, id long, label int, v array<double>, off double"
    placed = saved(_by_blocks(base, row, chosen, keys, _place, made), "placed")
    own = saved(_by_blocks(queries.withColumn("label", F.lit(None)), row, chosen, keys, _place, made).drop("label", "off"), "own-cells")
    edges = placed.select(*keys, "cell", F.posexplode("v").alias("dim", "x")).groupBy(*keys, "cell", "dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    boxes = edges.groupBy(*keys, "cell").agg(F.array_sort(F.collect_list(F.struct("dim", "low", "high"))).alias("e")).select(*keys, "cell", F.col("e.low").alias("low"), F.col("e.high").alias("high"))
    rings = placed.groupBy(*keys, "cell").agg(F.min("off").alias("near"), F.max("off").alias("far"))
    summary = boxes.join(rings.hint("shuffle_merge"), [*keys, "cell"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "low", "high", "near", "far"))).alias("boxes"))
    known = saved(chosen.join(summary.hint("shuffle_merge"), keys), "cells")
    some = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "cell").orderBy(F.xxhash64("id"), "id"))).where(F.col("nth") <= max(k, ROWS_A_CELL))
    met = nearest_neighbours(own, some, k, (*keys, "cell"), block).groupBy(*keys, "cell", F.col("query").alias("id")).agg(F.array_sort(F.collect_list("distance")).alias("close"))
    infinite = F.array_repeat(F.lit(float("inf")), k)
    close = F.slice(F.concat("close", infinite), 1, k)
    bounded = saved(own.join(met.hint("shuffle_merge"), [*keys, "cell", "id"]).withColumn("close", close), "bounded")
    asked = _by_blocks(bounded, ("id", F.lit(None).cast("int").alias("label"), "v", "cell", "close"), known, keys, _reach, "cell int, id long, v array<double>")
    return placed.drop("off"), saved(asked, "asked-cells")


def pivot_neighbours(queries: DataFrame, base: DataFrame, k: int, keys: tuple[str, ...], pivots: int | None = None, block: int = 1024) -> DataFrame:
    """(keys, query, neighbour, label, distance, rank): the k nearest of ``base(keys, id, label, v)`` to each of ``queries(keys, id, v)`` of the same key, by Euclidean distance, ties by id."""
    rows = lambda df, *more: df.select(*keys, F.col("id").cast("long").alias("id"), *more, F.col("v").cast("array<double>").alias("v"))
    placed, asked = cells(saved(rows(queries), "queries"), saved(rows(base, "label"), "base"), k, list(keys), pivots, block)
    found = nearest_neighbours(asked, placed, k, (*keys, "cell"), block).drop("rank", "cell")
    rank = F.row_number().over(Window.partitionBy(*keys, "query").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
