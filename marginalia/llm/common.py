"""Shared pieces: scratch tables in the shared folder, inputs, word hashing."""

from __future__ import annotations

import atexit
import contextlib
import itertools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Words are runs of characters outside ``[\x20\x09-\x0D]``; ``bytes.split()`` cuts at exactly these.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``). Where it is unset, a session in one process (as in tests) gets one of its own; a cluster, whose executors would not see that, is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[[^-]|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="marginalia-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Folders of saved tables that are still there, in the order of their making.
_MADE: list[str] = []


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage is cut, and Spark knows the true size."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of tables made by ``saved`` that nothing reads any more."""
    _delete(spark, [x for df in tables for x in _folders(df)])


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables saved inside are deleted at the end, but for those that are put into the list."""
    before, kept = len(_MADE), []
    yield kept
    stay = {name for df in kept for name in _folders(df)}
    _delete(spark, [x for x in _MADE[before:] if x not in stay])


def _folders(df: DataFrame) -> list[str]:
    names = {file.rsplit("/", 2)[-2] for file in df.inputFiles()}
    return [x for x in _MADE if x.rsplit("/", 1)[-1] in names]


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _MADE.remove(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Remembered(dict):
    """A bounded memo of ``make(key)``: two generations, the older one is forgotten when the younger is full."""

    def __init__(self, make, cap: int = 200_000):
        super().__init__()
        self.make, self.cap, self.old = make, cap, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_WORD_HASHES = Remembered(xxhash.xxh3_64_intdigest)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Stable 64-bit hashes of words."""
    return np.fromiter(map(_WORD_HASHES.__getitem__, words), np.uint64, len(words))


def texts(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


#: Bytes of input that a task takes up at once; one row may be more.
BATCH_BYTES = 4 << 20


def by_batches(make) -> object:
    """A ``mapInArrow`` function from a function of one record batch that isn't empty. Large batches are worked off in slices, so a task's memory doesn't follow their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                yield make(batch.slice(at, rows))

    return run


def by_sorted_groups(df: DataFrame, keys: list[str], work, schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """The rows (a list of tuples) that ``work`` makes of each group's columns (arrays, in order of ``df``).

    As ``applyInPandas``, for many small groups of bounded size: rows are dealt and
    sorted by the keys, which must be the first columns and never null, and by ``order``,
    and stream through ``mapInPandas``; one group at a time is held.
    """
    n = len(keys)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for rows in itertools.chain(batches, [None]):
            if rows is None:
                columns, edges = held, [0, len(held[0])] if held else [0]
            else:
                columns = [rows[c].to_numpy() for c in rows.columns]
                if held:
                    columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
                new = np.any([k[1:] != k[:-1] for k in columns[:n]], axis=0)
                edges = [0, *(np.flatnonzero(new) + 1)]
                held = [c[edges[-1] :] for c in columns]
            made = [x for i, j in itertools.pairwise(edges) for x in work(*(c[i:j] for c in columns))]
            yield pd.DataFrame(made, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


_CONTROL = re.compile(r"\W+")


def safe_label(text: str) -> str:
    return _CONTROL.sub("_", text)
