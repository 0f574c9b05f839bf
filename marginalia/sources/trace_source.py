"""Trace files as a data source: ``spark.read.format("traces").load(base)``.

A filter on ``model`` reaches the source, which then lists and reads the folders of these
models only. The driver lists the folders of models, never their files: a task lists its
model's folder itself and reads its share of the files by their names' checksums.

As a stream (``spark.readStream``), a batch is a span of time: it has the files that were
last written in that span, so a trace that is written anew comes again.
"""

from __future__ import annotations

import re
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .scan import parse_traces

#: The question's number in a file's name, the first pattern that fits (fixed forms of the trace files).
QUESTION_ID = (r"question_id_([0-9]+)", r"question_id_sample_([0-9]+)")


@dataclass
class Share(InputPartition):
    """The files of a model's folder whose checksums leave ``number`` when divided by ``of``, last written after ``after`` and up to ``until`` (ms; None: at any time)."""

    model: str
    folder: str
    number: int
    of: int
    after: int | None = None
    until: int | None = None

    def holds(self, name: str, written: int) -> bool:
        return zlib.crc32(name.encode()) % self.of == self.number and (self.after is None or self.after < written <= self.until)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path).rstrip("/"))


def is_hidden(name: str) -> bool:
    return name.startswith((".", "_"))


def question_of(name: str) -> str | None:
    """The question id in a trace file's path below its model's folder; None for raw outputs, files of other kinds and those without an id."""
    if "raw_output" in name or not name.endswith(".txt") or any(map(is_hidden, name.split("/"))):
        return None
    return next((m[1] for m in (re.search(p, name) for p in QUESTION_ID) if m), None)


class Folders:
    """What both readers share: the models' folders, and whole files below them as rows of ``columns``."""

    def __init__(self, base: str, shares: int, columns: list[str], files: str | None = None) -> None:
        self.base, self.shares, self.columns, self.models = base, shares, columns, None
        self.folder, self.below = (None, None) if files is None else files.split("/", 1)

    def is_named(self, folder: str) -> bool:
        """Whether a model's folder fits the pattern, which takes hidden ones in; without one they are left out."""
        return not is_hidden(folder) if self.folder is None else fnmatchcase(folder, self.folder)

    def is_below(self, name: str) -> bool:
        """Whether a path below a model's folder fits the pattern, step by step."""
        steps, wanted = name.split("/"), (self.below or "").split("/")
        return self.below is None or len(steps) == len(wanted) and all(map(fnmatchcase, steps, wanted))

    def folders(self) -> list[tuple[str, str]]:
        """(model, folder) of the models that are asked for; ``key=`` before a name is no part of it."""
        found, root = file_system(self.base)
        named = [(re.sub(r"^[^/=]+=", "", x.base_name), x.base_name) for x in found.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.Directory and self.is_named(x.base_name)]
        return sorted((m, f) for m, f in named if self.models is None or m in self.models)

    def shares_between(self, after: int | None = None, until: int | None = None) -> list[Share]:
        return [Share(m, f, i, self.shares, after, until) for m, f in self.folders() for i in range(self.shares)]

    def read(self, partition: Share | None) -> Iterator[tuple]:
        if partition is None:  # no folder fits
            return
        found, root = file_system(f"{self.base.rstrip('/')}/{partition.folder}")
        for x in found.get_file_info(fs.FileSelector(root, recursive=True)):
            name, written = x.path[len(root) :].lstrip("/"), (x.mtime_ns or 0) // 1_000_000
            question = question_of(name) if x.type == fs.FileType.File and self.is_below(name) else None
            if question is not None and partition.holds(name, written):
                with found.open_input_stream(x.path) as data:
                    row = {"model": partition.model, "question_id": question, "value": data.read().decode("utf-8", "replace"), "written": written}
                yield tuple(row[c] for c in self.columns)


class TraceReader(Folders, DataSourceReader):
    """Reads all files at once; filters on ``model`` choose the folders."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes the equalities on ``model``; Spark checks the others."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("model",):
                yield f
            else:
                self.models = wanted if self.models is None else self.models & wanted

    def partitions(self) -> list[Share]:
        return self.shares_between()


class TraceStreamReader(Folders, DataSourceStreamReader):
    """An offset is a time: the files last written up to it have been read. It stays ``settle`` seconds behind the clock, for writers whose files show up late."""

    def __init__(self, base: str, shares: int, columns: list[str], settle: float) -> None:
        super().__init__(base, shares, columns)
        self.settle = settle

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": int((time.time() - self.settle) * 1000)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.shares_between(start["until"], end["until"])


class TraceSource(DataSource):
    """Options: ``path``, the folder that holds a folder a model; ``files``, a pattern of the files' paths below it (all depths without one); ``shares``, the tasks that share a folder (4); ``settle``, how many seconds a stream waits for a file (10). A schema may also name ``written``, the time of a file in ms (long)."""

    @classmethod
    def name(cls) -> str:
        return "traces"

    def schema(self) -> str:
        return "model string, question_id string, value string"

    def reader(self, schema: StructType) -> TraceReader:
        return TraceReader(self.options["path"], int(self.options.get("shares", 4)), schema.names, self.options.get("files"))

    def streamReader(self, schema: StructType) -> TraceStreamReader:
        return TraceStreamReader(self.options["path"], int(self.options.get("shares", 4)), schema.names, float(self.options.get("settle", 10)))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, filters included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceSource)


def load_traces(spark: SparkSession, base: str, models: Iterable[str] = (), shares: int = 4) -> DataFrame:
    """(model, question_id, question, thinking, answer) as ``scan.scan_traces``, of ``models`` only if there are any. Repeated questions stay; an empty file has empty sections."""
    register(spark)
    rows, wanted = spark.read.format("traces").option("shares", shares).load(base), list(models)
    return parse_traces(rows.where(rows["model"].isin(wanted)) if wanted else rows)


def write_files(rows: DataFrame, base: str) -> None:
    """A text file ``base/folder/name`` for each of ``rows(folder, name, value)``. Tasks write the files themselves, each under a hidden name first, so a task that runs again leaves the same files; nothing is left for the driver to move."""

    def write(part: Iterator[Row]) -> None:
        found, root = file_system(base)
        made = set()
        for r in part:
            folder = f"{root}/{r['folder']}"
            if folder not in made:
                found.create_dir(folder)
                made.add(folder)
            hidden = f"{folder}/.{uuid.uuid4().hex}"
            with found.open_output_stream(hidden) as out:
                out.write((r["value"] or "").encode())
            found.move(hidden, f"{folder}/{r['name']}")

    file_system(base)[0].create_dir(file_system(base)[1])  # there without rows, too
    rows.select("folder", "name", "value").foreachPartition(write)


def stream_traces(spark: SparkSession, base: str, shares: int = 4, settle: float = 10) -> DataFrame:
    """A stream of (model, question_id, version, question, thinking, answer): traces as they are written; a later file of a question is a higher version."""
    register(spark)
    rows = spark.readStream.format("traces").schema("model string, question_id string, written long, value string").option("shares", shares).option("settle", settle).load(base)
    return parse_traces(rows.withColumnRenamed("written", "version"))


def sample_facts(facts: DataFrame, split: str) -> DataFrame:
    """Facts of traces, as (split, model, sample_id, version, code_name, cnt)."""
    return facts.select(F.lit(split).alias("split"), "model", F.col("question_id").alias("sample_id"), "version", "code_name", "cnt")
