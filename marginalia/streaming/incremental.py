"""Incremental code counts: annotations arrive on a stream, a re-annotation replaces a sample's old facts.

Two streams follow each other. The first keeps each sample's newest version and codes as
state, a value a range of samples, and writes what newer ones change; the second keeps the counts themselves as
state. Reading the counts reads that state: a row a count, however many batches went by.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marginalia.functions.annotations import parse_counts
from marginalia.sources.scratch import scratch_path

FACT_KEYS = ("split", "model", "sample_id")
_CHANGES = "split string, model string, codes array<string>, deltas array<bigint>"
#: Ranges of a model's samples, by the digest of their ids; a folder's state holds for this number.
RANGES = 256
#: State with timers is kept in RocksDB. A batch without rows never follows: with timers there would be no last one.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def annotation_facts(annotations: DataFrame) -> DataFrame:
    """(split, model, sample_id, version, code_name, cnt) of ``annotations(split, model, sample_id, version, annotation)``; an annotation here is of one output, A. Nothing is shuffled."""
    keyed = annotations.select(F.struct(*FACT_KEYS, "version").alias("key"), "annotation")
    return parse_counts(keyed, "key").where("side = 'a'").select("key.*", "code_name", "cnt")


def latest_facts(facts: DataFrame) -> DataFrame:
    """The facts of each sample's highest version. The highest version is aggregated, not sorted, per sample."""
    top = facts.groupBy(*FACT_KEYS).agg(F.max("version").alias("version"))
    return facts.join(top.hint("shuffle_merge"), [*FACT_KEYS, "version"], "left_semi")


def code_counts(facts: DataFrame) -> DataFrame:
    """Samples that hold a code by split, code and model."""
    return latest_facts(facts).groupBy("split", "code_name", "model").agg(F.count_if(F.col("cnt") > 0).alias("n"))


class NewestCodes(StatefulProcessor):
    """The newest version of each sample of a range, and the codes that it holds.

    A call to the state costs a task about as much as a hundred samples, so a range of samples
    is one value. Newer annotations give a row of the codes that the range's samples gained,
    lost and name; ones that are no newer give none. With ``keep_ms`` a sample that nothing
    newer reached for so long loses its codes and its state, in the first batch after: that is
    how a retired taxonomy leaves the counts.
    """

    def __init__(self, keep_ms: int = 0) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "timer long, ids array<string>, versions array<long>, untils array<long>, codes array<array<string>>")

    def _stored(self) -> tuple[int, dict]:
        """The timer that is set (0: none), and (version, until, codes) by sample."""
        timer, ids, *rest = self.newest.get() or (0, [], [], [], [])
        return timer, dict(zip(ids, zip(*rest, strict=True), strict=True))

    def _store(self, timer: int, samples: dict) -> None:
        """Sets the timer anew, to when the first sample's time is up."""
        due = min((until for _, until, _ in samples.values()), default=0)
        if due != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if due:
                self.handle.registerTimer(due)
        columns = [list(x) for x in zip(*samples.values(), strict=True)] or [[], [], []]
        self.newest.update((due, list(samples), *columns))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        found: dict[str | None, tuple[int, dict[str, int]]] = {}
        for part in rows:
            ids = part["sample_id"].astype(object).where(part["sample_id"].notna(), None)
            for sample, version, code, n in zip(ids, part["version"].tolist(), part["code_name"], part["cnt"].tolist(), strict=True):
                top, counts = found.get(sample, (-1, {}))
                if version > top:
                    top, counts = found[sample] = version, {}
                if version == top:
                    counts[code] = max(n, counts.get(code, 0))
        timer, samples = self._stored()
        until = timerValues.getCurrentProcessingTimeInMs() + self.keep_ms if self.keep_ms else 0
        gained, lost, named = Counter(), Counter(), set()
        for sample, (version, counts) in found.items():
            known, _, before = samples.get(sample, (-1, 0, ()))
            if version > known:
                now, before = {c for c, n in counts.items() if n > 0}, set(before)
                samples[sample] = version, until, sorted(now)
                gained.update(now - before)
                lost.update(before - now)
                named.update(counts)
        if named:
            self._store(timer, samples)
            yield _change(key, gained, lost, named)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        timer, samples = self._stored()
        due = {s for s, (_, until, _) in samples.items() if until <= expiredTimerInfo.getExpiryTimeInMs()}
        if due:
            lost = Counter(c for s in due for c in samples[s][2])
            left = {s: x for s, x in samples.items() if s not in due}
            if left:
                self._store(timer, left)
            else:
                self.newest.clear()
            yield _change(key, Counter(), lost, set())

    def close(self) -> None:
        pass


def _change(key: tuple, gained: Counter, lost: Counter, named: set[str]) -> pd.DataFrame:
    """A row of what changed in a range of samples: by how many samples a code's count moves."""
    moved = sorted(named | set(gained) | set(lost))
    return pd.DataFrame({"split": [key[0]], "model": [key[1]], "codes": [moved], "deltas": [[gained[c] - lost[c] for c in moved]]})


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """The settings of the streams that start inside."""
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def drain_changes(facts: DataFrame, folder: str, keep_ms: int = 0) -> None:
    """Takes all that ``facts(split, model, sample_id, version, code_name, cnt)``, a stream, has now; appends what changes to ``folder``. The sink lists whole batches only, so one that runs again adds nothing twice. Rows without a version or code are left out."""
    usable = facts.where("version IS NOT NULL AND code_name IS NOT NULL").withColumns({"version": F.col("version").cast("long"), "cnt": F.coalesce(F.col("cnt"), F.lit(0)).cast("long")})
    sample = F.col("sample_id").cast("string")
    ranged = usable.select("split", "model", sample.alias("sample_id"), "version", "code_name", "cnt", F.pmod(F.xxhash64(sample), F.lit(RANGES)).alias("range"))
    changes = ranged.groupBy("split", "model", "range").transformWithStateInPandas(NewestCodes(keep_ms), _CHANGES, "Append", "ProcessingTime" if keep_ms else "None")
    with _settings(facts.sparkSession):
        run = changes.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/samples").trigger(availableNow=True).start()
        run.awaitTermination()


def drain_counts(spark: SparkSession, folder: str) -> None:
    """Adds the changes that are new in ``folder`` to the counts, which are the state of this stream."""
    changes = spark.readStream.schema(_CHANGES).parquet(f"{folder}/changes")
    deltas = changes.select("split", "model", F.inline(F.arrays_zip(F.col("codes").alias("code_name"), F.col("deltas").alias("delta"))))
    with _settings(spark):
        counts = deltas.groupBy("split", "code_name", "model").agg(F.sum("delta").alias("n"))
        run = counts.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{folder}/counts").trigger(availableNow=True).start()
        run.awaitTermination()


def stored_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(split, code_name, model, n) from the state of the counts as of the last whole batch."""
    state = spark.read.format("statestore").load(f"{folder}/counts")
    return state.select("key.split", "key.code_name", "key.model", F.col("value.sum").alias("n"))


def incremental_counts(facts: DataFrame, folder: str, keep_ms: int = 0) -> DataFrame:
    """(split, code_name, model, n) after all that the stream ``facts`` has now; ``folder`` holds the state, and a later call with it goes on from there."""
    spark = facts.sparkSession
    drain_changes(facts, folder, keep_ms)
    drain_counts(spark, folder)
    return stored_counts(spark, folder)


def run_incremental(spark: SparkSession, source: str, schema: str, files_per_batch: int = 1, folder: str | None = None, keep_ms: int = 0) -> DataFrame:
    """``incremental_counts`` of the annotation files in ``source``, ``files_per_batch`` a micro-batch. A batch's annotations are dealt out before they are parsed, however few its files."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).repartition("sample_id")
    return incremental_counts(annotation_facts(stream), folder or scratch_path(spark, "incremental"), keep_ms)
