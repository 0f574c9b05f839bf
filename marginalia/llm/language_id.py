"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

1. Features: a text in lower case, whatever isn't a letter as one space, gives its
   n-grams of ORDERS characters, hashed to FEATURES places. A place's value is
   (1 + ln tf) idf, and a text's values have length 1. Whole texts are read, SLICE
   characters at a time.
2. Document frequencies are counted over all rows to learn from: a task adds up its texts
   and gives a row a place, Spark sums these.
3. The classifier is fitted on a sample of at most ``sample_rows`` labelled rows, as many
   of each language as there are, if need be the ones with the smallest digests. It is
   dealt to ``shards``; in each of ``epochs`` every shard runs follow-the-regularised-leader
   with elastic-net penalties (l1, l2) over its rows from the common state, and Spark averages
   the shards' states. Every fifth row of the sample stays out.
4. On these, one temperature is chosen that makes the true languages most probable. A score
   is the probability of the predicted language at this temperature.

The model is FEATURES x languages numbers. The languages are those of the sample.

Nulls: a text that is null or has no letter is ``und`` with score 0. A null language
isn't learned from. A null id is in fold 0. Without rows to learn from everything is
``und``. Repeated rows are predicted alike and count again. Equal probabilities go to the
language that is first in order of names.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binaries, by_batches, saved, scratch

ORDERS = (1, 2, 3)
FEATURES = 1 << 15
SLICE = 1 << 18
UNKNOWN = "und"
_MULTIPLY = np.uint32(0x9E3779B1)
_BITS = np.uint32(33 - FEATURES.bit_length())
_TEMPERATURES = np.geomspace(0.02, 20, 400)


@functools.lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _codes(text: str) -> np.ndarray:
    """Code points in lower case, 32 for each run of others."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    is_letter = letters()[points]
    points = np.where(is_letter, points, np.uint32(32))
    return points[is_letter | np.concatenate([[True], is_letter[:-1]])]


def feature_counts(text: str) -> np.ndarray:
    """How often each place is taken; all zero without a letter."""
    out, carried = None, np.array([32], np.uint32)
    for at in range(0, len(text), SLICE):
        new = _codes(text[at : at + SLICE])
        if carried[-1] == 32 and len(new) and new[0] == 32:
            new = new[1:]
        codes = np.concatenate([carried, new])
        if at + SLICE >= len(text) and codes[-1] != 32:
            codes = np.append(codes, np.uint32(32))
        mixed, found = np.zeros(len(codes), np.uint32), []
        for n in range(1, max(ORDERS) + 1):
            mixed = mixed[: len(codes) - n + 1] + codes[n - 1 :]
            mixed *= _MULTIPLY
            if n in ORDERS:
                found.append(mixed[max(0, len(carried) - n + 1) :])  # n-grams inside what was carried are counted
        counts = np.bincount(np.concatenate(found) >> _BITS, minlength=FEATURES)
        out = counts if out is None else out + counts
        carried = codes[-(max(ORDERS) - 1) :]
    return out if out is not None and has_letter(text) else np.zeros(FEATURES, np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _weighed(places: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = (1 + np.log(counts)) * idf[places]
    return places, values / max(np.sqrt((values**2).sum()), 1e-12)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places taken and their values."""
    places = np.flatnonzero(counts)
    return _weighed(places, counts[places], idf)


def packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """The places taken, as steps from one to the next, and their counts."""
    places = np.flatnonzero(counts)
    return np.diff(places, prepend=0).astype("<u2").tobytes(), counts[places].astype("<u4").tobytes()


def unpacked(places: bytes, counts: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and values of a packed row."""
    return _weighed(np.cumsum(np.frombuffer(places, "<u2"), dtype=np.int64), np.frombuffer(counts, "<u4"), idf)


@dataclass(frozen=True)
class Penalties:
    """Learning rate (alpha, beta) and penalties of follow-the-regularised-leader."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.001

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The weights that the state (z, n) stands for; 0 where z is within l1."""
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


def softmax(scores: np.ndarray) -> np.ndarray:
    grown = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return grown / grown.sum(axis=-1, keepdims=True)


def follow_the_leader(z: np.ndarray, n: np.ndarray, rows: Iterator[tuple[np.ndarray, np.ndarray, int]], penalties: Penalties) -> None:
    """One pass over rows of (places, values, language), changing the state."""
    for places, values, label in rows:
        z_at, n_at = z[places], n[places]
        weights = penalties.weights(z_at, n_at)
        error = softmax(values @ weights)
        error[label] -= 1
        slope = values[:, None] * error
        grown = n_at + slope**2
        z[places] = z_at + slope - (np.sqrt(grown) - np.sqrt(n_at)) / penalties.alpha * weights
        n[places] = grown


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # place x language
    temperature: float = 1.0

    def scores(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values @ self.weights[places]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not (counts := feature_counts(text)).any():
            return UNKNOWN, 0.0
        chances = softmax(self.scores(*tf_idf(counts, self.idf)) / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the fold that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def inverse_frequencies(learned: DataFrame) -> np.ndarray:
    """ln((1 + rows) / (1 + rows with the place)) + 1 of each place, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[:-1] += feature_counts(text.as_py() or "") > 0
                total[-1] += 1
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total[places])], ["place", "rows"])

    total = np.zeros(FEATURES + 1)
    for r in learned.select("text").mapInArrow(count, "place long, rows long").groupBy("place").agg(F.sum("rows").alias("rows")).collect():  # a row a place
        total[r.place] = r.rows
    return np.log((1 + total[-1]) / (1 + total[:-1])) + 1


def sampled(learned: DataFrame, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` rows (lang, text, digest), as many of each language."""
    named = learned.select("lang", "text", F.xxhash64("doc_id", "text").alias("digest"))
    marks = named.select("lang", "digest")
    size = saved(marks.groupBy("lang").count(), "language-sizes")
    share = max(1, sample_rows // max(1, size.count()))
    few = marks.distinct().withColumn("nth", F.row_number().over(Window.partitionBy("lang", F.pmod("digest", F.lit(64))).orderBy("digest"))).where(F.col("nth") <= share)
    first = few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("digest"))).where(F.col("nth") <= share)
    picks = saved(first.select("lang", "digest").limit(sample_rows), "sample-picks")
    return named.join(F.broadcast(picks), ["lang", "digest"]).groupBy("lang", "digest").agg(F.first("text").alias("text")).select("lang", "text", "digest")  # at most sample_rows rows


def fitted(learned: DataFrame, sample_rows: int, shards: int, epochs: int, penalties: Penalties) -> Model:
    """A model of the rows (doc_id, text, lang)."""
    spark = learned.sparkSession
    idf = inverse_frequencies(learned)
    with scratch(spark):
        texts = saved(sampled(learned, sample_rows), "language-sample")
        languages = sorted(r.lang for r in texts.select("lang").distinct().collect())
        index, width = {x: i for i, x in enumerate(languages)}, len(languages)
        model = Model(languages, idf, np.zeros((FEATURES, width)))
        if not languages:
            return model

        @by_batches
        def features(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [packed(feature_counts(x or "")) for x in batch.column(1).to_pylist()]
            labels = [index[x] for x in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(2), pa.array(labels, pa.int32()), binaries([x for x, _ in rows]), binaries([x for _, x in rows])], ["digest", "label", "places", "counts"])

        made = texts.select("lang", "text", "digest").mapInArrow(features, "digest long, label int, places binary, counts binary")
        dealt = made.where(F.length("places") > 0).withColumns({"kept": F.pmod("digest", F.lit(5)) == 0, "shard": F.pmod(F.xxhash64("digest"), F.lit(shards))})
        table = saved(dealt, "language-features")
        z, n = np.zeros((FEATURES, width)), np.zeros((FEATURES, width))
        for _ in range(epochs):
            z, n = _averaged(table.where("NOT kept"), idf, z, n, penalties)
        model.weights = penalties.weights(z, n)
        model.temperature = _temperature(table.where("kept"), model)
    return model


def _averaged(rows: DataFrame, idf: np.ndarray, z: np.ndarray, n: np.ndarray, penalties: Penalties) -> tuple[np.ndarray, np.ndarray]:
    """The state after one pass of every shard from (z, n), averaged over shards."""
    shared = rows.sparkSession.sparkContext.broadcast((z, n))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        z, n = (x.copy() for x in shared.value)
        part = part.sort_values("digest")
        follow_the_leader(z, n, ((*unpacked(p, c, idf), y) for p, c, y in zip(part["places"], part["counts"], part["label"], strict=True)), penalties)
        moved = np.flatnonzero((n != shared.value[1]).any(axis=1))
        return pd.DataFrame({"place": moved, "z": list(z[moved] - shared.value[0][moved]), "n": list(n[moved] - shared.value[1][moved])})

    moved = rows.groupBy("shard").applyInPandas(run, "place long, z array<double>, n array<double>")  # a shard is a part of the sample
    width = z.shape[1]
    each = [F.sum(F.col(x)[i]).alias(f"{x}{i}") for x in ("z", "n") for i in range(width)]
    z, n = z.copy(), n.copy()
    for r in moved.groupBy("place").agg(F.count("*").alias("shards"), *each).collect():  # a row a place
        z[r.place] += np.array(r[2 : 2 + width]) / r.shards
        n[r.place] += np.array(r[2 + width :]) / r.shards
    shared.destroy()
    return z, n


def _temperature(rows: DataFrame, model: Model) -> float:
    """The temperature at which the rows' own languages are most probable, each held for sure only as far as so many rows can tell: (rows + 1) in (rows + languages)."""
    width, size = len(model.languages), rows.count()
    if width < 2 or not size:
        return 1.0
    aim = np.full(width, 1 / (size + width))
    sure = (size + 1) / (size + width) - aim[0]

    def loss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(_TEMPERATURES))
        for batch in batches:
            for label, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                scores = model.scores(*unpacked(places, counts, model.idf)) / _TEMPERATURES[:, None]
                chances = scores - scores.max(axis=1, keepdims=True)
                chances -= np.log(np.exp(chances).sum(axis=1, keepdims=True))
                total -= chances @ aim + sure * chances[:, label]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "loss"])

    sums = rows.select("label", "places", "counts").mapInArrow(loss, "at long, loss double").groupBy("at").agg(F.sum("loss").alias("loss"))
    return float(_TEMPERATURES[sums.orderBy(F.round("loss", 6), F.desc("at")).first().at])


def predicted(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` without its text, with lang_pred and score; columns with these names are replaced."""
    kept = [c for c in df.columns if c not in (text, "lang_pred", "score")]
    at, shared = len(kept), df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(kept)), F.col(f"`{text}`").alias("text"))

    @by_batches
    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(x) for x in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*batch.schema.names[:at], "lang_pred", "score"])

    schema = "".join(f"own_{i} {rows.schema[i].dataType.simpleString()}, " for i in range(at)) + "lang_pred string, score double"
    found = rows.mapInArrow(predict, schema)
    return found.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(kept)), "lang_pred", "score")


def identify(df: DataFrame, sample_rows: int = 8_000, shards: int = 4, epochs: int = 3, penalties: Penalties = Penalties()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``df(doc_id, text, lang)``; only rows that aren't held out are learned from."""
    rows = df.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held_out(F.col("doc_id")).alias("held_out"))
    learned = rows.where("NOT held_out AND lang IS NOT NULL").drop("held_out")
    model = fitted(learned, sample_rows, shards, epochs, penalties)
    return predicted(rows.select("doc_id", "held_out", "text"), model)
