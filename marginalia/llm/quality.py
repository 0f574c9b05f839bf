"""Quality rules: base statistics of each document, and lines that too many documents of a host share.

Base: a document fails with under 20 words, or with over 30 % of its words in
8-word windows that the text holds twice or more.

Lines: a line (its words in lower case, one space between) is common if more
than ``limit`` documents of its host have it: 50, or a thousandth of the host's
documents if that is more. Common lines are taken out of the texts, and a document
that is left with under a tenth of its words is rejected as depleted. Copies of one
document share all their lines, but that makes none of these boilerplate; so the
count that decides only takes documents with at least a fifth of their words in
lines that are not common among all documents. A page of nothing but lines that
other pages also carry beside their own text goes; a much-copied document stays
whole for the stages that deal with copies.

Nulls: a null text has no words, fails the base rule and stays null; a null source
is the empty one; a null id is an id like others. Rows that repeat each get the same
verdict and each count as a document. Columns of the input with the names of the
results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, by_batches, raw_texts, saved, scratch, word_hashes

WINDOW = 8
BROADCAST = 500_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_KEEP_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
_SPACES = b" \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPARK_SEED = 42  # of the SQL function xxhash64
_STEPS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(hashes: np.ndarray) -> int:
    """How many words lie in a window of 8 words that stands in the text twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    windows = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        windows += hashes[k : k + n] * _STEPS[k]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def text_stats(raw: bytes) -> tuple[int, int, int, int, int]:
    """The statistics named in STATS of a text in UTF-8."""
    words = raw.split()
    word_chars = len(raw.translate(None, _SPACES).decode("utf-8", "replace"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), word_chars, len(raw.translate(None, _KEEP_SYMBOLS)), len(lines) - len(set(lines)), repeated_words(word_hashes(words))


def distinct_lines(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct normalised lines, and the words that each takes in all its places."""
    words: dict[bytes, int] = {}
    for line in raw.lower().split(b"\n"):
        if parts := line.split():
            key = b" ".join(parts)
            words[key] = words.get(key, 0) + len(parts)
    hashes = (xxhash.xxh64_intdigest(x, seed=_SPARK_SEED) for x in words)
    return np.fromiter(hashes, np.uint64, len(words)).view(np.int64), np.fromiter(words.values(), np.int64, len(words))


def line_hash(line: Column) -> Column:
    """The hash that ``distinct_lines`` gives a line."""
    return F.xxhash64(F.btrim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), f"{SPACE_CLASS}+", " ")))


def without_lines(text: Column, removed: Column) -> Column:
    """The text without the lines whose hashes are in ``removed``; unchanged where that is null."""
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, line_hash(x)))
    return F.when(removed.isNull(), text).otherwise(F.array_join(kept, "\n"))


def line_features(df: DataFrame, keep: Sequence[str], text: str = "text", host: str = "source") -> DataFrame:
    """Saved: the columns ``keep`` of ``df`` as own_0, own_1 ..., a row number, host, STATS, base_failed, line_hashes and line_words. Texts are read once."""
    own = df.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(keep)), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.col(f"`{text}`").alias("text"))

    @by_batches
    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = raw_texts(batch.column(batch.num_columns - 1))
        found = np.array([text_stats(x) for x in raws], np.int64).T
        failed = (found[0] < 20) | (100 * found[4] > 30 * found[0])
        each = [distinct_lines(x) for x in raws]
        edges = pa.array(np.concatenate([[0], np.cumsum([len(x) for x, _ in each])]).astype(np.int32))
        lines = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate([x[i] for x in each]))) for i in (0, 1)]
        names = [*batch.schema.names[:-1], *STATS, "base_failed", "line_hashes", "line_words"]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, found), pa.array(failed), *lines], names)

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in own.schema if f.name != "text") + "".join(f"{x} long, " for x in STATS)
    measured = own.mapInArrow(measure, kinds + "base_failed boolean, line_hashes array<long>, line_words array<long>")
    return saved(measured.withColumn("row", F.monotonically_increasing_id()), "line-features")


def line_verdicts(features: DataFrame, min_docs: int = 50, share: float = 0.001, own_tenths: int = 2, left_tenths: int = 1) -> DataFrame:
    """Saved (row, removed, depleted) of documents with common lines: the hashes of these, and whether over nine tenths of the words go with them."""
    with scratch(features.sparkSession) as kept:
        hosts = saved(features.groupBy("host").agg(F.greatest(F.lit(min_docs), (F.count("*") * share).cast("long")).alias("limit")), "hosts")
        lines = features.select("row", "host", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("line")).select("row", "host", F.col("line.line_hashes").alias("line"), F.col("line.line_words").alias("words"))

        def common(rows: DataFrame, label: str) -> DataFrame:
            counts = rows.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
            return saved(counts.join(hosts.hint("shuffle_merge"), "host").where(F.col("docs") > F.col("limit")).select("host", "line"), label)

        shared = saved(lines.join(common(lines, "common-lines"), ["host", "line"], "left_semi"), "shared-lines")
        taken = saved(shared.groupBy("row").agg(F.sum("words").alias("taken")), "taken")
        with_own = features.select("row", "n_words").join(taken.hint("shuffle_merge"), "row").where((F.col("n_words") - F.col("taken")) * 10 >= F.col("n_words") * own_tenths)
        decisive = common(shared.join(with_own.select("row").hint("shuffle_merge"), "row", "left_semi"), "decisive-lines")
        removed = shared.join(decisive, ["host", "line"], "left_semi").groupBy("row").agg(F.collect_list("line").alias("removed"), F.sum("words").alias("gone"))  # no longer than the document
        left = F.col("n_words") - F.col("gone")
        found = saved(features.select("row", "n_words").join(removed.hint("shuffle_merge"), "row").select("row", "removed", (left * 10 < F.col("n_words") * left_tenths).alias("depleted")), "line-verdicts")
        kept.append(found)
    return found


def with_verdict(features: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``features`` with removed (null where nothing is) and kept. Verdicts of at most BROADCAST rows and hashes are broadcast, more are merged."""
    rows, hashes = verdicts.agg(F.count("*"), F.coalesce(F.sum(F.size("removed")), F.lit(0))).first()
    small = rows + hashes <= BROADCAST
    joined = features.drop("line_hashes", "line_words").join(verdicts.hint("broadcast" if small else "shuffle_merge"), "row", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False)))


def quality_verdicts(df: DataFrame, **limits: float) -> DataFrame:
    """(doc_id, STATS, base_failed, kept) of each row of ``df(doc_id, text, source)``."""
    features = line_features(df, ["doc_id"])
    return with_verdict(features, line_verdicts(features, **limits)).select(F.col("own_0").alias("doc_id"), *STATS, "base_failed", "kept")


def judged(df: DataFrame, text: str = "text", host: str = "source", **limits: float) -> DataFrame:
    """``df`` with STATS, base_failed, kept and clean_text, the text without its common lines."""
    keep = [c for c in df.columns if c not in (*STATS, "base_failed", "kept", "clean_text")]
    features = line_features(df, keep, text, host)
    found = with_verdict(features, line_verdicts(features, **limits))
    clean = without_lines(F.col(f"own_{keep.index(text)}"), F.col("removed"))
    return found.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(keep)), *STATS, "base_failed", "kept", clean.alias("clean_text"))
