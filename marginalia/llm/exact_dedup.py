"""Exact duplicates by sorting content.

Rows are dealt by sampled ranges of their normalised text (its first characters,
then a hash of the whole, so splitters stay small; strings are ordered by their
UTF-8 bytes), sorted within each range by the whole text, and neighbours are
compared in full: rows of equal text lie side by side, the one to keep first.
Spark's sort spills to disk; nothing is gathered.

A text that very many rows share would be one long run in one range. A sample of
SAMPLE rows tells which hashes have over a thousandth of it (so at most a thousand
do), and rows with these also carry a salt, as many salts as the text's share of
all rows is worth tasks. Runs of one text and salt are sorted and compared like all
others; then the first rows of these runs, few for each text, are sorted and compared
in full once more, and the result for a whole text is joined to its runs. The sample
decides only where rows go: the result is the same whatever it holds.

Built from DataFrame functions only. A null text counts as empty; all empty texts
are equal. Repeated rows are members of their group like any others, one of them is
kept. A null ``doc_id`` sorts after all ids, so it is kept only where no other row
has its text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, saved

SAMPLE = 100_000
_PREFIX = 48
_SHARE = 1000


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, "")


def _order(length: Column, doc_id: Column) -> Column:
    """Smallest first: most code points, then smallest id, null ids last."""
    return F.struct((-length).alias("shorter"), doc_id.isNull().alias("unknown"), doc_id.alias("doc_id"))


def common_hashes(texts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Saved (hash, salts) of normalised texts with over a thousandth of a sample of ``texts(text)``: at most a thousand rows."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.count()
    drawn = texts.sample(min(1.0, sample / max(1, rows)), seed=11).select(F.xxhash64(normalised(F.col("text"))).alias("hash"))
    counts = drawn.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > max(16, min(rows, sample) // _SHARE))
    share = F.col("n") / min(max(1, rows), sample)
    return saved(counts.select("hash", (1 + F.ceil(share * 2 * partitions)).cast("int").alias("salts")), "common-hashes")


def exact_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all of them) with keep_id, group_size, kept and text_sha256 (of the normalised text).

    Of equal normalised texts the row with the longest original text stays, then
    the one with the smallest id. Columns of ``df`` with these names are replaced.
    """
    columns = [c for c in (df.columns if keep is None else keep) if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    carried = columns if text in columns else [*columns, text]
    raw = F.col(f"own_{carried.index(text)}")
    rows = df.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(carried)), F.col(f"`{doc_id}`").alias("id"))
    keyed = rows.select("*", F.xxhash64(normalised(raw)).alias("hash"), F.substring(normalised(raw), 1, _PREFIX).alias("prefix"), _order(F.char_length(F.coalesce(raw, F.lit(""))), F.col("id")).alias("best")).drop("id")
    salted = keyed.join(F.broadcast(common_hashes(rows.select(raw.alias("text")))), "hash", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts"))).drop("salts")

    ranged = salted.repartitionByRange("prefix", "hash", "salt").withColumn("norm", normalised(raw))
    run = Window.partitionBy("prefix", "hash", "salt", "norm")
    ordered = run.orderBy("best")
    found = ranged.withColumns({"first": F.first("best").over(ordered), "nth": F.row_number().over(ordered), "rows": F.count("*").over(run), "text_sha256": F.sha2("norm", 256)})
    head = F.when(F.col("salt").isNotNull() & (F.col("nth") == 1), F.col("norm"))
    runs = saved(found.withColumn("head", head).drop("norm", "best", *([] if text in columns else [f"own_{len(columns)}"])), "runs")

    heads = runs.where("head IS NOT NULL").select("prefix", "hash", "head", "text_sha256", "rows", F.struct("first", "salt").alias("first")).repartitionByRange("prefix", "hash")
    text_ = Window.partitionBy("prefix", "hash", "head")
    merged = heads.withColumns({"whole": F.min("first").over(text_), "whole_rows": F.sum("rows").over(text_)}).where(F.col("first") == F.col("whole"))
    whole = saved(merged.select("text_sha256", "whole", "whole_rows").distinct(), "whole-texts")  # a row for each text with salts
    joined = runs.join(F.broadcast(whole), (runs["text_sha256"] == whole["text_sha256"]) & runs["salt"].isNotNull(), "left").drop(whole["text_sha256"])
    first = F.coalesce(F.col("whole.first"), F.col("first"))
    stays = (F.col("nth") == 1) & (F.col("salt").isNull() | (F.col("salt") == F.col("whole.salt")))
    own = [F.col(f"own_{i}").alias(c) for i, c in enumerate(columns)]
    return joined.select(*own, first["doc_id"].alias("keep_id"), F.coalesce("whole_rows", "rows").alias("group_size"), stays.alias("kept"), "text_sha256")
