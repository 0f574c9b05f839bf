"""The data model: traces, taxonomy, facts and their companions as DataFrames.

Traces come in comparisons of two models (side 0 and 1). Facts are long: one row
for a trace and a code, with a count; NULL (never NaN) means that the trace was
annotated before the code existed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.mentions import counts_column

#: A taxonomy of function words for the lexical annotator: index is order.
SEED_CODES = ("the", "and", "of", "la", "de", "un", "der", "die")
#: A taxonomy up to this size is counted by one expression a name.
MOST_EXPRESSIONS = 64
TOKEN_BORDER = r"[^\p{L}\p{N}_]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, keys: Sequence[str], order: str, out: str, span: int = 65_536) -> DataFrame:
    """``df`` with a number from 0 within ``keys`` by the integer column ``order``.

    Rows are numbered in ranges of ``span`` values and the ranges' sizes summed, so a
    key with a third of all rows is shared by many tasks.
    """
    ranged = df.withColumn("__range", F.floor(F.col(order) / span))
    sizes = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.sum("__size").over(Window.partitionBy(*keys).orderBy("__range")) - F.col("__size")).drop("__size")
    inside = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(order)) - 1
    both = ranged.withColumn("__inside", inside).join(before.hint("shuffle_merge"), [*keys, "__range"])
    return both.withColumn(out, F.col("__before") + F.col("__inside")).drop("__range", "__inside", "__before")


def shuffle_numbered(df: DataFrame, keys: Sequence[str], rank: Column, key: str, out: str, size: str | None = None) -> DataFrame:
    """``df`` with a number from 0 within ``keys`` by the hexadecimal digest ``rank``, ties by ``key``; with ``size``, also how many rows the keys have.

    As ``numbered``: rows are numbered in the digest's 4096 ranges and the ranges' sizes summed.
    """
    ranged = df.withColumn("__rank", rank).withColumn("__range", F.substring("__rank", 1, 3))
    sizes = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(*keys)
    before = sizes.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__range").alias("__of"), (F.sum("__n").over(whole.orderBy("__range")) - F.col("__n")).alias("__before"), F.sum("__n").over(whole).alias("__size"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy("__rank", key)) - 1
    same = F.col("__range") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    both = ranged.withColumn("__inside", inside).join(before.hint("shuffle_merge"), same)
    made = {out: F.col("__before") + F.col("__inside")} | ({size: F.col("__size")} if size else {})
    return both.select(*df.columns, *(c.alias(n) for n, c in made.items()))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, model, comparison, side, question_id, thinking): each source is a model, each two sources a comparison, the n-th trace of a model answers question n."""
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("model"), number.alias("number"), F.col("text").alias("thinking"))
    split = docs.select("doc_id", "model", F.floor(F.col("number") / 2).cast("int").alias("comparison"), (F.col("number") % 2).alias("side"), "thinking")
    return numbered(split, ["comparison", "side", "model"], "doc_id", "question_id").select("doc_id", "model", "comparison", "side", "question_id", "thinking")


def codebook(spark: SparkSession, codes: Sequence[str] = SEED_CODES) -> DataFrame:
    """(code_idx, code_name); the index is explicit, as rows have no order."""
    return spark.createDataFrame(list(enumerate(codes)), "code_idx int, code_name string")


def _is_token(code: str) -> bool:
    return all(c.isalnum() or c == "_" for c in code)


def lexical_counts(lower: Column, hits: Column, codes: Sequence[str]) -> Column:
    """Array of (code_idx, code_name, cnt) from a text in lower case and its words that are codes."""

    def count(code: str) -> Column:
        code = code.lower()
        if _is_token(code):
            return F.size(F.filter(hits, lambda x: x == code)).cast("long")
        if " " in code:
            return F.floor((F.length(lower) - F.length(F.replace(lower, F.lit(code), F.lit("")))) / len(code)).cast("long")
        return F.regexp_count(lower, F.lit(rf"(?<![\p{{L}}\p{{N}}_])\Q{code}\E(?![\p{{L}}\p{{N}}_])")).cast("long")

    return F.array(*(F.struct(F.lit(i).alias("code_idx"), F.lit(c).alias("code_name"), count(c).alias("cnt")) for i, c in enumerate(codes)))


def count_mentions(df: DataFrame, codes: Sequence[str] = SEED_CODES, text: str = "thinking") -> DataFrame:
    """``df`` without its text, one row a code with its count in any case, zero counts too.

    A word is what stands between TOKEN_BORDERs; a phrase counts as a substring; a single
    word that holds a border itself (a hyphen) must not touch a letter, digit or underscore.
    A text is split once, and only its words that are codes are kept to be counted. More than
    ``MOST_EXPRESSIONS`` names, for which there would be as many expressions, are counted
    in one walk over the text instead, by the same rules.
    """
    rest = [c for c in df.columns if c != text]
    if len(codes) > MOST_EXPRESSIONS:
        found = df.select(*rest, F.posexplode(counts_column(F.lower(F.coalesce(F.col(text), F.lit(""))), codes)).alias("code_idx", "cnt"))
        return found.select(*rest, "code_idx", F.element_at(F.lit(list(codes)), F.col("code_idx") + 1).alias("code_name"), "cnt")
    words = sorted({c.lower() for c in codes if _is_token(c)})
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = F.filter(F.split(lower, TOKEN_BORDER), lambda x: x.isin(*words)) if words else F.array().cast("array<string>")
    phrases = [c for c in codes if not _is_token(c)]
    marked = df.select(*rest, hits.alias("__hits"), (lower if phrases else F.lit("")).alias("__lower"))
    return marked.select(*rest, F.inline(lexical_counts(F.col("__lower"), F.col("__hits"), codes)))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_mentions(traces(spark, sf_dir))


def facts_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts where every third question was annotated before the last two codes were added."""
    early = (F.col("code_idx") >= 6) & (F.col("question_id") % 3 == 0)
    return facts(spark, sf_dir).withColumn("cnt", F.when(~early, F.col("cnt")))


def correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, status): graded traces; what is absent is unfinished."""
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "correct").otherwise("wrong").alias("status"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, model, pos, code): each user's events in order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), (F.col("user_id") % 2).cast("int").alias("model"), F.row_number().over(order).cast("long").alias("pos"), F.col("event_type").alias("code"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, run, model, code, cnt): repeated annotations, absent codes as 0."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("sample_id"), (F.col("event_id") % 3).cast("int").alias("run"), (F.floor(F.col("event_id") / 3) % 2).cast("int").alias("model"), F.col("event_type").alias("code"))
    counts = events.groupBy("sample_id", "run", "model", "code").agg(F.count("*").alias("cnt"))
    annotated = counts.select("sample_id", "run", "model").distinct()
    codes = events.select("code").distinct()  # a handful of event types
    return annotated.crossJoin(F.broadcast(codes)).join(counts.hint("shuffle_merge"), ["sample_id", "run", "model", "code"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, dim, x) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "v")).select("vec_id", "label", "dim", F.col("v").cast("double").alias("x"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): a user turn and the assistant turn after it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("text").over(order).alias("answer"), F.lead("role").over(order).alias("next_role"))
    return rows.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", "question", "answer")


def shuffled_rank(key: Column, seed: int) -> Column:
    """A fixed shuffle order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
