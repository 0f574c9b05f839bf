"""Whole experiments: evaluation, comparison of methods, transfer, and the rounds that grow a taxonomy."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.annotations import extract_sequence, parse_counts, split_sections, verdict_model
from marginalia.functions.mentions import mentioned
from marginalia.functions.text import annotation_prompts
from marginalia.operators import calls, classify, codebook, pairs, stats, vectors, versions
from marginalia.operators.vectors import chosen
from marginalia.sources import tables as t
from marginalia.sources.scratch import appended, parts, saved, scratch_path


def concat_datasets(datasets: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """All rows with their source, and the id prefixed by it."""
    rows = [df.withColumns({"source": F.lit(name), "sample_id": F.concat(F.lit(name + "_"), F.col(key).cast("string"))}) for name, df in datasets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def status_sets(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def evaluate(method: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """(comparison, n, n_correct, accuracy) of a classifier on held-out pairs."""
    return stats.accuracy(resolved(method, train, test), ["comparison"])


def compare(methods: Iterable[str], train: DataFrame, test: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, (evaluate(m, train, test).withColumn("method", F.lit(m)) for m in methods))


def averaged(facts: DataFrame, runs: DataFrame) -> DataFrame:
    """Facts whose counts are means over reruns, ``runs(doc_id, run, code_idx, cnt)``."""
    means = runs.groupBy("doc_id", "code_idx").agg(F.avg("cnt").alias("cnt"))
    return facts.drop("cnt").join(means.hint("shuffle_merge"), ["doc_id", "code_idx"])


def transfer(facts: DataFrame, directions: DataFrame, method: str = "naive_bayes_multinomial") -> DataFrame:
    """(train_on, test_on, refit, n, n_correct, accuracy) for ``directions(train_on, test_on)`` of comparisons under one taxonomy.

    Zero-shot: the classifier of ``train_on`` judges the held-out pairs of ``test_on``;
    refit: one fitted on ``test_on`` does. Every direction is a comparison of its own
    in one job; comparisons are numbers from 0 below 2^31, so that both fit one key.
    """
    held_out = classify.is_eval(F.col("question_id"))
    ways = directions.withColumn("refit", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("way", F.expr("shiftleft(bigint(train_on), 33) + shiftleft(bigint(test_on), 1) + int(refit)"))
    fit_on = F.broadcast(ways.select("way", F.when(F.col("refit"), F.col("test_on")).otherwise(F.col("train_on")).alias("comparison")))
    judge = F.broadcast(ways.select("way", F.col("test_on").alias("comparison")))
    train = facts.where(~held_out).join(fit_on, "comparison").drop("comparison").withColumnRenamed("way", "comparison")
    test = facts.where(held_out).join(judge, "comparison").drop("comparison").withColumnRenamed("way", "comparison")
    return evaluate(method, train, test).join(F.broadcast(ways.withColumnRenamed("way", "comparison")), "comparison").drop("comparison")


#: A block of vectors has so many numbers at most (8 MB as floats). A table has SOME_BLOCKS before these grow, but none of under FEW_NUMBERS.
MOST_NUMBERS, FEW_NUMBERS, SOME_BLOCKS = 1 << 21, 1 << 16, 16
#: Two blocks are compared in slices of so many rows.
SLICE = 512


def _met_blocks(rows: DataFrame, block: int | None = None) -> DataFrame:
    """(qs, bs, same): every block of ``rows(id, v)`` with itself and every later block, so each pair meets once, in a unit of work of bounded size.

    Blocks are dealt out once, and a task fetches the two that it compares. So what is written grows with the rows; only the work grows with their square.
    """
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.select("id", F.col("v") if rows.schema["v"].dataType.simpleString() == "array<float>" else F.col("v").cast("array<double>").alias("v"))
    n, wide = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // block) if block else max(-(-n * wide // MOST_NUMBERS), min(SOME_BLOCKS, -(-n * wide // FEW_NUMBERS))))
    unit = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = saved(unit.groupBy("b").agg(F.collect_list(F.struct("id", "v")).alias("rows")), "vector-blocks")
    dealt = packed.repartitionById(min(blocks, max(32, blocks // 8)), F.col("b"))
    one, two = (dealt.select(F.col("b").alias(f"b{i}"), F.col("rows").alias(name)) for i, name in ((1, "qs"), (2, "bs")))
    return one.join(two.hint("shuffle_replicate_nl"), F.col("b1") <= F.col("b2")).select("qs", "bs", (F.col("b1") == F.col("b2")).alias("same"))


def _numbers(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block; all vectors are of one length."""
    return rows.field("id").to_numpy(zero_copy_only=False).astype(np.int64), rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _close_pairs(q: pa.StructArray, b: pa.StructArray, same: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and cosines of the pairs of two blocks at ``least`` or more; a block with itself gives each pair once."""
    (i, x), (j, y) = _numbers(q), _numbers(b)
    c = _unit(x) @ _unit(y).T
    u, w = np.nonzero((c >= least) & (i[:, None] < j[None, :] if same else i[:, None] != j[None, :]))
    return i[u], j[w], c[u, w]


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of ``x`` with that of ``y``, by sums in order of the dimensions, as SQL has them."""
    dot, xx, yy = np.zeros((3, len(x)))
    for k in range(x.shape[1]):
        a, b = x[:, k].astype(float), y[:, k].astype(float)
        dot, xx, yy = dot + a * b, xx + a * a, yy + b * b
    return dot / np.maximum(np.sqrt(xx) * np.sqrt(yy), 1e-300)


def _joined(roots: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """``roots`` with links between ``one`` and ``two``: each place has the smallest of its component."""
    while len(one):
        np.minimum.at(roots, np.maximum(roots[one], roots[two]), np.minimum(roots[one], roots[two]))
        while (roots != (after := roots[roots])).any():
            roots = after
        apart = roots[one] != roots[two]
        one, two = one[apart], two[apart]
    return roots


def _linked(q: pa.StructArray, b: pa.StructArray, same: bool, least: float) -> list[np.ndarray]:
    """Ids of two blocks that have links at ``least`` or more, the smallest id that a chain of these leads to, and how many they are.

    Slices meet in single precision. A pair closer to ``least`` than its rounding is worked out again in double. A slice's pairs are
    counted and only those that join two chains are kept, so a large class takes no memory a pair.
    """
    (i, x), (j, y) = _numbers(q), _numbers(b)
    ids, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    at_q, at_b = place[: len(i)], place[len(i) :]
    xs, ys = (_unit(z).astype(np.float32) for z in (x, y))
    slack = (x.shape[1] + 8) * 2.0**-23  # twice what a sum of so many products can be off
    roots, of_q, of_b = np.arange(len(ids)), np.zeros(len(i), np.int64), np.zeros(len(j), np.int64)
    for s in range(0, len(x), SLICE):
        for t in range(s if same else 0, len(y), SLICE):
            c = xs[s : s + SLICE] @ ys[t : t + SLICE].T
            at = np.flatnonzero(c >= least - slack)
            if not len(at):
                continue
            u, w = np.divmod(at, c.shape[1])
            one, two = at_q[s + u], at_b[t + w]
            found = (one != two) & ((u < w) | (not same or s != t))
            unsure = np.flatnonzero(found & (c.ravel()[at] < least + slack))
            if len(unsure):
                found[unsure] = _cosines(x[s + u[unsure]], y[t + w[unsure]]) >= least
            of_q[s : s + SLICE] += np.bincount(u[found], minlength=c.shape[0])
            of_b[t : t + SLICE] += np.bincount(w[found], minlength=c.shape[1])
            apart = found & (roots[one] != roots[two])
            roots = _joined(roots, one[apart], two[apart])
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, at_q, of_q)
    np.add.at(links, at_b, of_b)
    has = links > 0
    return [ids[has], ids[roots[has]], links[has]]


def _of_block_pairs(met: DataFrame, work: Callable[..., list[np.ndarray]], schema: str) -> DataFrame:
    """The columns that ``work`` makes of each row of ``met(qs, bs, same)``, one pair of blocks after the other: a task holds the numbers of one pair beside its batch, and never rows as Python objects."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                made = work(batch.column(0)[r].values, batch.column(1)[r].values, batch.column(2)[r].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names)

    return met.mapInArrow(run, schema)


def similar_vectors(rows: DataFrame, least: float, block: int = 1024) -> DataFrame:
    """(id_1, id_2, cosine) with id_1 < id_2 and cosine >= ``least``: all pairs of ``rows(id, v)``, exactly."""

    def close(q: pa.StructArray, b: pa.StructArray, same: bool) -> list[np.ndarray]:
        i, j, c = _close_pairs(q, b, same, least)
        return [np.minimum(i, j), np.maximum(i, j), np.round(c, 6)]

    return _of_block_pairs(_met_blocks(rows, block), close, "id_1 long, id_2 long, cosine double")


def similar_classes(rows: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """(id, class_id, links): a row for each of ``rows(id, v)`` with the smallest id that a chain of similar pairs leads to, and how many similar vectors it has itself.

    Two blocks give a row for each of their vectors with links, so a large class costs no row a pair. All roots of a vector are
    of one class, so only roots are joined further.
    """
    found = _of_block_pairs(_met_blocks(rows, block), lambda q, b, same: _linked(q, b, same, least), "id long, root long, links long")
    # dealt out before it is summed: a task has no id twice, and sums with sets are wider than rows
    linked = saved(found.repartition("id").groupBy("id").agg(F.sum("links").alias("links"), F.collect_set("root").alias("roots")).withColumn("root", F.array_min("roots")), "links")
    labels = codebook.component_labels(linked.select(F.explode("roots").alias("code_1"), F.col("root").alias("code_2")).distinct()).select(F.col("code_idx").alias("root"), "component")
    classes = linked.select("id", "root", "links").join(labels.hint("shuffle_merge"), "root")
    joined = rows.select("id").join(classes.hint("shuffle_merge"), "id", "left")
    return joined.select("id", F.coalesce("component", "id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def resolved(method: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """Outcomes of a classifier whose scores are rounded, so that ties are ties on any engine."""
    return classify.resolve(classify.classify(method, train, test).withColumns({p: F.round(p, 9) for p in ("p0", "p1")}))


def directions(facts: DataFrame) -> DataFrame:
    """(train_on, test_on): every two different comparisons, both ways."""
    found = facts.select("comparison").where("comparison IS NOT NULL").distinct()
    return found.select(F.col("comparison").alias("train_on")).join(F.broadcast(found.select(F.col("comparison").alias("test_on"))), F.col("train_on") != F.col("test_on"))


def evaluate_averaged(method: str, train: DataFrame, runs: DataFrame) -> DataFrame:
    """(comparison, n, n_correct, accuracy) on reruns of held-out facts, ``runs(comparison, question_id, side, doc_id, run, code_idx, cnt)``, their counts averaged."""
    keys = ["comparison", "question_id", "side", "doc_id", "code_idx"]
    return evaluate(method, train, runs.groupBy(*keys).agg(F.avg("cnt").alias("cnt")))


def evaluate_runs(method: str, train: DataFrame, runs: DataFrame) -> DataFrame:
    """Accuracy statistics of each comparison over reruns, each judged by itself; a (run, comparison) is a comparison of its own in one job."""
    key = (F.col("run").cast("long") * 2**32 + F.col("comparison")).alias("comparison")
    numbers = runs.select("run").distinct()  # a handful of reruns
    fit = train.select("comparison", "side", "doc_id", "code_idx", "cnt").crossJoin(F.broadcast(numbers)).select(key, "side", "doc_id", "code_idx", "cnt")
    outcomes = resolved(method, fit, runs.select(key, "question_id", "side", "doc_id", "code_idx", "cnt"))
    split = outcomes.select(F.expr("int(comparison div 4294967296)").alias("run"), F.expr("int(comparison % 4294967296)").alias("comparison"), "outcome")
    return stats.run_accuracy_stats(split, ["comparison"])


def sequences_from_counts(annotations: DataFrame, codes: list[str], key: str = "sample_id") -> DataFrame:
    """(key, side, pos, code_idx): the orders of behaviours in the sections of annotations that were made to count them."""
    return extract_sequence(split_sections(annotations, key), codes, [key, "side"], "section")


def seed_stability(facts: DataFrame, seeds: int, method: str = "naive_bayes_multinomial") -> DataFrame:
    """Accuracy statistics of each comparison over ``seeds`` splits; each (seed, comparison) is a comparison of its own in one job."""
    key = F.col("run").cast("long") * 2**32 + F.col("comparison")
    runs = pairs.repeated(facts, seeds).withColumn("held", F.md5(F.concat_ws(":", F.col("run").cast("string"), F.col("question_id").cast("string"))) < "4").withColumn("comparison", key.cast("long"))
    outcomes = resolved(method, runs.where("NOT held"), runs.where("held"))
    split = outcomes.select(F.expr("int(comparison div 4294967296)").alias("run"), F.expr("int(comparison % 4294967296)").alias("comparison"), "outcome")
    return stats.run_accuracy_stats(split, ["comparison"])


def correct_vs_wrong(facts: DataFrame, paired: DataFrame, method: str = "naive_bayes_multinomial") -> DataFrame:
    """Accuracy per comparison of telling correct (side 0) from wrong traces in ``paired(comparison, slot, correct_id, wrong_id)``.

    Slots are split as questions are; a trace that the pairing repeats can be on both sides of the split.
    """
    sides = (paired.select("comparison", F.col("slot").alias("question_id"), F.lit(i).alias("side"), F.col(f"{s}_id").alias("doc_id")) for i, s in enumerate(("correct", "wrong")))
    rows = reduce(DataFrame.unionByName, sides).join(facts.select("doc_id", "code_idx", "cnt").hint("shuffle_merge"), "doc_id")
    held_out = classify.is_eval(F.col("question_id"))
    return stats.accuracy(resolved(method, rows.where(~held_out), rows.where(held_out)), ["comparison"])


def train_concat(spark: SparkSession, traces: DataFrame, seed_codes: list[str], rounds: int, max_codes: int, method: str = "naive_bayes_multinomial") -> tuple[DataFrame, list[str]]:
    """(accuracy per dataset, codes): the pairs of all comparisons as one training set, split within each, one taxonomy grown on its training part and one classifier."""
    both = pairs.pair_traces(traces).select("comparison", "question_id")
    split = pairs.split_traces(both, 5, 1, 0.8, ["comparison"], "question_id")
    rows = saved(traces.join(split.hint("shuffle_merge"), ["comparison", "question_id"]), "concat")
    _, codes = grow_taxonomy(spark, rows.where("split <> 'eval'"), seed_codes, rounds, None, max_codes)
    counted = t.count_mentions(rows.withColumn("question_id", F.col("comparison") * F.lit(2**32) + F.col("question_id")).withColumn("comparison", F.lit(0)), codes)
    facts = saved(counted, "concat-facts")  # a classifier reads them several times
    outcomes = resolved(method, facts.where("split <> 'eval'"), facts.where("split = 'eval'"))
    return stats.accuracy(outcomes.withColumn("comparison", F.expr("int(question_id div 4294967296)")), ["comparison"]), codes


def judged_by_verdict(annotated: DataFrame) -> DataFrame:
    """``annotated(comparison, question_id, model_a, model_b, annotation)`` with outcome: the models that the annotation's verdict names, without any training."""
    named = annotated.withColumns({"said_a": verdict_model(F.col("annotation"), "a"), "said_b": verdict_model(F.col("annotation"), "b")})
    return named.withColumn("outcome", stats.outcome(F.col("said_a") == F.col("model_a"), F.col("said_b") == F.col("model_b")))


def direct_rules(train: DataFrame, k: int) -> DataFrame:
    """(comparison, code_idx, leans): the k most telling codes of a comparison as rules that name a side."""
    rules = stats.top_k_codes(stats.code_stats(train), k).where("c0 <> c1")
    return rules.select("comparison", "code_idx", F.when(F.col("c0") > F.col("c1"), 0).otherwise(1).alias("leans"))


def rule_annotations(rules: DataFrame, test: DataFrame) -> DataFrame:
    """(comparison, question_id, model_a, model_b, annotation): what an annotator that only applies the rules writes. The output with the larger balance of counts towards side 0 is given to its model."""
    lean = F.when(F.col("leans") == 0, F.col("cnt")).when(F.col("leans") == 1, -F.col("cnt"))
    hits = test.join(F.broadcast(rules), ["comparison", "code_idx"], "left").groupBy("comparison", "question_id", "side", "model").agg(F.coalesce(F.sum(lean), F.lit(0)).alias("balance"))
    a, b = (hits.where(F.col("side") == i).select("comparison", "question_id", F.col("model").alias(f"model_{x}"), F.col("balance").alias(f"balance_{x}")) for i, x in enumerate("ab"))
    first = F.col("balance_a") >= F.col("balance_b")
    said = [F.concat(F.lit(f"The author model of output {x} is "), F.when(first == (x == "a"), F.col("model_a")).otherwise(F.col("model_b"))) for x in "ab"]
    return a.join(b.hint("shuffle_merge"), ["comparison", "question_id"]).select("comparison", "question_id", "model_a", "model_b", F.concat(said[0], F.lit(".\n"), said[1], F.lit(".")).alias("annotation"))


# ---- the rounds that grow a taxonomy ---------------------------------------

Annotator = Callable[[DataFrame, list[str]], DataFrame]
Proposer = Callable[[DataFrame, list[str]], list[str]]


def lexical_annotator(samples: DataFrame, codes: list[str]) -> DataFrame:
    """The default annotator: whole-word counts. Any function of (samples, codes) to facts can stand in, such as ``prompted_annotator``."""
    return t.count_mentions(samples, codes)


def lexical_call(prompts: Sequence[calls.Prompt]) -> list[str]:
    """Answers annotation prompts as a model would, in the annotation's format, with whole-word counts of the taxonomy in the prompt."""
    said = []
    for p in prompts:
        names = tuple(line.partition(": ")[0] for line in p.system.split("\n")[1:])
        outputs = re.split(r"(?:\A|\n\n)OUTPUT ([AB]):\n", p.user)[1:]
        found = [(letter, mentioned(names, text)) for letter, text in zip(outputs[::2], outputs[1::2], strict=True)]
        said.append("\n".join("\n".join([f"### {name}", *(f"Count in OUTPUT {letter}: {counts[i]}" for letter, counts in found)]) for i, name in enumerate(names)))
    return said


def defined(codes: DataFrame) -> DataFrame:
    return codes.withColumn("definition", F.concat(F.lit("uses the word "), "code_name"))


def prompted_annotator(call: calls.Call, log: str, instructions: str = "Annotate.", **limits: int) -> Annotator:
    """An annotator that renders a prompt a sample, has ``calls.ask`` send them in batches, with its log in the folder ``log``, and parses the counts from the answers. A code that an answer leaves out is 0; a sample whose prompt failed for good has no facts."""

    def annotate(samples: DataFrame, codes: list[str]) -> DataFrame:
        book = t.codebook(samples.sparkSession, codes)
        id_ = F.col("doc_id").cast("string")
        prompts = annotation_prompts(samples.select(id_.alias("sample_id"), F.array(F.coalesce("thinking", F.lit(""))).alias("outputs")), defined(book), instructions)
        answers = saved(calls.ask(prompts, call, log, **limits).select("sample_id", F.col("text").alias("annotation")), "answers")
        counts = parse_counts(answers).where("side = 'a'").select("sample_id", "code_name", "cnt")
        answered = samples.drop("thinking").withColumn("sample_id", id_).join(answers.select("sample_id").hint("shuffle_merge"), "sample_id", "left_semi")
        grid = answered.crossJoin(F.broadcast(book))  # the taxonomy's rows
        facts = grid.join(counts.hint("shuffle_merge"), ["sample_id", "code_name"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long")))
        return facts.select(*(c for c in samples.columns if c != "thinking"), "code_idx", "code_name", "cnt")

    return annotate


def word_sums(samples: DataFrame, *keys: str) -> DataFrame:
    """(keys, w, d): how many more texts of side 0 than of the other side hold a word of two letters or more."""
    words = samples.select(*keys, "side", F.explode(F.array_distinct(F.split(F.lower("thinking"), t.TOKEN_BORDER))).alias("w")).where(F.length("w") > 1)
    return words.groupBy(*keys, "w").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).alias("d"))


def most_uneven_word(sums: DataFrame, codes: list[str]) -> list[str]:
    """The word of ``sums(w, d)``, not yet a code, that differs most between the sides, ties by the word. One row reaches the driver."""
    whole = sums.where(~F.col("w").isin(*codes)).groupBy("w").agg(F.sum("d").alias("d"))
    return [r["w"] for r in whole.orderBy(F.desc(F.abs("d")), "w").limit(1).collect()]


def frequent_word_proposer(samples: DataFrame, codes: list[str]) -> list[str]:
    """The default update: ``most_uneven_word`` of the samples."""
    return most_uneven_word(word_sums(samples), codes)


ROUNDS = "round int, codes int, samples long, cnt long"


def grow_taxonomy(spark: SparkSession, samples: DataFrame, seed_codes: list[str], rounds: int, per_round: int | None, max_codes: int, annotate: Annotator = lexical_annotator, propose: Proposer | None = frequent_word_proposer, log: Callable[..., None] | None = None, run: str | None = None) -> tuple[DataFrame, list[str]]:
    """(round table, codes): accumulate a round's samples, annotate them, then update the taxonomy; stop by rule.

    A round takes ``per_round`` samples of each comparison; with None the questions are dealt
    to the rounds in equal shares, both sides together, so that the rounds cover every sample.
    One Spark job a step. A round appends its facts, the taxonomy's next version and, last, its
    row of the round table to the folder ``run`` (a scratch folder if None). Called again with
    the same arguments, the loop goes on after the last whole round of ``run``.
    ``propose`` None keeps the taxonomy fixed.
    """
    run = run or scratch_path(spark, "run")
    history = _rounds_done(spark, run)
    if history:
        events = parts(spark, f"{run}/versions", versions.EVENTS, len(history))
        found = versions.codebooks(events, spark.createDataFrame([(len(history),)], "version long")).orderBy("code_idx")
        codes = [*seed_codes, *(r["code_name"] for r in found.collect())]  # names of one taxonomy
    else:
        codes = list(seed_codes)
    dealt = _in_shares(samples, rounds) if per_round is None else _in_rounds(samples, per_round)
    rounded = saved(dealt, "rounds")
    stopped = bool(history) and codebook.should_stop(spark.createDataFrame(history, ROUNDS), max_codes=max_codes)
    for number in range(len(history), rounds):
        if stopped:
            break
        batch = rounded.where(F.col("round") == number)
        facts = appended(annotate(batch, codes), f"{run}/facts", number)
        total = facts.agg(F.count_distinct("doc_id").alias("n"), F.sum("cnt").alias("cnt")).first()
        row = (number, len(codes), total["n"], total["cnt"] or 0)
        history.append(row)
        if log:
            log(round=number, codes=len(codes), samples=total["n"])
        stopped = codebook.should_stop(spark.createDataFrame(history, ROUNDS), max_codes=max_codes)
        new = [c for c in propose(batch, codes) if c not in codes] if propose and not stopped else []
        codes += new
        events = [(number + 1, number or None, i, "put", c, None) for i, c in enumerate(new)] or [(number + 1, number or None, 0, None, None, None)]
        appended(spark.createDataFrame(events, versions.EVENTS), f"{run}/versions", number)
        appended(spark.createDataFrame([row], ROUNDS), f"{run}/rounds", number)
    return spark.createDataFrame(history, ROUNDS), codes


def _rounds_done(spark: SparkSession, run: str) -> list[tuple]:
    """The round table of a run's whole rounds so far, a row a round."""
    found: list[tuple] = []
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    while True:
        done = files.Path(f"{run}/rounds/part={len(found)}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            return found
        found.append(tuple(spark.read.schema(ROUNDS).parquet(f"{run}/rounds/part={len(found)}").first()))


def _dense(facts: DataFrame, codebook_: DataFrame) -> DataFrame:
    """Facts of the taxonomy's codes, NULL for a trace that was annotated before a code existed; codes that are gone drop out."""
    keys = ["comparison", "question_id", "side", "model", "doc_id", "round"]
    grid = facts.select(*keys).distinct().crossJoin(F.broadcast(codebook_))
    return grid.join(facts.select("doc_id", "code_name", "cnt").hint("shuffle_merge"), ["doc_id", "code_name"], "left")


def _most_telling(facts: DataFrame, k: int) -> list[str]:
    """The k codes that tell some comparison's models apart best, in their order; k rows reach the driver."""
    score = F.abs(F.col("c0") / F.nullif(F.col("total"), F.lit(0)) - 0.5) * F.col("total")
    best = stats.code_stats(facts).groupBy("code_idx", "code_name").agg(F.max(F.round(F.coalesce(score, F.lit(0.0)), 6)).alias("score")).orderBy(F.desc("score"), "code_idx").limit(k)
    return [r["code_name"] for r in sorted(best.collect(), key=lambda r: r["code_idx"])]


def train_taxonomy(
    spark: SparkSession,
    samples: DataFrame,
    seed_codes: list[str],
    rounds: int,
    max_codes: int,
    epochs: int = 1,
    warm_start: int = 0,
    patience: int = 1,
    impute: str = "mean",
    method: str = "naive_bayes_multinomial",
    annotate: Annotator = lexical_annotator,
    propose: Proposer = frequent_word_proposer,
    log: Callable[..., None] | None = None,
) -> tuple[DataFrame, list[str]]:
    """(round table, codes): the training loop of a taxonomy.

    ``warm_start`` forced updates come first. A round annotates its share of the samples
    with the codes of the moment, adds the facts to those so far, fills what older traces
    lack, and judges the round's pairs by a classifier on the facts of the rounds before
    (the first round by its own). If the accuracy has not risen for more than ``patience``
    rounds, the codes of the best round come back; else the update adds a code. A taxonomy
    over ``max_codes`` is pruned to the most telling ones. An epoch deals the samples anew
    and starts with no facts; texts move once, with their shares of all epochs, and the
    default update counts their words once for all rounds. A step is one job, a round appends its facts, and a row or
    the taxonomy's names reach the driver.
    """
    codes, history = list(seed_codes), []
    best, best_codes, stale = -1.0, list(codes), 0
    texts = saved(_in_all_shares(samples, rounds, epochs), "rounds")
    sums = saved(word_sums(texts, "shares"), "word-sums") if propose is frequent_word_proposer else None
    share = lambda df, epoch, number: df.withColumn("round", F.get("shares", F.lit(epoch))).where(F.col("round") == number).drop("shares")
    update = lambda epoch, number: propose(share(texts, epoch, number), codes) if sums is None else most_uneven_word(share(sums, epoch, number), codes)
    for epoch in range(epochs):
        kept = scratch_path(spark, "facts")
        for _ in range(warm_start if epoch == 0 else 0):
            codes += update(0, 0)
        for number in range(rounds):
            facts = appended(annotate(share(texts, epoch, number), codes), kept, number)
            dense = saved(_dense(facts, t.codebook(spark, codes)), "dense")
            imputed = chosen(vectors.IMPUTERS, impute)(dense).drop("cnt").withColumnRenamed("value", "cnt")
            if "round" not in imputed.columns:
                imputed = imputed.join(dense.select("doc_id", "round").distinct().hint("shuffle_merge"), "doc_id")
            filled = saved(imputed, "filled")
            earlier = filled.where(F.col("round") < number) if number else filled
            found = stats.accuracy(resolved(method, earlier, filled.where(F.col("round") == number))).first()
            total = dense.agg(F.count_distinct("doc_id")).first()[0]
            restored = False
            if (found["accuracy"] or 0.0) > best:
                best, best_codes, stale = found["accuracy"] or 0.0, list(codes), 0
            else:
                stale += 1
            history.append((epoch, number, len(codes), total, found["n"], found["accuracy"], stale > patience))
            if log:
                log(epoch=epoch, round=number, codes=list(codes), accuracy=found["accuracy"])
            if stale > patience:
                codes, stale, restored = list(best_codes), 0, True
            if not restored:
                codes += [c for c in update(epoch, number) if c not in codes]
            if len(codes) > max_codes:
                codes = _most_telling(_dense(facts, t.codebook(spark, codes)), max_codes)
    return spark.createDataFrame(history, "epoch int, round int, codes int, samples long, judged long, accuracy double, restored boolean"), codes


def _shares(samples: DataFrame, rounds: int, seed: int) -> DataFrame:
    """(comparison, question_id, round): each comparison's shuffled questions in ``rounds`` equal shares, numbered in ranges of the digest."""
    digest = F.conv(F.substring(t.shuffled_rank(F.col("question_id"), seed), 1, 15), 16, 10).cast("long")
    questions = samples.select("comparison", "question_id").distinct().withColumn("digest", digest)
    sizes = questions.groupBy("comparison").agg(F.count("*").alias("n"))
    return t.numbered(questions, ["comparison"], "digest", "place", 1 << 54).join(F.broadcast(sizes), "comparison").select("comparison", "question_id", F.floor(F.col("place") * rounds / F.col("n")).alias("round"))


def _in_shares(samples: DataFrame, rounds: int, seed: int = 1) -> DataFrame:
    """``samples`` with round, their question's share."""
    return samples.join(_shares(samples, rounds, seed).hint("shuffle_merge"), ["comparison", "question_id"])


def _in_all_shares(samples: DataFrame, rounds: int, epochs: int) -> DataFrame:
    """``samples`` with shares, their rounds in each epoch; only keys are numbered, texts are joined once."""
    keys = saved(samples.select("comparison", "question_id").distinct(), "questions")
    each = reduce(DataFrame.unionByName, (_shares(keys, rounds, e + 1).withColumn("epoch", F.lit(e)) for e in range(epochs)))
    shares = each.groupBy("comparison", "question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "round"))), lambda x: x["round"]).alias("shares"))
    return samples.join(shares.hint("shuffle_merge"), ["comparison", "question_id"])


def _in_rounds(samples: DataFrame, per_round: int) -> DataFrame:
    """``samples`` with round: each comparison's shuffled samples, ``per_round`` a round. Only keys are numbered, texts are joined once."""
    keys = samples.select("comparison", "question_id", "side").withColumn("order_", F.col("question_id") * 2 + F.col("side"))
    placed = t.shuffle_numbered(keys, ["comparison"], t.shuffled_rank(F.col("question_id"), 1), "order_", "round").select("comparison", "question_id", "side", F.floor(F.col("round") / per_round).alias("round"))
    return samples.join(placed.hint("shuffle_merge"), ["comparison", "question_id", "side"])
