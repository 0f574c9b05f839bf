"""Chat formatting for training: templates, escapes, windows and loss masks.

A turn is written ``### role: text</turn>`` and a line feed. In texts and roles a
backslash goes before every backslash, ``#`` and the slash of ``</``, so no text
can look like a mark and reading removes one backslash before any character.

A conversation becomes windows of whole turns. Prefix sums of the turns' token
counts choose the spans: each window begins with the conversation's system turn
and up to ``history`` tokens of the turns before it, then takes new turns up to
``budget``; a turn that alone is longer gets a window of its own, uncut. Repeated
turns aren't targets again: the loss mask of a window covers the text of its new
assistant turns only.

Turns get their places in the conversation by sampled ranges, so that no task
holds or sorts a whole conversation, and are dealt by conversation and block of
BLOCK places, whatever the turn numbers are. The last turns of a block, up to
``history`` tokens, go to the next one too, so its first window repeats them as any
other does; a window takes new turns of one block only. A
conversation's checksum alone needs its windows in order: they stream through one
task, none is held.

Nulls: a null text or role is empty; rows with a null ``conv_id`` are one
conversation; null turn numbers come first. Equal turn numbers are ordered by role
and a digest of the text; equal rows are turns like others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_sorted_groups, saved

BLOCK = 512
_CONVERSATION = ("unknown", "conv")
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_READ = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    once = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#"))
    return F.replace(once, F.lit("</"), F.lit("<\\/"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn in a window, with the place of its written text."""
    out, at = [], 0
    while at < len(formatted):
        m = _READ.match(formatted, at)
        if not m:
            raise ValueError("not a formatted window")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def formatted_turns(df: DataFrame) -> DataFrame:
    """Each turn as written, its token count, and where its text lies in it."""
    role = F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:"))
    head = F.concat(F.lit(OPEN), role, F.lit(MIDDLE))
    made = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), head.alias("head"), F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("written"))
    return made.withColumn("tokens", F.regexp_count("written", F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long"))


def placed_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with (unknown, conv), which stand for ``conv_id`` without nulls, and their place from 0 in the conversation.

    Ranges are numbered by themselves and the sizes of the ranges before are added.
    """
    order = ("turn", "role", "digest", "tie")
    keyed = turns.withColumns({"unknown": F.col("conv_id").isNull(), "conv": F.coalesce("conv_id", F.lit(0)), "digest": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    ranged = saved(keyed.repartitionByRange(*_CONVERSATION, *order).withColumn("range", F.spark_partition_id()), "ranged-turns")
    sizes = ranged.groupBy(*_CONVERSATION, "range").agg(F.count("*").alias("size"))
    before = saved(sizes.withColumn("before", F.sum("size").over(Window.partitionBy(*_CONVERSATION).orderBy("range")) - F.col("size")).drop("size"), "turn-ranges")
    inside = F.row_number().over(Window.partitionBy(*_CONVERSATION, "range").orderBy(*order)) - 1
    joined = ranged.withColumn("inside", inside).join(before.hint("shuffle_merge"), [*_CONVERSATION, "range"])
    return joined.withColumn("place", F.col("before") + F.col("inside")).drop("digest", "tie", "range", "inside", "before")


def chat_windows(df: DataFrame, budget: int = 512, history: int = 128, target: str = "assistant") -> DataFrame:
    """(conv_id, block, window, n_repeated, n_turns, formatted, loss): formatted windows and the (start, end) spans under the loss."""
    turns = placed_turns(formatted_turns(df))
    first_system = F.min_by(F.struct("written", "tokens"), "place")
    systems = saved(turns.where("role = 'system'").groupBy(*_CONVERSATION).agg(first_system.alias("system")), "system-turns")
    placed = saved(turns.withColumn("block", F.expr(f"place div {BLOCK}")).join(systems.hint("shuffle_merge"), list(_CONVERSATION), "left"), "placed-turns")
    to_end = F.sum("tokens").over(Window.partitionBy(*_CONVERSATION, "block").orderBy(F.desc("place")))  # at most BLOCK rows
    before = placed.withColumn("to_end", to_end).where(F.col("to_end") <= history).drop("to_end").withColumn("block", F.col("block") + 1)
    later = placed.where(F.col("block") > 0).select(*_CONVERSATION, "block").distinct()
    again = before.join(saved(later, "later-blocks").hint("shuffle_merge"), [*_CONVERSATION, "block"], "left_semi")
    named = placed.withColumn("again", F.lit(False)).unionByName(again.withColumn("again", F.lit(True)))
    at_start = F.col("place") % BLOCK == 0  # a block needs its system turn once
    columns = [*_CONVERSATION, "block", "place", F.char_length("head").alias("text_from"), "written", "tokens", (F.col("role") == target).alias("is_target"), "again", F.when(at_start, F.col("system.written")).alias("sys_written"), F.when(at_start, F.col("system.tokens")).alias("sys_tokens")]

    def windows(unknown, conv, block, place, text_from, written, tokens, is_target, again, sys_written, sys_tokens) -> list[tuple]:  # noqa: ANN001
        at = int(again.sum())  # turns of the block before come first
        system, system_size, written = sys_written[at], sys_tokens[at], written.tolist()
        sums, out = np.concatenate([[0], np.cumsum(tokens)]), []
        while at < len(written):
            head, room = [], budget
            back = at
            if at or (isinstance(system, str) and written[0] != system):
                if isinstance(system, str):
                    head, room = [system], budget - int(system_size)
                back = int(np.searchsorted(sums, sums[at] - history))
                while back < at and written[back] == system:
                    back += 1
                if sums[at + 1] - sums[back] > room:
                    back = at
            end = max(at + 1, int(np.searchsorted(sums, sums[back] + room, "right")) - 1)
            parts = [*head, *written[back:end]]
            starts = np.cumsum([0, *map(len, parts)])
            skip = len(parts) - (end - at)
            loss = [{"start": int(starts[skip + i - at] + text_from[i]), "end": int(starts[skip + i - at + 1] - len(CLOSE))} for i in range(at, end) if is_target[i]]
            out.append((None if unknown[0] else int(conv[0]), int(block[0]), len(out), skip, len(parts), "".join(parts), loss))
            at = end
        return out

    return by_sorted_groups(named.select(*columns), [*_CONVERSATION, "block"], windows, "conv_id long, block long, window long, n_repeated int, n_turns int, formatted string, loss array<struct<start:int,end:int>>", ("place",))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from its windows alone."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None

        def result() -> list:
            return [key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for rows in batches:
            done = []
            for conv, repeated, formatted, loss in zip(rows["conv_id"], rows["n_repeated"], rows["formatted"], rows["loss"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if key != (conv,):
                    if key:
                        done.append(result())
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_turns(formatted)[repeated:]
                state[0] += len(turns)
                state[1].update("".join(f"{r}\n{t}\n" for r, t, _, _ in turns).encode())
                target = "".join(unescape(formatted[x["start"] : x["end"]]) for x in loss)
                state[2] += len(target)
                state[3].update(target.encode())
                state[4] += len(formatted)
            yield pd.DataFrame(done, columns=_DIGESTS)
        if key:
            yield pd.DataFrame([result()], columns=_DIGESTS)

    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
    return ordered.select("conv_id", "n_repeated", "formatted", "loss").mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
