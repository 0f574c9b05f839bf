"""Alignment of two tokenizations of the same texts, and how often ids are linked in the corpus.

1. A text, with a space before it, is cut before single spaces between characters that
   aren't white space. No token of either vocabulary reaches over such a place (checked
   when the vocabularies are loaded), so both tokenizations of the parts make up those
   of the text. Each distinct part is worked off once, and a worker remembers recent ones.
2. Pointer jumping: every token points to the token of the other side that reaches farthest
   right among those it overlaps, or to itself if both end at the same byte (there, the first
   side's token points to the other's). All successors of a batch are doubled at once (each
   takes its successor's) until nothing changes: then each token knows the last token of its
   component, and components are the groups.
3. Tasks work off chunks of about CHUNK links. Each text keeps its distinct id pairs; a
   chunk adds up in how many of its texts each pair is, and Spark sums the chunks.
4. A pair's count comes back to the chunks that have it by one join, not to each text:
   chunk and counts meet sorted, and texts stream by the counts of their own chunk.

Nulls: null and empty texts, and texts whose tokens' bytes aren't the text's, have no
tokens. Rows that repeat an id are texts of their own and count in their own right.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, binaries, saved, scratch, texts
from .tokens import Encoder, vocabulary_path

CHUNK = 6_000_000
#: Parts that a worker remembers, twice.
KEPT = 150_000
_BORDER = re.compile(r"(?<=\S) (?=\S)")
_MARK = "▁"
_SPECIAL = re.compile(r"<0x([0-9A-F]{2})>")
_FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_NOTHING = (0, 0, 0, 0, b"", b"")


class Pair:
    """The two vocabularies: tokens of texts without special tokens, and each id's bytes."""

    def __init__(self, first: str, second: str):
        import sentencepiece

        self.a = Encoder(first)
        self.a.library.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(second))
        self.bytes_a = self.a._pieces
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _SPECIAL.fullmatch(x)) else x.replace(_MARK, " ").encode() for i, x in enumerate(names)]
        self.lengths = np.array([len(x) for x in self.bytes_a], np.int64), np.array([len(x) for x in self.bytes_b], np.int64)
        self.size_b = len(names)
        self.kind = np.dtype("<u4") if len(self.bytes_a) * self.size_b < 1 << 32 else np.dtype("<u8")
        #: Whether no token has a space after another character, so that texts may be cut before one.
        self.divisible = self.a.by_ranks is not None and not any(re.search(rb"[^ ] ", x) for i, x in enumerate(self.bytes_b) if not (self.b.is_control(i) or self.b.is_unknown(i)))
        self.texts = [[str(i).encode() + end for end in (b",", b"|") for i in range(len(self.bytes_a))], [str(i).encode() + end for end in (b",", b";") for i in range(self.size_b)]]
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def parts(self, text: str) -> list[str]:
        spaced = " " + text
        if not self.divisible:
            return [spaced]
        first, *rest = _BORDER.split(spaced)
        return [first, *(" " + x for x in rest)]

    def learn(self, parts: set[str]) -> None:
        """Work off the parts that aren't known, all together."""
        if len(self.known) > KEPT:
            self.known, self.before = {}, self.known
        new = []
        for part in parts - self.known.keys():
            if part in self.before:
                self.known[part] = self.before[part]
            else:
                new.append(part)
        a = [np.frombuffer(self.a.encode(x), "<u4").astype(np.int64) for x in new]
        b = [np.array(self.b.encode(x[1:]), np.int64) for x in new]  # it adds the space itself
        spelt = [self._spells(self.bytes_a, i, x) and self._spells(self.bytes_b, j, x) for i, j, x in zip(a, b, new, strict=True)]
        self.known.update((x, None) for x, ok in zip(new, spelt, strict=True) if not ok)
        good = [x for x, ok in zip(new, spelt, strict=True) if ok]
        self.known.update(zip(good, aligned(self, [x for x, ok in zip(a, spelt, strict=True) if ok], [x for x, ok in zip(b, spelt, strict=True) if ok]), strict=True))

    def of_texts(self, texts: list[str]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, links) of whole texts."""
        split = [self.parts(x) if x else [] for x in texts]
        self.learn({x for parts in split for x in parts})
        out = []
        for parts in split:
            found = list(map(self.known.__getitem__, parts))
            if not found or None in found:
                out.append(_NOTHING)
                continue
            a, b, groups, links, written, codes = zip(*found, strict=True)
            out.append((sum(a), sum(b), sum(groups), sum(links), b"".join(written)[:-1], b"".join(codes)))
        return out

    @staticmethod
    def _spells(strings: list[bytes], ids: np.ndarray, part: str) -> bool:
        return b"".join(map(strings.__getitem__, ids.tolist())) == part.encode()


@functools.lru_cache(2)
def vocabularies(first: str, second: str) -> Pair:
    """One per worker process."""
    return Pair(first, second)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For each token (the first side's, then the second's) the last token of its component, from where the tokens end.

    Both sides cover the same bytes, each side's tokens in order, none without bytes.
    """
    n_a, n_b = len(ends_a), len(ends_b)
    over_a = n_a + np.searchsorted(ends_b, ends_a)  # the token that holds the last byte reaches farthest
    over_b = np.searchsorted(ends_a, ends_b)
    after = np.concatenate([over_a, np.where(ends_a[over_b] == ends_b, np.arange(n_a, n_a + n_b), over_b)])
    while True:
        doubled = after[after]
        if (doubled == after).all():
            return after
        after = doubled


def aligned(pair: Pair, a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups, links) of each part: groups as written, links as packed pair codes."""
    if not a:
        return []
    ids_a, ids_b = np.concatenate(a), np.concatenate(b)
    ends_a, ends_b = np.cumsum(pair.lengths[0][ids_a]), np.cumsum(pair.lengths[1][ids_b])
    n_a, n_b = len(ids_a), len(ids_b)
    label = terminals(ends_a, ends_b)
    group_a, group_b = label[:n_a], label[n_a:]
    last_a = np.append(group_a[1:] != group_a[:-1], True)
    last_b = np.append(group_b[1:] != group_b[:-1], True)
    # in the written form the first side's tokens of a group come before the second's.
    at_a = np.arange(n_a) + np.searchsorted(group_b, group_a)
    at_b = np.arange(n_b) + np.searchsorted(group_a, group_b, "right")
    written = np.zeros(n_a + n_b, np.int64)
    written[at_a] = ids_a + len(pair.bytes_a) * last_a
    written[at_b] = 2 * len(pair.bytes_a) + ids_b + pair.size_b * last_b
    strings = [*pair.texts[0], *pair.texts[1]]
    names = [strings[i] for i in written.tolist()]
    # each stretch between neighbouring ends of either side lies in one token of each: a link.
    ends = np.union1d(ends_a, ends_b)
    codes = ids_a[np.searchsorted(ends_a, ends)] * pair.size_b + ids_b[np.searchsorted(ends_b, ends)]
    count_a, count_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    stop_a, stop_b = np.cumsum(count_a), np.cumsum(count_b)
    groups = np.cumsum(last_b)[stop_b - 1]
    stop_links = np.searchsorted(ends, ends_b[stop_b - 1], "right")
    codes, out, one, link, before = codes.astype(pair.kind), [], 0, 0, 0
    for i in range(len(a)):
        two = int(stop_a[i] + stop_b[i])
        out.append((int(count_a[i]), int(count_b[i]), int(groups[i]) - before, int(stop_links[i]) - link, b"".join(names[one:two]), codes[link : stop_links[i]].tobytes()))
        one, link, before = two, int(stop_links[i]), int(groups[i])
    return out


def _unpacked(raw: bytes, kind: np.dtype) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, kind), dtype=kind)


def _packed(codes: np.ndarray) -> bytes:
    """Sorted codes as their differences."""
    return np.diff(codes, prepend=codes[:0].dtype.type(0)).tobytes() if len(codes) else b""


def chunks(rows: DataFrame, first: str, second: str, chunk: int) -> DataFrame:
    """Saved: for each row of ``rows(own_0 ..., text)`` its chunk, figures, digest, and distinct pairs with their places in the text; and for each chunk (where ``own`` is false) its distinct pairs with their texts."""
    at = len(rows.columns) - 1
    names = ["chunk", "own", *rows.columns[:-1], *_FIGURES, "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = vocabularies(first, second)
        context = TaskContext.get()
        number, held, size = (context.partitionId() if context else 0) << 24, [], 0

        def summary(like: pa.RecordBatch) -> pa.RecordBatch:
            codes, times = np.unique(np.concatenate(held), return_counts=True)
            columns = [pa.array([number]), pa.array([False]), *(pa.nulls(1, x.type) for x in like.columns[:at]), *(pa.nulls(1, pa.int64()) for _ in _FIGURES), pa.nulls(1, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, binaries([_packed(codes)]), binaries([times.astype("<u4").tobytes()])], names)

        for batch in batches:
            step = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                found = pair.of_texts(texts(part.column(at)))
                links = [np.unique(np.frombuffer(x[5], pair.kind), return_counts=True) for x in found]
                figures = [pa.array([x[k] for x in found], pa.int64()) for k in range(4)]
                digests = pa.array([hashlib.sha256(x[4]).hexdigest() if x[4] else "" for x in found])
                columns = [pa.array([number] * len(found)), pa.array([True] * len(found)), *part.columns[:at], *figures, digests]
                yield pa.RecordBatch.from_arrays([*columns, binaries([_packed(c) for c, _ in links]), binaries([t.astype("<u4").tobytes() for _, t in links])], names)
                held += [c for c, _ in links]
                size += sum(len(c) for c, _ in links)
                if size >= chunk:
                    yield summary(part)
                    number, held, size = number + 1, [], 0
                last = part
        if held:
            yield summary(last)

    own = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return saved(rows.mapInArrow(run, f"chunk long, own boolean, {own}{''.join(f'{x} long, ' for x in _FIGURES)}groups_sha256 string, pairs binary, times binary"), "token-chunks")


def pair_counts(made: DataFrame, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """Saved (chunk, pair, a, texts), the pairs of each chunk, and (a, b, pair, count, best), those of the corpus: in how many texts a pair is, and whether no pair of its first id is in more."""

    def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = vocabularies(first, second)
        for batch in batches:
            for number, codes, times in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                codes, times = _unpacked(codes, pair.kind).astype(np.int64), np.frombuffer(times, "<u4").astype(np.int64)
                for i in range(0, len(codes), 100_000):
                    some = codes[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), number)), pa.array(some), pa.array(some // pair.size_b), pa.array(some % pair.size_b), pa.array(times[i : i + 100_000])], ["chunk", "pair", "a", "b", "texts"])

    each = saved(made.where("NOT own").select("chunk", "pairs", "times").mapInArrow(expanded, "chunk long, pair long, a long, b long, texts long"), "chunk-pairs")
    sums = each.groupBy("a", "b", "pair").agg(F.sum("texts").alias("count"))
    highest = F.max("count").over(Window.partitionBy("a"))  # no more rows than the second vocabulary has ids
    return each, saved(sums.withColumn("best", F.col("count") == highest), "pair-counts")


def align(df: DataFrame, first: str, second: str, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``df`` without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; columns with these names are replaced."""
    made_names = (*_FIGURES, "n_best", "count_sum", "groups_sha256")
    kept = [c for c in df.columns if c not in (text, *made_names)]
    rows = df.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(kept)), F.col(f"`{text}`").cast("string").alias("text"))
    owns = rows.columns[:-1]
    with scratch(df.sparkSession) as stay:
        made = chunks(rows, first, second, chunk)
        each, counts = pair_counts(made, first, second)
        answers = saved(each.select("chunk", "pair").join(counts.select("pair", "count", "best").hint("shuffle_merge"), "pair"), "chunk-counts")
        stay += [made, answers]

    def meet(mine: pa.Table, counted: pa.Table) -> pa.Table:
        kind = vocabularies(first, second).kind
        pairs, count, best = (counted.column(x).to_numpy() for x in ("pair", "count", "best"))
        order = np.argsort(pairs)
        pairs, count, best = pairs[order], count[order], best[order]
        sums, bests = [], []
        for codes, times in zip(mine.column("pairs").to_pylist(), mine.column("times").to_pylist(), strict=True):
            at = np.searchsorted(pairs, _unpacked(codes, kind))
            times = np.frombuffer(times, "<u4").astype(np.int64)
            sums.append(int((count[at] * times).sum()))
            bests.append(int(times[best[at]].sum()))
        return pa.table([*(mine.column(x) for x in owns), *(mine.column(x) for x in (*_FIGURES, "groups_sha256")), pa.array(bests, pa.int64()), pa.array(sums, pa.int64())], names=[*owns, *_FIGURES, "groups_sha256", "n_best", "count_sum"])

    own = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    schema = f"{own}{''.join(f'{x} long, ' for x in _FIGURES)}groups_sha256 string, n_best long, count_sum long"
    mine = made.where("own").groupBy("chunk")  # a chunk is of bounded size
    found = mine.cogroup(answers.groupBy("chunk")).applyInArrow(meet, schema)
    return found.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(kept)), *made_names)
