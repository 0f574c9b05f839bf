"""Phrases of two to four words whose words keep together, by language.

1. A task counts the paths of words in its texts in a HAT-trie: a shallow trie on word
   ids, whose leaves are hash containers of the ids below; a container over BURST
   entries bursts into one for each next word. When a task holds MOST entries, its largest
   subtrees leave it whole, as sorted runs, until half is gone.
2. Runs are merged by ranges of the sorted order: a range is a set of whole subtrees,
   or a part of one that is too large. Equal phrases of a run are one row, so no phrase
   is many rows of a range.
3. Words come first, then pairs, then windows of three and four: a phrase is no more
   frequent than its parts. With each pass, tasks also count the next longer phrases in
   2^BUCKET_BITS buckets by hash, which lie spread over PARTS parts of the shuffle; a
   phrase in a bucket counted too seldom can't be frequent and isn't put into a trie.
   Tasks learn the other buckets from a filter of a fixed 2^FILTER_BITS bits, which Spark
   builds by ``bitmap`` aggregates. A bit may stand for several phrases; then some are
   counted in vain, none is lost. Texts are read once for each of the three.
4. Both parts of every cut are looked up by joins on written tables; longer phrases give
   the shorter ones inside them their largest count.

Words are runs outside ``[\\x20\\x09]`` inside pieces between ``[.,;:!?\\x0A-\\x0D]``, A-Z in
lower case. Scores are whole numbers, computed in decimals, as products may pass 64 bits.

Nulls: a null text has no words; a null language is ``und``, together with rows that say so.
Repeated rows count again. Columns other than language and text are not read.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_BYTES, binaries, dropped, raw_texts, saved, scratch

#: Bits of a word's id in a task; a task with so many words gives all of its counts away and starts anew.
ID_BITS = 21
BURST, MOST = 4096, 500_000
FILTER_BITS, BUCKET_BITS, PARTS = 26, 40, 2048
#: Hashed phrases that a task holds before it gives them away.
HASHED = 6_000_000
_BITMAP = 32_768  # bits of one of Spark's bitmaps
_SEED = 42
_BREAK = b"\xff"  # in no UTF-8 text
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _BREAK * 10)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text that are cut into words at once.
SEGMENT = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_PART = np.uint64((1 << BUCKET_BITS) // PARTS)  # buckets of a part
_RUN = "lang string, phrase string, count long, part int, buckets binary, counts binary"


def words_of(raw: bytes) -> list[bytes]:
    """The words of a text in UTF-8, with a mark between pieces."""
    return raw.lower().translate(_PIECES).replace(_BREAK, b" \xff ").split()


def segments(raws: list[bytes]) -> Iterator[tuple[list[bytes], int]]:
    """The words of texts in parts of about SEGMENT bytes, a mark after each text, and how many of them begin here: the last three of a part inside a text come again at the head of the next."""
    tokens: list[bytes] = []
    size = 0
    for raw in raws:
        at = 0
        while len(raw) - at > SEGMENT and (space := _SPACE.search(raw, at + SEGMENT)):
            tokens += words_of(raw[at : space.start()])
            yield tokens, max(0, len(tokens) - 3)
            tokens, at, size = tokens[-3:], space.start(), 0
        tokens += words_of(raw[at:])
        tokens.append(_BREAK)
        size += len(raw) - at
        if size > SEGMENT:
            yield tokens, len(tokens)
            tokens, size = [], 0
    if tokens:
        yield tokens, len(tokens)


def _mixed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in their order."""
    found = (one * _MIX[0]) ^ (two * _MIX[1])
    found ^= found >> np.uint64(31)
    return found * _MIX[0]


def _is_known(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = hashes >> np.uint64(64 - FILTER_BITS)
    return ((known[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1).view(bool)


class Buckets:
    """Counts of hashed phrases, as sorted buckets in PARTS parts of their range."""

    def __init__(self, least: int):
        self.least, self.held, self.size = least, [], 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(hashes >> np.uint64(64 - BUCKET_BITS))
        self.size += len(hashes)
        if self.size > HASHED:
            yield from self.given()

    def given(self) -> Iterator[pa.RecordBatch]:
        """(part, buckets as steps, counts up to ``least``)."""
        if not self.size:
            return
        buckets, counts = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.size = [], 0
        parts = (buckets // _PART).astype(np.int64)
        edges = _edges(parts)
        counts = np.minimum(counts, self.least).astype("<u4" if self.least >> 16 else "<u2")
        rows = [(int(parts[i]), np.diff(buckets[i:j], prepend=np.uint64(parts[i]) * _PART).astype("<u8" if int(_PART) >> 32 else "<u4").tobytes(), counts[i:j].tobytes()) for i, j in itertools.pairwise(edges)]
        yield _run_batch(parts=[x for x, _, _ in rows], buckets=[x for _, x, _ in rows], counts=[x for _, _, x in rows])


def _run_batch(lang: str = "", phrases: Sequence[bytes] = (), count: Sequence[int] = (), parts: Sequence[int] = (), buckets: Sequence[bytes] = (), counts: Sequence[bytes] = ()) -> pa.RecordBatch:
    """Rows of a run, or of hashed phrases."""
    size = len(phrases) or len(parts)
    if phrases:
        columns = [pa.array([lang] * size), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(count, pa.int64()), *(pa.nulls(size, x) for x in (pa.int32(), pa.binary(), pa.binary()))]
    else:
        columns = [*(pa.nulls(size, x) for x in (pa.string(), pa.string(), pa.int64())), pa.array(parts, pa.int32()), binaries(buckets), binaries(counts)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "count", "part", "buckets", "counts"])


class WordIds(dict):
    """Ids from 1 of a language's words in a task; 0 for marks and for words that the filter doesn't know."""

    def __init__(self, lang: str, known: bytes | None):
        super().__init__({_BREAK: 0})
        self.seed, self.known = xxhash.xxh64_intdigest(lang.encode(), seed=_SEED), known
        self.words, self.hashes = [b""], [0]

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word, seed=self.seed)
        bit, new = code >> 64 - FILTER_BITS, 0
        if self.known is None or self.known[bit >> 3] >> (bit & 7) & 1:
            new = len(self.words)
            self.words.append(word)
            self.hashes.append(code)
        self[word] = new
        return new


class Subtree:
    """Counts of the paths below a word: one hash container, or a subtree for each next word."""

    __slots__ = ("held", "below", "size")

    def __init__(self):
        self.held, self.below, self.size = {}, None, 0

    def put(self, keys: np.ndarray, counts: np.ndarray, ids: int) -> None:
        """Add counts of sorted keys, each of ``ids`` packed word ids."""
        if self.below is None:
            held = self.held
            for key, count in zip(keys.tolist(), counts.tolist(), strict=True):
                held[key] = held.get(key, 0) + count
            self.size = len(held)
            if self.size > BURST and ids > 1:
                self.below, self.held = {}, {}
                order = np.argsort(keys := np.fromiter(held, np.int64, len(held)))
                counts = np.fromiter(held.values(), np.int64, len(held))
                self.put(keys[order], counts[order], ids)
            return
        shift = ID_BITS * (ids - 1)
        heads = keys >> shift
        for i, j in itertools.pairwise(_edges(heads)):
            self.below.setdefault(int(heads[i]), Subtree()).put(keys[i:j] & ((1 << shift) - 1), counts[i:j], ids - 1)
        self.size = sum(x.size for x in self.below.values())

    def paths(self, ids: int) -> tuple[np.ndarray, np.ndarray]:
        """All keys and their counts."""
        if self.below is None:
            return np.fromiter(self.held, np.int64, len(self.held)), np.fromiter(self.held.values(), np.int64, len(self.held))
        found = [(x.paths(ids - 1), head << ID_BITS * (ids - 1)) for head, x in self.below.items()]
        return np.concatenate([k | head for (k, _), head in found]), np.concatenate([c for (_, c), _ in found])


def _edges(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))


class HatTrie:
    """Counts of paths of ``width`` words; a path may be shorter, with id 0 in its last place."""

    def __init__(self, width: int):
        self.width, self.root = width, {}

    def add(self, windows: np.ndarray) -> None:
        rest = np.zeros(len(windows), np.int64)
        for k in range(1, self.width):
            rest = rest << ID_BITS | windows[:, k]
        order = np.lexsort((rest, windows[:, 0]))
        first, rest = windows[order, 0], rest[order]
        new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])])) if len(first) else first
        counts = np.diff(np.append(new, len(first)))
        first, rest = first[new], rest[new]
        for i, j in itertools.pairwise(_edges(first) if len(first) else ()):
            self.root.setdefault(int(first[i]), Subtree()).put(rest[i:j], counts[i:j], self.width - 1)

    @property
    def size(self) -> int:
        return sum(x.size for x in self.root.values())

    def taken(self, left: int) -> Iterator[tuple[int, Subtree]]:
        """Take whole subtrees, the largest first, until at most ``left`` entries stay."""
        size = self.size
        for first, tree in sorted(self.root.items(), key=lambda x: -x[1].size):
            if size <= left:
                break
            size -= tree.size
            yield first, self.root.pop(first)


class LanguageCounts:
    """Counts of a language in a task: of words, of pairs, or of windows of three and four words; and the next longer phrases by hash.

    ``known`` has the filters of words, pairs and triples, as far as they are there.
    """

    def __init__(self, lang: str, level: int, known: Sequence[bytes | None], buckets: Buckets):
        self.lang, self.level, self.buckets = lang, level, buckets
        self.words, *self.known = known[0], *(x and np.frombuffer(x, np.uint8) for x in known[1:])
        self.clear()

    def clear(self) -> None:
        self.ids, self.single = WordIds(self.lang, self.words), np.zeros(1, np.int64)
        self.trie = HatTrie(2 if self.level == 2 else 4)

    @property
    def size(self) -> int:
        return len(self.ids) + self.trie.size

    def add(self, raws: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Count the texts; a part's words always get ids, if need be after all counts have left."""
        for tokens, own in segments(raws):
            if len(self.ids.words) + len(tokens) >= 1 << ID_BITS:
                yield from self.spilled(0)
            yield from self._count(tokens, own)

    def _count(self, tokens: list[bytes], own: int) -> Iterator[pa.RecordBatch]:
        ids = np.zeros(len(tokens) + 3, np.int64)
        ids[: len(tokens)] = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        hashes = np.array(self.ids.hashes, np.uint64)
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        two = _mixed(hashes[ids[at]], hashes[ids[at + 1]])
        if self.level == 1:
            counts = np.bincount(ids[:own], minlength=len(hashes))
            counts[: len(self.single)] += self.single
            self.single = counts
            yield from self.buckets.add(two[: np.searchsorted(at, own)])
            return
        good = _is_known(self.known[0], two)
        at, two = at[good], two[good]
        if self.level == 2:
            mine = at[: np.searchsorted(at, own)]
            self.trie.add(np.stack([ids[mine], ids[mine + 1]], 1))
        follows = np.flatnonzero(at[1:] == at[:-1] + 1)  # pairs that overlap in a word
        three = _mixed(two[follows], hashes[ids[at[follows] + 2]])
        at = at[follows]
        if self.level == 2:
            yield from self.buckets.add(three[: np.searchsorted(at, own)])
            return
        at = at[_is_known(self.known[1], three)]
        goes_on = np.append(at[1:] == at[:-1] + 1, False) if len(at) else at
        last = np.where(goes_on, ids[np.minimum(at + 3, len(ids) - 1)], 0)
        mine = np.searchsorted(at, own)
        self.trie.add(np.stack([ids[at], ids[at + 1], ids[at + 2], last], 1)[:mine])

    def run(self, first: int, tree: Subtree) -> list[tuple[bytes, int]]:
        """(phrase, count) of a subtree, sorted by phrase."""
        keys, counts = tree.paths(self.trie.width - 1)
        words = self.ids.words
        if self.level == 2:
            return sorted((words[first] + b" " + words[k], c) for k, c in zip(keys.tolist(), counts.tolist(), strict=True))
        mask, out, short = (1 << ID_BITS) - 1, [], Counter()
        for key, count in zip(keys.tolist(), counts.tolist(), strict=True):
            phrase = b" ".join((words[first], words[key >> 2 * ID_BITS], words[key >> ID_BITS & mask]))
            short[phrase] += count
            if key & mask:
                out.append((phrase + b" " + words[key & mask], count))
        return sorted(out + list(short.items()))

    def spilled(self, left: int) -> Iterator[pa.RecordBatch]:
        """Runs of whole subtrees until at most ``left`` entries stay; of everything, where the words alone are more."""
        everything = left == 0 or len(self.ids) > left
        if everything:
            yield from self._batches(sorted((self.ids.words[i], int(self.single[i])) for i in range(1, len(self.single))))
        rows = []
        for first, tree in self.trie.taken(-1 if everything else left - len(self.ids)):
            rows += self.run(first, tree)
            if len(rows) >= 50_000:
                yield from self._batches(rows)
                rows = []
        yield from self._batches(rows)
        if everything:
            self.clear()

    def _batches(self, rows: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 50_000):
            phrases, counts = zip(*rows[at : at + 50_000], strict=True)
            yield _run_batch(self.lang, phrases, counts)


def runs(texts: DataFrame, level: int, known: Sequence[bytes | None], least: int) -> DataFrame:
    """Saved: (lang, phrase, count) that the tasks counted in ``texts(lang, text)``, and (part, buckets, counts) of the next longer phrases."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, LanguageCounts] = {}
        buckets = Buckets(least)
        for batch in batches:
            step = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                part, by_lang = batch.slice(at, step), {}
                for lang, raw in zip(part.column(0).to_pylist(), raw_texts(part.column(1)), strict=True):
                    by_lang.setdefault(lang, []).append(raw)
                for lang, raws in by_lang.items():
                    if lang not in held:
                        held[lang] = LanguageCounts(lang, level, shared.value, buckets)
                    yield from held[lang].add(raws)
                size = sum(x.size for x in held.values())
                for x in sorted(held.values(), key=lambda x: -x.size):
                    if size <= MOST:
                        break
                    before = x.size
                    yield from x.spilled(before // 2)
                    size -= before - x.size
                if size > MOST:  # many languages
                    for x in held.values():
                        yield from x.spilled(0)
                    held = {}
        for x in held.values():
            yield from x.spilled(0)
        yield from buckets.given()

    return saved(texts.mapInArrow(count, _RUN), f"phrase-runs-{level}")


def merged(found: DataFrame, least: int) -> DataFrame:
    """Saved (lang, phrase, f) of the phrases counted ``least`` times, merged by ranges of their order."""
    ranged = found.where("lang IS NOT NULL").select("lang", "phrase", "count").repartitionByRange("lang", "phrase")
    return saved(ranged.groupBy("lang", "phrase").agg(F.sum("count").alias("f")).where(F.col("f") >= least), "phrase-counts")


def full_buckets(found: DataFrame, least: int) -> DataFrame:
    """Saved (bit): the filter's bits of the buckets counted ``least`` times."""
    steps, kind = "<u8" if int(_PART) >> 32 else "<u4", "<u4" if least >> 16 else "<u2"

    def add(group: pa.Table) -> pa.Table:  # a part of the buckets' range
        buckets = np.concatenate([np.cumsum(np.frombuffer(x, steps), dtype=np.int64) for x in group.column("buckets").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, kind) for x in group.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(buckets)
        first = _edges(buckets[order])
        full = buckets[order][first[:-1][np.add.reduceat(counts[order], first[:-1]) >= least]]
        bits = full + group.column("part")[0].as_py() * int(_PART) >> BUCKET_BITS - FILTER_BITS
        return pa.table([np.unique(bits)], names=["bit"])

    return saved(found.where("part IS NOT NULL").select("part", "buckets", "counts").groupBy("part").applyInArrow(add, "bit long"), "full-buckets")


def bit_filter(bits: DataFrame) -> bytes:
    """The bits of all rows (bit): 2^FILTER_BITS of them, whatever the number of rows."""
    at = F.col("bit") + 1
    rows = bits.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out, width = bytearray(1 << FILTER_BITS - 3), _BITMAP // 8
    for r in rows:
        out[(r.bucket - 1) * width : r.bucket * width] = r.bits
    return bytes(out)


def word_bits(words: DataFrame) -> DataFrame:
    """(bit) of each word, as ``WordIds`` has it."""
    return words.select(F.shiftrightunsigned(F.xxhash64("lang", "phrase"), 64 - FILTER_BITS).alias("bit"))


def phrase_counts(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Saved (lang, phrase, words, f) of all phrases of 1 to 4 words counted ``least`` times, and (lang, n), all words of each language."""
    with scratch(texts.sparkSession) as kept:
        singles = runs(texts, 1, (None,), least)
        totals = saved(singles.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("count").alias("n")), "word-totals")
        words = merged(singles, least)
        known = [bit_filter(word_bits(words)), bit_filter(full_buckets(singles, least))]
        dropped(texts.sparkSession, singles)
        doubles = runs(texts, 2, known, least)
        pairs = merged(doubles, least)
        known.append(bit_filter(full_buckets(doubles, least)))
        longer = merged(runs(texts, 3, known, least), least)
        every = words.unionByName(pairs).unionByName(longer).withColumn("words", F.size(F.split("phrase", " ")))
        counts = saved(every.select("lang", "phrase", "words", "f"), "all-phrases")
        kept += [counts, totals]
    return counts, totals


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more, by their lowest-scoring cut."""
    phrases = counts.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("parts"))
    cuts = phrases.select("lang", "phrase", "a", "words", "parts", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.explode(F.expr("array(named_struct('left', true, 'part', array_join(slice(parts, 1, k), ' ')), named_struct('left', false, 'part', array_join(slice(parts, k + 1, words - k), ' ')))")).alias("side"))
    named = sides.select("lang", "phrase", "a", "k", "side.left", F.col("side.part").alias("part"))
    met = named.join(counts.select("lang", F.col("phrase").alias("part"), "f").hint("shuffle_merge"), ["lang", "part"])
    both = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    whole = both.withColumn("score", F.expr("2000000BD * CAST(a AS DECIMAL(20, 0)) DIV (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"))
    best = whole.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def largest_around(counts: DataFrame) -> DataFrame:
    """(lang, phrase, around): for each shorter phrase of two words or more inside longer ones, the largest count of these."""
    longer = counts.where("words > 2").select("lang", "f", "words", F.split("phrase", " ").alias("parts"))
    sizes = longer.select("lang", "f", "words", "parts", F.explode(F.expr("sequence(2, words - 1)")).alias("n"))
    inside = sizes.select("lang", "f", F.explode(F.expr("transform(sequence(1, words - n + 1), i -> array_join(slice(parts, i, n), ' '))")).alias("phrase"))
    return inside.groupBy("lang", "phrase").agg(F.max("f").alias("around"))


def first_of_each(df: DataFrame, key: str, order: list, keep: int, salts: int = 64) -> DataFrame:
    """The first ``keep`` rows of each key with their rank; first in ``salts`` parts of a key, so no task sorts a whole one."""
    salted = df.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy(key, "salt").orderBy(*order))).where(F.col("rank") <= keep)
    return few.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= keep)


def collocations(df: DataFrame, least: int = 30, percent: int = 80, keep: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``keep`` best phrases.

    A phrase counted ``a`` times scores 2 000 000 a / (l + r), rounded down, at the cut whose
    parts' counts l and r make this least. Phrases inside a longer one with at least
    ``percent`` of their count give way to it.
    """
    texts = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    counts, totals = phrase_counts(texts, least)
    around = largest_around(counts).hint("shuffle_merge")
    gives_way = F.expr(f"100BD * CAST(around AS DECIMAL(20, 0)) >= {percent}BD * CAST(a AS DECIMAL(20, 0))")
    left = scored(counts).join(around, ["lang", "phrase"], "left").where(~F.coalesce(gives_way, F.lit(False)))
    best = first_of_each(left, "lang", [F.desc("score"), F.desc("a"), "phrase"], keep)
    return best.join(totals.hint("shuffle_merge"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
