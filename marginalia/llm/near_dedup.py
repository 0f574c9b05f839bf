"""Near-duplicates: many universal hash minima, banding, verification, components.

A document's set holds its distinct word shingles. Documents are linked when
their sets' Jaccard similarity is at least ``percent`` %.

1. Sets and signatures are made where the texts lie; a signature is the minima
   of BANDS x ROWS universal hashes. Documents of equal sets form a class, of
   which only the one with the smallest id goes on.
2. A band's hash is a bucket, its smallest member the centre. Every class is compared
   with the CENTRES centres that it meets in most buckets (not with all members):
   first by signature, then on the full sets. Links found so far give labels.
3. A star can miss a link between two classes that both differ from the centre. So
   at last all pairs across labels in buckets of several labels are compared:
   bucket members are dealt to blocks of bounded size and every block pair is one
   group, so no task holds a bucket. Signatures mark the members that may have a
   partner, each pair in the first bucket that it shares; then the marked members'
   texts meet in blocks, pairs are compared in full, and a block returns a
   spanning forest of its links. Nothing is capped, and nothing grows with the
   square of a group but the comparisons inside blocks of unlinked classes.
4. All links make components (large-star, small-star).

With 26 bands of 5 rows a link at the limit of 85 % (80 %) shares no bucket in
2 of 10 million (3 of 100 thousand) cases; nearer pairs still less often. A pair's
signature may fall SLACK short of the limit: 6.4 (5.7) standard deviations.

Grouped and distinct sides of joins are written tables, so that Spark can deal the
rows of a very large bucket, class or hub to several tasks.

Nulls: a null text has no words. A document without words has an empty set and
no links. A row without ``doc_id`` stays by itself: its component is null and it
is kept. Rows that repeat an id are compared by their own texts and keep their own sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_batches, by_sorted_groups, raw_texts, saved, scratch, word_hashes
from .components import connected_components, partial_labels

BANDS, ROWS = 26, 5
SLACK = 0.2
#: Members of a block, or units of so many bytes of text if these are more.
BLOCK, UNIT = 512, 8192
CENTRES = 2


def _universal(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229).integers(0, 1 << 64, (2, count), np.uint64, endpoint=False)
    return draw[0] | np.uint64(1), draw[1]


_MULTIPLY, _ADD = _universal(BANDS * ROWS)
_LINK = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles of ``width`` words, A-Z in lower case; with fewer words, the whole sequence is one."""
    hashes = word_hashes(raw.lower().split())
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    mixed = np.full(n, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ hashes[k : k + n]) * _LINK[k % 2]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash (a x + b mod 2^64, upper half)."""
    best = np.full(len(_MULTIPLY), (1 << 32) - 1, np.uint32)
    for at in range(0, len(shingles), 256):
        values = shingles[at : at + 256, None] * _MULTIPLY + _ADD
        best = np.minimum(best, (values.min(axis=0) >> np.uint64(32)).astype(np.uint32))
    return best


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, band number included."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _LINK[0], parts.shape[:2]).copy()
    for k in range(ROWS):
        keys = (keys ^ parts[:, :, k]) * _LINK[1]
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def set_features(df: DataFrame, width: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Saved (doc_id, n_shingles, same, signature) of each row; same: digest of the set, null for an empty one."""

    @by_batches
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, width) for x in raw_texts(batch.column(1))]
        same = pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary())
        signs = pa.array([signature(x).tobytes() if len(x) else None for x in sets], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), same, signs], ["doc_id", "n_shingles", "same", "signature"])

    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return saved(narrow.mapInArrow(make, "doc_id long, n_shingles long, same binary, signature binary"), "set-features")


def _buckets(signs: DataFrame) -> DataFrame:
    """Saved (bucket, band, node, size) of each class and band whose bucket holds others."""

    @by_batches
    def explode(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = _band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1))
        bands = np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(bands), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["bucket", "band", "node"])

    rows = signs.select("node", "signature").mapInArrow(explode, "bucket long, band int, node long")
    sizes = saved(rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
    return saved(rows.join(sizes.hint("shuffle_merge"), "bucket"), "buckets")


def _near(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    return (left == right).mean(axis=-1) >= least


def _by_signature(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b), those whose signatures and set sizes allow a link."""
    least = percent / 100 - SLACK

    @by_batches
    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
        return batch.select([0, 1]).filter(pa.array(_near(one, two, least)))

    ends = [signs.select(F.col("node").alias(x), F.col("signature").alias(f"sign_{x}"), F.col("n_shingles").alias(f"n_{x}")) for x in "ab"]
    met = pairs.join(ends[0].hint("shuffle_merge"), "a").join(ends[1].hint("shuffle_merge"), "b")
    possible = met.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return possible.select("a", "b", "sign_a", "sign_b").mapInArrow(check, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of (a, b), those whose full sets are similar enough. Only texts of nodes in pairs move."""
    pairs = saved(pairs, "pairs")
    nodes = saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "paired")
    held = saved(docs.join(nodes.hint("shuffle_merge"), "node"), "paired-texts")

    @by_batches
    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[bytes, np.ndarray] = {}
        sets = [[known[x] if x in known else known.setdefault(x, shingle_set(x, width)) for x in raw_texts(batch.column(i))] for i in (2, 3)]
        shared = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)])
        either = np.array([len(x) + len(y) for x, y in zip(*sets, strict=True)]) - shared
        return batch.select([0, 1]).filter(pa.array(100 * shared >= percent * either))

    ends = [held.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"]
    both = pairs.join(ends[0].hint("shuffle_merge"), "a").join(ends[1].hint("shuffle_merge"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def _mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Saved (bucket, band, node, size, label) of buckets that still hold several labels."""
    of_node = labels.select(F.col("a").alias("node"), F.col("b").alias("label"))
    named = saved(buckets.join(of_node.hint("shuffle_merge"), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    several = saved(named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket"), "several")
    return saved(named.join(several.hint("shuffle_merge"), "bucket", "left_semi"), "mixed")


def _stars(buckets: DataFrame) -> DataFrame:
    """(a, b): each class and the CENTRES centres that it meets in most buckets; a bucket's centre is its smallest member. Centres are a written table, so that a join on a bucket of very many members can be split."""
    centres = saved(buckets.groupBy("bucket").agg(F.min("node").alias("centre")), "centres")
    met = buckets.join(centres.hint("shuffle_merge"), "bucket").where("node <> centre")
    times = met.groupBy("node", "centre").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), "centre"))
    return times.withColumn("nth", nth).where(F.col("nth") <= CENTRES).select(F.col("node").alias("a"), F.col("centre").alias("b"))


def _in_blocks(held: DataFrame, size: Column, minor: Column, columns: list[str]) -> DataFrame:
    """(bucket, base, probe, probing, columns): every member as a base against the blocks of minor members, and every minor member as a probe against all blocks of its bucket. Two minor members meet once."""
    blocks = F.ceil(size / BLOCK).cast("int")
    dealt = held.select("bucket", *columns, blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), minor.alias("minor"))
    held = saved(dealt, "dealt")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    needed = saved(held.where("minor").select("bucket", F.col("block").alias("probe")).distinct(), "needed")
    once = ~F.col("minor") | (F.col("block") >= F.col("probe"))
    bases = held.join(needed.hint("shuffle_merge"), "bucket").where(once).select("bucket", F.col("block").alias("base"), "probe", F.lit(False).alias("probing"), *columns)
    probes = held.where("minor").select("bucket", F.explode(every).alias("base"), F.col("block").alias("probe"), F.lit(True).alias("probing"), *columns)
    return bases.unionByName(probes)


def _with_main(buckets: DataFrame, weight: Column) -> DataFrame:
    """Members with ``main``, the label that most of their bucket has, and ``size``: their number, or the units of ``weight`` if these are more."""
    by_label = buckets.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    largest = by_label.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.greatest(F.sum("n"), F.sum("w")).alias("size"))
    return buckets.drop("size", "main").join(saved(largest.select("bucket", F.col("top.label").alias("main"), "size"), "mains").hint("shuffle_merge"), "bucket")


def _marked(buckets: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Saved (bucket, band, node, label) of members that may be linked across labels, each pair looked at in the first bucket that it shares."""
    least = percent / 100 - SLACK
    held = _with_main(buckets, F.lit(1)).join(signs.select("node", "signature").hint("shuffle_merge"), "node")
    blocked = _in_blocks(held, F.col("size"), F.col("label") != F.col("main"), ["band", "node", "label", "signature"])

    def mark(bucket, base, probe, probing, band, node, label, sign) -> list[tuple]:  # noqa: ANN001
        probing = probing.astype(bool)
        if probing.all() or not probing.any():
            return []
        ones, twos = (np.frombuffer(b"".join(sign[x]), np.uint32).reshape(-1, BANDS * ROWS) for x in (probing, ~probing))
        twos, most = np.ascontiguousarray(twos.T), least * BANDS * ROWS
        labels, hit_base, hit_probe = label[~probing], np.zeros(twos.shape[1], bool), np.zeros(len(ones), bool)
        for i, (one, own, number) in enumerate(zip(ones, label[probing], band[probing], strict=True)):
            equal = twos == one[:, None]
            hit = (equal.sum(axis=0, dtype=np.uint8) >= most) & (labels != own)
            if hit.any():
                hit[hit] = ~equal[: number * ROWS, hit].reshape(number, ROWS, hit.sum()).all(axis=1).any(axis=0)
                hit_probe[i] = hit.any()
                hit_base |= hit
        marks = np.concatenate([np.flatnonzero(probing)[hit_probe], np.flatnonzero(~probing)[hit_base]])
        return list({(int(bucket[0]), int(band[i]), int(node[i]), int(label[i])) for i in marks})

    return saved(by_sorted_groups(blocked, ["bucket", "base", "probe"], mark, "bucket long, band int, node long, label long").distinct(), "marked")


def _linked_in_blocks(marked: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links across labels among marked members, in full; of each block pair, enough to connect what its links connect."""
    nodes = saved(marked.select("node").distinct(), "marked-nodes")
    texts = saved(docs.join(nodes.hint("shuffle_merge"), "node").withColumn("units", F.ceil(F.octet_length("text") / UNIT)), "marked-texts")
    units = saved(texts.groupBy("node").agg(F.sum("units").alias("units")), "text-units")
    sized = saved(marked.join(units.hint("shuffle_merge"), "node"), "marked-sizes")
    held = _with_main(sized, F.coalesce("units", F.lit(0))).drop("units").join(texts.drop("units").hint("shuffle_merge"), "node")
    blocked = _in_blocks(held, F.col("size"), F.col("label") != F.col("main"), ["node", "label", "text"])

    def link(bucket, base, probe, probing, node, label, text) -> list[tuple]:  # noqa: ANN001
        probing = probing.astype(bool)
        if probing.all() or not probing.any():
            return []
        ones, twos = ([shingle_set((x or "").encode(), width) for x in text[y]] for y in (probing, ~probing))
        nodes, labels = node[~probing], label[~probing]
        sizes = np.array([len(x) for x in twos])
        every, owner = np.concatenate(twos), np.repeat(np.arange(len(twos)), sizes)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                x = up
            return x

        found = []
        for own_node, own, one in zip(node[probing].tolist(), label[probing].tolist(), ones, strict=True):
            first, last = np.searchsorted(every, one), np.searchsorted(every, one, "right")
            held = last > first
            spans = [owner[i:j] for i, j in zip(first[held], last[held], strict=True)]
            shared = np.bincount(np.concatenate(spans), minlength=len(twos)) if spans else np.zeros(len(twos), int)
            for i in np.flatnonzero((100 * shared >= percent * (len(one) + sizes - shared)) & (labels != own)):
                if (x := top(own)) != (y := top(int(labels[i]))):
                    root[max(x, y)] = min(x, y)
                    found.append((max(own_node, int(nodes[i])), min(own_node, int(nodes[i]))))
        return found

    return by_sorted_groups(blocked, ["bucket", "base", "probe"], link, "a long, b long").distinct()


def set_classes(features: DataFrame) -> DataFrame:
    """Saved (same, node, signature, n_shingles) of each class of equal sets; node is its smallest id."""
    known = features.where("same IS NOT NULL AND doc_id IS NOT NULL").groupBy("same")
    return saved(known.agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")), "classes")


def near_components(signs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of each of ``signs(node, signature, n_shingles)`` in a component of several; ``docs(node, text)`` has the texts."""
    with scratch(docs.sparkSession) as kept:
        buckets = _buckets(signs)
        links = saved(_verified(_by_signature(_stars(buckets), signs, percent), docs, width, percent), "verified")
        mixed = _mixed(buckets, partial_labels(links))
        marked = _marked(mixed, signs, percent)
        if not marked.isEmpty():
            links = links.unionByName(saved(_linked_in_blocks(marked, docs, width, percent), "verified"))
        components = connected_components(links)
        kept.append(components)
    return components.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``df``."""
    features = set_features(df, width, text, doc_id)
    docs = df.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    classes = set_classes(features)
    components = near_components(classes.drop("same"), docs, width, percent)
    of_row = features.select("doc_id", "n_shingles", "same").join(classes.select("same", "node").hint("shuffle_merge"), "same", "left")
    named = of_row.join(components.hint("shuffle_merge"), "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df(doc_id, text, ...)`` that ``near_duplicates`` keeps; only the ids that go are joined."""
    gone = saved(near_duplicates(df, width, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "near-gone")
    return df.join(gone, df["doc_id"].cast("long") == gone["__gone"], "left_anti")
