"""Token counts under a unigram model, without writing tokens.

A pre-token is a word with the word-start mark. Its count is that of the best
segmentation into vocabulary pieces (highest sum of scores, then fewest tokens).
The distinct pre-tokens of a batch go into a trie: the forward score of each prefix
is computed once however many pre-tokens begin with it, and the count at each
pre-token's end is stored. The trie is walked depth first without being built: in
sorted order, a pre-token's path leaves that of the one before where their common
prefix ends, so a stack with a row for each character of the path, cut back to the
common prefix, meets every node of the trie exactly once. A worker remembers the
counts of recent pre-tokens; prefixes are shared among those new in a batch.

Scores follow the vocabulary's order by Zipf's law: a piece of rank r scores
-1000 ln(r + 2), rounded, so sums are exact. A character outside the vocabulary
counts one token for each of its bytes and scores as that many last pieces.

Nulls: a null or empty text has no pre-tokens and no tokens. Repeated rows each
get their counts.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches, raw_texts
from .tokens import vocabulary_path

MARK = "▁"
_KEPT = 300_000
_SHIFT = 60  # sums of scores stay below


def zipf_scores(pieces: Iterable[str]) -> dict[str, int]:
    return {x: -round(1000 * math.log(rank + 2)) for rank, x in enumerate(pieces)}


class UnigramTrie:
    def __init__(self, scores: dict[str, int]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.unknown = min(scores.values())
        self.known: dict[bytes, int] = {}  # tokens << _SHIFT | -score
        self.backwards: dict = {}  # the pieces from their ends; "" has the score of the piece that begins there
        for x, score in scores.items():
            node = self.backwards
            for char in reversed(x):
                node = node.setdefault(char, {})
            node[""] = score

    def forward(self, words: list[str]) -> list[tuple[int, int]]:
        """(score, -tokens) at the end of each of sorted ``words``."""
        rows, last, out = [(0, 0)], "", []
        root, scores = self.backwards, self.scores
        for word in words:
            shared = len(commonprefix((last, word)))
            del rows[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                node, start, best = root, end, None
                while start:  # the pieces that end here, shortest first, as long as there are longer ones
                    start -= 1
                    node = node.get(word[start])
                    if node is None:
                        break
                    value = node.get("")
                    if value is not None:
                        score, tokens = rows[start]
                        found = (score + value, tokens - 1)
                        if best is None or found > best:
                            best = found
                if word[end - 1] not in scores:
                    n = len(word[end - 1].encode("utf-8", "replace"))
                    score, tokens = rows[end - 1]
                    found = (score + self.unknown * n, tokens - n)
                    if best is None or found > best:
                        best = found
                rows.append(best)
            last = word
            out.append(rows[-1])
        return out

    def learn(self, words: Iterable[bytes]) -> None:
        """Store the counts of the words that aren't known."""
        if len(self.known) > _KEPT:
            self.known = {}
        new = sorted((MARK + w.decode("utf-8", "replace"), w) for w in set(words) - self.known.keys())
        self.known.update((w, -tokens << _SHIFT | -score) for (_, w), (score, tokens) in zip(new, self.forward([x for x, _ in new]), strict=True))


@functools.lru_cache(2)
def unigram_trie(model: str) -> UnigramTrie:
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(model))
    usable = (found.id_to_piece(i) for i in range(found.get_piece_size()) if not (found.is_control(i) or found.is_unknown(i) or found.is_byte(i)))
    return UnigramTrie(zipf_scores(usable))


def unigram_counts(df: DataFrame, model: str, text: str = "text", batch_words: int = 200_000) -> DataFrame:
    """``df`` without its text, with n_pre_tokens, n_tokens and score (thousandths of a nat)."""
    rest = df.drop("n_pre_tokens", "n_tokens", "score", text)
    at = len(rest.columns)

    @by_batches
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        trie, split, out, held = unigram_trie(model), [x.split() for x in raw_texts(batch.column(at))], [], 0
        first = 0
        for last, words in enumerate(split, 1):
            held += len(words)
            if held < batch_words and last < len(split):
                continue
            trie.learn(w for ws in split[first:last] for w in ws)
            for ws in split[first:last]:
                total = sum(map(trie.known.__getitem__, ws))
                out.append((len(ws), total >> _SHIFT, -(total & (1 << _SHIFT) - 1)))
            first, held = last, 0
        return pa.RecordBatch.from_arrays([*batch.columns[:at], *(pa.array(x, pa.int64()) for x in zip(*out, strict=True))], [*batch.schema.names[:at], "n_pre_tokens", "n_tokens", "score"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema) + "n_pre_tokens long, n_tokens long, score long"
    return df.select(*(F.col(f"`{c}`") for c in rest.columns), F.col(text)).mapInArrow(count, schema)
