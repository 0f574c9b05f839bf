"""BPE encoding and decoding of whole texts.

Texts of up to LONG characters are encoded where they lie. Longer ones are cut into
pieces that Spark deals to many tasks, and the pieces' ids are joined:

- A text is cut, about every PIECE characters, before a single space or line feed
  between printable ASCII characters. No pre-token of these vocabularies, no special
  token and no step of their normalizers reaches over that place, so both sides
  agree there as they are.
- A stretch without such a place can't be cut into words. Its long pre-tokens are cut
  anywhere and joined as a tree. At a join the tokens around it are encoded anew in a
  growing window until the window's outermost tokens on both sides are the tokens
  that were there before.

One token on each side is enough: merges are made in order of rank, and a merge over
an outer token's edge would have changed this token, with the same neighbours in
the window as in the run. So the ids are exactly those of the uncut run. A model
whose merges depend on more than rank (dropout, ``ignore_merges``) is never cut; nor
is a stretch with the beginning of a special token: the library takes it whole.

Nulls: a null text is an empty one, with no ids. Repeated rows each get their ids.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, by_batches, by_sorted_groups, saved, texts
from .tokens import Encoder, _merges, encoder, pack_ids, to_letters

LONG, PIECE, RUN_PIECE = 32_768, 16_384, 1024
_BORDER = re.compile(r"[!-~](?=[ \n][!-~])")
#: What a piece is: a text of its own, letters inside a run, or a run's last letters.
TEXT, INNER, LAST = range(3)


class RunEncoder:
    """Encodes parts of one pre-token given in byte letters; only the last part ends the word."""

    def __init__(self, enc: Encoder):
        from tokenizers import models

        self.strings, self.suffix, self.ends = enc.strings, enc.suffix, enc.library.model
        self.inner = self.ends
        if self.suffix:
            with open(enc.path, encoding="utf-8") as file:
                model = json.load(file)["model"]
            self.inner = models.BPE(vocab=model["vocab"], merges=_merges(model))

    def encode(self, letters: str, ends_word: bool) -> list[int]:
        return [x.id for x in (self.ends if ends_word else self.inner).tokenize(letters)]

    def length(self, ids: list[int], ends_word: bool) -> int:
        """Letters that the tokens stand for."""
        return sum(len(self.strings[i]) for i in ids) - len(self.suffix) * ends_word

    def join(self, left: list[int], right: list[int], letters: str, middle: int, ends_word: bool) -> list[int]:
        """The ids of ``letters`` from those of its two sides, which meet at ``middle``."""
        for width in (8 << i for i in itertools.count()):
            first, last = max(len(left) - width, 0), min(width, len(right))
            at_end = last == len(right)
            start = middle - self.length(left[first:], False)
            stop = len(letters) if at_end else middle + self.length(right[:last], False)
            window = self.encode(letters[start:stop], ends_word and at_end)
            if (first == 0 or window[0] == left[first]) and (at_end or window[-1] == right[last - 1]):
                return left[:first] + window + right[last:]

    def tree(self, parts: list[list[int]], lengths: list[int], letters: str, ends_word: bool = True) -> list[int]:
        if len(parts) == 1:
            return parts[0]
        half = len(parts) // 2
        cut = sum(lengths[:half])
        left = self.tree(parts[:half], lengths[:half], letters[:cut], False)
        right = self.tree(parts[half:], lengths[half:], letters[cut:], ends_word)
        return self.join(left, right, letters, cut, ends_word)


@functools.lru_cache(4)
def run_encoder(tokenizer: str) -> RunEncoder:
    return RunEncoder(encoder(tokenizer))


Piece = tuple[bytes | None, str, int]  # ids or, where they are to be found, letters or text; and its kind


def split_runs(text: str, tokenizer: str, run_piece: int) -> list[Piece]:
    """A stretch without borders: ids of short pre-tokens, and the pieces of the long ones."""
    enc, out, ready = encoder(tokenizer), [], []
    if "<|" in text or not enc.divisible:  # a special token's string may stand anywhere
        return [(enc.encode(text), "", TEXT)]
    lib = enc.library
    norm = lib.normalizer.normalize_str(text) if lib.normalizer else text
    for letters, _ in lib.pre_tokenizer.pre_tokenize_str(norm):
        if len(letters) <= run_piece:
            ready.append(pack_ids([x.id for x in lib.model.tokenize(letters)]))
            continue
        out.append((b"".join(ready), "", TEXT))
        ready = []
        out += [(None, letters[i : i + run_piece], INNER if i + run_piece < len(letters) else LAST) for i in range(0, len(letters), run_piece)]
    return [*out, (b"".join(ready), "", TEXT)]


def cut_text(text: str, tokenizer: str, piece: int, run_piece: int) -> list[Piece]:
    """The pieces of a long text in order."""
    out, at = [], 0
    while len(text) - at > 2 * piece:
        near = _BORDER.search(text, at + piece, at + 2 * piece)
        border = near or _BORDER.search(text, at + 2 * piece)
        end = border.end() if border else len(text)
        out += [(None, text[at:end], TEXT)] if near else split_runs(text[at:end], tokenizer, run_piece)
        at = end
    return [*out, (None, text[at:], TEXT)]


def encode_long(long: DataFrame, tokenizer: str, piece: int, run_piece: int) -> DataFrame:
    """(row, ids) of ``long(row, text)``."""
    schema = "row long, place int, ids binary, part string, kind int"
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int32())

    @by_batches
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(r, i, *x) for r, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True) for i, x in enumerate(cut_text(t, tokenizer, piece, run_piece))]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["row", "place", "ids", "part", "kind"])

    @by_batches
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, runs = encoder(tokenizer), run_encoder(tokenizer)
        ids, parts, what = (batch.column(k).to_pylist() for k in (2, 3, 4))
        found = [i if i is not None else enc.encode(s) if k == TEXT else pack_ids(runs.encode(s, k == LAST)) for i, s, k in zip(ids, parts, what, strict=True)]
        left = pa.array(["" if k == TEXT else s for s, k in zip(parts, what, strict=True)], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns[:2], binaries(found), left, batch.column(4)], batch.schema.names)

    def join(row, place, ids, part, kind) -> list[tuple]:  # noqa: ANN001
        out, parts = [], []
        for i, s, k in zip(ids, part, kind, strict=True):
            if k == TEXT:
                out.append(i)
                continue
            parts.append((np.frombuffer(i, "<u4").tolist(), s))
            if k == LAST:
                whole = run_encoder(tokenizer).tree([x for x, _ in parts], [len(s) for _, s in parts], "".join(s for _, s in parts))
                out.append(pack_ids(whole))
                parts = []
        return [(int(row[0]), b"".join(out))]

    pieces = long.select("row", "text").mapInArrow(cut, schema)
    done = pieces.repartition("row", "place").mapInArrow(encode, schema)
    return by_sorted_groups(done, ["row"], join, "row long, ids binary", ("place",))


def bpe_encode(df: DataFrame, tokenizer: str, text: str = "text", out: str = "ids", decoded: str | None = None, keep: Sequence[str] | None = None, long: int = LONG, piece: int = PIECE, run_piece: int = RUN_PIECE) -> DataFrame:
    """The columns ``keep`` of ``df`` (all of them) with the ids of each text as packed little-endian unsigned 32-bit integers in column ``out``.

    The ids are the library's with ``add_special_tokens=False``. With ``decoded``, the
    ids are decoded again into that column. Columns of ``df`` with these names are replaced.
    """
    made = [out, *([decoded] if decoded else [])]
    kept = [c for c in (df.columns if keep is None else keep) if c not in made]
    carried = kept if text in kept else [*kept, text]
    at, n = carried.index(text), len(kept)
    rows = df.select(*(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(carried)))
    is_long = F.coalesce(F.char_length(f"own_{at}") > long, F.lit(False))
    schema = ", ".join([*(f"own_{i} {rows.schema[i].dataType.simpleString()}" for i in range(n)), "ids binary", *(["decoded string"] if decoded else [])])

    @by_batches
    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer)
        ids = [enc.encode(x) for x in texts(batch.column(at))]
        columns = [*batch.columns[:n], binaries(ids)]
        if decoded:
            columns.append(pa.array([enc.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string()))
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:n], "ids", *(["decoded"] if decoded else [])])

    short = rows.where(~is_long).mapInArrow(encode, schema)
    held = saved(rows.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long-texts")
    ids = encode_long(held.select("row", F.col(f"own_{at}").alias("text")), tokenizer, piece, run_piece)
    joined = held.select("row", *(f"own_{i}" for i in range(n))).join(ids.hint("shuffle_merge"), "row").drop("row")
    whole = short.unionByName(bpe_decode(joined, tokenizer, "ids", "decoded") if decoded else joined)
    return whole.select(*(F.col(f"own_{i}").alias(c) for i, c in enumerate(kept)), F.col("ids").alias(out), *([F.col("decoded").alias(decoded)] if decoded else []))


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of packed ids in column ``out``, as the library's ``decode(ids, skip_special_tokens=False)``; null ids give an empty text."""
    kept = [c for c in df.columns if c != out]
    at = kept.index(ids)

    @by_batches
    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer)
        decoded = [enc.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], [*batch.schema.names, out])

    named = df.select(*(F.col(f"`{c}`") for c in kept))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema)
    return named.mapInArrow(decode, f"{kinds}, `{out}` string")


def bpe_digests(df: DataFrame, tokenizer: str, **sizes: int) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``df(doc_id, text)``: every text encoded, its ids decoded again."""
    both = bpe_encode(df, tokenizer, decoded="decoded", keep=["doc_id"], **sizes)
    return both.select("doc_id", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
