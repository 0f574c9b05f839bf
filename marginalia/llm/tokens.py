"""Encoding and decoding with public BPE vocabularies inside Spark tasks.

A text in plain Latin letters is cut into pre-tokens here, by the vocabulary's
own pattern written for these letters. With a byte-level vocabulary, cutting and
merging are one call of the rank encoder, which always merges the neighbours
whose joint string has the lowest id. With a vocabulary that marks the ends of
words, each distinct pre-token is encoded once per worker by the library's model.
A text with anything else in it (a special token's string, white space beyond the
plain four, other letters) goes through the library as a whole, so the ids are
the library's in every case.

Why the rank encoder's ids are the library's: it stands in only where merges are
in order of their products' ids, merge single bytes or products of earlier
merges, and where the library encodes each product alone as itself (all checked
when a vocabulary is loaded). Suppose that both agree on all merges below rank r,
and the rank encoder joins x and y to the product t of rank r. No token crosses
the borders of x + y, so what was merged inside is what is merged in t alone; there
the library, before its merge of rank r, has just the two parts of that merge, as
t becomes itself. So x and y are these parts, and the library merges them too.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
import sys

import numpy as np

from .common import Remembered

_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = r" \t\n\r"
#: White space for some library but not among the plain four, and what lies beyond Latin.
_ODD = "\x0b\x0c\x1c-\x1f\x85\xa0\u0250-\U0010ffff"
_OTHER = rf"[^{_SPACE}{_LETTER}{_NUMBER}{_ODD}]"
#: Pre-tokens of a vocabulary with ends of words; what none of the alternatives takes is a piece of one odd character.
_WORDS = re.compile(rf"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBER}]|{_OTHER}+|[^{_SPACE}]").findall
#: Pre-tokens of a byte-level vocabulary (a fixed pattern); without neighbouring white space its last two parts are one character.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
_BYTE_LEVEL, _SINGLE_SPACES = _PARTS + r"|\s+(?!\S)|\s+", _PARTS + r"|\s"
_IS_ODD = re.compile(rf"[{_ODD}]|<\|").search
_HAS_WIDE_SPACE = re.compile(rf"[{_SPACE}]{{2}}").search


def vocabulary_path(name_or_path: str) -> str:
    """The place of a vocabulary file: a path as it is, a bare name as one of the public tokenizers."""
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte, by the rule of byte-level BPE: printable Latin-1 stays, the rest follows from U+0100."""
    stay = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in stay]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()
_TO_LETTERS = {i: c for i, c in BYTE_LETTERS.items()}
LETTER_BYTES = {c: b for b, c in BYTE_LETTERS.items()}


def pack_ids(ids: list[int]) -> bytes:
    packed = array.array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()


def to_letters(text: str) -> str:
    return text.encode("utf-8").decode("latin-1").translate(_TO_LETTERS)


class _Unsure(Exception):
    """The text must go through the library as a whole."""


def _merges(model: dict) -> list[tuple[str, str]]:
    return [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]


def _ranks(model: dict, library) -> dict[bytes, int] | None:  # noqa: ANN001
    """The id of each byte and merge product, if merging by these alone gives the library's ids (see above)."""
    vocab, plain = model["vocab"], not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if model["type"] != "BPE" or not plain or not vocab.keys() >= LETTER_BYTES.keys():
        return None
    made, last = {c: vocab[c] for c in LETTER_BYTES}, -1
    for one, two in _merges(model):
        product = vocab.get(one + two, -1)
        if product <= last or one not in made or two not in made or [x.id for x in library.model.tokenize(one + two)] != [product]:
            return None
        made[one + two] = last = product
    return {bytes(LETTER_BYTES[c] for c in x): i for x, i in made.items()} if len(set(made.values())) == len(made) else None


class Encoder:
    """Ids of whole texts, as the library gives them with ``add_special_tokens=False``."""

    def __init__(self, name_or_path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = vocabulary_path(name_or_path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        model = self.spec.pop("model")
        self.path, self.suffix = path, model.get("end_of_word_suffix") or ""
        #: Whether a part's merges may depend on chance or on whole words: then no text is cut.
        self.divisible = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "ignore_merges", "continuing_subword_prefix", "unk_token"))
        kinds = [x["type"] for x in (self.spec["normalizer"] or {}).get("normalizers", [])]
        pre = self.spec["pre_tokenizer"] or {}
        self.pieces = self.by_ranks = None
        if all(x["content"].startswith("<|") for x in self.spec["added_tokens"]):
            if not self.spec["normalizer"] and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]:
                self.by_ranks = self._rank_encoders(_ranks(model, self.library))
            elif kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
                self.pieces = _WORDS
        self.piece_ids = Remembered(self._piece, 300_000)

    @staticmethod
    def _rank_encoders(ranks: dict[bytes, int] | None) -> list | None:
        import tiktoken

        return ranks and [tiktoken.Encoding(x, pat_str=x, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for x in (_SINGLE_SPACES, _BYTE_LEVEL)]

    def _piece(self, piece: str) -> bytes:
        """The ids of one pre-token."""
        if _IS_ODD(piece):
            raise _Unsure
        return pack_ids([x.id for x in self.library.model.tokenize(to_letters(piece))])

    def _whole(self, text: str) -> bytes:
        return pack_ids(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.by_ranks and not _IS_ODD(text):
            return pack_ids(self.by_ranks[_HAS_WIDE_SPACE(text) is not None](text))
        if self.pieces:
            try:
                return b"".join(map(self.piece_ids.__getitem__, self.pieces(text.lower())))
            except _Unsure:
                pass
        return self._whole(text)

    @functools.cached_property
    def strings(self) -> list[str]:
        """The string of each id."""
        by_id = {i: x for x, i in self.library.get_vocab(with_added_tokens=True).items()}
        return [by_id.get(i, "") for i in range(max(by_id) + 1)]

    @functools.cached_property
    def _pieces(self) -> list[bytes]:
        special = {x["id"] for x in self.spec["added_tokens"]}
        if self.spec["decoder"] is None:
            return [x.encode() for x in self.strings]
        return [x.encode() if i in special else bytes(LETTER_BYTES[c] for c in x) for i, x in enumerate(self.strings)]

    def decode(self, ids: np.ndarray) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)``: without a decoder the tokens' strings with spaces between, else the bytes they stand for."""
        if self.spec["decoder"] is None:
            return b" ".join(map(self._pieces.__getitem__, ids.tolist())).decode()
        if self.spec["decoder"]["type"] != "ByteLevel":
            return self.library.decode(ids.tolist(), skip_special_tokens=False)
        return b"".join(map(self._pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(4)
def encoder(name_or_path: str) -> Encoder:
    """One per worker process and vocabulary."""
    return Encoder(name_or_path)
