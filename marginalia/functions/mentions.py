"""Names of a large taxonomy in texts: one automaton over all names, one walk a text whatever their number."""

from __future__ import annotations

import heapq
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def automaton(names: Sequence[str]) -> ahocorasick.Automaton:
    """Finds ``names`` in lower case; a name's value is (its length, the indexes of all codes with this name). An empty name stands nowhere."""
    places: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        places.setdefault(name.lower(), []).append(i)
    found = ahocorasick.Automaton()
    for name, codes in places.items():
        if name:
            found.add_word(name, (len(name), " " not in name, codes))
    found.make_automaton()
    return found


@lru_cache(maxsize=65_536)
def _letter_or_digit(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def _of_a_word(c: str) -> bool:
    return c == "_" or _letter_or_digit(c)


def _occurrences(names: ahocorasick.Automaton, lower: str, touches) -> Iterator[tuple[int, int, list[int]]]:  # noqa: ANN001
    """(start, end, codes) of all occurrences by their ends, overlaps too; a name of one word only where no neighbour ``touches`` it."""
    if not len(names):
        return
    for last, (length, word, codes) in names.iter(lower):
        start, end = last - length + 1, last + 1
        if word and (start and touches(lower[start - 1]) or end < len(lower) and touches(lower[end])):
            continue
        yield start, end, codes


def first_places(names: ahocorasick.Automaton, text: str, longest: int) -> list[int]:
    """The codes that stand in ``text``, the first ``longest`` by place, then index; no more are held. Neighbours of a one-word name may be underscores."""
    found = ((start, i) for start, _, codes in _occurrences(names, text.lower(), str.isalnum) for i in codes)
    return [i for _, i in heapq.nsmallest(longest, found)]


def counts(names: ahocorasick.Automaton, size: int, lower: str) -> np.ndarray:
    """How often each of ``size`` codes stands in a text in lower case: one-word names between borders, phrases anywhere, occurrences of one name not overlapping."""
    out, free = np.zeros(size, np.int64), {}
    for start, end, codes in _occurrences(names, lower, _of_a_word):
        if start >= free.get(codes[0], 0):
            free[codes[0]] = end
            out[codes] += 1
    return out


def places_column(text: Column, names: Sequence[str], longest: int) -> Column:
    """``first_places`` of a text column, null as empty. A task builds the automaton once."""

    @F.pandas_udf("array<int>")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = automaton(names)
        for texts in batches:
            yield texts.map(lambda x: first_places(known, x or "", longest))

    return places(text)


def counts_column(lower: Column, names: Sequence[str]) -> Column:
    """``counts`` of a column of texts in lower case, one number a name in their order."""

    @F.pandas_udf("array<bigint>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = automaton(names)
        for texts in batches:
            yield texts.map(lambda x: counts(known, len(names), x or ""))

    return counted(lower)


@lru_cache(maxsize=8)
def _known(names: tuple[str, ...]) -> ahocorasick.Automaton:
    return automaton(names)


def mentioned(names: tuple[str, ...], text: str) -> list[int]:
    """The counts of ``names`` in one text."""
    return counts(_known(names), len(names), text.lower()).tolist()
