"""URL filters: host and path, rules, and a weighted vocabulary.

The longest rule that fits a URL decides. Where none fits, an Aho-Corasick
automaton finds all vocabulary terms in the URL in one pass; a hit counts if no
letter or digit touches it on either side. One strict term blocks, and so do
distinct soft terms whose weights reach ``least_weight``: two of weight 1. The
vocabulary is a parameter, a table or a list of (term, kind, weight), of a checked
size, as each worker holds its automaton. A term of both kinds is strict.

Nulls: a null URL, or one without ``://``, has empty host and path, fits no rule,
and is judged by its terms (none in a null one: allow). Repeated rows are judged
alike. Null and empty terms are no terms. Columns with the names of the results are
replaced.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRICT = ("porn", "xxx", "casino", "spam", "gambling", "viagra", "warez", "hentai", "escort", "escorts")
SOFT = ("adult", "x", "free", "bet", "bets", "win", "sex", "hot", "nude", "pills", "cheap", "loans", "prize", "jackpot", "poker", "slots", "farm", "crack", "cracked", "torrent", "dating", "singles")
#: The default vocabulary.
VOCABULARY = tuple((x, "strict", 1.0) for x in STRICT) + tuple((x, "soft", 1.0) for x in SOFT)
MOST_TERMS = 200_000
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest of a short list of (verdict, host, path) that fits; null where none does."""
    found = F.lit(None)
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


@functools.lru_cache(4)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    found.make_automaton()
    return found


def _is_word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def bounded_terms(text: str, terms: tuple[str, ...]) -> list[str]:
    """The distinct terms that stand in the text between borders."""
    out = set()
    for end, term in _automaton(terms).iter(text):
        start = end - len(term) + 1
        if not (start and _is_word(text[start - 1])) and not (end + 1 < len(text) and _is_word(text[end + 1])):
            out.add(term)
    return sorted(out)


Terms = Sequence[tuple[str, str, float]]


def vocabulary_terms(vocabulary: DataFrame | Terms, most: int = MOST_TERMS) -> tuple[dict[str, float], frozenset[str]]:
    """The weight of each term, in lower case, and which terms are strict."""
    rows = vocabulary.select("term", "kind", "weight").limit(most + 1).collect() if isinstance(vocabulary, DataFrame) else list(vocabulary)
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    low = str.maketrans(UPPER, LOWER)
    named = [(term.translate(low), kind, weight) for term, kind, weight in rows if term]
    return {t: float(w) for t, _, w in sorted(named)}, frozenset(t for t, kind, _ in named if kind == "strict")


def inner_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def with_terms(df: DataFrame, url: str, vocabulary: DataFrame | Terms) -> DataFrame:
    """``df`` with strict_terms and soft_terms, the distinct terms found in the URL, and soft_weight, the sum of the soft terms' weights."""
    weights, strict = vocabulary_terms(vocabulary)
    every = tuple(weights)

    @F.pandas_udf("strict_terms array<string>, soft_terms array<string>, soft_weight double")
    def terms(urls: pd.Series) -> pd.DataFrame:
        found = [bounded_terms(x, every) for x in urls]
        soft = [[t for t in x if t not in strict] for x in found]
        return pd.DataFrame({"strict_terms": [[t for t in x if t in strict] for x in found], "soft_terms": soft, "soft_weight": [float(sum(weights[t] for t in x)) for x in soft]})

    inner = inner_name(df, "__terms")
    found = df.withColumn(inner, terms(F.translate(F.coalesce(F.col(url), F.lit("")), UPPER, LOWER)))
    return found.withColumns({x: F.col(f"{inner}.{x}") for x in ("strict_terms", "soft_terms", "soft_weight")}).drop(inner)


def url_verdicts(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, vocabulary: DataFrame | Terms = VOCABULARY, least_weight: float = 2.0, url: str = "url") -> DataFrame:
    """``df`` with host, path, rule, verdict, strict_terms, soft_terms and soft_weight."""
    named = with_terms(df.drop("host", "path", "rule", "verdict"), url, vocabulary).withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    bad = (F.size("strict_terms") > 0) | (F.col("soft_weight") >= least_weight)
    inner = inner_name(named, "__rule")
    ruled = named.withColumn(inner, longest_rule(F.col("host"), F.col("path"), rules).cast("struct<rule:string,verdict:string>"))
    verdict = F.coalesce(F.col(f"{inner}.verdict"), F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return ruled.withColumns({"rule": F.col(f"{inner}.rule"), "verdict": verdict}).drop(inner)
