"""The numbered queries: each applies one operator, with production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, collocations, exact_dedup, html_extract, language_id, near_dedup, packing, quality, token_counts, token_files, urls
from .common import scratch_path, table

BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"
#: A conversation whose texts look like control strings.
_TRICKY = "\\### Assistant: </turn> ok"


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE, separator=0, capacity=2048)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", _TRICKY), (-7, 1, "assistant", _TRICKY)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.chat_windows(turns.unionByName(tricky)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.unigram_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, BYTE_BPE, end_id=2)
    return token_files.token_offsets(spark, path)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", F.size("strict_terms").alias("n_strict"), F.size("soft_terms").alias("n_soft"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=30, percent=80, keep=2000)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_BPE, PIECES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    numbered = (
        op1_bpe_round_trip,
        op2_html_main_text,
        op3_best_fit_packing,
        op4_exact_dedup,
        op5_chat_windows,
        op6_token_counts,
        op7_minhash_near_dedup,
        op8_token_files,
        op9_quality_rules,
        op10_url_filter,
        op11_collocations,
        op12_language_id,
        op13_token_alignment,
    )
    return {f.__name__: f for f in numbered}


_NORM = "translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')"


def _hits(terms: tuple[str, ...]) -> str:
    return " + ".join(f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t in terms)


def _rule_cases(what: str) -> str:
    cases = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}'" for v, h, p in cases) + " END"


_WORD = r"[^\x20\x09-\x0D]+"

_QUALITY = rf"""
    WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
    windows AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM d WHERE len(ws) >= 8),
    named AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS w FROM windows),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM named) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM twice) GROUP BY doc_id),
    raw AS MATERIALIZED (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d),
    full_lines AS MATERIALIZED (SELECT doc_id, host, line, regexp_extract_all(lower(line), '{_WORD}') AS ws FROM raw WHERE regexp_matches(line, '{_WORD}')),
    dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
    base AS MATERIALIZED (
        SELECT d.doc_id, host, len(ws)::BIGINT AS n_words, list_sum(list_transform(ws, lambda x: length(x))) AS wc,
            length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups.n, 0) AS n_dup, coalesce(covered.n, 0) AS n_rep
        FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id)),
    lines AS MATERIALIZED (SELECT doc_id, host, array_to_string(ws, ' ') AS line, sum(len(ws)) AS words FROM full_lines GROUP BY ALL),
    hosts AS (SELECT host, greatest(50, floor(count(*) * 0.001)) AS lim FROM d GROUP BY host),
    common AS (SELECT host, line FROM lines JOIN hosts USING (host) GROUP BY host, line, lim HAVING count(*) > lim),
    shared AS MATERIALIZED (SELECT lines.* FROM lines SEMI JOIN common USING (host, line)),
    own AS (SELECT doc_id FROM shared JOIN base USING (doc_id) GROUP BY doc_id, n_words HAVING (n_words - sum(words)) * 10 >= n_words * 2),
    decisive AS (SELECT s.host, s.line FROM shared s JOIN hosts USING (host) SEMI JOIN own ON s.doc_id = own.doc_id GROUP BY s.host, s.line, lim HAVING count(*) > lim),
    depleted AS (SELECT doc_id FROM (SELECT shared.* FROM shared SEMI JOIN decisive USING (host, line)) JOIN base USING (doc_id) GROUP BY doc_id, n_words HAVING (n_words - sum(words)) * 10 < n_words)
    SELECT doc_id, n_words, coalesce(wc, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines, n_rep::BIGINT AS n_repeat_words,
        n_words < 20 OR 100 * n_rep > 30 * n_words AS base_failed,
        NOT (n_words < 20 OR 100 * n_rep > 30 * n_words) AND doc_id NOT IN (SELECT doc_id FROM depleted) AS kept
    FROM base"""

_COLLOCATIONS = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    worded AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces WHERE regexp_matches(piece, '[^\x20\x09]')),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
    placed AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(w) >= k),
    f AS MATERIALIZED (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= 30),
    cut AS (SELECT lang, phrase, f AS a, words, string_split(phrase, ' ') AS p, unnest(range(1, words)) AS k FROM f WHERE words > 1),
    scored AS (
        SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, 2000000::HUGEINT * c.a // (x.f + y.f) AS score
        FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(p[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(p[k + 1:c.words], ' ')),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    longer AS (SELECT lang, f, words, string_split(phrase, ' ') AS p, unnest(range(2, words)) AS m FROM f WHERE words > 2),
    inside AS (SELECT lang, f, p, m, unnest(range(1, words - m + 2)) AS i FROM longer),
    around AS (SELECT lang, array_to_string(p[i:i + m - 1], ' ') AS phrase, max(f) AS f FROM inside GROUP BY ALL),
    ranked AS (
        SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
        FROM best b LEFT JOIN around USING (lang, phrase) WHERE around.f IS NULL OR 100::HUGEINT * around.f < 80::HUGEINT * a)
    SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_collocations": _COLLOCATIONS,
        "op4_exact_dedup": f"""
            WITH n AS (SELECT doc_id, {_NORM} AS norm, length(coalesce(text, '')) AS n FROM documents),
            g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
            SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
        "op9_quality_rules": _QUALITY,
        "op10_url_filter": f"""
            WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, translate(coalesce(url, ''), '{urls.UPPER}', '{urls.LOWER}') AS u FROM pages),
            h AS (SELECT *, ({_hits(urls.STRICT)})::INT AS n_strict, ({_hits(urls.SOFT)})::INT AS n_soft FROM p)
            SELECT page_id, host, path, {_rule_cases("rule")} AS rule,
                coalesce({_rule_cases("verdict")}, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n_soft
            FROM h""",
    }
