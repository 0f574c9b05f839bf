"""The registry of queries, and SQL for the views that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.sources.tables import SEED_CODES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``<inventory id>_<what it does>``, with DuckDB SQL for the same rows."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


_NUMBER = r"CAST(regexp_extract(source, '(\d+)', 1) AS INT)"
TRACES = f"traces AS MATERIALIZED (SELECT doc_id, source AS model, {_NUMBER} // 2 AS comparison, {_NUMBER} % 2 AS side, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS question_id, text AS thinking FROM documents)"
CODEBOOK = "codebook(code_idx, code_name) AS (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(SEED_CODES)) + ")"
TOKENS = r"tokens AS MATERIALIZED (SELECT doc_id, model, comparison, side, question_id, string_split_regex(lower(coalesce(thinking, '')), '[^\p{L}\p{N}_]+') AS ws FROM traces)"
_FACTS = "facts AS MATERIALIZED (SELECT doc_id, model, comparison, side, question_id, code_idx, code_name, {cnt} AS cnt FROM tokens, codebook)"
_COUNT = "len(list_filter(ws, lambda w: w = code_name))::BIGINT"
FACTS = ", ".join([TRACES, CODEBOOK, TOKENS, _FACTS.format(cnt=_COUNT)])
MISSING = ", ".join([TRACES, CODEBOOK, TOKENS, _FACTS.format(cnt=f"CASE WHEN NOT (code_idx >= 6 AND question_id % 3 = 0) THEN {_COUNT} END")])
STATUS = "status AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'correct' ELSE 'wrong' END AS status FROM labels)"
SEQ = "seq AS (SELECT user_id AS sample_id, (user_id % 2)::INT AS model, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS code FROM events)"
RUNS = """ev AS (SELECT user_id AS sample_id, (event_id % 3)::INT AS run, ((event_id // 3) % 2)::INT AS model, event_type AS code FROM events),
    rc AS (SELECT sample_id, run, model, code, count(*) AS cnt FROM ev GROUP BY ALL),
    runs AS MATERIALIZED (SELECT a.sample_id, a.run, a.model, c.code, coalesce(rc.cnt, 0) AS cnt FROM (SELECT DISTINCT sample_id, run, model FROM ev) a CROSS JOIN (SELECT DISTINCT code FROM ev) c LEFT JOIN rc USING (sample_id, run, model, code))"""
DENSE = "dense AS MATERIALIZED (SELECT vec_id, label, generate_subscripts(embedding, 1)::INT - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
TURNS = "turns AS (SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"
PAIRS = "pairs AS (SELECT comparison, question_id, a.doc_id AS doc_a, b.doc_id AS doc_b, a.thinking AS text_a, b.thinking AS text_b FROM traces a JOIN traces b USING (comparison, question_id) WHERE a.side = 0 AND b.side = 1)"
STATS = "stats AS (SELECT comparison, code_idx, code_name, coalesce(sum(cnt) FILTER (side = 0), 0)::BIGINT AS c0, coalesce(sum(cnt) FILTER (side = 1), 0)::BIGINT AS c1 FROM facts GROUP BY ALL)"
