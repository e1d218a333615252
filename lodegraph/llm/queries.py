"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, exact_dedup, language, mixing, near_dedup, packing, quality, secret_scan, suffix_dedup
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": lambda s, d: quality.classify(table(s, d, "documents", "doc_id"), table(s, d, "labels")),
        "op2_exact_dedup": lambda s, d: exact_dedup.of_both_halves(table(s, d, "documents", "doc_id")),
        "op3_simhash_near_dedup": lambda s, d: near_dedup.near_duplicates(table(s, d, "documents", "doc_id")),
        "op4_language_id": lambda s, d: language.identify(table(s, d, "documents", "doc_id")),
        "op5_secret_scan": lambda s, d: secret_scan.scan(table(s, d, "documents", "doc_id")),
        "op6_suffix_array_dedup": lambda s, d: suffix_dedup.repeated_passages(table(s, d, "documents", "doc_id")),
        "op7_chat_formatting": lambda s, d: chat.format_chats(table(s, d, "conversations")),
        "op8_source_mixing": lambda s, d: mixing.mixture(table(s, d, "documents", "doc_id")),
        "op9_packing": lambda s, d: packing.pack(table(s, d, "documents", "doc_id")),
        "op10_nearest_neighbours": lambda s, d: ann.neighbours(table(s, d, "embeddings", "vec_id"), F.col("id") % 100 == 0),
    }


_TOKENS = r"coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0)"


def _key(seed: str) -> str:
    return f"md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), ''))"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            SELECT doc_id, sha256(text) AS digest,
                   CASE WHEN text IS NULL THEN doc_id ELSE first_value(doc_id) OVER w END AS winner_id,
                   text IS NULL OR row_number() OVER w = 1 AS kept
            FROM documents WINDOW w AS (PARTITION BY text ORDER BY coalesce(md5(CAST(doc_id AS VARCHAR)) >= '8', true), doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
        "op6_suffix_array_dedup": rf"""
            WITH words AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS w FROM documents),
            windows AS (SELECT doc_id, i - 1 AS s, array_to_string(w[i : i + {suffix_dedup.PASSAGE - 1}], ' ') AS t
                        FROM words, unnest(range(1, len(w) - {suffix_dedup.PASSAGE - 2})) AS u(i)),
            often AS (SELECT doc_id, s FROM windows WHERE t IN (SELECT t FROM windows GROUP BY t HAVING count(*) > 1)),
            islands AS (SELECT doc_id, s, s - row_number() OVER (PARTITION BY doc_id ORDER BY s) AS island FROM often)
            SELECT doc_id, CAST(min(s) AS BIGINT) AS start_word, CAST(max(s) - min(s) + {suffix_dedup.PASSAGE} AS BIGINT) AS n_words
            FROM islands GROUP BY doc_id, island""",
        "op7_chat_formatting": """
            SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages,
                   string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
            FROM conversations GROUP BY conv_id""",
        "op8_source_mixing": f"""
            WITH t AS (SELECT doc_id, source, CAST({_TOKENS} AS BIGINT) AS tokens, {_key(mixing.SEED)} AS k FROM documents),
            have AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS n FROM t GROUP BY source),
            goal AS (SELECT source, n, CASE WHEN n > 0 THEN CAST(floor(sum(n) OVER () * (sqrt(n) * sqrt(sqrt(n))) / sum(sqrt(n) * sqrt(sqrt(n))) OVER () + 1e-6) AS BIGINT) ELSE 0 END AS budget FROM have),
            placed AS (SELECT t.*, n, budget, CASE WHEN n > 0 THEN budget // n ELSE 0 END AS whole,
                       CAST(sum(tokens) OVER (PARTITION BY t.source ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) - tokens AS before
                       FROM t JOIN goal ON t.source IS NOT DISTINCT FROM goal.source),
            epochs AS (SELECT *, budget - whole * n AS rest, whole + CASE WHEN before < budget - whole * n THEN 1 ELSE 0 END AS times FROM placed)
            SELECT doc_id, source, e AS epoch, tokens, CASE WHEN e = whole + 1 THEN least(tokens, rest - before) ELSE tokens END AS taken
            FROM epochs, unnest(range(1, times + 1)) AS u(e)""",
        "op9_packing": f"""
            WITH t AS (SELECT doc_id, CAST({_TOKENS} AS BIGINT) AS n, {_key(packing.SEED)} AS k FROM documents),
            shards AS (SELECT greatest(1, CAST(ceil(count(*) / {packing.SHARD_ROWS}) AS BIGINT)) AS shards FROM t),
            pieces AS (SELECT doc_id, k, i AS piece, least({packing.CAPACITY}, n - i * {packing.CAPACITY}) AS tokens,
                       CAST('0x' || k[1:8] AS BIGINT) % shards AS shard
                       FROM t, shards, unnest(range(0, (n + {packing.CAPACITY - 1}) // {packing.CAPACITY})) AS u(i)),
            classed AS (SELECT *, {packing.CAPACITY} // tokens AS class FROM pieces),
            placed AS (SELECT *, row_number() OVER (PARTITION BY class, shard ORDER BY k, piece) - 1 AS place FROM classed)
            SELECT doc_id, piece, tokens, class, class || '-' || shard || '-' || (place // class) AS bin_id, place % class AS slot FROM placed
            UNION ALL SELECT doc_id, NULL, 0, NULL, NULL, NULL FROM t WHERE n = 0""",
    }
