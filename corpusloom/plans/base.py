"""Registry of queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _address_free(c: str) -> str:
    t = f"regexp_replace(trim({c}), '^.*arxiv\\.org/(?:abs|e-print)/', '')"
    t = f"regexp_replace({t}, '^.*arxiv\\.org/pdf/(.*?)(?:\\.pdf)?$', '\\1')"
    return f"trim(regexp_replace({t}, '^(?:https?://)?(?:arxiv\\.org/)?', ''))"


def sql_core(c: str) -> str:
    return f"regexp_replace({_address_free(c)}, 'v\\d+$', '', 'i')"


def sql_format_version(c: str) -> str:
    t = f"trim({c})"
    return f"(CASE WHEN {t} IS NULL OR {t} = '' THEN 'v1' WHEN regexp_full_match({t}, '\\d+') THEN 'v' || {t} WHEN regexp_full_match({t}, '[vV]\\d+') THEN 'v' || substr({t}, 2) ELSE {t} END)"


def sql_key(c: str, version: str = "NULL") -> str:
    own = f"nullif(regexp_extract({_address_free(c)}, 'v(\\d+)$', 1, 'i'), '')"
    given = f"nullif(trim({version}), '')" if version != "NULL" else "NULL"
    inner = f"coalesce({given}, 'v' || {own})"
    return f"({sql_core(c)} || {sql_format_version(inner)})"


def sql_normalize(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace({c}, chr(173), ''), '([\\p{{L}}\\p{{M}}\\p{{N}}_])-\\s+([\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1\\2', 'g'), '\\s+', ' ', 'g'))"


SQL_VECTORS = """vec AS (SELECT paper_key AS key, min(matrix)::DOUBLE[] AS v FROM feature_matrix
  WHERE paper_key IS NOT NULL AND matrix IS NOT NULL AND len(matrix) > 0 AND len(list_filter(matrix, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(matrix, lambda x: x <> 0)) > 0 GROUP BY paper_key)"""
SQL_HITS = """sims AS (SELECT q.topic_id, q.q_idx, c.key, round(list_cosine_similarity(c.v, q.embedding::DOUBLE[]), 9) AS score FROM vec c, topic_query q WHERE q.embedding IS NOT NULL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, q_idx ORDER BY score DESC, key) AS pos FROM sims) WHERE pos <= 150)"""
