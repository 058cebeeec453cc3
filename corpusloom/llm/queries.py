"""The queries of the training-data operators; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import clusters, mixing, names, neighbours, packing, pii, scans


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def paper_key(df: DataFrame) -> DataFrame:
    """df with `key`: versionless id + version, from the several ways ids are written."""
    raw = F.regexp_replace(F.trim("arxiv_id"), r"(?i)^(https?://)?(www\.)?arxiv\.org/(abs|pdf)/|^arxiv:\s*|\.pdf$", "")
    core = F.regexp_replace(raw, r"(?i)v\d+$", "")
    version = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("version", F.lit("")), r"(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(raw, r"(?i)v(\d+)$", 1), F.lit("")), F.lit("1"))
    return df.withColumn("key", F.concat(core, F.lit("v"), version))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.pairs_of_groups(clusters.group_similar(_read(spark, folder, "feature_matrix")))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    titles = paper_key(_read(spark, folder, "paper_meta").withColumnRenamed("latest_version", "version")).select("key", "title")
    return clusters.describe_groups(clusters.group_similar(_read(spark, folder, "feature_matrix")), titles)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.spelling_pairs(names.link_spellings(_read(spark, folder, "paper_hit"), _read(spark, folder, "given_name")))


def p2_entities(spark: SparkSession, folder: str) -> DataFrame:
    return names.link_spellings(_read(spark, folder, "paper_hit"), _read(spark, folder, "given_name"))


def _scanned(spark: SparkSession, folder: str, compose: bool) -> DataFrame:
    docs = paper_key(_read(spark, folder, "paper_doc")).select("key", "title", "source_kind", "sections")
    return scans.repair_documents(docs, compose=compose)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scanned(spark, folder, False).select(F.col("key").alias("paper_key"), "sec_no", F.explode("changes").alias("c"))
    return rows.select("paper_key", "sec_no", "c.kind", "c.item").distinct()


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scanned(spark, folder, True).select(F.col("key").alias("paper_key"), "sec_no", "text", F.size("changes").alias("n_changes"))
    return rows.dropDuplicates(["paper_key", "sec_no", "text"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.most_similar(_read(spark, folder, "feature_matrix")))


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours.most_similar(_read(spark, folder, "feature_matrix"))
    return near.select(F.col("key").alias("paper_key"), F.col("other").alias("near_key"), F.round("similarity", 6).alias("broad_score"), "rank")


def p4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar papers of every paper, however similar."""
    near = neighbours.most_similar(_read(spark, folder, "feature_matrix"), least=-1.0)
    return near.select(F.col("key").alias("paper_key"), F.col("other").alias("near_key"), F.round("similarity", 6).alias("broad_score"), "rank")


def p5_windows(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_read(spark, folder, "documents"), _read(spark, folder, "context_window"))


def p5_fill(spark: SparkSession, folder: str) -> DataFrame:
    windows = _read(spark, folder, "context_window")
    return packing.fill_report(packing.pack(_read(spark, folder, "documents"), windows), windows)


def p5_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Of every window the texts that were packed whole, without a gap between their pieces, and the containers beyond its capacity."""
    windows = _read(spark, folder, "context_window")
    packed = packing.pack(_read(spark, folder, "documents"), windows)
    whole = packed.groupBy("window_name", "doc_id").agg(F.sum("n_tokens").alias("tokens"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.count_distinct("piece").alias("pieces"), F.count("*").alias("rows"))
    whole = whole.groupBy("window_name").agg(F.count_if((F.col("tokens") == F.col("end")) & (F.col("pieces") == F.col("rows"))).alias("whole_texts"))
    full = packed.groupBy("window_name", "container").agg(F.sum("n_tokens").alias("held")).join(F.broadcast(windows.select("window_name", "capacity_tokens").distinct()), "window_name")
    full = full.groupBy("window_name").agg(F.count_if(F.col("held") > F.col("capacity_tokens")).alias("too_full"))
    return whole.join(full, "window_name")


def p6_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_read(spark, folder, "documents"), _read(spark, folder, "source_weight"))[0]


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_read(spark, folder, "documents"), _read(spark, folder, "source_weight"))[1]


def p6_grown(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of a mixture of three quarters of all tokens, for which the exponent must leave the targets."""
    return mixing.mix(_read(spark, folder, "documents"), _read(spark, folder, "source_weight"), wanted=0.75)[1]


def p6_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of a mixture whose weights have nine tenths of the largest possible entropy."""
    return mixing.mix(_read(spark, folder, "documents"), _read(spark, folder, "source_weight"), entropy=0.9)[1]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_spans(_read(spark, folder, "documents"), _read(spark, folder, "given_name"))
    return found.select("doc_id", "kind", "value").distinct()


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redact_documents(_read(spark, folder, "documents"), _read(spark, folder, "given_name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


# SQL that compares all vectors with all others; for the sizes at which the rows are checked.
_PAIRS = """WITH RECURSIVE vec AS (SELECT paper_key AS key, min(matrix)::DOUBLE[] AS v FROM feature_matrix WHERE paper_key IS NOT NULL AND matrix IS NOT NULL AND len(matrix) > 0
  AND len(list_filter(matrix, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(matrix, lambda x: x <> 0)) > 0 GROUP BY paper_key),
near AS (SELECT a.key AS a, b.key AS b, list_cosine_similarity(a.v, b.v) AS s FROM vec a JOIN vec b ON a.key <> b.key WHERE list_cosine_similarity(a.v, b.v) >= 0.5)"""
_TOP = "top AS (SELECT * FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM near) WHERE r <= 5 AND s >= 0.80)"
# Groups that are whole components of the pairs at 0.80 and hold the bound for every member.
_GROUPS = """reach(a, b) AS (SELECT a, b FROM near WHERE s >= 0.80 UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a WHERE n.s >= 0.80 AND r.a <> n.b),
mean AS (SELECT r.a, avg(list_cosine_similarity(x.v, y.v)) AS m FROM reach r JOIN vec x ON x.key = r.a JOIN vec y ON y.key = r.b GROUP BY r.a),
good AS (SELECT r.a FROM reach r JOIN mean m ON m.a = r.b GROUP BY r.a HAVING min(m.m) >= 0.80)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_PAIRS}, {_GROUPS} SELECT a AS paper_key_a, b AS paper_key_b FROM reach WHERE a < b AND a IN (SELECT a FROM good)",
        "p4_found": f"{_PAIRS}, {_TOP} SELECT DISTINCT least(a, b) AS paper_key_a, greatest(a, b) AS paper_key_b FROM top",
        "p5_packed": "SELECT window_name, count(*) FILTER (WHERE text <> '') AS whole_texts, 0::BIGINT AS too_full FROM documents, (SELECT DISTINCT window_name FROM context_window) GROUP BY 1",
        "p4_neighbours": f"{_PAIRS}, {_TOP} SELECT a AS paper_key, b AS near_key, round(s, 6) AS broad_score, r::INT AS rank FROM top",
    }
