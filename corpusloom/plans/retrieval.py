"""Retrieval queries over the paper tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import retrieval as R
from corpusloom.plans.base import SQL_HITS, SQL_VECTORS, query, sql_core, sql_format_version, sql_key, table

META = f"""meta AS (SELECT key, year, matched_categories FROM (SELECT {sql_key('arxiv_id', 'latest_version')} AS key, year, matched_categories,
  row_number() OVER (PARTITION BY {sql_key('arxiv_id', 'latest_version')} ORDER BY row_id, year NULLS FIRST) AS r FROM paper_meta) WHERE r = 1)"""


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return R.clean_vectors(table(spark, d, "feature_matrix"))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "paper_meta").withColumn("key", T.paper_key("arxiv_id", "latest_version"))
    w = Window.partitionBy("key").orderBy("row_id", F.col("year").asc_nulls_first())
    return m.withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "year", "matched_categories")


def keyword_ranking(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "paper_hit").where("keyword_rank is not null").select("topic_id", T.paper_key("arxiv_id", "latest_version").alias("key"), "keyword_rank")
    return h.groupBy("topic_id", "key").agg(F.min("keyword_rank").alias("pos"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "paper_hit").where("citation_count is not null").select(T.paper_key("arxiv_id", "latest_version").alias("key"), "citation_count")
    return h.groupBy("key").agg(F.max("citation_count").cast("long").alias("n"))


@query(f"WITH {SQL_VECTORS}, {SQL_HITS} SELECT topic_id, q_idx, key, round(score, 6) AS score, pos::INT AS pos FROM hits WHERE pos <= 10")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = R.search(corpus(spark, d), table(spark, d, "topic_query"), 10)
    return hits.select("topic_id", "q_idx", "key", F.round("score", 6).alias("score"), "pos")


UNION = """un AS (SELECT topic_id, key, max(score) AS best_score, min({'q_idx': q_idx, 'pos': pos}) AS seen, array_to_string(list_sort(list(DISTINCT q_idx)), ',') AS found_by FROM hits GROUP BY topic_id, key)"""


@query(f"WITH {SQL_VECTORS}, {SQL_HITS}, {UNION} SELECT topic_id, key, round(best_score, 6) AS best_score, found_by FROM un")
def multi_query_union(spark: SparkSession, d: str) -> DataFrame:
    hits = R.union_hits(R.search(corpus(spark, d), table(spark, d, "topic_query"), 150))
    return hits.select("topic_id", "key", F.round("best_score", 6).alias("best_score"), "found_by")


@query(f"""WITH {META} SELECT key, year, matched_categories FROM meta WHERE year >= 2015 AND year <= 2023 AND list_has_any(regexp_split_to_array(trim(coalesce(matched_categories, '')), '\\s+'), ['cs.LG', 'cs.CL'])""")
def null_year_filter(spark: SparkSession, d: str) -> DataFrame:
    return metadata(spark, d).where(R.passes(2015, 2023, ["cs.LG", "cs.CL"]))


FUSION = """ranks AS (SELECT topic_id, 'q' || q_idx AS ranking, key, pos FROM hits UNION ALL SELECT topic_id, 'keyword', key, pos FROM kw),
first_pos AS (SELECT topic_id, ranking, key, min(pos) AS pos FROM ranks GROUP BY ALL),
rrf AS (SELECT topic_id, key, sum(1.0::DOUBLE / (60 + pos)) AS rrf_score FROM first_pos GROUP BY topic_id, key)"""
KW = f"kw AS (SELECT topic_id, {sql_key('arxiv_id', 'latest_version')} AS key, min(keyword_rank) AS pos FROM paper_hit WHERE keyword_rank IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {SQL_VECTORS}, {SQL_HITS}, {KW}, {FUSION} SELECT topic_id, key, round(rrf_score, 9) AS rrf_score FROM rrf")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    hits = R.search(corpus(spark, d), table(spark, d, "topic_query"), 150)
    ranks = hits.select("topic_id", F.concat(F.lit("q"), "q_idx").alias("ranking"), "key", "pos")
    ranks = ranks.unionByName(keyword_ranking(spark, d).select("topic_id", F.lit("keyword").alias("ranking"), "key", "pos"))
    return R.fuse_ranks(ranks).select("topic_id", "key", F.round("rrf_score", 9).alias("rrf_score"))


CONDITION = "year >= 2012 AND list_has_any(regexp_split_to_array(trim(coalesce(matched_categories, '')), '\\s+'), ['cs.LG', 'cs.CL', 'cs.IR', 'cs.AI'])"


def _hybrid_sql(select: str, cited: bool, rerank: bool = True) -> str:
    cite = f", cite AS (SELECT {sql_key('arxiv_id', 'latest_version')} AS key, max(citation_count)::BIGINT AS n FROM paper_hit WHERE citation_count IS NOT NULL GROUP BY 1)" if cited else ""
    third = "UNION ALL SELECT topic_id, 'citations', key, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, rerank_pos) FROM scored JOIN cite USING (key)" if cited else ""
    score = "round(list_cosine_similarity(v.v, t.embedding::DOUBLE[]), 9)" if rerank else "p.best_score"
    return f"""WITH {SQL_VECTORS}, {SQL_HITS}, {UNION}, {META}, {KW}{cite},
ok AS (SELECT key FROM meta WHERE {CONDITION}),
pool0 AS (SELECT topic_id, key, best_score, found_by, row_number() OVER (PARTITION BY topic_id ORDER BY best_score DESC, seen.q_idx, seen.pos, key) AS pp FROM un WHERE key IN (SELECT key FROM ok)),
pool1 AS (SELECT * FROM pool0 WHERE pp <= 200),
words AS (SELECT topic_id, key, min(pos) AS keyword_rank FROM kw WHERE pos <= 50 AND key IN (SELECT key FROM ok) AND key IN (SELECT key FROM vec) GROUP BY 1, 2),
extra AS (SELECT topic_id, key, 0.0::DOUBLE AS best_score, '' AS found_by, 1000000 + row_number() OVER (PARTITION BY topic_id ORDER BY keyword_rank, key) AS pp FROM words w WHERE NOT EXISTS (SELECT 1 FROM pool1 p WHERE p.topic_id = w.topic_id AND p.key = w.key)),
pool AS (SELECT * FROM (SELECT topic_id, key, best_score, found_by, row_number() OVER (PARTITION BY topic_id ORDER BY pp) AS pool_pos FROM (SELECT * FROM pool1 UNION ALL SELECT * FROM extra)) WHERE pool_pos <= 250),
scored0 AS (SELECT p.*, {score} AS rerank_score FROM pool p JOIN vec v ON p.key = v.key JOIN topic_query t ON t.topic_id = p.topic_id AND t.q_idx = 0),
scored AS (SELECT s.*, w.keyword_rank, row_number() OVER (PARTITION BY s.topic_id ORDER BY rerank_score DESC, pool_pos) AS rerank_pos FROM scored0 s LEFT JOIN words w ON s.topic_id = w.topic_id AND s.key = w.key),
ranks AS (SELECT topic_id, 'vector' AS ranking, key, rerank_pos AS pos FROM scored UNION ALL SELECT topic_id, 'keyword', key, keyword_rank FROM scored WHERE keyword_rank IS NOT NULL {third}),
several AS (SELECT topic_id FROM ranks GROUP BY 1 HAVING count(DISTINCT ranking) > 1),
rrf AS (SELECT topic_id, key, round(sum(1.0::DOUBLE / (60 + pos)), 12) AS rrf_score FROM (SELECT topic_id, ranking, key, min(pos) AS pos FROM ranks GROUP BY ALL) WHERE topic_id IN (SELECT topic_id FROM several) GROUP BY 1, 2),
fused AS (SELECT s.*, r.rrf_score, round(s.rerank_score + coalesce(r.rrf_score, 0), 9) AS fused FROM scored s LEFT JOIN rrf r ON s.topic_id = r.topic_id AND s.key = r.key),
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY fused DESC, rerank_score DESC, pool_pos) AS rank FROM fused) WHERE rank <= 25)
{select}"""


FINAL = "SELECT topic_id, rank::INT AS rank, key, round(best_score, 6) AS broad_score, round(rerank_score, 6) AS rerank_score, round(rrf_score, 6) AS rrf_score, round(fused, 6) AS fused, keyword_rank, found_by FROM final"


def _hybrid(spark: SparkSession, d: str, cited: bool, rerank: bool = True) -> DataFrame:
    return R.retrieve(
        corpus(spark, d), table(spark, d, "topic_query"), metadata(spark, d), keyword_ranking(spark, d), citations(spark, d) if cited else None,
        rerank=rerank, condition=R.passes(2012, None, ["cs.LG", "cs.CL", "cs.IR", "cs.AI"]),
    )


def _six(df: DataFrame) -> DataFrame:
    return df.select("topic_id", "rank", "key", *[F.round(c, 6).alias(c) for c in ("broad_score", "rerank_score", "rrf_score", "fused")], "keyword_rank", "found_by")


@query(_hybrid_sql(FINAL, False))
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return _six(_hybrid(spark, d, False))


@query(_hybrid_sql(FINAL, True))
def citation_boost(spark: SparkSession, d: str) -> DataFrame:
    return _six(_hybrid(spark, d, True))


@query(_hybrid_sql(FINAL, False, rerank=False))
def retrieve_without_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _six(_hybrid(spark, d, False, rerank=False))


@query(_hybrid_sql("""SELECT topic_id, round(coalesce(count(*) FILTER (WHERE b.key IS NOT NULL) / nullif(count(*), 0), 0), 4) AS overlap
FROM final f LEFT JOIN (SELECT topic_id, key FROM pool1 WHERE pp <= 25) b USING (topic_id, key) GROUP BY topic_id""", False))
def topk_overlap(spark: SparkSession, d: str) -> DataFrame:
    final = _hybrid(spark, d, False)
    broad = R.union_hits(R.search(corpus(spark, d), table(spark, d, "topic_query"), 150))
    broad = broad.join(metadata(spark, d).where(R.passes(2012, None, ["cs.LG", "cs.CL", "cs.IR", "cs.AI"])).select("key"), "key", "left_semi")
    w = Window.partitionBy("topic_id").orderBy(F.desc("best_score"), "seen.q_idx", "seen.pos", "key")
    broad = broad.withColumn("r", F.row_number().over(w)).where("r <= 25")
    return R.top_overlap(broad, final).join(final.select("topic_id").distinct(), "topic_id", "left_semi")


@query(f"""SELECT row_id, {sql_core('arxiv_id')} AS core, {sql_key('arxiv_id', 'latest_version')} AS key, {sql_format_version('latest_version')} AS version,
coalesce(try_cast(regexp_extract({sql_format_version('latest_version')}, '^v(\\d+)$', 1) AS INT), 0) AS version_no, count(*) AS n FROM paper_meta GROUP BY ALL""")
def paper_ids(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "paper_meta")
    m = m.select("row_id", T.id_core("arxiv_id").alias("core"), T.paper_key("arxiv_id", "latest_version").alias("key"), T.format_version("latest_version").alias("version"), T.version_number("latest_version").alias("version_no"))
    return m.groupBy("row_id", "core", "key", "version", "version_no").agg(F.count("*").alias("n"))


@query("""WITH q AS (SELECT topic_id, q_idx, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS topic FROM topic_query WHERE query IS NOT NULL),
e AS (SELECT topic_id, q_idx, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS q FROM (SELECT topic_id, q_idx, [topic, 'methods and algorithms for ' || topic, topic || ' in deep neural networks', 'empirical study of ' || topic, topic || ' survey benchmarks datasets'] AS l FROM q))
SELECT topic_id, q_idx, pos::INT AS pos, q AS expanded FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, q_idx, lower(q) ORDER BY pos) AS r FROM e) WHERE r = 1 AND pos < 4""")
def template_expand(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators.expansion import template_queries

    return template_queries(table(spark, d, "topic_query").select("topic_id", "q_idx", "query"), "query", 3)


@query(f"""WITH h AS (SELECT topic_id, {sql_key('arxiv_id', 'latest_version')} AS key, count(*) AS hits, sum(CASE WHEN broad_score >= 0.5 THEN 1 ELSE 0 END) AS near, avg(broad_score) AS mean_score FROM paper_hit GROUP BY 1, 2)
SELECT topic_id, count(*) AS papers, sum(hits)::BIGINT AS hits, sum(near)::BIGINT AS near, round(max(mean_score), 6) AS best_mean FROM h GROUP BY topic_id""")
def retrieval_run_metrics(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "paper_hit").withColumn("key", T.paper_key("arxiv_id", "latest_version"))
    h = h.groupBy("topic_id", "key").agg(F.count("*").alias("hits"), F.sum((F.col("broad_score") >= 0.5).cast("int")).alias("near"), F.avg("broad_score").alias("m"))
    return h.groupBy("topic_id").agg(F.count("*").alias("papers"), F.sum("hits").alias("hits"), F.sum("near").alias("near"), F.round(F.max("m"), 6).alias("best_mean"))
