"""Record assembly and corpus checks as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import assembly as A
from corpusloom.operators import extraction as X
from corpusloom.operators import identity as I
from corpusloom.operators import retrieval as R
from corpusloom.plans.base import SQL_VECTORS, query, sql_core, table
from corpusloom.plans.extraction import DOCS, RANKED, SCORED, SECTIONS, docs
from corpusloom.plans.review import QRELS
from corpusloom.plans.synthesis import RECORDS, VERSION_NO, records
from corpusloom.sources import corpus as C


@query(f"WITH {SQL_VECTORS}, {QRELS} SELECT query_id, count(*) AS judged, count(v.key) AS present, count(*) FILTER (WHERE grade > 0 AND v.key IS NOT NULL) AS relevant_present FROM q LEFT JOIN vec v USING (key) GROUP BY 1")
def judged_coverage(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "paper_hit")
    rel = h.groupBy(F.col("topic_id").alias("query_id"), T.paper_key("arxiv_id", "latest_version").alias("key")).agg(F.max(F.when(F.col("rank") <= 5, 2).when(F.col("rank") <= 15, 1).otherwise(0)).alias("grade"))
    return A.judged_coverage(rel, R.clean_vectors(table(spark, d, "feature_matrix")))


@query(f"""WITH p AS (SELECT DISTINCT run_id AS batch, rank AS pos, arxiv_id, {sql_core('arxiv_id')} AS id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, rank ORDER BY row_id, loaded_at) AS r FROM paper_hit) WHERE r = 1),
rec AS (SELECT batch, pos AS rec_pos, CASE WHEN pos % 3 = 0 THEN NULL ELSE id END AS id FROM p WHERE pos % 4 <> 1),
s AS (SELECT batch, count(*) AS n, count(id) AS ids FROM rec GROUP BY 1), m AS (SELECT batch, count(*) AS m FROM p GROUP BY 1), pl AS (SELECT batch FROM s JOIN m USING (batch) WHERE ids = 0 AND n = m),
rn AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY rec_pos) AS nth FROM rec), pn AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pos) AS nth FROM p WHERE batch IN (SELECT batch FROM pl)),
last AS (SELECT batch, id, max(rec_pos) AS rec_pos FROM rec WHERE id IS NOT NULL GROUP BY 1, 2), k AS (SELECT p.batch, p.pos, l.rec_pos FROM p LEFT JOIN last l ON p.batch = l.batch AND p.id = l.id WHERE p.batch NOT IN (SELECT batch FROM pl)),
o AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pos) AS nth FROM k WHERE rec_pos IS NULL)
SELECT pn.batch, pn.pos, rn.rec_pos FROM pn JOIN rn USING (batch, nth) UNION ALL SELECT batch, pos, rec_pos FROM k WHERE rec_pos IS NOT NULL UNION ALL SELECT o.batch, o.pos, rn.rec_pos FROM o JOIN rn USING (batch, nth)""")
def match_records(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("run_id", "rank").orderBy("row_id", "loaded_at")
    p = table(spark, d, "paper_hit").withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("run_id").alias("batch"), F.col("rank").alias("pos"), "arxiv_id")
    rec = p.where("pos % 4 != 1").select("batch", F.col("pos").alias("rec_pos"), F.when(F.col("pos") % 3 == 0, None).otherwise(F.col("arxiv_id")).alias("arxiv_id"))
    return A.match_records(p, rec)


@query(f"""WITH {RECORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS nth, {VERSION_NO} AS no FROM rec), e AS (SELECT *, CASE WHEN nth > 1 THEN 'duplicate' WHEN status = 'skipped' THEN 'skipped' WHEN trim(coalesce(method, '')) = '' THEN 'missing_method' END AS early FROM n),
b AS (SELECT *, row_number() OVER (PARTITION BY core, early IS NULL ORDER BY no DESC, idx) AS place FROM e), x AS (SELECT coalesce(early, CASE WHEN place = 1 THEN 'accepted' ELSE 'superseded_version' END) AS disposition, count(*) AS n FROM b GROUP BY 1) SELECT disposition, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share FROM x""")
def run_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return A.run_diagnostics(I.inventory(records(spark, d)))


@query(f"""WITH {DOCS}, {SECTIONS}, {SCORED}, {RANKED}, sn AS (SELECT key, rn, sentence FROM cap WHERE k = 'method' AND (rn = 1 OR before + rn <= 28)), t AS (SELECT key, rn, unnest(l) AS keyword, generate_subscripts(l, 1) AS at_ FROM (SELECT key, rn, regexp_extract_all(sentence, '\\b(?:TidalWeb|GlacierTab|MarlinQA|PebbleVQA|CobaltNews)\\b') AS l FROM sn))
SELECT key, keyword FROM (SELECT *, row_number() OVER (PARTITION BY key, lower(keyword) ORDER BY rn, at_) AS r FROM t) WHERE r = 1""")
def keyword_harvest(spark: SparkSession, d: str) -> DataFrame:
    s = X.rank_snippets(X.score_snippets(X.explode_sections(docs(spark, d))))
    return A.harvest_keywords(s, r"\b(?:TidalWeb|GlacierTab|MarlinQA|PebbleVQA|CobaltNews)\b")


@query(f"""WITH r AS (SELECT {sql_core('arxiv_id')} AS core, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, trim(regexp_replace(abstract, '\\s+', ' ', 'g')) AS abstract, array_to_string(list_filter(regexp_split_to_array(trim(matched_categories), '\\s+'), lambda c: c IN ('cs.LG', 'cs.CL')), ' ') AS matched_categories, substr(arxiv_id, 1, 0) AS e FROM paper_meta)
SELECT core, title, matched_categories, sha256(title || chr(10) || abstract) AS row_hash, count(*) AS n FROM r WHERE core <> '' AND title <> '' AND abstract <> '' AND matched_categories <> '' GROUP BY ALL""")
def snapshot_etl(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "paper_meta").select(F.col("arxiv_id").alias("id"), "title", "abstract", "authors", F.col("matched_categories").alias("categories"), "doi", F.lit(None).cast("string").alias("created"))
    return C.normalize_records(m, ["cs.LG", "cs.CL"]).groupBy("core", "title", "matched_categories", "row_hash").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) AS row_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT *, row_id // 100 AS shard, row_id % 100 AS i, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)
SELECT shard::BIGINT AS shard, count(*) AS count, min(len(v))::INT AS min_dim, max(len(v))::INT AS max_dim, round(min(norm) FILTER (WHERE i < 32), 6) AS min_norm, round(avg(norm) FILTER (WHERE i < 32), 6) AS mean_norm, round(max(norm) FILTER (WHERE i < 32), 6) AS max_norm FROM s GROUP BY 1""")
def shard_validation(spark: SparkSession, d: str) -> DataFrame:
    e = C.number_rows(table(spark, d, "embeddings").withColumnRenamed("embedding", "vec"), "vec_id", shard_rows=100)
    v = C.validate_shards(e)
    return v.select(F.col("shard").cast("long").alias("shard"), "count", "min_dim", "max_dim", *[F.round(c, 6).alias(c) for c in ("min_norm", "mean_norm", "max_norm")])


@query(f"""WITH {RECORDS} SELECT key, count(*) AS n, min(idx)::INT AS first FROM rec GROUP BY 1 HAVING count(*) > 1""")
def repeated_records(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).groupBy("key").agg(F.count("*").alias("n"), F.min("idx").cast("int").alias("first")).where("n > 1")


