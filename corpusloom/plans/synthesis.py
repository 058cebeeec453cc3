"""Identity, similarity and clustering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import features as V
from corpusloom.operators import identity as I
from corpusloom.operators import retrieval as R
from corpusloom.plans.base import SQL_VECTORS, query, sql_core, sql_format_version, sql_key, table
from corpusloom.plans.extraction import DOCS, docs
from corpusloom.sources.corpus import number_rows

VERSION_NO = f"coalesce(try_cast(regexp_extract({sql_format_version('version')}, '^v(\\d+)$', 1) AS INT), 0)"


def records(spark: SparkSession, d: str) -> DataFrame:
    """paper_doc as records of an extraction: rows numbered, some skipped or without a method."""
    p = table(spark, d, "paper_doc")
    p = number_rows(p, "arxiv_id", "version", "parsed_at", "source_kind").withColumn("idx", F.col("row_id").cast("int"))
    return p.select("idx", T.paper_key("arxiv_id", "version").alias("key"), T.id_core("arxiv_id").alias("core"), "version", F.when(F.col("source_kind").isNull(), "skipped").when(F.col("source_kind") == "pdf", "degraded").otherwise("ok").alias("status"), F.col("abstract").alias("method"), F.lit("").alias("error"))


RECORDS = f"""rec AS (SELECT (row_number() OVER (ORDER BY arxiv_id, version NULLS FIRST, parsed_at, source_kind NULLS FIRST) - 1)::INT AS idx, {sql_key('arxiv_id', 'version')} AS key, {sql_core('arxiv_id')} AS core, version,
 CASE WHEN source_kind IS NULL THEN 'skipped' WHEN source_kind = 'pdf' THEN 'degraded' ELSE 'ok' END AS status, abstract AS method FROM paper_doc)"""


@query(f"""WITH {RECORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS nth, {VERSION_NO} AS no FROM rec),
e AS (SELECT *, CASE WHEN nth > 1 THEN 'duplicate' WHEN status = 'skipped' THEN 'skipped' WHEN trim(coalesce(method, '')) = '' THEN 'missing_method' END AS early FROM n),
b AS (SELECT *, row_number() OVER (PARTITION BY core, early IS NULL ORDER BY no DESC, idx) AS place, first_value(key) OVER (PARTITION BY core, early IS NULL ORDER BY no DESC, idx) AS winner FROM e)
SELECT idx, key, coalesce(early, CASE WHEN place = 1 THEN 'accepted' ELSE 'superseded_version' END) AS disposition,
 CASE early WHEN 'duplicate' THEN 'identical record already kept' WHEN 'skipped' THEN 'extraction skipped' WHEN 'missing_method' THEN 'blank or missing method text' ELSE CASE WHEN place = 1 THEN 'eligible for clustering' ELSE 'kept ' || winner END END AS reason FROM b""")
def inventory(spark: SparkSession, d: str) -> DataFrame:
    return I.inventory(records(spark, d)).select("idx", "key", "disposition", "reason")


@query(f"WITH {RECORDS} SELECT core, key, version FROM (SELECT *, row_number() OVER (PARTITION BY core ORDER BY {VERSION_NO} DESC, idx) AS r FROM rec) WHERE r = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return I.latest_versions(records(spark, d), "core", "version", "idx").select("core", "key", "version")


@query("SELECT sha256(text) AS key, count(*) AS n, count(DISTINCT source) AS payloads FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def record_conflicts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null and source is not null").withColumn("key", F.sha2("text", 256))
    return I.conflicts(t, "key", "source").join(t.groupBy("key").agg(F.count("*").alias("n")), "key").select("key", "n", "payloads")


@query("""WITH h AS (SELECT sha256(concat_ws('|', coalesce(paper_key, chr(0)), coalesce(channel_used, chr(0)))) AS h FROM feature_matrix)
SELECT sha256(""" + " || '|' || ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::DECIMAL(38,0)::VARCHAR" for i in range(8)) + ") AS digest, count(*) AS n FROM h")
def corpus_digest(spark: SparkSession, d: str) -> DataFrame:
    return I.corpus_digest(table(spark, d, "feature_matrix"), "paper_key", "channel_used")


TERMS = """w AS (SELECT key, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT key, regexp_extract_all(lower(abstract), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+') AS l FROM docs WHERE abstract IS NOT NULL)),
uni AS (SELECT key, t AS term FROM w UNION ALL SELECT a.key, a.t || ' ' || b.t FROM w a JOIN w b ON a.key = b.key AND b.i = a.i + 1),
tf AS (SELECT key, term, count(*) AS tf FROM uni GROUP BY ALL), n AS (SELECT count(DISTINCT key) AS n FROM tf), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
wt AS (SELECT tf.key, tf.term, (1 + ln(tf)) * (ln((1 + n.n)::DOUBLE / (1 + df.df)) + 1) AS x FROM tf JOIN df USING (term), n),
len AS (SELECT key, sqrt(sum(x * x)) AS l FROM wt GROUP BY 1), tfidf AS (SELECT wt.key, term, x / l AS weight FROM wt JOIN len USING (key))"""


def _tfidf(spark: SparkSession, d: str) -> DataFrame:
    return V.tfidf(V.terms(docs(spark, d).select("key", "abstract"), "abstract"))


@query(f"WITH {DOCS}, {TERMS} SELECT key, term, round(weight, 6) AS weight FROM tfidf")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    return _tfidf(spark, d).select("key", "term", F.round("weight", 6).alias("weight"))


CHANNELS = f"""kwd AS (SELECT DISTINCT d.key, unnest(regexp_split_to_array(trim(m.matched_categories), '\\s+')) AS term FROM docs d JOIN (SELECT {sql_key('arxiv_id', 'latest_version')} AS key, min(matched_categories) AS matched_categories FROM paper_meta GROUP BY 1) m USING (key)),
kn AS (SELECT count(DISTINCT key) AS n FROM kwd), kdf AS (SELECT term, count(*) AS df FROM kwd GROUP BY 1), kw0 AS (SELECT key, term, ln((1 + n)::DOUBLE / (1 + df)) + 1 AS x FROM kwd JOIN kdf USING (term), kn),
kl AS (SELECT key, sqrt(sum(x * x)) AS l FROM kw0 GROUP BY 1), kt AS (SELECT key, term, x / l AS weight FROM kw0 JOIN kl USING (key)),
bc AS (SELECT key, 'text' AS channel, term, weight * sqrt(0.5) AS w FROM tfidf UNION ALL SELECT key, 'keywords', term, weight * sqrt(0.5) FROM kt), bl AS (SELECT key, sqrt(sum(w * w)) AS l FROM bc GROUP BY 1),
feat AS (SELECT key, channel, term, w / l AS weight FROM bc JOIN bl USING (key))"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "paper_meta").select(T.paper_key("arxiv_id", "latest_version").alias("key"), "matched_categories").groupBy("key").agg(F.min("matched_categories").alias("c"))
    k = docs(spark, d).select("key").join(m, "key").select("key", F.explode(F.split(F.trim("c"), r"\s+")).alias("term")).distinct().withColumn("tf", F.lit(1))
    return V.two_channels(_tfidf(spark, d), V.tfidf(k))


@query(f"WITH {DOCS}, {TERMS}, {CHANNELS} SELECT a.key AS a, b.key AS b, round(sum(a.weight * b.weight), 6) AS similarity FROM feat a JOIN feat b ON a.channel = b.channel AND a.term = b.term AND a.key < b.key GROUP BY 1, 2 HAVING sum(a.weight * b.weight) >= 0.8")
def two_channel_similarity(spark: SparkSession, d: str) -> DataFrame:
    return V.similar_pairs(_features(spark, d), 0.8).select("a", "b", F.round("similarity", 6).alias("similarity"))


SEED = "m AS (SELECT key, (row_number() OVER (ORDER BY key) - 1)::INT AS i FROM vec)"


@query()
def agglomerative(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "paper_hit").select("topic_id", T.paper_key("arxiv_id", "latest_version").alias("key")).distinct()
    items = hits.join(R.clean_vectors(table(spark, d, "feature_matrix")), "key")
    return V.agglomerate_whole(items.withColumn("collection", F.col("topic_id").cast("string")), 0.4)


LABELLED = """c AS (SELECT cluster_id, label, paper_keys, top_keywords, size FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY built_at) AS r FROM cluster_assignment) WHERE r = 1),
m AS (SELECT DISTINCT cluster_id AS cluster, unnest(paper_keys) AS key FROM c)"""


def members(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("cluster_id").orderBy("built_at")
    c = table(spark, d, "cluster_assignment").withColumn("r", F.row_number().over(w)).where("r = 1")
    return c.select(F.col("cluster_id").alias("cluster"), F.explode("paper_keys").alias("key")).distinct()


@query(f"""WITH {LABELLED}, k AS (SELECT DISTINCT {sql_key('arxiv_id', 'latest_version')} AS key, unnest(regexp_split_to_array(trim(matched_categories), '\\s+')) AS keyword FROM paper_meta WHERE matched_categories IS NOT NULL),
kk AS (SELECT * FROM k WHERE keyword <> ''), tot AS (SELECT keyword, count(*) AS total FROM kk WHERE key IN (SELECT key FROM m) GROUP BY 1),
ins AS (SELECT cluster, keyword, count(DISTINCT key) AS n FROM m JOIN kk USING (key) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, n::DOUBLE / total DESC, keyword) AS r FROM ins JOIN tot USING (keyword)),
l AS (SELECT cluster, string_agg(keyword, '; ' ORDER BY r) AS label FROM r WHERE r <= 3 GROUP BY 1) SELECT DISTINCT m.cluster, coalesce(l.label, 'unlabeled') AS label FROM m LEFT JOIN l USING (cluster)""")
def cluster_labels(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "paper_meta").where("matched_categories is not null").select(T.paper_key("arxiv_id", "latest_version").alias("key"), F.explode(F.split(F.trim("matched_categories"), r"\s+")).alias("keyword"))
    return V.label_clusters(members(spark, d), k).select("cluster", "label")


EMB = "e AS (SELECT vec_id::VARCHAR AS key, label::VARCHAR AS cluster, embedding::DOUBLE[] AS v FROM embeddings), dist AS (SELECT a.key AS a, b.key AS b, round(1 - list_cosine_similarity(a.v, b.v), 9) AS d, a.cluster AS ca, b.cluster AS cb FROM e a JOIN e b ON a.key <> b.key)"


@query(f"""WITH {EMB}, w AS (SELECT ca AS cluster, avg(d) FILTER (WHERE ca = cb) AS mean_within, min(d) FILTER (WHERE ca <> cb) AS nearest_other FROM dist GROUP BY 1),
x AS (SELECT a, ca, cb, avg(d) AS m FROM dist GROUP BY ALL), y AS (SELECT a, ca, min(m) FILTER (WHERE ca = cb) AS own, min(m) FILTER (WHERE ca <> cb) AS other FROM x GROUP BY ALL),
s AS (SELECT ca AS cluster, avg(CASE WHEN own IS NULL OR other IS NULL THEN 0 ELSE coalesce((other - own) / nullif(greatest(own, other), 0), 0) END) AS silhouette FROM y GROUP BY 1)
SELECT cluster, (SELECT count(*) FROM e WHERE e.cluster = w.cluster) AS size, round(mean_within, 5) AS mean_within, round(nearest_other, 5) AS nearest_other, round(silhouette, 5) AS silhouette FROM w JOIN s USING (cluster)""")
def cluster_quality(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("label").cast("string").alias("cluster"), F.col("embedding").alias("vec"))
    q = V.cluster_quality(e)
    return q.select("cluster", "size", *[F.round(c, 5).alias(c) for c in ("mean_within", "nearest_other", "silhouette")])


@query(f"""WITH {EMB}, x AS (SELECT a, ca, cb, avg(d) AS m FROM dist GROUP BY ALL), y AS (SELECT a, ca, min(m) FILTER (WHERE ca = cb) AS own, min(m) FILTER (WHERE ca <> cb) AS other FROM x GROUP BY ALL),
s AS (SELECT avg(CASE WHEN own IS NULL OR other IS NULL THEN 0 ELSE coalesce((other - own) / nullif(greatest(own, other), 0), 0) END) AS v FROM y), n AS (SELECT count(DISTINCT cluster) AS k, count(*) AS n FROM e)
SELECT k AS n_clusters, (SELECT count(*) FROM (SELECT cluster FROM e GROUP BY 1 HAVING count(*) = 1)) AS n_singletons, n AS n_clustered, round(v, 4) AS silhouette, round(v, 4) < 0.15 AS ambiguity_warning, CASE WHEN k < 2 OR k >= n THEN 'label-count precondition not met (need 2..n-1 clusters)' END AS silhouette_reason FROM s, n""")
def cluster_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("label").cast("string").alias("cluster"), F.col("embedding").alias("vec"))
    return V.cluster_summary(V.cluster_quality(e))


@query(f"WITH {SQL_VECTORS}, {SEED} SELECT key, floor(i / 1000)::INT AS shard, i AS row_id, len(v)::INT AS dim FROM m JOIN vec USING (key)")
def shard_rows(spark: SparkSession, d: str) -> DataFrame:
    v = R.clean_vectors(table(spark, d, "feature_matrix"))
    return number_rows(v, "key", shard_rows=1000).select("key", F.col("shard").cast("int").alias("shard"), F.col("row_id").cast("int").alias("row_id"), F.size("vec").alias("dim"))
