"""Evidence, claim, review, metric and quota queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evidence as E
from corpusloom.operators import extraction as X
from corpusloom.operators import metrics as M
from corpusloom.operators import review as W
from corpusloom.plans.base import SQL_HITS, SQL_VECTORS, query, sql_key, table
from corpusloom.plans.extraction import DOCS, SECTIONS, docs, norm
from corpusloom.plans.synthesis import LABELLED, members
from corpusloom.streaming import quota as Q

STATEMENTS = f"""st AS (SELECT key, 'problem' AS field, NULL AS ord, 'problem' AS kind, abstract AS text FROM docs WHERE abstract IS NOT NULL UNION ALL
 SELECT key, CASE kind WHEN 'method' THEN 'methods' WHEN 'results' THEN 'results' ELSE 'limitations' END, sec_no, CASE kind WHEN 'method' THEN 'method' WHEN 'results' THEN 'result' ELSE 'limitation' END, {norm('text')} FROM sec WHERE kind IN ('method', 'results', 'limits')),
units AS (SELECT *, 'e_' || left(sha256(key || '|' || path || '|' || text), 12) AS unit_id FROM (SELECT *, CASE WHEN ord IS NULL THEN field ELSE field || '[' || ord || ']' END AS path FROM st))"""


def units(spark: SparkSession, d: str) -> DataFrame:
    p = docs(spark, d)
    a = p.where("abstract is not null").select("key", F.lit("problem").alias("field"), F.lit(None).cast("int").alias("ord"), F.lit("problem").alias("kind"), F.col("abstract").alias("text"))
    s = X.explode_sections(p).where(F.col("kind").isin("method", "results", "limits"))
    name = lambda *v: F.when(F.col("kind") == "method", v[0]).when(F.col("kind") == "results", v[1]).otherwise(v[2])
    s = s.select("key", name("methods", "results", "limitations").alias("field"), F.col("sec_no").alias("ord"), name("method", "result", "limitation").alias("kind"), T.normalize_text("text").alias("text"))
    return E.registry(a.unionByName(s))


@query(f"WITH {DOCS}, {SECTIONS}, {STATEMENTS} SELECT key, path AS field_path, kind, unit_id FROM units")
def evidence_registry(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).select("key", "field_path", "kind", "unit_id")


@query(f"""WITH {DOCS}, {SECTIONS}, {STATEMENTS} SELECT d.key, CASE WHEN max(CASE WHEN u.kind = 'method' THEN 1 END) = 1 THEN 'observed' ELSE 'unknown' END AS method_state, CASE WHEN max(CASE WHEN u.kind = 'result' THEN 1 END) = 1 THEN 'observed' ELSE 'unknown' END AS result_state,
CASE WHEN max(CASE WHEN u.kind = 'limitation' THEN 1 END) = 1 THEN 'observed' ELSE 'unknown' END AS limitation_state FROM docs d LEFT JOIN units u USING (key) GROUP BY 1""")
def coverage_states(spark: SparkSession, d: str) -> DataFrame:
    return E.coverage(units(spark, d), docs(spark, d), ("method", "result", "limitation"))


@query(f"""WITH {DOCS}, {SECTIONS}, {STATEMENTS} SELECT 'documented_limitation' AS kind, text AS statement, 1::BIGINT AS papers, 0::BIGINT AS unknown FROM units WHERE kind = 'limitation' GROUP BY key, path, text
UNION ALL SELECT 'relationship_not_observed', 'No supported method-dataset evaluation relations were recorded in this extraction snapshot; dataset fields are mentions only.', count(*), count(*) FROM docs""")
def gap_candidates(spark: SparkSession, d: str) -> DataFrame:
    return E.gap_candidates(units(spark, d), docs(spark, d)).drop("refs")


CLAIMS = f"""{LABELLED}, cl AS (SELECT (row_number() OVER (ORDER BY cluster_id))::INT AS claim_no, cluster_id AS cluster, CASE WHEN size IS NULL THEN 'difference' ELSE 'shared' END AS kind, coalesce(label, '') AS text, list_distinct(paper_keys) AS subj FROM c),
refs AS (SELECT DISTINCT cl.claim_no, u.unit_id AS ref, u.key AS owner, u.kind AS unit_kind FROM cl, units u WHERE list_contains(cl.subj, u.key))"""


def claims(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("cluster_id").orderBy("built_at")
    c = table(spark, d, "cluster_assignment").withColumn("r", F.row_number().over(w)).where("r = 1")
    c = c.withColumn("claim_no", F.row_number().over(Window.orderBy("cluster_id")))
    c = c.select("claim_no", F.col("cluster_id").alias("cluster"), F.when(F.col("size").isNull(), "difference").otherwise("shared").alias("kind"), F.coalesce("label", F.lit("")).alias("text"), F.array_distinct("paper_keys").alias("subjects"))
    u = units(spark, d)
    refs = c.select("claim_no", F.explode("subjects").alias("key")).join(u, "key").groupBy("claim_no").agg(F.sort_array(F.collect_set("unit_id")).alias("refs"))
    return c.join(refs, "claim_no", "left")


@query(f"""WITH {DOCS}, {SECTIONS}, {STATEMENTS}, {CLAIMS},
ok AS (SELECT DISTINCT r.claim_no, r.owner FROM refs r JOIN cl USING (claim_no) WHERE (cl.kind = 'shared' AND r.unit_kind IN ('method', 'problem', 'contribution')) OR (cl.kind = 'difference' AND r.unit_kind IN ('method', 'result', 'limitation', 'contribution'))),
s AS (SELECT claim_no, list(owner) AS sup FROM ok GROUP BY 1)
SELECT cl.claim_no, len(subj)::INT AS subjects, coalesce(len(sup), 0)::INT AS supported, CASE WHEN trim(text) <> '' AND len(subj) > 0 AND len(list_filter(subj, lambda x: NOT list_contains(coalesce(sup, []), x))) = 0 AND coalesce(len(sup), 0) >= 2
 AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.claim_no = cl.claim_no AND NOT ((cl.kind = 'shared' AND r.unit_kind IN ('method', 'problem', 'contribution')) OR (cl.kind = 'difference' AND r.unit_kind IN ('method', 'result', 'limitation', 'contribution')))) THEN 'structurally_validated' ELSE 'rejected' END AS status FROM cl LEFT JOIN s USING (claim_no)""")
def claim_validation(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d)
    v = E.validate_claims(c, units(spark, d), members(spark, d))
    allowed = F.when(F.col("kind") == "shared", F.array(*map(F.lit, E.PERMITTED["shared"]))).otherwise(F.array(*map(F.lit, E.PERMITTED["difference"])))
    sup = c.select("claim_no", allowed.alias("ok"), F.explode("refs").alias("unit_id")).join(units(spark, d).select("unit_id", F.col("key").alias("owner"), F.col("kind").alias("uk")), "unit_id").where(F.array_contains("ok", F.col("uk")))
    sup = sup.groupBy("claim_no").agg(F.count_distinct("owner").alias("supported"))
    out = v.join(c.select("claim_no", F.size("subjects").alias("subjects")), "claim_no").join(sup, "claim_no", "left").fillna(0, ["supported"])
    return out.select("claim_no", "subjects", F.col("supported").cast("int").alias("supported"), "status")


@query(f"""WITH {LABELLED} SELECT m.cluster, count(*) AS dangling FROM m LEFT JOIN (SELECT DISTINCT paper_key FROM feature_matrix) f ON f.paper_key = m.key WHERE f.paper_key IS NULL GROUP BY 1""")
def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "feature_matrix").select(F.col("paper_key").alias("key")).distinct()
    return members(spark, d).join(f, "key", "left_anti").groupBy("cluster").agg(F.count("*").alias("dangling"))


@query(f"""WITH {DOCS}, {SECTIONS}, {STATEMENTS}, {CLAIMS} SELECT ref, string_agg(claim_no::VARCHAR, ',' ORDER BY claim_no) AS claims FROM refs GROUP BY 1""")
def backlinks(spark: SparkSession, d: str) -> DataFrame:
    return E.backlinks(claims(spark, d).where("refs is not null"))


@query(f"""WITH {DOCS}, {SECTIONS}, {STATEMENTS}, {LABELLED}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY unit_id) AS r FROM units WHERE kind IN ('method', 'limitation')) WHERE r = 1),
p AS (SELECT key, min(cluster) AS cluster FROM m GROUP BY 1), s AS (SELECT CASE WHEN kind = 'limitation' THEN 'gaps' ELSE coalesce(p.cluster, 'unassigned') END AS section, kind, text, f.key, unit_id AS ref FROM f LEFT JOIN p ON p.key = f.key WHERE trim(text) <> '')
SELECT section, 'w_' || left(sha256(section || '|' || text || '|' || key || '|' || ref), 20) AS claim_id, kind, key, ref FROM s""")
def review_plan(spark: SparkSession, d: str) -> DataFrame:
    m = members(spark, d).groupBy("key").agg(F.min("cluster").alias("cluster"))
    return W.plan_slots(units(spark, d), m).select("section", "claim_id", "kind", "key", "ref")


@query(f"""WITH {DOCS} SELECT (row_number() OVER (ORDER BY key))::INT AS number, key FROM docs""")
def bibliography(spark: SparkSession, d: str) -> DataFrame:
    return W.bibliography(docs(spark, d))


@query()
def review_bundle(spark: SparkSession, d: str) -> DataFrame:
    m = members(spark, d).groupBy("key").agg(F.min("cluster").alias("cluster"))
    return W.render_bundle(W.plan_slots(units(spark, d), m))


@query("""WITH RECURSIVE h AS (SELECT DISTINCT run_id, rank, row_id, coalesce(length(title), 0) + coalesce(length(abstract), 0) + 64 AS size FROM paper_hit),
o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank, row_id, size) AS i FROM h),
w(run_id, i, rank, row_id, size, used, b, batch) AS (SELECT run_id, 0::BIGINT, 0, 0::BIGINT, 0::BIGINT, 0::BIGINT, -1, NULL::INT FROM o WHERE i = 1
 UNION ALL SELECT o.run_id, o.i, o.rank, o.row_id, o.size, CASE WHEN o.size > 1000 THEN w.used WHEN w.b < 0 OR w.used + o.size > 1000 THEN o.size ELSE w.used + o.size END, CASE WHEN o.size > 1000 THEN w.b WHEN w.b < 0 OR w.used + o.size > 1000 THEN w.b + 1 ELSE w.b END,
  CASE WHEN o.size > 1000 THEN NULL WHEN w.b < 0 OR w.used + o.size > 1000 THEN w.b + 1 ELSE w.b END FROM w JOIN o ON o.run_id = w.run_id AND o.i = w.i + 1)
SELECT run_id, rank, row_id, size, batch FROM w WHERE i > 0""")
def pack_batches(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "paper_hit").select("run_id", "rank", "row_id", (F.coalesce(F.length("title"), F.lit(0)) + F.coalesce(F.length("abstract"), F.lit(0)) + 64).cast("long").alias("size")).distinct()
    return W.greedy_batches(h, "run_id", F.struct("rank", "row_id", "size"), "size", 1000).select("run_id", "rank", "row_id", "size", "batch")


QRELS = f"""q AS (SELECT topic_id AS query_id, {sql_key('arxiv_id', 'latest_version')} AS key, max(CASE WHEN rank <= 5 THEN 2 WHEN rank <= 15 THEN 1 ELSE 0 END) AS grade FROM paper_hit GROUP BY 1, 2)"""


@query(f"""WITH {SQL_VECTORS}, {SQL_HITS}, {QRELS}, r AS (SELECT topic_id AS query_id, key, pos FROM hits WHERE q_idx = 0),
j AS (SELECT r.*, q.grade FROM r LEFT JOIN q USING (query_id, key)), rel AS (SELECT query_id, count(*) AS n FROM q WHERE grade > 0 GROUP BY 1),
i AS (SELECT query_id, sum((pow(2.0, grade) - 1) / log2(p + 1)) FILTER (WHERE p <= 10) AS i10, sum((pow(2.0, grade) - 1) / log2(p + 1)) FILTER (WHERE p <= 25) AS i25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, key) AS p FROM q WHERE grade > 0) GROUP BY 1),
g AS (SELECT query_id, min(pos) FILTER (WHERE grade > 0) AS first, count(*) FILTER (WHERE grade > 0 AND pos <= 10) AS h10, count(*) FILTER (WHERE grade > 0 AND pos <= 25) AS h25, count(*) FILTER (WHERE grade IS NOT NULL AND pos <= 10) AS j10, count(*) FILTER (WHERE grade IS NOT NULL AND pos <= 25) AS j25,
 coalesce(sum((pow(2.0, grade) - 1) / log2(pos + 1)) FILTER (WHERE grade > 0 AND pos <= 10), 0) AS d10, coalesce(sum((pow(2.0, grade) - 1) / log2(pos + 1)) FILTER (WHERE grade > 0 AND pos <= 25), 0) AS d25 FROM j GROUP BY 1)
SELECT g.query_id, round(CASE WHEN n > 0 THEN coalesce(1.0 / first, 0) END, 6) AS mrr, round(h10::DOUBLE / n, 6) AS recall_10, round(h10 / 10.0, 6) AS precision_10, CASE WHEN n > 0 THEN (h10 > 0)::INT::DOUBLE END AS hit_10, round(d10 / i10, 6) AS ndcg_10, round(h10::DOUBLE / nullif(j10, 0), 6) AS judged_10,
 round(h25::DOUBLE / n, 6) AS recall_25, round(h25 / 25.0, 6) AS precision_25, CASE WHEN n > 0 THEN (h25 > 0)::INT::DOUBLE END AS hit_25, round(d25 / i25, 6) AS ndcg_25, round(h25::DOUBLE / nullif(j25, 0), 6) AS judged_25 FROM g LEFT JOIN rel USING (query_id) LEFT JOIN i USING (query_id)""")
def ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    from corpusloom.operators import retrieval as R
    from corpusloom.plans.retrieval import corpus

    q = table(spark, d, "topic_query").where("q_idx = 0")
    r = R.search(corpus(spark, d), q, 150).select(F.col("topic_id").alias("query_id"), "key", "pos")
    h = table(spark, d, "paper_hit")
    rel = h.groupBy(F.col("topic_id").alias("query_id"), T.paper_key("arxiv_id", "latest_version").alias("key")).agg(F.max(F.when(F.col("rank") <= 5, 2).when(F.col("rank") <= 15, 1).otherwise(0)).alias("grade"))
    m = M.ranking_metrics(r, rel).join(r.select("query_id").distinct(), "query_id", "left_semi")
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in m.columns if c != "query_id"])


@query(f"""WITH {LABELLED}, a AS (SELECT cluster, list(DISTINCT lower(trim(k))) AS p FROM (SELECT cluster_id AS cluster, unnest(top_keywords) AS k FROM c) WHERE trim(k) <> '' GROUP BY 1), b AS (SELECT cluster_id AS cluster, list_distinct(list_filter(list_transform(string_split(coalesce(label, ''), ';'), lambda x: lower(trim(x))), lambda x: x <> '')) AS g FROM c),
s AS (SELECT cluster, coalesce(p, []) AS p, g, len(list_intersect(coalesce(p, []), g)) AS i FROM b LEFT JOIN a USING (cluster)), t AS (SELECT *, CASE WHEN len(p) = 0 THEN CASE WHEN len(g) = 0 THEN 1.0 ELSE 0.0 END ELSE i::DOUBLE / len(p) END AS pr, CASE WHEN len(g) = 0 THEN 1.0 ELSE i::DOUBLE / len(g) END AS rc FROM s)
SELECT cluster, round(pr, 3) AS precision, round(rc, 3) AS recall, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, 3) AS f1, round(CASE WHEN len(p) + len(g) - i = 0 THEN 1.0 ELSE i::DOUBLE / (len(p) + len(g) - i) END, 3) AS jaccard FROM t""")
def pr_f1(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("cluster_id").orderBy("built_at")
    c = table(spark, d, "cluster_assignment").withColumn("r", F.row_number().over(w)).where("r = 1")
    return M.set_scores(c.select(F.col("cluster_id").alias("cluster"), F.col("top_keywords").alias("predicted"), F.split(F.coalesce("label", F.lit("")), ";").alias("gold")), "cluster")


@query("""WITH t AS (SELECT source AS p, lang AS g, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2), b AS (SELECT sum(n * (n - 1) / 2.0) AS shared, sum(n) AS n FROM t), x AS (SELECT sum(m * (m - 1) / 2.0) AS pred FROM (SELECT sum(n) AS m FROM t GROUP BY p)), y AS (SELECT sum(m * (m - 1) / 2.0) AS gold FROM (SELECT sum(n) AS m FROM t GROUP BY g))
SELECT round(shared::DOUBLE / pred, 3) AS precision, round(shared::DOUBLE / gold, 3) AS recall, round(2 * (shared::DOUBLE / pred) * (shared::DOUBLE / gold) / (shared::DOUBLE / pred + shared::DOUBLE / gold), 3) AS f1, pred::BIGINT AS pred_pairs, gold::BIGINT AS gold_pairs,
 round((shared::DOUBLE - pred::DOUBLE * gold::DOUBLE / (n * (n - 1) / 2.0)::DOUBLE) / ((pred::DOUBLE + gold::DOUBLE) / 2 - pred::DOUBLE * gold::DOUBLE / (n * (n - 1) / 2.0)::DOUBLE), 3) AS ari FROM b, x, y""")
def cluster_agreement(spark: SparkSession, d: str) -> DataFrame:
    return M.cluster_agreement(table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("predicted"), F.col("lang").alias("gold")))


@query("""WITH r AS (SELECT CASE WHEN source_kind IS NULL THEN 'skipped' WHEN source_kind = 'pdf' THEN 'degraded' ELSE 'ok' END AS status, source_kind, len(sections) AS proposed, len(list_filter(sections, lambda s: length(s.text) > 500)) AS kept, length(abstract) AS chars FROM paper_doc)
SELECT count(*) AS papers, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'degraded') AS degraded, count(*) FILTER (WHERE status = 'skipped') AS skipped, round(count(*) FILTER (WHERE source_kind = 'tex')::DOUBLE / count(*), 3) AS tex_rate, round(count(*) FILTER (WHERE source_kind = 'pdf')::DOUBLE / count(*), 3) AS pdf_rate,
 round(sum(kept)::DOUBLE / sum(proposed), 3) AS keep_rate, round(sum(chars)::DOUBLE / count(*), 3) AS mean_chars FROM r""")
def extraction_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paper_doc")
    return M.extraction_metrics(p.select(F.when(F.col("source_kind").isNull(), "skipped").when(F.col("source_kind") == "pdf", "degraded").otherwise("ok").alias("status"), "source_kind", F.size("sections").alias("proposed"), F.size(F.filter("sections", lambda s: F.length(s["text"]) > 500)).alias("kept"), F.length("abstract").alias("chars")))


@query("SELECT category, year, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(trim(matched_categories), '\\s+')) AS category, year FROM paper_meta) WHERE category <> '' GROUP BY ALL")
def corpus_by_category(spark: SparkSession, d: str) -> DataFrame:
    return M.by_category(table(spark, d, "paper_meta"))


@query("""SELECT event_id, count(*) OVER m AS minute_requests, round(coalesce(sum(value) OVER m, 0), 4) AS minute_tokens, count(*) OVER t AS day_requests FROM events
WINDOW m AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), t AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""")
def quota_window(spark: SparkSession, d: str) -> DataFrame:
    u = Q.window_use(table(spark, d, "events"), "event_type", "ts", "value")
    return u.select("event_id", "minute_requests", F.round("minute_tokens", 4).alias("minute_tokens"), "day_requests")


@query()
def quota_admission(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("grp"), "ts", F.col("value").alias("tokens"))
    return Q.admit(e, Q.Quota())


@query("""WITH s AS (SELECT c.cluster_id, len(c.paper_keys) AS size FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY built_at) AS r FROM cluster_assignment) c WHERE r = 1) SELECT round(count(*) FILTER (WHERE size = 1)::DOUBLE / sum(size), 3) AS singleton_rate FROM s""")
def singleton_rate(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("cluster_id").orderBy("built_at")
    c = table(spark, d, "cluster_assignment").withColumn("r", F.row_number().over(w)).where("r = 1")
    return M.singleton_rate(c.select(F.size("paper_keys").alias("size")))


VALID = f"""ok AS (SELECT DISTINCT r.claim_no, r.owner FROM refs r JOIN cl USING (claim_no) WHERE (cl.kind = 'shared' AND r.unit_kind IN ('method', 'problem', 'contribution')) OR (cl.kind = 'difference' AND r.unit_kind IN ('method', 'result', 'limitation', 'contribution'))),
sup AS (SELECT claim_no, list(owner) AS sup FROM ok GROUP BY 1), st2 AS (SELECT cl.claim_no, trim(text) <> '' AND len(subj) > 0 AND len(list_filter(subj, lambda x: NOT list_contains(coalesce(sup, []), x))) = 0 AND coalesce(len(sup), 0) >= 2
 AND NOT EXISTS (SELECT 1 FROM refs r WHERE r.claim_no = cl.claim_no AND NOT ((cl.kind = 'shared' AND r.unit_kind IN ('method', 'problem', 'contribution')) OR (cl.kind = 'difference' AND r.unit_kind IN ('method', 'result', 'limitation', 'contribution')))) AS good FROM cl LEFT JOIN sup USING (claim_no))"""


@query(f"WITH {DOCS}, {SECTIONS}, {STATEMENTS}, {CLAIMS}, {VALID} SELECT count(*) FILTER (WHERE good) AS kept, count(*) AS total, round(count(*) FILTER (WHERE good)::DOUBLE / nullif(count(*), 0), 3) AS rate FROM st2")
def citation_keep_rate(spark: SparkSession, d: str) -> DataFrame:
    return M.citation_keep_rate(E.validate_claims(claims(spark, d), units(spark, d), members(spark, d)))


@query(f"""WITH {DOCS}, {SECTIONS}, {STATEMENTS}, {CLAIMS}, {VALID}, wr AS (SELECT r.claim_no, string_agg(DISTINCT ref || ':' || unit_kind, ';' ORDER BY ref || ':' || unit_kind) AS wrong FROM refs r JOIN cl USING (claim_no)
 WHERE NOT ((cl.kind = 'shared' AND unit_kind IN ('method', 'problem', 'contribution')) OR (cl.kind = 'difference' AND unit_kind IN ('method', 'result', 'limitation', 'contribution'))) GROUP BY 1)
SELECT claim_no, trim(text) = '' AS empty_text, len(subj) = 0 AS no_subjects, len(list_filter(subj, lambda x: NOT list_contains(coalesce(sup, []), x))) > 0 AS unsupported_subjects,
 cl.kind = 'shared' AND coalesce(len(sup), 0) < 2 AS shared_requires_two_subjects, cl.kind = 'difference' AND coalesce(len(sup), 0) < 2 AS difference_requires_both_sides, coalesce(wrong, '') AS wrong_kinds
 FROM cl LEFT JOIN sup USING (claim_no) LEFT JOIN wr USING (claim_no)""")
def claim_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The reasons of every claim, taken apart."""
    v = E.validate_claims(claims(spark, d), units(spark, d), members(spark, d)).withColumn("r", F.coalesce("reason", F.lit("")))
    has = lambda x: F.concat(F.lit("; "), "r").contains(f"; {x}").alias(x)
    wrong = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("r", F.lit(r"wrong_kind:(\w+:\w+)"), 1))), ";").alias("wrong_kinds")
    return v.select("claim_no", *[has(x) for x in ("empty_text", "no_subjects", "unsupported_subjects", "shared_requires_two_subjects", "difference_requires_both_sides")], wrong)


@query(f"""WITH {DOCS}, {SECTIONS}, {STATEMENTS}, f AS (SELECT key, kind, min(unit_id) AS ref FROM units WHERE kind IN ('method', 'limitation') GROUP BY 1, 2), g AS (SELECT f.*, u.text FROM f JOIN units u ON u.unit_id = f.ref AND u.key = f.key WHERE trim(u.text) <> '')
SELECT (SELECT count(DISTINCT key) FROM g) AS papers_supported, (SELECT count(*) FROM docs) AS papers, count(*) FILTER (WHERE kind = 'method') AS claims_written, count(*) AS claims, 0::BIGINT AS omitted, (SELECT count(DISTINCT unit_id) FROM units) - count(DISTINCT ref) AS unselected_units,
 round((SELECT count(DISTINCT key) FROM g)::DOUBLE / (SELECT count(*) FROM docs), 6) AS paper_coverage, round(count(*) FILTER (WHERE kind = 'method')::DOUBLE / count(*), 6) AS prose_coverage FROM g""")
def writing_metrics(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    slots = W.plan_slots(u, members(spark, d).groupBy("key").agg(F.min("cluster").alias("cluster")))
    slots = slots.withColumn("generation", F.when(F.col("kind") == "method", "llm").otherwise("template")).withColumn("omitted", F.lit(None).cast("string"))
    return M.writing_metrics(slots, docs(spark, d), u)


@query(f"""WITH {DOCS}, {SECTIONS}, {STATEMENTS}, {LABELLED} SELECT 'invalid_cluster_size' AS rule, count(*) AS broken FROM (SELECT c.cluster_id, c.size, count(m.key) AS held FROM c LEFT JOIN m ON m.cluster = c.cluster_id GROUP BY 1, 2) WHERE size IS NULL OR size <> held
UNION ALL SELECT 'unknown_cluster_paper', count(*) FROM (SELECT DISTINCT key FROM m) WHERE key NOT IN (SELECT key FROM docs) UNION ALL SELECT 'duplicate_membership', count(*) FROM (SELECT key FROM m GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_cluster_id', count(*) FROM (SELECT cluster_id FROM c GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'missing_membership_disposition', count(*) FROM docs WHERE key NOT IN (SELECT key FROM m WHERE key IS NOT NULL)
UNION ALL SELECT 'invalid_evidence_owner_or_text', count(*) FROM units WHERE trim(text) = ''""")
def snapshot_rules(spark: SparkSession, d: str) -> DataFrame:
    p, u, m = docs(spark, d), units(spark, d), members(spark, d)
    w = Window.partitionBy("cluster_id").orderBy("built_at")
    c = table(spark, d, "cluster_assignment").withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("cluster_id").alias("cluster"), "size")
    papers = p.select("key", T.id_core("arxiv_id").alias("core"), "version")
    found = E.violations(papers, u, m, p.select("key").limit(0), u.select(F.col("unit_id").alias("ref")), clusters=c)
    return found.where(F.col("rule").isin("invalid_cluster_size", "unknown_cluster_paper", "duplicate_membership", "duplicate_cluster_id", "missing_membership_disposition", "invalid_evidence_owner_or_text")).select("rule", "broken")
