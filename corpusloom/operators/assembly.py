"""Putting records together: model answers to papers, extraction without a model, narrations to clusters, run diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.evidence import validate_claims

# Method names that are harvested from method statements.
METHOD_TOKENS = r"(?i)\b(?:EL2N|GraNd|CCS|InfoBatch|coreset|RRS)\b"


def match_records(papers: DataFrame, records: DataFrame) -> DataFrame:
    """(batch, pos, rec_pos): which record of a model's answer belongs to which paper of the batch.

    papers (batch, pos, arxiv_id), records (batch, rec_pos, arxiv_id). By id (the last record of an id counts), else the unmatched papers take the batch's
    records in order from the first, including ones that an id has claimed. A batch with as many records as papers and no ids goes by position. Papers
    that nothing is left for have no row.
    """
    r = records.withColumn("id", F.nullif(T.id_core(F.coalesce("arxiv_id", F.lit(""))), F.lit("")))
    size = r.groupBy("batch").agg(F.count("*").alias("n"), F.count("id").alias("ids")).join(papers.groupBy("batch").agg(F.count("*").alias("m")), "batch")
    plain = size.where("ids = 0 and n = m").select("batch")
    place = lambda df, c: df.withColumn("nth", F.row_number().over(Window.partitionBy("batch").orderBy(c)))
    by_place = place(papers.join(plain, "batch", "left_semi"), "pos").select("batch", "pos", "nth").join(place(r.join(plain, "batch", "left_semi"), "rec_pos").select("batch", "rec_pos", "nth"), ["batch", "nth"])
    rest = papers.join(plain, "batch", "left_anti").withColumn("id", T.id_core("arxiv_id"))
    last = r.where("id is not null").groupBy("batch", "id").agg(F.max("rec_pos").alias("rec_pos"))
    known = rest.join(last, ["batch", "id"], "left")
    open_ = place(known.where("rec_pos is null").drop("rec_pos"), "pos").select("batch", "pos", "nth").join(place(r, "rec_pos").select("batch", "rec_pos", "nth"), ["batch", "nth"])
    cols = ["batch", "pos", "rec_pos"]
    return by_place.select(cols).unionByName(known.where("rec_pos is not null").select(cols)).unionByName(open_.select(cols))


def local_papers(snippets: DataFrame, confidence: DataFrame, source: DataFrame, least: float = 0.92) -> DataFrame:
    """(key, status, method, problem, confidence) of papers that need no model: confidence of least or more and a method snippet; the first snippet
    of each kind is the statement. Papers of which only the abstract was read are degraded."""
    w = Window.partitionBy("key", "kind").orderBy(F.length("id"), "id")
    first = snippets.where("kind in ('method', 'problem')").withColumn("r", F.row_number().over(w)).where("r = 1")
    both = first.groupBy("key").agg(F.max(F.when(F.col("kind") == "method", F.col("sentence"))).alias("method"), F.max(F.when(F.col("kind") == "problem", F.col("sentence"))).alias("problem"))
    rows = both.where("method is not null").join(confidence.where(F.col("confidence") >= least), "key").join(source.select("key", "source_kind"), "key")
    return rows.select("key", F.when(F.col("source_kind") == "abstract", "degraded").otherwise("ok").alias("status"), "method", "problem", "confidence")


def harvest_keywords(snippets: DataFrame, pattern: str = METHOD_TOKENS) -> DataFrame:
    """(key, keyword): what pattern finds in a paper's method snippets, once whatever its case, as first written."""
    t = snippets.where("kind = 'method'").select("key", F.length("id").alias("n"), "id", F.posexplode(F.regexp_extract_all("sentence", F.lit(pattern), 0)).alias("at", "keyword"))
    w = Window.partitionBy("key", F.lower("keyword")).orderBy("n", "id", "at")
    return t.withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "keyword")


def apply_narration(claims: DataFrame, units: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The validated claims of a narration, and its errors (cluster, error): unknown_cluster_id, the reasons of rejected claims, empty_cluster_summary
    and missing_cluster_summaries."""
    known = members.select("cluster").distinct()
    checked = validate_claims(claims.join(known, "cluster", "left_semi"), units, members)
    good = checked.where("status = 'structurally_validated'")
    err = lambda df, e: df.select("cluster", (F.lit(e) if isinstance(e, str) else e).alias("error")).distinct()
    errors = err(claims.join(known, "cluster", "left_anti"), "unknown_cluster_id").unionByName(err(checked.where("reason is not null"), F.col("reason")))
    errors = errors.unionByName(err(checked.select("cluster").distinct().join(good.select("cluster"), "cluster", "left_anti"), "empty_cluster_summary"))
    return good, errors.unionByName(err(known.join(claims.select("cluster"), "cluster", "left_anti"), "missing_cluster_summaries"))


def judged_coverage(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, judged, present, relevant_present): how many judged papers of each query the corpus holds."""
    c = corpus.select("key").distinct().withColumn("here", F.lit(1))
    j = qrels.select("query_id", "key", "grade").distinct().join(c, "key", "left")
    return j.groupBy("query_id").agg(F.count("*").alias("judged"), F.count("here").alias("present"), F.count_if((F.col("grade") > 0) & F.col("here").isNotNull()).alias("relevant_present"))


def run_diagnostics(inventory: DataFrame) -> DataFrame:
    """(disposition, n, share) of an inventory."""
    n = inventory.groupBy("disposition").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def new_batches(batches: DataFrame, done: DataFrame) -> DataFrame:
    """batches (run_id, batch_id, ...) that done (run_id, batch_id) lacks: what a resumed run still has to do, each once."""
    return batches.dropDuplicates(["run_id", "batch_id"]).join(done.select("run_id", "batch_id").distinct(), ["run_id", "batch_id"], "left_anti")
