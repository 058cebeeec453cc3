"""Quality figures of rankings, extractions and clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranking_metrics(ranking: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (10, 25), group: str = "query_id") -> DataFrame:
    """(group, mrr, recall@k, precision@k, hit@k, ndcg@k, judged@k as recall_k and so on) of rankings (group, pos, key) against graded judgments
    (group, key, grade).

    Relevant means a grade above 0; gain is 2^grade - 1 over log2(pos + 1). A group without relevant keys has null recall, hit, nDCG and MRR;
    one without judged results has null judged precision.
    """
    r = ranking.groupBy(group, "key").agg(F.min("pos").alias("pos")).join(qrels.select(group, "key", "grade").dropDuplicates([group, "key"]), [group, "key"], "left")
    rel = F.coalesce(F.col("grade") > 0, F.lit(False))
    gain = lambda g, p: (F.pow(F.lit(2.0), g) - 1) / F.log2(p + 1)
    ideal = qrels.dropDuplicates([group, "key"]).where("grade > 0").withColumn("p", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("grade"), "key")))
    best = ideal.groupBy(group).agg(F.count("*").alias("relevant"), *[F.sum(F.when(F.col("p") <= k, gain(F.col("grade"), F.col("p")))).alias(f"ideal_{k}") for k in ks])
    aggs = [F.min(F.when(rel, F.col("pos"))).alias("first")]
    for k in ks:
        top = F.col("pos") <= k
        aggs += [F.count_if(rel & top).alias(f"hits_{k}"), F.count_if(top & F.col("grade").isNotNull()).alias(f"judged_n_{k}"), F.coalesce(F.sum(F.when(top & rel, gain(F.col("grade"), F.col("pos")))), F.lit(0.0)).alias(f"dcg_{k}")]
    got = r.groupBy(group).agg(*aggs)
    out = ranking.select(group).union(qrels.select(group)).distinct().join(got, group, "left").join(best, group, "left")
    cols = [F.when(F.col("relevant") > 0, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr")]
    for k in ks:
        hits = F.coalesce(F.col(f"hits_{k}"), F.lit(0))
        cols += [
            (hits / F.col("relevant")).alias(f"recall_{k}"), (hits / F.lit(k)).alias(f"precision_{k}"), F.when(F.col("relevant") > 0, (hits > 0).cast("double")).alias(f"hit_{k}"),
            (F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / F.col(f"ideal_{k}")).alias(f"ndcg_{k}"), F.try_divide(F.col(f"hits_{k}"), F.col(f"judged_n_{k}")).alias(f"judged_{k}"),
        ]
    return out.select(group, *cols)


def macro_mean(metrics: DataFrame, group: str = "query_id") -> DataFrame:
    """Means over groups; nulls don't count."""
    return metrics.agg(*[F.avg(c).alias(c) for c in metrics.columns if c != group])


def leak_at(ranking: DataFrame, forbidden: DataFrame, k: int, group: str = "query_id") -> DataFrame:
    """(group, leak): share of the first k results that belong to a hard pair's other side, forbidden (group, key)."""
    top = ranking.where(F.col("pos") <= k)
    bad = top.join(forbidden.select(group, "key").distinct(), [group, "key"], "left_semi").groupBy(group).agg(F.count("*").alias("bad"))
    return top.groupBy(group).agg(F.count("*").alias("n")).join(bad, group, "left").select(group, (F.coalesce("bad", F.lit(0)) / F.col("n")).alias("leak"))


def set_scores(sets: DataFrame, group: str = "key") -> DataFrame:
    """(group, precision, recall, f1, jaccard) of arrays predicted and gold, compared trimmed and in small letters.

    Nothing predicted: precision 1 if nothing was to be found, else 0. Nothing to find: recall 1. Both empty: Jaccard 1. Three digits.
    """
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    s = sets.select(group, clean("predicted").alias("p"), clean("gold").alias("g"))
    both = F.size(F.array_intersect("p", "g"))
    s = s.withColumn("pr", F.when(F.size("p") == 0, F.when(F.size("g") == 0, 1.0).otherwise(0.0)).otherwise(both / F.size("p")))
    s = s.withColumn("rc", F.when(F.size("g") == 0, 1.0).otherwise(both / F.size("g")))
    f1 = F.when(F.col("pr") + F.col("rc") == 0, 0.0).otherwise(2 * F.col("pr") * F.col("rc") / (F.col("pr") + F.col("rc")))
    jac = F.when(F.size(F.array_union("p", "g")) == 0, 1.0).otherwise(both / F.size(F.array_union("p", "g")))
    return s.select(group, F.round("pr", 3).alias("precision"), F.round("rc", 3).alias("recall"), F.round(f1, 3).alias("f1"), F.round(jac, 3).alias("jaccard"))


def cluster_agreement(labels: DataFrame) -> DataFrame:
    """One row of pairwise precision, recall and f1, the numbers of pairs, and the adjusted Rand index of labels (key, predicted, gold).

    From the contingency table, so no pairs are made. Keys with a null on either side don't count; the index is null below two keys.
    """
    t = labels.where("predicted is not null and gold is not null").groupBy("predicted", "gold").agg(F.count("*").alias("n"))
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = t.agg(two("n").alias("both"), F.sum("n").alias("all"))
    a = t.groupBy("predicted").agg(F.sum("n").alias("m")).agg(two("m").alias("pred"))
    b = t.groupBy("gold").agg(F.sum("n").alias("m")).agg(two("m").alias("gold"))
    r = both.crossJoin(a).crossJoin(b).fillna(0.0)
    p = F.when(F.col("pred") == 0, F.when(F.col("gold") == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide("both", "pred"))
    q = F.when(F.col("gold") == 0, 1.0).otherwise(F.try_divide("both", "gold"))
    f1 = F.when(p + q == 0, 0.0).otherwise(2 * p * q / (p + q))
    pairs = F.col("all") * (F.col("all") - 1) / 2
    chance = F.try_divide(F.col("pred") * F.col("gold"), pairs)
    top = (F.col("pred") + F.col("gold")) / 2 - chance
    ari = F.when(F.col("all") >= 2, F.when(top == 0, 1.0).otherwise((F.col("both") - chance) / top))
    return r.select(F.round(p, 3).alias("precision"), F.round(q, 3).alias("recall"), F.round(f1, 3).alias("f1"), F.col("pred").cast("long").alias("pred_pairs"), F.col("gold").cast("long").alias("gold_pairs"), F.round(ari, 3).alias("ari"))


def extraction_metrics(records: DataFrame) -> DataFrame:
    """One row over records (status, source_kind, proposed, kept, chars): counts by status, share of sources, keep rate, mean size; 0 for empty denominators."""
    n = F.count("*")
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 3)
    return records.agg(
        n.alias("papers"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "degraded", "skipped")], *[rate(F.count_if(F.col("source_kind") == s), n).alias(f"{s}_rate") for s in ("tex", "pdf")],
        rate(F.coalesce(F.sum("kept"), F.lit(0)), F.coalesce(F.sum("proposed"), F.lit(0))).alias("keep_rate"), rate(F.coalesce(F.sum("chars"), F.lit(0)), n).alias("mean_chars"),
    )


def by_category(papers: DataFrame) -> DataFrame:
    """(category, year, n): papers by each of their categories and year."""
    return papers.select(F.explode(F.split(F.trim("matched_categories"), r"\s+")).alias("category"), "year").where("category != ''").groupBy("category", "year").agg(F.count("*").alias("n"))


def singleton_rate(sizes: DataFrame) -> DataFrame:
    """One row: the share of single-member clusters in the members of all clusters (size), 0 without any."""
    return sizes.agg(F.round(F.coalesce(F.try_divide(F.count_if(F.col("size") == 1), F.sum("size")), F.lit(0.0)), 3).alias("singleton_rate"))


def rate(kept, total):
    """kept / total in three digits, null for an empty total."""
    return F.round(F.try_divide(kept, total), 3)


def citation_keep_rate(claims: DataFrame) -> DataFrame:
    """One row over claims (status): kept (structurally validated), total and rate, null without claims."""
    kept = F.count_if(F.col("status") == "structurally_validated")
    return claims.agg(kept.alias("kept"), F.count("*").alias("total"), rate(kept, F.count("*")).alias("rate"))


def completeness(records: DataFrame) -> DataFrame:
    """One row: the share of records (status, method, results ARRAY) that are ok and have a method and a result; 0 without records."""
    whole = (F.col("status") == "ok") & (F.coalesce("method", F.lit("")) != "") & (F.size(F.coalesce("results", F.array().cast("array<string>"))) > 0)
    return records.agg(F.coalesce(rate(F.count_if(whole), F.count("*")), F.lit(0.0)).alias("completeness"))


def support_shares(labels: DataFrame) -> DataFrame:
    """One row over labels (label): the shares of supported, partially_supported and unsupported, and n; 0 without labels."""
    share = lambda x: F.coalesce(rate(F.count_if(F.col("label") == x), F.count("*")), F.lit(0.0)).alias(x)
    return labels.agg(share("supported"), share("partially_supported"), share("unsupported"), F.count("*").alias("n"))


def writing_metrics(claims: DataFrame, papers: DataFrame, units: DataFrame) -> DataFrame:
    """One row over written claims (key, ref, generation, omitted), papers (key) and units (unit_id): papers with a claim and all, claims written by a model
    and all, both rates (null for nothing), units that no claim uses, and claims omitted for the budget."""
    held = papers.select("key").distinct().join(claims.select("key").distinct().withColumn("hit", F.lit(1)), "key", "left").agg(F.count("hit").alias("papers_supported"), F.count("*").alias("papers"))
    prose = claims.agg(F.count_if(F.col("generation") == "llm").alias("claims_written"), F.count("*").alias("claims"), F.count("omitted").alias("omitted"))
    free = units.select("unit_id").distinct().join(claims.select(F.col("ref").alias("unit_id")).distinct(), "unit_id", "left_anti").agg(F.count("*").alias("unselected_units"))
    r = held.crossJoin(prose).crossJoin(free)  # one row each
    return r.select("*", F.round(F.try_divide("papers_supported", "papers"), 6).alias("paper_coverage"), F.round(F.try_divide("claims_written", "claims"), 6).alias("prose_coverage"))
