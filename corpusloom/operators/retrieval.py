"""Vector search, rank fusion and filtered, reranked retrieval over many topics at once.

Every tie has a key: best score, then the query that found it, then its position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.staging import materialize

#: Most query vectors that one search takes; they are sent to every task (with 768 floats each, 200 MB at the bound).
MOST_QUERIES = 65_536


def clean_vectors(df: DataFrame, key: str = "paper_key", vector: str = "matrix") -> DataFrame:
    """(key, vec ARRAY<FLOAT>): one row per key, without null, empty, all-zero or not finite vectors."""
    v = F.col("vec")
    fine = v.isNotNull() & (F.size(v) > 0) & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("vec")).where("key is not null")
    return rows.where(fine).groupBy("key").agg(F.min("vec").alias("vec"))


def search(corpus: DataFrame, queries: DataFrame, k: int, query_keys: tuple[str, ...] = ("topic_id", "q_idx"), digits: int = 9) -> DataFrame:
    """Exact top k by cosine of every query: the query's keys, key, score, pos (1 is best); at equal score the smaller key first.

    corpus is (key, vec), queries has query_keys and embedding. Scores are rounded to `digits`. A task multiplies its block by all queries and
    keeps k per query, so what is shuffled doesn't depend on the corpus. At most MOST_QUERIES queries.
    """
    found = queries.where("embedding is not null").select(*query_keys, "embedding").limit(MOST_QUERIES + 1).toArrow()
    if found.num_rows > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries; search in parts")
    fields = ", ".join(f"{q} {queries.schema[q].dataType.simpleString()}" for q in query_keys)
    spark = corpus.sparkSession
    if not found.num_rows:
        return spark.createDataFrame([], f"{fields}, key string, score double, pos int")
    q = np.stack([np.asarray(v, float) for v in found.column("embedding").to_pylist()])
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    names = [found.column(c).combine_chunks() for c in query_keys]
    sent = spark.sparkContext.broadcast((q, names))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, names = sent.value
        top_s, top_k = np.full((len(q), 0), -np.inf), np.full((len(q), 0), None, object)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            s = np.concatenate([top_s, np.round(q @ x.T, digits)], 1)
            keys = np.concatenate([top_k, np.broadcast_to(b.column("key").to_numpy(zero_copy_only=False).astype(object), (len(q), b.num_rows))], 1)
            if s.shape[1] > k:
                # the k best and all ties of the k-th, then the smaller keys among them
                edge = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                rows = []
                for i in range(len(q)):
                    at = np.flatnonzero(s[i] >= edge[i])
                    rows.append(at[np.lexsort((keys[i, at].astype(str), -s[i, at]))[:k]])
                pick = np.stack(rows)
                s, keys = np.take_along_axis(s, pick, 1), np.take_along_axis(keys, pick, 1)
            top_s, top_k = s, keys
        i, j = np.nonzero(np.isfinite(top_s))
        if len(i):
            yield pa.RecordBatch.from_arrays([*(n.take(pa.array(i)) for n in names), pa.array(top_k[i, j], pa.string()), pa.array(top_s[i, j])], [*query_keys, "key", "score"])

    hits = corpus.select("key", "vec").mapInArrow(best, f"{fields}, key string, score double")
    w = Window.partitionBy(*query_keys).orderBy(F.desc("score"), "key")
    return hits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def search_sql(corpus: DataFrame, queries: DataFrame, k: int, query_keys: tuple[str, ...] = ("topic_id", "q_idx")) -> DataFrame:
    """The same by plain expressions: every query against every vector, for small corpora and as a check."""
    from corpusloom.functions.text import dot

    pairs = corpus.crossJoin(F.broadcast(queries.where("embedding is not null")))
    score = F.round(dot("vec", "embedding") / F.sqrt(dot("vec", "vec")) / F.sqrt(dot("embedding", "embedding")), 9)
    w = Window.partitionBy(*query_keys).orderBy(F.desc("score"), "key")
    return pairs.select(*query_keys, "key", score.alias("score")).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def union_hits(hits: DataFrame, group: str = "topic_id") -> DataFrame:
    """One row per group and key: best score, the first query and position that found it, and all queries that did, in order."""
    return hits.groupBy(group, "key").agg(
        F.max("score").alias("best_score"), F.min(F.struct("q_idx", "pos")).alias("seen"), F.array_join(F.transform(F.sort_array(F.collect_set("q_idx")), lambda x: x.cast("string")), ",").alias("found_by")
    )


def fuse_ranks(rankings: DataFrame, k: int = 60, group: str = "topic_id") -> DataFrame:
    """Reciprocal rank fusion of (group, ranking, key, pos): sum over rankings of 1 / (k + first position)."""
    first = rankings.groupBy(group, "ranking", "key").agg(F.min("pos").alias("pos"))
    return first.groupBy(group, "key").agg(F.sum(1.0 / (k + F.col("pos"))).alias("rrf_score"))


def passes(year_from: int | None = None, year_to: int | None = None, categories: list[str] | None = None, year: str = "year", cats: str = "matched_categories"):
    """Condition on year and category; a null year fails as soon as a bound is set, any common category suffices."""
    ok = F.lit(True)
    if year_from is not None:
        ok &= F.coalesce(F.col(year) >= year_from, F.lit(False))
    if year_to is not None:
        ok &= F.coalesce(F.col(year) <= year_to, F.lit(False))
    if categories:
        own = F.split(F.trim(F.coalesce(F.col(cats), F.lit(""))), r"\s+")
        ok &= F.arrays_overlap(own, F.array(*[F.lit(c) for c in categories]))
    return ok


def require_all(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """ids joined with table, in the order of their `pos`; an error if an id is missing."""
    missing = ids.join(table.select(key), key, "left_anti").count()
    if missing:
        raise LookupError(f"{missing} of the requested {key} are not in the table")
    return ids.join(table, key).orderBy("pos")


def retrieve(corpus: DataFrame, queries: DataFrame, metadata: DataFrame, keyword_ranking: DataFrame, citations: DataFrame | None = None, *, broad_k: int = 150, pool_size: int = 200, keyword_n: int = 50, top_k: int = 25, rrf_k: int = 60, rerank: bool = True, condition=None) -> DataFrame:
    """Hybrid retrieval of every topic: (topic_id, rank, key, broad_score, rerank_score, rrf_score, fused, keyword_rank, found_by).

    corpus (key, vec); queries (topic_id, q_idx, embedding), q_idx 0 being the topic; metadata has key and what condition needs, one row per
    key; keyword_ranking (topic_id, pos, key) may name unknown keys; citations (key, n) may miss keys. Filters come after the search and
    never refill. rrf_score is null where a topic has one ranking only; keyword-only hits have broad score 0.
    """
    broad = union_hits(search(corpus, queries, broad_k))
    kept = broad.join(metadata.where(condition if condition is not None else F.lit(True)).select("key"), "key", "left_semi")
    w = Window.partitionBy("topic_id").orderBy(F.desc("best_score"), "seen.q_idx", "seen.pos", "key")
    pool = kept.withColumn("pool_pos", F.row_number().over(w)).where(F.col("pool_pos") <= pool_size)
    words = keyword_ranking.where(F.col("pos") <= keyword_n).groupBy("topic_id", "key").agg(F.min("pos").alias("keyword_rank"))
    words = words.join(metadata.where(condition if condition is not None else F.lit(True)).select("key"), "key", "left_semi").join(corpus.select("key"), "key", "left_semi")
    w = Window.partitionBy("topic_id").orderBy("keyword_rank", "key")
    new = words.join(pool, ["topic_id", "key"], "left_anti").withColumn("pool_pos", F.row_number().over(w) + 1_000_000)
    pool = pool.select("topic_id", "key", "best_score", "found_by", "pool_pos").unionByName(new.select("topic_id", "key", F.lit(0.0).alias("best_score"), F.lit("").alias("found_by"), "pool_pos"))
    w = Window.partitionBy("topic_id").orderBy("pool_pos")
    pool = pool.withColumn("pool_pos", F.row_number().over(w)).where(F.col("pool_pos") <= pool_size + keyword_n)

    topic = queries.where("q_idx = 0").select("topic_id", F.col("embedding").alias("topic_vec"))
    scored = pool.join(corpus, "key").join(F.broadcast(topic), "topic_id")
    if rerank:
        scored = scored.withColumn("rerank_score", cosine_udf()("vec", "topic_vec"))
    else:
        scored = scored.withColumn("rerank_score", F.col("best_score"))
    scored = scored.drop("vec", "topic_vec").join(words, ["topic_id", "key"], "left")
    w = Window.partitionBy("topic_id").orderBy(F.desc("rerank_score"), "pool_pos")
    scored = scored.withColumn("rerank_pos", F.row_number().over(w))
    scored = materialize(scored, "pool")  # at most pool_size + keyword_n rows a topic, read four times
    ranks = scored.select("topic_id", F.lit("vector").alias("ranking"), "key", F.col("rerank_pos").alias("pos"))
    ranks = ranks.unionByName(scored.where("keyword_rank is not null").select("topic_id", F.lit("keyword").alias("ranking"), "key", F.col("keyword_rank").alias("pos")))
    if citations is not None:
        w = Window.partitionBy("topic_id").orderBy(F.desc("n"), "rerank_pos")
        cited = scored.join(citations, "key").withColumn("pos", F.row_number().over(w))
        ranks = ranks.unionByName(cited.select("topic_id", F.lit("citations").alias("ranking"), "key", "pos"))
    several = ranks.groupBy("topic_id").agg(F.count_distinct("ranking").alias("r")).where("r > 1").select("topic_id")
    rrf = fuse_ranks(ranks, rrf_k).join(several, "topic_id", "left_semi").withColumn("rrf_score", F.round("rrf_score", 12))
    fused = scored.join(rrf, ["topic_id", "key"], "left").withColumn("fused", F.round(F.col("rerank_score") + F.coalesce("rrf_score", F.lit(0.0)), 9))
    w = Window.partitionBy("topic_id").orderBy(F.desc("fused"), F.desc("rerank_score"), "pool_pos")
    out = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    return out.select("topic_id", "rank", "key", F.col("best_score").alias("broad_score"), "rerank_score", "rrf_score", "fused", "keyword_rank", "found_by")


def cosine_udf(digits: int = 9):
    """Cosine of two vector columns, rounded, batch by batch."""
    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = np.stack(a.to_numpy()).astype(float), np.stack(b.to_numpy()).astype(float)
        s = (x * y).sum(1) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), 1e-12)
        return pd.Series(np.round(s, digits))

    return cosine


def top_overlap(a: DataFrame, b: DataFrame, group: str = "topic_id") -> DataFrame:
    """(group, overlap): share of b's keys that a holds too; 0 where b has none."""
    n = b.groupBy(group).agg(F.count_distinct("key").alias("n"))
    both = b.select(group, "key").distinct().join(a.select(group, "key").distinct(), [group, "key"]).groupBy(group).agg(F.count("*").alias("both"))
    everyone = a.select(group).union(b.select(group)).distinct()
    return everyone.join(n, group, "left").join(both, group, "left").select(group, F.round(F.coalesce(F.try_divide(F.coalesce("both", F.lit(0)), F.col("n")), F.lit(0.0)), 4).alias("overlap"))
