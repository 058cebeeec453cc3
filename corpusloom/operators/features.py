"""Two-channel TF-IDF, similarity over shared terms, and agglomerative clustering of small collections."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.sources.staging import materialize


def words(x) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\b\w+\b"), 0)


def terms(docs: DataFrame, text: str = "text", bigrams: bool = True) -> DataFrame:
    """(key, term, tf LONG): the words, and pairs of neighbouring words, of every document. Null texts have none."""
    t = docs.select("key", words(text).alias("w")).where("w is not null and size(w) > 0")
    one = F.col("w")
    if bigrams:
        one = F.concat("w", F.expr("transform(sequence(1, greatest(size(w) - 1, 1)), i -> if(size(w) > 1, concat(w[i - 1], ' ', w[i]), cast(null as string)))"))
    return t.select("key", F.explode(one).alias("term")).where("term is not null").groupBy("key", "term").agg(F.count("*").alias("tf"))


def tfidf(counts: DataFrame, max_features: int | None = None) -> DataFrame:
    """(key, term, weight) of term counts: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), rows of length 1.

    n counts the documents with any term. With max_features only the terms with the highest total tf stay (smaller term at a tie).
    """
    n = counts.select("key").distinct().agg(F.count("*").alias("n"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    if max_features is not None:
        df = df.orderBy(F.desc("total"), "term").limit(max_features)
    w = counts.join(df, "term").crossJoin(F.broadcast(n)).withColumn("weight", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = w.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("len"))
    return w.join(length, "key").select("key", "term", (F.col("weight") / F.col("len")).alias("weight"))


def two_channels(text: DataFrame, keywords: DataFrame, weight: float = 0.5) -> DataFrame:
    """(key, channel, term, weight): both channels scaled by sqrt(1 - weight) and sqrt(weight), rows of length 1 again."""
    both = text.select("key", F.lit("text").alias("channel"), "term", (F.col("weight") * (1 - weight) ** 0.5).alias("weight"))
    both = both.unionByName(keywords.select("key", F.lit("keywords").alias("channel"), "term", (F.col("weight") * weight**0.5).alias("weight")))
    length = both.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("len")).where("len > 1e-12")
    return both.join(length, "key").select("key", "channel", "term", (F.col("weight") / F.col("len")).alias("weight"))


def similar_pairs(features: DataFrame, least: float, by: tuple[str, ...] = ("channel", "term"), block: int = 8000) -> DataFrame:
    """(a, b, similarity) for a < b with similarity of least (above 0) or more, exact.

    Rows are cut into blocks of at most about `block`, and two blocks meet in one task (see _block_pairs). Terms that one row alone holds are left out, and a term that
    more than a twentieth of all rows hold is a common one, of which there are at most 20 times as many as a row has terms.
    """
    f = materialize(features.where("key is not null").groupBy("key", *by).agg(F.sum("weight").alias("weight")).where("weight is not null"), "features")  # read three times
    n = f.agg(F.count_distinct("key")).first()[0]
    df = f.groupBy(*by).agg(F.count("*").alias("df")).where("df > 1").withColumn("id", F.monotonically_increasing_id())
    df = materialize(df.select(*by, F.when(F.col("df") > max(20, n / 20), -1 - F.col("id")).otherwise(F.col("id")).alias("id")), "terms")  # numbers must not change; common ones are negative
    blocks = max(1, math.ceil(n / min(block, max(1000, n // 12))))
    rows = f.join(df, list(by)).groupBy("key").agg(F.collect_list(F.struct("id", "weight")).alias("terms")).withColumn("own", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "terms")
    kind = f.schema["key"].dataType
    spark = f.sparkSession
    met = met.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "i", "j")  # a fixed number, which AQE leaves as it is
    found = met.groupBy("i", "j").applyInArrow(lambda t: _block_pairs(t, least), f"x {kind.simpleString()}, y {kind.simpleString()}, similarity double")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def _block_pairs(t: pa.Table, least: float, cells: int = 4_000_000) -> pa.Table:
    """(x, y, similarity) of the pairs between two blocks (or within one) that reach least.

    Sums over the terms that are not common come from an inverted index, for a strip of rows at a time. What common terms can add is at most the product of
    the lengths of both rows' common parts; their product proper is only computed for pairs that can still reach least.
    """
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    sides = [t.filter(pc.equal(t.column("own"), k)) for k in (i, j)]
    cut = []
    for side in sides:
        lists = side.column("terms").combine_chunks()
        flat = lists.flatten()
        ids, w = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "weight"))
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        common = ids < 0
        cut.append((ids[~common], row[~common], w[~common], ids[common], row[common], w[common]))
    na, nb = (side.num_rows for side in sides)
    names = np.intersect1d(cut[0][3], cut[1][3])
    dense = []
    for size, (*_, ids, row, w) in zip((na, nb), cut, strict=True):
        d = np.zeros((size, len(names)))
        if len(names):
            at = np.minimum(np.searchsorted(names, ids), len(names) - 1)
            held = names[at] == ids
            d[row[held], at[held]] = w[held]
        dense.append(d)
    length = [np.sqrt((d * d).sum(1)) for d in dense]
    order = np.argsort(cut[1][0], kind="stable")
    index, place, weight = (x[order] for x in cut[1][:3])
    by_row = np.argsort(cut[0][1], kind="stable")
    ids, row, w = (x[by_row] for x in cut[0][:3])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, cells // max(1, nb))
    for start in range(0, na if nb else 0, step):
        end = min(na, start + step)
        lo, hi = np.searchsorted(row, [start, end])
        first = np.searchsorted(index, ids[lo:hi])
        times = np.searchsorted(index, ids[lo:hi], "right") - first
        s = np.zeros((end - start) * nb)
        upto = np.cumsum(times)
        pieces = [0, *(np.flatnonzero(np.diff(upto // cells)) + 1).tolist(), len(times)]  # bounds what is laid out at once
        for p, q in zip(pieces, pieces[1:], strict=False):
            k = times[p:q]
            total = int(k.sum())
            if total:
                at = np.arange(total) + np.repeat(first[p:q] - (np.cumsum(k) - k), k)
                s += np.bincount(np.repeat(row[lo:hi][p:q] - start, k) * nb + place[at], np.repeat(w[lo:hi][p:q], k) * weight[at], len(s))
        s = s.reshape(end - start, nb)
        x, y = np.nonzero(s + length[0][start:end, None] * length[1] >= least - 1e-9)
        if 50 * len(x) > s.size:
            s += dense[0][start:end] @ dense[1].T
            v = s[x, y]
        else:
            v = s[x, y]
            for p in range(0, len(x), 4096):
                v[p : p + 4096] += np.einsum("ij,ij->i", dense[0][start + x[p : p + 4096]], dense[1][y[p : p + 4096]])
        x = x + start
        keep = (v >= least) & ((x < y) if i == j else True)
        out.append((x[keep], y[keep], v[keep]))
    x, y, v = (np.concatenate(c) if out else np.zeros(0, int) for c in (zip(*out, strict=True) if out else ([], [], [])))
    return pa.Table.from_arrays([sides[0].column("key").take(pa.array(x)), sides[1].column("key").take(pa.array(y)), pa.array(v, pa.float64())], ["x", "y", "similarity"])


def fold_text(x: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", x or "").casefold().split())


# Keywords that mean another one.
ALIASES = {"data pruning": "dataset pruning", "data prune": "dataset pruning"}


@F.pandas_udf(StringType())
def normalize_keyword(x: pd.Series) -> pd.Series:
    """NFKC, casefold, underscores, dashes and other signs as blanks, collapsed, then by ALIASES; null counts as empty."""
    plain = x.map(lambda t: " ".join(re.sub(r"[^\w\s]", " ", re.sub(r"[_‐-―-]", " ", fold_text(t))).split()))
    return plain.map(lambda t: ALIASES.get(t, t))


def agglomerate(items: DataFrame, threshold: float, collection: str = "collection", most: int = 5000) -> DataFrame:
    """(collection, key, cluster INT): average linkage on cosine distance of the vectors of each collection, merged while below threshold.

    Meant for collections a reader looks at: one is one task with a matrix of n * n, and one of more than `most` rows raises an error.
    Clusters are numbered by their smallest key; zero vectors stand alone. Order of the input doesn't matter.
    """

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("key", kind="stable")
        n = len(t)
        if n > most:
            raise ValueError(f"collection {t[collection].iloc[0]} has {n} rows; at most {most} can be clustered at once")
        x = np.stack(t.vec.to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d = np.clip(1 - x @ x.T, 0, None)
        np.fill_diagonal(d, np.inf)
        size, label = np.ones(n), np.arange(n)
        while n > 1:
            i, j = divmod(int(d.argmin()), len(d))
            if not d[i, j] < threshold:
                break
            i, j = min(i, j), max(i, j)
            d[i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[:, i] = d[i]
            d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
            size[i] += size[j]
            label[label == j] = i
        names = {v: k for k, v in enumerate(sorted(set(label.tolist())))}
        return pd.DataFrame({collection: t[collection], "key": t.key, "cluster": [names[v] for v in label]})

    kind = items.schema[collection].dataType.simpleString()
    return items.select(collection, "key", "vec").groupBy(collection).applyInPandas(run, f"{collection} {kind}, key string, cluster int")


def link_by_sums(x: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest row of each row's cluster: average linkage on cosine distance of unit rows, merged while below threshold.

    The mean distance of two clusters follows from the sums of their rows, so nearest-neighbour chains need no matrix of n * n.
    """
    parent, ids = np.arange(len(x)), np.arange(len(x))
    sums, size, alive = x.copy(), np.ones(len(x)), np.ones(len(x), bool)
    chain: list[int] = []
    while alive.any():
        if not chain:
            live = np.flatnonzero(alive)
            if 2 * len(live) < len(alive):
                ids, sums, size, alive = ids[live], sums[live], size[live], alive[live]
            chain = [int(alive.argmax())]
        i = chain[-1]
        d = np.clip(1 - sums @ sums[i] / (size * size[i]), 0, None)
        d[~alive] = d[i] = np.inf
        j = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[j] + 1e-12:  # rounding must not lead the chain in a circle
            j = chain[-2]
        if not d[j] < threshold:  # nothing comes nearer by later merges
            alive[chain.pop()] = False
        elif len(chain) > 1 and j == chain[-2]:
            chain = chain[:-2]
            i, j = (i, j) if ids[i] < ids[j] else (j, i)
            parent[ids[j]] = ids[i]
            sums[i] += sums[j]
            size[i] += size[j]
            alive[j] = False
        else:
            chain.append(j)
    for v in range(len(x)):
        parent[v] = parent[parent[v]]
    return parent


def agglomerate_whole(items: DataFrame, threshold: float, collection: str = "collection") -> DataFrame:
    """What agglomerate gives, for collections of any size: one is one task whose memory grows with its rows and whose time with their square."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("key", kind="stable")
        x = np.stack(t.vec.to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        _, names = np.unique(link_by_sums(x, threshold), return_inverse=True)
        return pd.DataFrame({collection: t[collection], "key": t.key, "cluster": names})

    kind = items.schema[collection].dataType.simpleString()
    return items.select(collection, "key", "vec").groupBy(collection).applyInPandas(run, f"{collection} {kind}, key string, cluster int")


def label_clusters(members: DataFrame, keywords: DataFrame, group: tuple[str, ...] = ("cluster",), top: int = 3) -> DataFrame:
    """(group, label, top_keywords): keywords held by most members, then by the greatest share inside, then alphabetic; `unlabeled` without any.

    keywords is (key, keyword), counted once per member.
    """
    k = keywords.where("keyword is not null and keyword != ''").select("key", "keyword").distinct()
    all_ = k.join(members.select("key").distinct(), "key", "left_semi").groupBy("keyword").agg(F.count("*").alias("total"))
    inside = members.join(k, "key").groupBy(*group, "keyword").agg(F.count_distinct("key").alias("n")).join(all_, "keyword")
    w = Window.partitionBy(*group).orderBy(F.desc("n"), F.desc(F.col("n") / F.col("total")), "keyword")
    best = inside.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "keyword"))), lambda x: x.keyword).alias("top_keywords"))
    out = members.select(*group).distinct().join(best, list(group), "left")
    return out.select(*group, F.coalesce(F.nullif(F.array_join("top_keywords", "; "), F.lit("")), F.lit("unlabeled")).alias("label"), F.coalesce("top_keywords", F.array().cast("array<string>")).alias("top_keywords"))


def cluster_quality(items: DataFrame, block: int = 8192) -> DataFrame:
    """(cluster, size, mean_within, nearest_other, silhouette) of items (key, cluster, vec), by cosine distance of the vectors scaled to length 1.

    A vector's mean distance to a cluster follows from the cluster's sum of vectors, so mean_within and silhouettes need one row per cluster, sent in blocks of
    about `block` clusters. nearest_other compares all vectors, in blocks of as many; a task gives one number per cluster and block. Singletons have
    a silhouette of 0 and no mean_within. Null or zero vectors are left out.
    """
    spark = items.sparkSession
    kind = items.schema["cluster"].dataType.simpleString()

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _rows(b.column("vec"))
                length = np.linalg.norm(x, axis=1)
                x /= np.maximum(length, 1e-12)[:, None]
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("cluster"), _lists(x)], ["key", "cluster", "vec"]).filter(pa.array(length > 0))

    unit = items.where("vec is not null and size(vec) > 0").select(F.col("key").cast("string").alias("key"), "cluster", F.col("vec").cast("array<double>").alias("vec"))
    unit = materialize(unit.mapInArrow(scale, f"key string, cluster {kind}, vec array<double>"), "unit")

    def add(t: pa.Table) -> pa.Table:
        return pa.table({"cluster": t.column("cluster")[:1], "n": [sum(t.column("n").to_pylist())], "s": _lists(_rows(t.column("s").combine_chunks()).sum(0)[None])})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                names, own = np.unique(b.column("cluster").to_numpy(zero_copy_only=False), return_inverse=True)
                x = _rows(b.column("vec"))
                total = np.zeros((len(names), x.shape[1]))
                np.add.at(total, own, x)
                yield pa.RecordBatch.from_arrays([pa.array(names, b.column("cluster").type), pa.array(np.bincount(own)), _lists(total)], ["cluster", "n", "s"])

    sums = unit.select("cluster", "vec").mapInArrow(partial, f"cluster {kind}, n long, s array<double>")
    sums = materialize(sums.groupBy("cluster").applyInArrow(add, f"cluster {kind}, n long, s array<double>"), "sums")
    square = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)
    size = sums.select("cluster", F.col("n").alias("size"), F.when(F.col("n") > 1, 1 - (square - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("mean_within"))

    means = None
    for part in _blocks(sums, "cluster", block):
        sent = spark.sparkContext.broadcast((part.column("cluster").to_numpy(zero_copy_only=False), part.column("n").to_numpy(), _rows(part.column("s").combine_chunks())))

        def to_clusters(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, n, s = sent.value
            for b in batches:
                if b.num_rows:
                    dots = _rows(b.column("vec")) @ s.T
                    own = b.column("cluster").to_numpy(zero_copy_only=False)[:, None] == names[None]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        mine = np.where(own & (n > 1), 1 - (dots - 1) / (n - 1), np.nan)
                    there = np.where(own.any(1), np.nanmax(np.where(own, np.nan_to_num(mine, nan=-1.0), -2.0), axis=1), -2.0)
                    other = np.where(own, np.inf, 1 - dots / n).min(1)
                    yield pa.RecordBatch.from_arrays([b.column("key"), b.column("cluster"), pa.array(np.where(there >= -0.5, there, np.nan), from_pandas=True), pa.array(np.where(np.isfinite(other), other, np.nan), from_pandas=True)], ["key", "cluster", "own", "other"])

        made = unit.mapInArrow(to_clusters, f"key string, cluster {kind}, own double, other double")
        means = made if means is None else means.unionByName(made)
    near = None
    for part in _blocks(unit, "key", block):
        sent = spark.sparkContext.broadcast((part.column("cluster").to_numpy(zero_copy_only=False), _rows(part.column("vec").combine_chunks())))

        def to_others(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, y = sent.value
            best: dict = {}
            for b in batches:
                if b.num_rows:
                    own = b.column("cluster").to_numpy(zero_copy_only=False)
                    d = np.where(own[:, None] == names[None], np.inf, 1 - _rows(b.column("vec")) @ y.T).min(1)
                    for c, v in zip(own.tolist(), d.tolist(), strict=True):
                        best[c] = min(best.get(c, v), v)
            yield pa.RecordBatch.from_arrays([pa.array(list(best), spark_type), pa.array([v if np.isfinite(v) else None for v in best.values()], pa.float64())], ["cluster", "d"])

        spark_type = part.column("cluster").type
        made = unit.select("cluster", "vec").mapInArrow(to_others, f"cluster {kind}, d double")
        near = made if near is None else near.unionByName(made)
    if means is None:
        return size.select("cluster", "size", "mean_within", F.lit(None).cast("double").alias("nearest_other"), F.lit(None).cast("double").alias("silhouette")).limit(0)
    s = F.when(F.col("own").isNull() | F.col("other").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")), F.lit(0.0)))
    sil = means.groupBy("key", "cluster").agg(F.max("own").alias("own"), F.min("other").alias("other")).groupBy("cluster").agg(F.avg(s).alias("silhouette"))
    return size.join(near.groupBy("cluster").agg(F.min("d").alias("nearest_other")), "cluster", "left").join(sil, "cluster", "left").select("cluster", "size", "mean_within", "nearest_other", "silhouette")


def cluster_summary(quality: DataFrame) -> DataFrame:
    """One row over the clusters of cluster_quality: n_clusters, n_singletons, n_clustered, silhouette (mean over records), ambiguity_warning (below 0.15) and
    silhouette_reason; silhouette and warning are null, with the reason, unless there are 2 to n - 1 clusters."""
    t = quality.agg(F.count("*").alias("n_clusters"), F.count_if(F.col("size") == 1).alias("n_singletons"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_clustered"), F.sum(F.col("silhouette") * F.col("size")).alias("_s"))
    fine = (F.col("n_clusters") >= 2) & (F.col("n_clusters") < F.col("n_clustered"))
    score = F.round(F.when(fine, F.col("_s") / F.col("n_clustered")), 4)
    reason = F.when(~fine, "label-count precondition not met (need 2..n-1 clusters)")
    return t.select("n_clusters", "n_singletons", "n_clustered", score.alias("silhouette"), (score < 0.15).alias("ambiguity_warning"), reason.alias("silhouette_reason"))


def _rows(column) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _blocks(df: DataFrame, column: str, block: int) -> Iterator[pa.Table]:
    """The rows of df in parts of about `block`, by a hash of column."""
    parts = max(1, -(-df.count() // block))
    for i in range(parts):
        got = df.where(F.pmod(F.xxhash64(column), F.lit(parts)) == i).toArrow()
        if got.num_rows:
            yield got


__all__ = ["agglomerate", "cluster_quality", "cluster_summary", "label_clusters", "normalize_keyword", "similar_pairs", "terms", "tfidf", "two_channels"]
