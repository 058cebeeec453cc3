"""Grouping vectors into clusters of mutually similar records (problem 1).

Method: CF trees per partition are merged into one bounded summary, whose k-means centres cut the space into overlapping
shards. In each shard a finer CF tree reduces the vectors to leaves, Ward's agglomeration joins the leaves, and every
maximal subtree whose mean pairwise cosine reaches the bound is a candidate. One pass then assigns every vector to the
candidates near it, and exact rounds over the sums of the members keep the groups that hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import list_column, materialize, pairs_within, spread, vectors_of
from corpusloom.llm.vectors import CFTree, prepared, salts_of, shard_centres, to_shards

#: Most leaves that one agglomeration takes, whose distances need leaves squared: the tree of a shard coarsens its leaves until it has no more.
WARD_LEAVES = 6000


def ward(n: np.ndarray, ls: np.ndarray) -> list[tuple[int, int]]:
    """Ward's agglomeration of cluster features by nearest-neighbour chains: the merges in the order they can be replayed.

    Inputs are nodes 0..len(n)-1; merge i makes node len(n)+i.
    """
    k = len(n)
    w = n.astype(float).copy()
    c = ls / n[:, None]
    sq = (c * c).sum(1)
    d = np.maximum(sq[:, None] + sq[None] - 2 * (c @ c.T), 0).astype(np.float32)
    d *= (w[:, None] * w[None] / (w[:, None] + w[None])).astype(np.float32)
    np.fill_diagonal(d, np.inf)
    alive = np.ones(k, bool)
    label = list(range(k))
    merges: list[tuple[int, int]] = []
    chain: list[int] = []
    start = 0
    for _ in range(k - 1):
        if not chain:
            while not alive[start]:
                start += 1
            chain = [start]
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        dab = d[a, b]
        row = ((w + w[a]) * d[a] + (w + w[b]) * d[b] - w * dab) / (w + w[a] + w[b])
        row[~alive] = np.inf
        row[[a, b]] = np.inf
        d[a], d[:, a] = row, row
        d[b], d[:, b] = np.inf, np.inf
        alive[b] = False
        w[a] += w[b]
        merges.append((label[a], label[b]))
        label[a] = k + len(merges) - 1
    return merges


def candidates_of(n: np.ndarray, ls: np.ndarray, bounds: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(n, LS) of the maximal subtrees of Ward's tree that have two rows or more and a mean pairwise cosine of a bound or more."""
    k = len(n)
    merges = ward(n, ls)
    size, total = np.concatenate([n, np.zeros(len(merges))]), np.concatenate([ls.astype(float), np.zeros((len(merges), ls.shape[1]))])
    parent = np.full(k + len(merges), -1)
    for i, (a, b) in enumerate(merges):
        size[k + i], total[k + i] = size[a] + size[b], total[a] + total[b]
        parent[a] = parent[b] = k + i
    mean = ((total * total).sum(1) - size) / np.maximum(size * (size - 1), 1)
    keep = np.zeros(len(size), bool)
    for bound in bounds:
        good = (size > 1.5) & (mean >= bound)
        above = np.zeros(len(size), bool)  # a good node at or above the parent
        for v in range(len(size) - 1, -1, -1):
            p = parent[v]
            above[v] = p >= 0 and (above[p] or good[p])
        keep |= good & ~above
    return size[keep], total[keep]


def group_similar(df: DataFrame, key: str = "paper_key", vector: str = "matrix", bound: float = 0.80, leaf: float = 0.93, copies: int = 3, reach: int = 8) -> DataFrame:
    """(cluster_id STRING, key STRING, size LONG, mean DOUBLE, vec): the members of every group and their mean cosine to the others.

    A group is a largest set of records in which each record's mean cosine to the other members is at least bound; a record
    is in one group at most, a group has two records at least, and its id is its smallest key. Records that clean_vectors
    leaves out (null, zero or NaN vectors, null keys) and records without a group have no row. Repeated rows of a key count once;
    equal vectors under different keys are different records of one group. An empty table gives no rows.
    """
    spark = df.sparkSession
    points, dim, rows = prepared(df, key, vector)
    if not rows:
        return spark.createDataFrame([], "cluster_id string, key string, size long, mean double, vec array<double>")
    centres, load = shard_centres(points, dim, rows)
    salts = salts_of(load)
    salt_of = F.array(*[F.lit(s) for s in salts])
    routed = to_shards(points, centres, copies, "key string, vec array<float>").withColumn("salt", F.pmod(F.xxhash64("key"), F.get(salt_of, F.col("shard"))).cast("int"))
    routed = spread(routed, "shard", "salt")

    def leaves(t: pa.Table) -> pa.Table:
        tree = CFTree(dim, leaf)
        t = t.sort_by("key")
        x = vectors_of(t.column("vec")).astype(np.float32)
        tree.insert(np.ones(len(x)), x)
        m, sums = tree.entries()
        return pa.Table.from_arrays([pa.array(np.full(len(m), t.column("shard")[0].as_py(), np.int32)), pa.array(m), list_column(sums, pa.float32())], ["shard", "n", "ls"])

    def agglomerate(t: pa.Table) -> pa.Table:
        tree = CFTree(dim, leaf, WARD_LEAVES)
        n, ls = t.column("n").to_numpy(), vectors_of(t.column("ls"))
        order = np.lexsort((ls[:, 0], ls[:, -1], -n))
        tree.insert(n[order], ls[order])
        m, sums = tree.entries()
        size, total = candidates_of(m, sums, (bound, (1 + bound) / 2))
        for _ in range(2):  # let the leaves move between the candidates before the vectors do
            if len(size):
                near = (sums / m[:, None]) @ (total / size[:, None]).T >= bound
                size = np.maximum(near.T @ m, 1)
                total = near.T.astype(float) @ sums
        keep = size > 1.5
        shard = t.column("shard")[0].as_py()
        ids = [f"{shard}-{i}" for i in range(int(keep.sum()))]
        return pa.Table.from_arrays([pa.array(ids, pa.string()), list_column((total[keep] / size[keep][:, None]).reshape(-1, dim).astype(np.float32), pa.float32())], ["cid", "centre"])

    found = routed.groupBy("shard", "salt").applyInArrow(leaves, "shard int, n double, ls array<float>")
    found = materialize(spread(found, "shard").groupBy("shard").applyInArrow(agglomerate, "cid string, centre array<float>"), "candidates")
    # Members of a group can lie in shards that are not among the nearest of its candidate, the more so the more shards there are.
    near = to_shards(found, centres, max(copies, reach), "cid string, centre array<float>", vec="centre")
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.get(salt_of, F.col("shard")) - 1)))

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, cids = np.array([], object), np.array([], object)
        if left.num_rows and right.num_rows:
            s = vectors_of(left.column("vec")) @ vectors_of(right.column("centre")).T
            i, j = np.nonzero(s >= bound - 0.03)
            keys, cids = left.column("key").to_numpy()[i], right.column("cid").to_numpy()[j]
        return pa.Table.from_arrays([pa.array(cids, pa.string()), pa.array(keys, pa.string())], ["cid", "key"])

    member = routed.groupBy("shard", "salt").cogroup(spread(near, "shard", "salt").groupBy("shard", "salt")).applyInArrow(assign, "cid string, key string").distinct()
    member = materialize(member, "members")
    # The two copies of a shard's candidates, and candidates from several bounds, mostly have the same members: keep one of each.
    sets = member.groupBy("cid").agg(F.count("*").alias("m"), F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("x")).where("m > 1")
    one = sets.groupBy("m", "h", "x").agg(F.min("cid").alias("cid")).select("cid")
    # The first rounds work on narrow vectors with a margin, the last one, on each key's largest group, in double precision.
    member = materialize(member.join(one, "cid").join(points.select("key", F.col("vec").cast("array<float>").alias("vec")), "key"), "members")
    for step in (bound - 0.01, bound - 1e-4):
        member = _hold(member, step, dim, "float")
    member = materialize(member.drop("vec", "mean"), "members")
    sized = member.join(member.groupBy("cid").agg(F.count("*").alias("size")), "cid")
    first = sized.groupBy("key").agg(F.max(F.struct("size", "cid")).cid.alias("cid"))
    member = materialize(_hold(first.join(points, "key"), bound, dim, "double"), "members")
    named = member.groupBy("cid").agg(F.min("key").alias("cluster_id"), F.count("*").alias("size")).where("size > 1")
    return member.join(named, "cid").select("cluster_id", "key", "size", "mean", "vec")


def _hold(member: DataFrame, bound: float, dim: int, kind: str) -> DataFrame:
    """The members whose mean cosine to the other members of cid is at least bound, with that mean; vec is an array of kind."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, own = np.unique(b.column("cid").to_numpy(zero_copy_only=False), return_inverse=True)
            total = np.zeros((len(ids), dim))
            np.add.at(total, own, vectors_of(b.column("vec")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(np.bincount(own).astype(np.int64)), list_column(total)], ["cid", "m", "s"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for b in batches:
            for cid, m, s in zip(b.column("cid").to_pylist(), b.column("m").to_pylist(), vectors_of(b.column("s")) if b.num_rows else [], strict=True):
                if cid in sums:
                    sums[cid][0] += m
                    sums[cid][1] = sums[cid][1] + s
                else:
                    sums[cid] = [m, s]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v[0] for v in sums.values()], pa.int64()), list_column(np.stack([v[1] for v in sums.values()]))], ["cid", "m", "s"])

    rows = member.select("cid", "key", "vec")
    sums = rows.select("cid", "vec").mapInArrow(partial, "cid string, m long, s array<double>").repartition("cid").mapInArrow(total, "cid string, m long, s array<double>")

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                mean = ((vectors_of(b.column("vec")) * vectors_of(b.column("s"))).sum(1) - 1) / (b.column("m").to_numpy() - 1)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("cid", "key", "vec")), pa.array(mean)], ["cid", "key", "vec", "mean"]).filter(pa.array(mean >= bound))

    return rows.join(sums, "cid").where("m > 1").mapInArrow(means, f"cid string, key string, vec array<{kind}>, mean double")


def pairs_of_groups(members: DataFrame) -> DataFrame:
    """(paper_key_a, paper_key_b): all pairs of different members of a group, smaller key first."""
    return pairs_within(members, "cluster_id", "key", "paper_key_a", "paper_key_b")


def describe_groups(members: DataFrame, titles: DataFrame, typical: int = 3, keywords: int = 5) -> DataFrame:
    """(cluster_id, size, typical_keys, top_keywords): each group with its most typical members and its most telling title phrases.

    Typical members have the highest mean cosine (smaller key first at a tie). Keywords are the pairs of neighbouring title words
    held by most members, weighted by how rare they are outside the group; titles is (key, title), and a group without
    titles has an empty list.
    """
    w = Window.partitionBy("cluster_id").orderBy(F.desc("mean"), "key")
    top = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical)
    top = top.groupBy("cluster_id", "size").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "key"))), lambda x: x.key).alias("typical_keys"))
    words = F.expr(r"filter(regexp_extract_all(lower(title), '[\\p{L}\\p{N}-]+', 0), w -> length(w) > 3)")
    t = titles.where("key is not null and title is not null").groupBy("key").agg(F.min("title").alias("title")).withColumn("w", words).where("size(w) > 1")
    t = t.select("key", F.explode(F.array_distinct(F.expr("transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))"))).alias("phrase"))
    everywhere = t.groupBy("phrase").agg(F.count("*").alias("df"))
    inside = t.join(members.select("key", "cluster_id"), "key").groupBy("cluster_id", "phrase").agg(F.count("*").alias("tf"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc(F.col("tf") * F.col("tf") / F.col("df")), "phrase")
    best = inside.join(everywhere, "phrase").withColumn("r", F.row_number().over(w)).where(F.col("r") <= keywords)
    best = best.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "phrase"))), lambda x: x.phrase).alias("top_keywords"))
    return top.join(best, "cluster_id", "left").select("cluster_id", "size", "typical_keys", F.coalesce("top_keywords", F.array().cast("array<string>")).alias("top_keywords"))
