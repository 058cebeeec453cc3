"""Filling containers of fixed capacity with items of varying length (problem 5).

Method: optimal length buckets. A dynamic program over the histogram of all lengths chooses the bucket boundaries with the least
padding. Batches then form from whole buckets under the token budget: since items of a bucket count as equally long, a plan
over the buckets' numbers alone says which ranks of which bucket share a container. Batches from one bucket only would leave up to
half of a container empty for items longer than half of it, so a batch may take its rest from shorter buckets.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize
from corpusloom.llm.tokens import TOKENIZER, sized

#: Most buckets of a capacity.
BUCKETS = 128
#: Rows that are ranked in one task.
RANK_ROWS = 50_000


def bucket_bounds(sizes: list[int], counts: list[int], most: int = BUCKETS) -> list[int]:
    """The upper bounds of at most `most` buckets over ascending sizes with the least sum of count * (bound - size).

    Lines of a convex hull give each layer of the dynamic program in linear time.
    """
    s = len(sizes)
    if s <= most:
        return list(sizes)
    n, w = [0], [0]  # numbers and lengths of all items up to a size
    for x, c in zip(sizes, counts, strict=True):
        n.append(n[-1] + c)
        w.append(w[-1] + c * x)
    best = [0.0] + [float("inf")] * s
    froms: list[list[int]] = []
    for _ in range(most):
        hull: list[tuple[float, float, int]] = []  # slope, intercept, index: best[i] + w[i] - bound * n[i]
        new, came = [float("inf")] * (s + 1), [0] * (s + 1)
        at = 0
        for j in range(1, s + 1):
            i = j - 1
            if best[i] < float("inf"):
                m, b = -float(n[i]), best[i] + w[i]
                while len(hull) >= 2 and (b - hull[-1][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - m):
                    hull.pop()
                hull.append((m, b, i))
                at = min(at, len(hull) - 1)
            if hull:
                x = sizes[j - 1]
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                    at += 1
                new[j] = hull[at][0] * x + hull[at][1] + x * n[j] - w[j]
                came[j] = hull[at][2]
        froms.append(came)
        best = new
    bounds, j = [], s
    for came in reversed(froms):
        if j <= 0:
            break
        bounds.append(sizes[j - 1])
        j = came[j]
    return bounds[::-1]


def plan_batches(bounds: list[int], counts: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(bucket, first rank, ranks, first container, items per container), and the number of containers.

    Longest buckets first, each into the containers with the least room that still take its bound (best fit); containers that
    look alike are handled together, so the plan grows with the buckets and not with the items.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    open_: list[tuple[int, int, int]] = []  # room, first container, containers; ascending
    made = 0
    for k in range(len(bounds) - 1, -1, -1):
        h, left, rank = bounds[k], counts[k], 0
        at = bisect_left(open_, (h, -1, -1))
        touched: list[tuple[int, int, int]] = []
        while left and at < len(open_):
            room, first, number = open_.pop(at)
            q = room // h
            use = min(number, -(-left // q))
            if use * q > left and left >= q:  # the last container would not be full: leave the rest for the next turn
                use = left // q
            q = min(q, left)
            plan.append((k, rank, use * q, first, q))
            rank, left = rank + use * q, left - use * q
            touched.append((room - q * h, first, use))
            if use < number:
                open_.insert(at, (room, first + use, number - use))
        while left:
            q = min(capacity // h, left)
            use = left // q
            plan.append((k, rank, use * q, made, q))
            touched.append((capacity - q * h, made, use))
            rank, left, made = rank + use * q, left - use * q, made + use
        open_ = sorted(open_ + [t for t in touched if t[0] > 0])
    return plan, made


def pack(docs: DataFrame, windows: DataFrame, id_column: str = "doc_id", text: str = "text", path: str = TOKENIZER, buckets: int = BUCKETS) -> DataFrame:
    """(window_name, container LONG, doc_id, piece INT, start INT, n_tokens INT): for every window the container of every text.

    windows is (window_name, capacity_tokens). A text that fits is one piece; a longer one is cut into full windows and a rest, piece by
    piece. Null and empty texts take no room and have no row; rows that repeat are packed again; windows without a positive
    capacity are left out. The pieces of a container never exceed its capacity.
    """
    spark = docs.sparkSession
    sizes = sized(docs, id_column, text, path).where("n_tokens > 0")
    caps = [(r.window_name, int(r.capacity_tokens)) for r in windows.where("capacity_tokens > 0").distinct().collect()]  # a fixed table of a few rows
    if not caps:
        return spark.createDataFrame([], f"window_name string, container long, doc_id {sizes.schema['doc_id'].dataType.simpleString()}, piece int, start int, n_tokens int")
    pieces = sizes.withColumn("w", F.explode(F.array(*[F.struct(F.lit(n).alias("window_name"), F.lit(c).alias("cap")) for n, c in caps])))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / F.col("w.cap")).cast("int"))))
    start = F.col("piece") * F.col("w.cap")
    pieces = pieces.select("w.window_name", "doc_id", "piece", start.alias("start"), F.least("w.cap", F.col("n_tokens") - start).alias("n_tokens"))

    found: dict[str, dict[int, int]] = {n: {} for n, _ in caps}
    for r in pieces.groupBy("window_name", "n_tokens").count().collect():  # at most the sum of the capacities
        found[r.window_name][r.n_tokens] = r["count"]
    plans, firsts = {}, {}
    for name, cap in caps:
        sizes_ = sorted(found[name])
        bounds = bucket_bounds(sizes_, [found[name][x] for x in sizes_], buckets)
        counts = [0] * len(bounds)
        for x in sizes_:
            counts[bisect_left(bounds, x)] += found[name][x]
        plan, _ = plan_batches(bounds, counts, cap)
        plans[name] = (np.array(bounds), [np.array(sorted(p[1:] for p in plan if p[0] == k), dtype=np.int64).reshape(-1, 4) for k in range(len(bounds))])
        firsts[name] = [max(1, -(-c // RANK_ROWS)) for c in counts]
    sent = spark.sparkContext.broadcast(plans)
    salts = spark.sparkContext.broadcast(firsts)

    @F.pandas_udf("struct<bucket:int,salts:int>")
    def bucket_of(names: pd.Series, n: pd.Series) -> pd.DataFrame:
        bucket, number = np.zeros(len(n), np.int32), np.zeros(len(n), np.int32)
        for w, at in names.groupby(names, sort=False).indices.items():
            bucket[at] = np.searchsorted(sent.value[w][0], n.to_numpy()[at])
            number[at] = np.asarray(salts.value[w])[bucket[at]]
        return pd.DataFrame({"bucket": bucket, "salts": number})

    put = pieces.withColumn("b", bucket_of("window_name", "n_tokens")).select("window_name", "doc_id", "piece", "start", "n_tokens", "b.bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("b.salts")).cast("int").alias("salt"))
    put = materialize(put, "pieces")
    # Ranks within a bucket: within each salt by sorting, after as many as the salts before it hold.
    number = put.groupBy("window_name", "bucket", "salt").agg(F.count("*").alias("m"))
    before = Window.partitionBy("window_name", "bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    number = number.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    order = Window.partitionBy("window_name", "bucket", "salt").orderBy("doc_id", "piece")
    ranked = put.withColumn("r", F.row_number().over(order)).join(number, ["window_name", "bucket", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("r") - 1)

    @F.pandas_udf("long")
    def container(names: pd.Series, bucket: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(names), np.int64)
        r = rank.to_numpy()
        for (w, b), at in pd.DataFrame({"w": names, "b": bucket}).groupby(["w", "b"], sort=False).indices.items():
            p = sent.value[w][1][b]
            i = np.searchsorted(p[:, 0], r[at], "right") - 1
            out[at] = p[i, 2] + (r[at] - p[i, 0]) // p[i, 3]
        return pd.Series(out)

    return ranked.select("window_name", container("window_name", "bucket", "rank").alias("container"), "doc_id", "piece", "start", "n_tokens")


def fill_report(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, capacity_tokens, containers, pieces, tokens, filled DOUBLE, fullest): how full the containers of each window are."""
    each = packed.groupBy("window_name", "container").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))
    total = each.groupBy("window_name").agg(F.count("*").alias("containers"), F.sum("k").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    total = total.join(F.broadcast(windows.select("window_name", "capacity_tokens").distinct()), "window_name")
    return total.select("window_name", "capacity_tokens", "containers", "pieces", "tokens", F.round(F.col("tokens") / F.col("containers") / F.col("capacity_tokens"), 4).alias("filled"), "fullest")


__all__ = ["bucket_bounds", "fill_report", "pack", "plan_batches"]
