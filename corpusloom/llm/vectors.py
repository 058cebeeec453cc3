"""Vector tables: cleaning, cluster-feature trees, and shards that follow the tree.

A cluster feature (CF) of a set of unit vectors is (n, LS): its size and the sum of its vectors. CFs add up, so trees
built apart can be merged by inserting one's leaf entries into the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import list_column, materialize, vectors_of

#: Entries of the summary that reaches the driver: as many, or twice the number of shards if that is more.
SUMMARY_ENTRIES = 4096
#: Most shards, hence most centres that are broadcast (25 MB at 96 dimensions). Above ONE_LEVEL they are found and asked in two levels.
#: Beyond 65,536 shards (some 100 million vectors) the shards grow and are cut into parts, all of which are asked.
MOST_SHARDS = 65_536
#: Vectors a shard should hold.
SHARD_ROWS = 1500
#: Most centres that are all asked.
ONE_LEVEL = 8192
#: Rows that are held against all centres at once.
BLOCK = 1024


class CFTree:
    """A cluster-feature tree of two levels over unit vectors, filled in blocks.

    An entry absorbs a vector if the entry's mean keeps a cosine of at least `threshold` with it. With `most` set, a tree
    that outgrows it lowers its threshold and reinserts its own entries, as BIRCH does.
    """

    def __init__(self, dim: int, threshold: float, most: int | None = None, branching: int = 64):
        self.threshold, self.most, self.branching = threshold, most, branching
        self.n = np.zeros(64)
        self.ls = np.zeros((64, dim), np.float32)
        self.size = 0
        self.inner: list[list[int]] = []  # entries below each inner node

    def _centre(self, at) -> np.ndarray:
        ls = self.ls[at]
        return ls / np.maximum(np.linalg.norm(ls, axis=-1, keepdims=True), 1e-12)

    def _add_entry(self, n: float, ls: np.ndarray) -> int:
        if self.size == len(self.n):
            self.n = np.concatenate([self.n, np.zeros_like(self.n)])
            self.ls = np.concatenate([self.ls, np.zeros_like(self.ls)])
        self.n[self.size], self.ls[self.size] = n, ls
        self.size += 1
        return self.size - 1

    def _split(self, node: int) -> None:
        """Split an inner node between two of its entries that are far apart."""
        own = np.array(self.inner[node])
        c = self._centre(own)
        a = int(np.argmin(c @ c[0]))
        b = int(np.argmin(c @ c[a]))
        left = c @ c[a] >= c @ c[b]
        if left.all() or not left.any():
            left = np.arange(len(own)) < len(own) // 2
        self.inner[node] = own[left].tolist()
        self.inner.append(own[~left].tolist())

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each vector the nearest entry below its two nearest inner nodes, its cosine, and the nearest inner node."""
        k = len(self.inner)
        heads = np.stack([self.ls[e].sum(0) for e in self.inner])
        heads /= np.maximum(np.linalg.norm(heads, axis=1, keepdims=True), 1e-12)
        s = x @ heads.T
        first = s.argmax(1)
        paths = [first]
        if k > 1:
            s[np.arange(len(x)), first] = -2
            paths.append(s.argmax(1))
        best, sim = np.full(len(x), -1), np.full(len(x), -2.0, np.float32)
        for path in paths:
            order = np.argsort(path, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(path[order])) + 1):
                own = np.array(self.inner[path[rows[0]]])
                t = x[rows] @ self._centre(own).T
                j = t.argmax(1)
                v = t[np.arange(len(rows)), j]
                better = v > sim[rows]
                best[rows[better]], sim[rows[better]] = own[j[better]], v[better]
        return best, sim, first

    def insert(self, n: np.ndarray, ls: np.ndarray, block: int = 512) -> None:
        """Insert cluster features; a single vector is one of n = 1."""
        for at in range(0, len(n), block):
            self._block(n[at : at + block], ls[at : at + block].astype(np.float32))
            if self.most and self.size > self.most:
                self._shrink(block)

    def _shrink(self, block: int) -> None:
        """Reinsert the own entries under a lower threshold that leaves a quarter to three quarters of `most`, if there is one.

        It is bisected: where vectors have no near neighbours, a little less makes the difference between nearly all entries and hardly any.
        """
        n, ls = self.n[: self.size].copy(), self.ls[: self.size].copy()
        order = np.argsort(-n, kind="stable")
        high, low = self.threshold, None
        while True:
            ends = low is not None and high - low < 1e-3
            self.threshold = low if ends else 1 - min(2.0, (1 - high) * 1.3 + 0.01) if low is None else (high + low) / 2
            self.size, self.inner = 0, []
            for b in range(0, len(order), block):
                self._block(n[order[b : b + block]], ls[order[b : b + block]])
            if ends or self.most / 4 <= self.size <= self.most * 3 / 4 or self.threshold <= -1:
                return
            if self.size > self.most * 3 / 4:
                high = self.threshold
            else:
                low = self.threshold

    def _block(self, n: np.ndarray, ls: np.ndarray) -> None:
        x = ls / np.maximum(np.linalg.norm(ls, axis=1, keepdims=True), 1e-12)
        rest = np.arange(len(x))
        home = np.zeros(len(x), int)
        if self.inner:
            best, sim, home = self._nearest(x)
            into = sim >= self.threshold
            np.add.at(self.n, best[into], n[into])
            np.add.at(self.ls, best[into], ls[into])
            rest = rest[~into]
        if not len(rest):
            return
        s = x[rest] @ x[rest].T >= self.threshold
        free = np.ones(len(rest), bool)
        for i in range(len(rest)):
            if not free[i]:
                continue
            take = s[i] & free
            take[i] = True
            free[take] = False
            e = self._add_entry(n[rest[take]].sum(), ls[rest[take]].sum(0))
            if not self.inner:
                self.inner.append([])
            node = min(home[rest[i]], len(self.inner) - 1)
            self.inner[node].append(e)
            while len(self.inner[node]) > self.branching:
                self._split(node)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        return self.n[: self.size], self.ls[: self.size]


def clean_vectors(df: DataFrame, key: str = "paper_key", vector: str = "matrix") -> DataFrame:
    """(key STRING, vec ARRAY<DOUBLE>): one row per key, each vector scaled to length 1 in double precision.

    Left out: rows whose key or vector is null, vectors that are empty, all zero, or have a null, NaN or infinite component, and
    vectors of another length than the most frequent one (the longer at a tie). Of several vectors of a key the smallest
    counts. Other columns are ignored, whatever their names.
    """

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vec")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)  # skips null lists
            starts = np.cumsum(sizes) - sizes
            for d in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == d)
                x = flat[starts[rows][:, None] + np.arange(d)]
                top = np.abs(x).max(1)
                good = np.isfinite(top) & (top > 0)
                x = x[good] / top[good, None]  # guards the squares against under- and overflow
                x /= np.sqrt((x * x).sum(1))[:, None]
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows[good])), list_column(x)], ["key", "vec"])

    raw = df.select(F.col(key).cast("string").alias("key"), F.col(vector).cast("array<double>").alias("vec")).where("key is not null and vec is not null")
    return raw.mapInArrow(unit, "key string, vec array<double>").groupBy("key").agg(F.min("vec").alias("vec"))


def same_length(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """vectors of the most frequent length, that length, and their number."""
    counts = vectors.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).take(1)
    if not counts:
        return vectors, 0, 0
    d, n = counts[0]
    return vectors.where(F.size("vec") == d), d, n


def summarize(vectors: DataFrame, dim: int, most: int = SUMMARY_ENTRIES, threshold: float = 0.98, fan_in: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """CF entries (n, LS) of all rows: a tree per partition, merged in a tree of fan-in 8. At most `most` reach the driver."""
    schema = "n double, ls array<float>"

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = CFTree(dim, threshold, most)
        for b in batches:
            x = vectors_of(b.column("vec"))
            tree.insert(np.ones(len(x)), x)
        yield from _entries(tree)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = CFTree(dim, threshold, most)
        for b in batches:
            tree.insert(b.column("n").to_numpy(), vectors_of(b.column("ls")))
        yield from _entries(tree)

    cf = vectors.select("vec").mapInArrow(leaves, schema)
    parts = vectors.rdd.getNumPartitions()
    while parts > 1:
        parts = math.ceil(parts / fan_in)
        cf = cf.repartition(parts).mapInArrow(merge, schema)
    got = cf.toArrow()
    if not got.num_rows:
        return np.zeros(0), np.zeros((0, dim), np.float32)
    n, ls = got.column("n").to_numpy(), vectors_of(got.column("ls"))
    order = np.lexsort(ls.T[::-1])
    return n[order], ls[order]


def _entries(tree: CFTree) -> Iterator[pa.RecordBatch]:
    n, ls = tree.entries()
    if len(n):
        yield pa.RecordBatch.from_arrays([pa.array(n), list_column(ls, pa.float32())], ["n", "ls"])


def entries_for(rows: int, shard_rows: int = SHARD_ROWS) -> int:
    """Entries that the summary of so many rows may have."""
    return max(SUMMARY_ENTRIES, 2 * min(MOST_SHARDS, math.ceil(rows / shard_rows)))


def _directions(ls: np.ndarray) -> np.ndarray:
    return (ls / np.maximum(np.linalg.norm(ls, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def k_means(x: np.ndarray, n: np.ndarray, ls: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of k groups of CF entries by weighted spherical k-means; x are the entries' directions."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), k, replace=False, p=n / n.sum())] if k < len(x) else x.copy()
    for _ in range(rounds):
        own, near = np.zeros(len(x), int), np.zeros(len(x), np.float32)
        for at in range(0, len(x), BLOCK):
            s = x[at : at + BLOCK] @ c.T
            own[at : at + BLOCK] = s.argmax(1)
            near[at : at + BLOCK] = s.max(1)
        new = np.zeros_like(c)
        np.add.at(new, own, ls)
        load = np.bincount(own, n, k)
        empty = np.flatnonzero(load == 0)
        heavy = np.argsort(-load)[: len(empty)]
        for e, h in zip(empty, heavy, strict=False):  # an empty group takes half of a heavy one
            mine = np.flatnonzero(own == h)
            new[e] = ls[mine[np.argmin(near[mine])]]
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, new / np.maximum(norm, 1e-12), c)
    return c.astype(np.float32)


class Centres:
    """Centres of shards. Above one_level of them they lie below coarse centres, and only those below the coarse ones near a vector are asked: `near` of them, or a quarter."""

    def __init__(self, n: np.ndarray, ls: np.ndarray, k: int, one_level: int = ONE_LEVEL, near: int = 6):
        x = _directions(ls)
        k = int(max(1, min(MOST_SHARDS, k, len(x))))
        self.near, self.one_level = near, one_level
        if k <= one_level:
            self._place(k_means(x, n, ls, k))
        else:
            coarse = k_means(x, n, ls, math.ceil(math.sqrt(k)))
            own = (x @ coarse.T).argmax(1)
            parts = []
            for g in range(len(coarse)):
                if len(at := np.flatnonzero(own == g)):
                    parts.append(k_means(x[at], n[at], ls[at], max(1, min(len(at), round(k * n[at].sum() / n.sum())))))
            self._place(np.concatenate(parts))
        first, _ = self.nearest(x, 1)
        self.load = np.bincount(first[:, 0], n, len(self.fine))

    @classmethod
    def at(cls, n: np.ndarray, ls: np.ndarray, one_level: int = ONE_LEVEL, near: int = 6) -> Centres:
        """A centre for each of the given sums, with n as their loads."""
        own = cls.__new__(cls)
        own.near, own.one_level, own.load = near, one_level, n
        own._place(_directions(ls))
        return own

    def _place(self, fine: np.ndarray) -> None:
        self.fine, self.below = fine, None
        if len(fine) > self.one_level:
            self.coarse = k_means(fine, np.ones(len(fine)), fine, math.ceil(math.sqrt(len(fine))))
            own = (fine @ self.coarse.T).argmax(1)
            self.below = [np.flatnonzero(own == g) for g in range(len(self.coarse))]

    def nearest(self, x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Shards of the m nearest centres of each row, nearest first (the last repeats where there are fewer), and whether each is another one."""
        x = np.asarray(x, np.float32)
        got = [self._nearest(x[at : at + BLOCK], m) for at in range(0, max(1, len(x)), BLOCK)]
        return np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])

    def _nearest(self, x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        if self.below is None:
            s, names = x @ self.fine.T, np.broadcast_to(np.arange(len(self.fine)), (len(x), len(self.fine)))
            out, _ = self._top(s, names, min(m, len(self.fine)))
        else:
            s = x @ self.coarse.T
            asked = np.zeros(s.shape, bool)
            ask = min(s.shape[1], max(self.near, math.ceil(s.shape[1] / 4)))
            np.put_along_axis(asked, np.argpartition(-s, ask - 1, axis=1)[:, :ask], True, 1)
            out, best = np.full((len(x), m), -1), np.full((len(x), m), -3, np.float32)
            for g, own in enumerate(self.below):
                rows = np.flatnonzero(asked[:, g])
                if len(rows) and len(own):
                    s = np.concatenate([best[rows], x[rows] @ self.fine[own].T], 1)
                    names = np.concatenate([out[rows], np.broadcast_to(own, (len(rows), len(own)))], 1)
                    out[rows], best[rows] = self._top(s, names, m)
        new = np.zeros((len(x), m), bool)
        new[:, : out.shape[1]] = out >= 0
        last = new.sum(1) - 1
        return out[np.arange(len(x))[:, None], np.minimum(np.arange(m), last[:, None])], new

    @staticmethod
    def _top(s: np.ndarray, names: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.argpartition(-s, m - 1, axis=1)[:, :m]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
        return np.take_along_axis(names, near, 1), np.take_along_axis(s, near, 1)


def refine(vectors: DataFrame, centres: Centres, shard_rows: int, rounds: int = 4, most_parts: int = 64) -> Centres:
    """The centres moved to the means of all rows that are nearest to them, in passes over all vectors.

    An entry of a summary can hold the rows of many shards and can't be divided. So a centre with the rows of several shards becomes as
    many: the means of the sectors of its rows around random directions.
    """
    dim = centres.fine.shape[1]
    directions = np.random.default_rng(11).normal(size=(most_parts, dim)).astype(np.float32)
    for _ in range(rounds):
        parts = np.clip(np.round(centres.load / shard_rows), 1, most_parts).astype(np.int64)
        if parts.sum() > MOST_SHARDS:
            parts[:] = 1
        sent = vectors.sparkSession.sparkContext.broadcast((centres, parts, np.cumsum(parts) - parts))

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            c, parts, start = sent.value
            n, ls = np.zeros(parts.sum()), np.zeros((parts.sum(), dim))
            for b in batches:
                if not b.num_rows:
                    continue
                x = vectors_of(b.column("vec")).astype(np.float32)
                own = c.nearest(x, 1)[0][:, 0]
                to = start[own]
                cut = np.flatnonzero(parts[own] > 1)
                if len(cut):
                    mid = c.fine[own[cut]]
                    side = (x[cut] - (x[cut] * mid).sum(1)[:, None] * mid) @ directions.T
                    side[np.arange(most_parts) >= parts[own[cut]][:, None]] = -np.inf
                    to[cut] += side.argmax(1)
                order = np.argsort(to, kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(to[order]) > 0])
                n += np.bincount(to, minlength=len(n))
                ls[to[order[at]]] += np.add.reduceat(x[order].astype(float), at)
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), list_column(ls[some])], ["c", "n", "ls"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
            if t is not None and t.num_rows:
                names, own = np.unique(t.column("c").to_numpy(), return_inverse=True)
                ls = np.zeros((len(names), dim))
                np.add.at(ls, own, vectors_of(t.column("ls")))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(own, t.column("n").to_numpy())), list_column(np.round(ls, 5).astype(np.float32), pa.float32())], ["c", "n", "ls"])

        schema = "c int, n double, ls array<%s>"
        got = vectors.select("vec").mapInArrow(sums, schema % "double").repartition("c").mapInArrow(total, schema % "float").toArrow().sort_by("c")
        centres = Centres.at(got.column("n").to_numpy(), vectors_of(got.column("ls")), centres.one_level, centres.near)
    return centres


def shard_centres(vectors: DataFrame, dim: int, rows: int, shard_rows: int = SHARD_ROWS) -> tuple[Centres, np.ndarray]:
    """Centres of about rows / shard_rows shards and the rows near each."""
    n, ls = summarize(vectors, dim, entries_for(rows, shard_rows))
    centres = Centres(n, ls, math.ceil(rows / shard_rows / 2))  # refine adds as many
    if rows > shard_rows:
        centres = refine(vectors, centres, shard_rows)
    return centres, centres.load


def salts_of(load: np.ndarray, shard_rows: int = SHARD_ROWS) -> list[int]:
    """Into how many parts each shard is cut, so that a part holds at most 4 x shard_rows rows for each copy that is sent."""
    return [int(max(1, math.ceil(x / (4 * shard_rows)))) for x in load]


def to_shards(table: DataFrame, centres: Centres, copies: int, columns: str, vec: str = "vec") -> DataFrame:
    """Each row once for each of its `copies` nearest centres, with `shard` INT and `turn` INT (0 for the nearest) before its columns; columns says the type vec is sent in."""
    sent = table.sparkSession.sparkContext.broadcast(centres)
    narrow = f"{vec} array<float>" in columns

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors_of(b.column(vec)).astype(np.float32)
            near, other = sent.value.nearest(x, copies)
            own = [list_column(x) if narrow and name == vec else b.column(name) for name in b.schema.names]
            for turn in range(copies):
                keep = pa.array(other[:, turn])
                made = pa.RecordBatch.from_arrays([pa.array(near[:, turn].astype(np.int32)), pa.array(np.full(len(x), turn, np.int32)), *own], ["shard", "turn", *b.schema.names])
                yield made.filter(keep)

    return table.mapInArrow(route, f"shard int, turn int, {columns}")


def prepared(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int]:
    """clean_vectors as a table in the shared folder, its vector length and its rows."""
    table = materialize(clean_vectors(df, key, vector).sortWithinPartitions("key"), "vectors")  # trees depend on the order of their rows
    return same_length(table)


__all__ = ["CFTree", "clean_vectors", "prepared", "refine", "same_length", "shard_centres", "summarize", "to_shards"]
