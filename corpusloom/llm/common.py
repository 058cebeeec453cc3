"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.staging import materialize


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *cols: str, times: int = 1) -> DataFrame:
    """Hash-partition on cols into a fixed number of parts, which AQE leaves as they are.

    For groups that go to Python: coalescing by bytes would put CPU-heavy groups into few tasks. Several times as many parts even out heavy groups.
    """
    return df.repartition(times * parallelism(df.sparkSession), *cols)


def pairs_within(members: DataFrame, group: str, item: str, first: str, second: str, block: int = 2000) -> DataFrame:
    """(first, second): all pairs of different items of a group, the smaller one first.

    The pairs of a large group are many by nature. It is cut into blocks of about `block` items, and each of its items is sent once to every block, so the pairs are
    made in as many tasks as there are blocks and a task holds a block.
    """
    sized = members.select(group, item).distinct()
    number = sized.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks")).where("_blocks > 1")
    sized = sized.join(number, group, "left").fillna(1, ["_blocks"])
    left = sized.select(group, F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int").alias("_block"), F.col(item).alias(first))
    right = sized.select(group, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.col(item).alias(second))
    return left.join(right, [group, "_block"]).where(F.col(first) < F.col(second)).select(first, second)


def vectors_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list<float> column without nulls as one matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def list_column(rows: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    values = pa.array(rows.ravel(), type=kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), values)


__all__ = ["list_column", "materialize", "pairs_within", "parallelism", "spread", "vectors_of"]
