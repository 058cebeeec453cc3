"""Reading and writing corpora: numbered shards with a manifest, JSON snapshots, results kept by fingerprint."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from corpusloom.functions import text as T
from corpusloom.sources.staging import materialize

#: Schema of a raw record of a metadata snapshot.
RAW = S.StructType([S.StructField(c, S.StringType()) for c in ("id", "title", "abstract", "authors", "categories", "doi", "created", "update_date")])


def number_rows(df: DataFrame, *order, shard_rows: int = 10_000) -> DataFrame:
    """df with row_id from 0 in the order of columns, and shard. Rows that tie in all of them are numbered in any order.

    Ranges are sorted side by side and written once with their own numbers, so that every later read sees the same rows in the same ranges; each
    range then begins at the number of rows in the ranges before it. Only one row per range reaches a single task.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = materialize(ranges.withColumn("_part", F.shiftright("_id", 33)).withColumn("_nth", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"), "ranges")
    held = rows.groupBy("_part").agg(F.count("*").alias("_held"))
    start = held.select("_part", F.coalesce(F.sum("_held").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    numbered = rows.join(F.broadcast(start), "_part").withColumn("row_id", F.col("_start") + F.col("_nth")).drop("_part", "_nth", "_start")
    return numbered.withColumn("shard", F.floor(F.col("row_id") / shard_rows))


def write_corpus(df: DataFrame, path: str, order: str, shard_rows: int = 10_000, settings: dict | None = None) -> None:
    """Write df as a corpus: Parquet partitioned by shard, and a manifest that names every shard with its rows."""
    numbered = number_rows(df, order, shard_rows=shard_rows)
    numbered.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/rows")
    spark = df.sparkSession
    rows = spark.read.parquet(f"{path}/rows")
    shards = rows.groupBy("shard").agg(F.min("row_id").alias("row_start"), (F.max("row_id") + 1).alias("row_end"), F.count("*").alias("count"))
    shards = shards.withColumn("settings", F.lit(json.dumps(settings or {}, sort_keys=True)))
    shards.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def open_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a corpus, after a check of the manifest: shards follow each other without a gap and hold what it says."""
    manifest = spark.read.schema("shard long, row_start long, row_end long, count long, settings string").json(f"{path}/manifest")
    rows = spark.read.parquet(f"{path}/rows")
    held = rows.groupBy("shard").agg(F.count("*").alias("held"), F.count_distinct("row_id").alias("ids"))
    after = F.coalesce(F.lag("row_end").over(Window.orderBy("row_start")), F.lit(0))
    m = manifest.withColumn("gap", F.col("row_start") != after)
    bad = m.join(held, "shard", "full").where("gap or held is null or count is null or held != count or ids != count or row_end - row_start != count").count()
    if bad:
        raise ValueError(f"{bad} shards of {path} don't match the manifest")
    return rows


def shard_of(ids: DataFrame, manifest: DataFrame) -> DataFrame:
    """ids (row_id) with shard, by row_start <= row_id < row_end; the manifest has a row per 10,000 rows or so and is joined by its ranges' buckets."""
    width = 10_000
    m = manifest.select("shard", "row_start", "row_end", F.explode(F.sequence(F.floor(F.col("row_start") / width), F.floor((F.col("row_end") - 1) / width))).alias("bucket"))
    return ids.withColumn("bucket", F.floor(F.col("row_id") / width)).join(m, "bucket").where("row_id >= row_start and row_id < row_end").drop("bucket", "row_start", "row_end")


def validate_shards(vectors: DataFrame, sample: int = 32) -> DataFrame:
    """(shard, count, min_dim, max_dim, min_norm, mean_norm, max_norm): norms over the first `sample` rows of each shard."""
    norm = F.sqrt(F.aggregate(F.transform("vec", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    rows = vectors.withColumn("r", F.row_number().over(Window.partitionBy("shard").orderBy("row_id")))
    n = F.when(F.col("r") <= sample, norm)
    return rows.groupBy("shard").agg(F.count("*").alias("count"), F.min(F.size("vec")).alias("min_dim"), F.max(F.size("vec")).alias("max_dim"), F.min(n).alias("min_norm"), F.avg(n).alias("mean_norm"), F.max(n).alias("max_norm"))


def read_snapshot(spark: SparkSession, path: str, schema: S.StructType = RAW) -> DataFrame:
    """JSON lines of a raw snapshot; lines that are no records are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def normalize_records(raw: DataFrame, categories: list[str], year_from: int | None = None) -> DataFrame:
    """Records with an id, title and abstract, one of the categories and a year not before year_from; texts without inner line breaks.

    matched_categories are those of the record that are wanted, in the record's order; row_hash identifies title and abstract.
    """
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    wanted = F.filter(F.split(F.trim("categories"), r"\s+"), lambda c: c.isin(*categories))
    rows = raw.select(T.id_core("id").alias("core"), one("title").alias("title"), one("abstract").alias("abstract"), one("authors").alias("authors"), F.array_join(wanted, " ").alias("matched_categories"), "doi", T.year_of("created", "id").alias("year"), F.date_format(T.rfc_timestamp("created"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created"))
    rows = rows.where("core != '' and title != '' and abstract != '' and matched_categories != ''")
    if year_from is not None:
        rows = rows.where(F.col("year") >= year_from)
    return rows.withColumn("row_hash", F.sha2(F.concat("title", F.lit("\n"), "abstract"), 256))


def read_strict(spark: SparkSession, path: str, schema: S.StructType, extra: bool = False) -> DataFrame:
    """A stage's JSON snapshot with its schema; a malformed line fails, and unless extra so does a field the schema doesn't have."""
    if not extra:
        known = set(schema.fieldNames())
        text = spark.read.text(path)
        odd = text.where("value != ''").select(F.explode(F.json_object_keys("value")).alias("k")).where(~F.col("k").isin(*known)).distinct().take(1)
        if odd:
            raise ValueError(f"unknown field {odd[0].k} in {path}")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def fingerprint(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str, separators=(",", ":")).encode()).hexdigest()


def cached(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under a fingerprint, else what make gives, written there. One without its success mark counts as missing."""
    path = f"{root}/{key}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def newest_runs(runs: DataFrame, most: int = 30) -> DataFrame:
    """The newest runs (run_id, started) of a listing, newest first."""
    return runs.orderBy(F.desc("started"), "run_id").limit(most)


def write_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
