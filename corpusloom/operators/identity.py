"""Duplicates, conflicts and versions of records: an audit row for every input row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def conflicts(records: DataFrame, key: str = "key", payload: str = "payload") -> DataFrame:
    """(key, payloads): keys whose records differ in their payload."""
    return records.groupBy(F.col(key).alias("key")).agg(F.count_distinct(payload).alias("payloads")).where("payloads > 1")


def require_no_conflicts(records: DataFrame, key: str = "key", payload: str = "payload") -> None:
    found = conflicts(records, key, payload).orderBy("key").take(1)
    if found:
        raise ValueError(f"conflicting records for {found[0].key}")


def inventory(records: DataFrame, strict: bool = False) -> DataFrame:
    """records (idx, key, core, version, status, method, error) with disposition and reason, one row per input row.

    duplicate: an earlier record has the key; skipped: by status; strict_ok_excluded: not ok although strict; missing_method: blank text;
    superseded_version: a higher version, or the same one earlier, of the core is kept; else accepted.
    """
    first = Window.partitionBy("key").orderBy("idx")
    rows = records.withColumn("nth", F.row_number().over(first))
    status = F.col("status")
    say = lambda d, r: F.struct(F.lit(d).alias("disposition"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    early = (
        F.when(F.col("nth") > 1, say("duplicate", "identical record already kept"))
        .when(status == "skipped", say("skipped", F.coalesce(F.nullif("error", F.lit("")), F.lit("extraction skipped"))))
        .when(F.lit(strict) & ~F.coalesce(status == "ok", F.lit(False)), say("strict_ok_excluded", F.concat(F.lit("status="), F.coalesce(status, F.lit("null")))))
        .when(~F.coalesce(status.isin("ok", "degraded"), F.lit(False)), say("skipped", F.concat(F.lit("status="), F.coalesce(status, F.lit("null")))))
        .when(F.trim(F.coalesce("method", F.lit(""))) == "", say("missing_method", "blank or missing method text"))
    )
    rows = rows.withColumn("early", early).withColumn("no", T.version_number("version"))
    best = Window.partitionBy("core", F.col("early").isNull()).orderBy(F.desc("no"), "idx")
    rows = rows.withColumn("place", F.row_number().over(best)).withColumn("winner", F.first("key").over(best))
    late = F.when(F.col("place") == 1, say("accepted", "eligible for clustering")).otherwise(say("superseded_version", F.concat(F.lit("kept "), F.col("winner"))))
    return rows.withColumn("d", F.coalesce("early", late)).select(*records.columns, "d.disposition", "d.reason")


def latest_versions(records: DataFrame, core: str, version: str, tie: str) -> DataFrame:
    """The row of the highest version of every core; at a tie the smallest `tie`."""
    w = Window.partitionBy(core).orderBy(F.desc(T.version_number(version)), tie)
    return records.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def corpus_digest(records: DataFrame, *columns: str) -> DataFrame:
    """One row: a digest of the rows that doesn't depend on their order, and their number.

    Row hashes are summed, so nothing is gathered; equal rows count each time.
    """
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    return records.agg(F.sha2(F.concat_ws("|", *[part(i) for i in range(8)]), 256).alias("digest"), F.count("*").alias("n"))
