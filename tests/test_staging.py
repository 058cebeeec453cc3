import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.sources import corpus as C
from corpusloom.sources import staging
from corpusloom.streaming import quota as Q


def stop_after(run, batches):
    """Stop a query that has done so many batches with rows; one with timeouts would go on with empty ones for ever."""
    end = time.monotonic() + 60
    while time.monotonic() < end and sum(p["numInputRows"] > 0 for p in run.recentProgress) < batches:
        time.sleep(0.1)
    run.stop()


def test_a_million_rows_are_numbered_without_gaps(spark, tmp_path):
    n = 1_000_000
    rows = spark.range(n, numPartitions=7).select(F.format_string("k%07d", F.pmod(F.col("id") * 7_919, F.lit(n))).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    for _ in range(2):
        got = C.number_rows(rows, "key").agg(F.count_distinct("row_id").alias("ids"), F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.count_if(F.substring("key", 2, 7).cast("long") != F.col("row_id")).alias("moved")).first()
        assert tuple(got) == (n, 0, n - 1, 0)
    C.write_corpus(rows, f"file://{tmp_path}/c", "key")
    held = C.open_corpus(spark, f"file://{tmp_path}/c").agg(F.count("*"), F.count_distinct("row_id"), F.count_distinct("shard")).first()
    assert tuple(held) == (n, n, 100)


def test_ties_and_odd_tables_are_numbered(spark):
    rows = spark.createDataFrame([("a", None), ("a", 1), (None, 2), ("b", 3), ("b", 3)], "key string, row_id_ int")
    got = C.number_rows(rows, "key", "row_id_").orderBy("row_id").collect()
    assert [(r.key, r.row_id_, r.row_id) for r in got] == [(None, 2, 0), ("a", None, 1), ("a", 1, 2), ("b", 3, 3), ("b", 3, 4)]
    assert C.number_rows(rows.limit(0), "key").count() == 0


def test_tables_are_released(spark):
    at = staging.mark()
    t = staging.materialize(spark.range(5), "x")
    assert t.count() == 5
    staging.release(spark, at)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(t.inputFiles()[0])


def test_windows_cut_into_days_equal_whole_ones(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(4 * 86_400), rng.choice([None, 1.0, 2.5])) for _ in range(3000)] + [("a", 86_400, 1.0)] * 3
    e = spark.createDataFrame(rows, "grp string, s long, tokens double").withColumn("ts", F.timestamp_seconds("s"))
    w = lambda n: Window.partitionBy("grp").orderBy("s").rangeBetween(-n + 1, 0)
    want = e.select("grp", "s", "tokens", F.count("*").over(w(60)), F.coalesce(F.sum("tokens").over(w(60)), F.lit(0)), F.count("*").over(w(86_400)))
    got = Q.window_use(e).select("grp", "s", "tokens", "minute_requests", "minute_tokens", "day_requests")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_windows_are_running_sums(spark):
    rows = [("a", 10, 1.0), ("a", 20, float("inf")), ("a", 69, 2.0), ("a", 70, 3.0), ("a", 80, 4.0), ("a", 86_410, 5.0), ("a", None, 6.0), ("a", None, 7.0), (None, 15, None)]
    e = spark.createDataFrame(rows, "grp string, s long, tokens double").withColumn("ts", F.timestamp_seconds("s"))
    used = Q.window_use(e)
    got = {(r.s, r.tokens): (r.minute_requests, r.minute_tokens, r.day_requests) for r in used.collect()}
    inf = float("inf")
    assert got == {(10, 1.0): (1, 1.0, 1), (20, inf): (2, inf, 2), (69, 2.0): (3, inf, 3), (70, 3.0): (3, inf, 4), (80, 4.0): (3, 9.0, 5), (86_410, 5.0): (1, 5.0, 5), (None, 6.0): (2, 13.0, 2), (None, 7.0): (2, 13.0, 2), (15, None): (1, 0.0, 1)}
    # A frame that begins a number of rows or seconds back is summed anew for every row: time in proportion to rows times what a window holds.
    assert "RangeFrame, -" not in used._jdf.queryExecution().optimizedPlan().toString()


def test_admission_equals_a_search_of_the_past():
    rng = random.Random(9)
    q = Q.Quota(rpm=6, tpm=60, rpd=40, safety=1.0, min_interval_s=0)
    ledger, given, now = Q.Ledger(q), [], 0.0
    for _ in range(3000):
        now += rng.choice([0.5, 3, 10, 11, 400])
        tokens = rng.choice([1, 10, 30, 61])

        def fits(t):
            minute = [n for at, n in given if t - 60 < at]
            return len(minute) < 6 and sum(minute) + tokens <= 60 and sum(t - 86_400 < at for at, _ in given) < 40 and (not given or t >= given[-1][0] + 10)

        decision, earliest = ledger.ask(now, tokens)
        if tokens > 60:
            assert decision == "request_exceeds_token_window"
        elif decision == "admitted":
            assert fits(now)
            given.append((now, tokens))
        else:
            assert not fits(now) and (decision == "daily_request_budget" or fits(earliest))
    assert len(given) > 100


def test_quotas_are_checked():
    for bad in ({"rpm": 0}, {"tpm": 1.5}, {"safety": 0}, {"safety": 2}, {"min_interval_s": -1}, {"min_interval_s": float("inf")}):
        with pytest.raises(ValueError):
            Q.Quota(**bad)


def test_an_answer_closes_the_circuit_live(spark, tmp_path):
    q = Q.Quota(rpm=100, tpm=1000, rpd=1000, safety=1.0, min_interval_s=0)
    rows = [("g", 0, 1.0, None), ("g", 1, 0.0, "error"), ("g", 2, 0.0, "error"), ("g", 3, 1.0, None), ("g", 63, 1.0, None)]
    e = spark.createDataFrame(rows, "grp string, s long, tokens double, outcome string").withColumn("ts", F.timestamp_seconds("s"))
    want = {0.0: "admitted", 3.0: "deferred", 63.0: "admitted"}
    assert {r["at"]: r.decision for r in Q.admit(e, q).collect()} == want
    for i, part in enumerate((e.where("s <= 1"), e.where("s > 1"))):  # two batches, so the state carries failures over
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = Q.admit_stream(spark.readStream.schema(e.schema).parquet(f"file://{tmp_path}/in"), q)
        run = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").start()
        stop_after(run, 1)
    assert {r["at"]: r.decision for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == want
