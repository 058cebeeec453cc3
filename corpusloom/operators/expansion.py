"""Query expansion by templates, and the cleaning of queries a model wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import extract_json


def template_queries(topics: DataFrame, column: str, n: int) -> DataFrame:
    """topics without column, with pos INT (0 is the topic itself) and expanded: at most n + 1 templates, different but for case. Null topics give no rows."""
    t = F.trim(F.regexp_replace(column, r"\s+", " "))
    # The templates.
    made = F.array(t, F.concat(F.lit("methods and algorithms for "), t), F.concat(t, F.lit(" in deep neural networks")), F.concat(F.lit("empirical study of "), t), F.concat(t, F.lit(" survey benchmarks datasets")))
    keys = [c for c in topics.columns if c != column]
    rows = topics.where(F.col(column).isNotNull()).select(*keys, F.posexplode(made).alias("pos", "expanded"))
    w = Window.partitionBy(*keys, F.lower("expanded")).orderBy("pos")
    return rows.withColumn("r", F.row_number().over(w)).where((F.col("r") == 1) & (F.col("pos") <= n)).drop("r")


def model_queries(answers: DataFrame, keys: list[str], column: str, n: int) -> DataFrame:
    """keys, pos, expanded: the first n queries, different but for case and white space, in `{"queries": [...]}` of a model's answer.

    Answers without such a list give no rows, so the caller can fall back on templates with an anti join.
    """
    listed = F.from_json(extract_json(column), "queries array<string>").queries
    rows = answers.select(*keys, F.posexplode(F.transform(listed, lambda q: F.trim(F.regexp_replace(q, r"\s+", " ")))).alias("at", "expanded")).where("expanded != ''")
    once = Window.partitionBy(*keys, F.lower("expanded")).orderBy("at")
    rows = rows.withColumn("r", F.row_number().over(once)).where("r = 1")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1).where(F.col("pos") < n).select(*keys, "pos", "expanded")
