"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize

#: The rank file of a public byte-level BPE; a parameter everywhere, never part of this repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that tokenizer cuts text before merging (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(path: str = TOKENIZER):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sized(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens INT, the columns of keep), as a table in the shared folder: the whole text's size. Null and empty texts have 0 tokens."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), *keep)
    spark = docs.sparkSession
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:  # a single small file
        rows = rows.repartition(spark.sparkContext.defaultParallelism)

    @F.pandas_udf("int")
    def size(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for b in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in b], dtype="int32")

    return materialize(rows.select("doc_id", size("text").alias("n_tokens"), *keep), "sizes")
