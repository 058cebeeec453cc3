"""Mixing sources to target weights (problem 6).

Method: temperature mixing. A source's weight is its target share times a power of what it holds relative to that share: exponent 0
gives the targets themselves, 1 the natural shares. Without a wanted size the mixture is as large as exponent 0 allows under the
repetition limits; with one, the smallest exponent that meets the limits is found by bisection. With a target entropy the weights are powers of the
natural shares, and the exponent whose weights have that entropy is found by bisection. Weights become whole passes over a
source and one part of a pass, which a permutation of blocks of texts fills up to its budget.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize
from corpusloom.llm.tokens import TOKENIZER, sized

#: Texts of a block; a source has so many blocks that one holds about as many, however large it is.
BLOCK_TEXTS = 2000


def weights_at(exponent: float, shares: dict[str, float], tokens: dict[str, int]) -> dict[str, float]:
    """Normalised weights share * (tokens / share) ** exponent, of sources that have both."""
    raw = {s: x * (tokens[s] / x) ** exponent for s, x in shares.items() if x > 0 and tokens.get(s, 0) > 0}
    total = sum(raw.values())
    return {s: x / total for s, x in raw.items()} if total else {}


def entropy_of(weights: dict[str, float]) -> float:
    """Entropy of weights in nats."""
    return -sum(x * math.log(x) for x in weights.values() if x > 0)


def weights_of_entropy(entropy: float, tokens: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], float]:
    """Powers of the natural shares whose entropy is the wanted one, and the exponent. Entropy falls as the exponent grows, from the logarithm of the number of
    sources at 0; more than that can't be had and gives 0, less than at exponent 64 gives 64."""
    low, high = 0.0, 64.0
    held = {s: n for s, n in tokens.items() if n > 0}
    most = max(held.values(), default=1)

    def at(a: float) -> dict[str, float]:
        raw = {s: (n / most) ** a for s, n in held.items()}
        total = sum(raw.values())
        return {s: x / total for s, x in raw.items()}

    if not held or entropy >= entropy_of(at(0.0)):
        return at(0.0) if held else {}, 0.0
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy_of(at(mid)) > entropy else (low, mid)
    return at(high), high


def choose_budgets(shares: dict[str, float], repeats: dict[str, int], tokens: dict[str, int], wanted: int | None = None, entropy: float | None = None, rounds: int = 60) -> tuple[dict[str, float], float]:
    """Token budget of each source, and the exponent.

    Without wanted: the largest mixture with exactly the shares. With it: that many tokens, or all the limits allow, at the smallest exponent
    that keeps every source within its limit. With an entropy: powers of the natural shares of that entropy, as large as the limits allow or as wanted.
    """
    if entropy is not None:
        weights, exponent = weights_of_entropy(entropy, {s: tokens.get(s, 0) for s in shares}, rounds)
        total = min((repeats[s] * tokens[s] / x for s, x in weights.items() if x > 0), default=0.0)
        return {s: x * min(total, wanted or total) for s, x in weights.items()}, exponent

    def largest(a: float) -> float:
        w = weights_at(a, shares, tokens)
        return min((repeats[s] * tokens[s] / x for s, x in w.items()), default=0.0)

    low = 0.0
    total = largest(0.0)
    if wanted is not None:
        if total >= wanted:
            total = float(wanted)
        elif largest(1.0) <= total:
            pass
        else:
            low, high = 0.0, 1.0
            if largest(1.0) >= wanted:
                for _ in range(rounds):
                    mid = (low + high) / 2
                    low, high = (low, mid) if largest(mid) >= wanted else (mid, high)
                low, total = high, float(wanted)
            else:
                low, total = 1.0, largest(1.0)
    return {s: x * total for s, x in weights_at(low, shares, tokens).items()}, low


def source_name(column: str = "source"):
    """A source's name however it is typed: trimmed, lower case, dashes and blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s-]+", "_")


def mix(docs: DataFrame, targets: DataFrame, wanted: int | float | None = None, entropy: float | None = None, seed: int = 11, id_column: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, n_tokens, repeats INT) and the report (source, target_share, max_repeats, available, tokens, share, most_repeats, exponent).

    targets is (source, target_share, max_repeats). wanted is a number of tokens, or as a float a multiple of all tokens of the sources; entropy is a share of the
    largest possible one, the logarithm of the number of sources. Equal texts under several ids are one text: it belongs to the smallest id, stands in
    the mixture under it, and is used max_repeats times at most. Texts of sources without a target, of a null source, and null or
    empty texts are not used. Each source ends within the size of its smallest unused text of its budget.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), source_name().alias("source"), F.sha2(F.col(text), 256).alias("hash")).where("text is not null and text != ''")
    sizes = sized(rows, "doc_id", "text", path, ("source", "hash"))
    one = sizes.groupBy("hash").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("x")).select("x.*", "hash")
    goal = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.withColumn("source", source_name()).where("source is not null and target_share > 0 and max_repeats > 0").collect()}  # a fixed table of some rows
    texts = materialize(one.where(F.col("source").isin(*goal)) if goal else one.where("false"), "texts")
    held = {r.source: (r.tokens, r.n) for r in texts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    tokens = {s: int(t) for s, (t, _) in held.items()}
    shares = {s: x for s, (x, _) in goal.items()}
    if isinstance(wanted, float):
        wanted = int(wanted * sum(tokens.values()))
    budgets, exponent = choose_budgets(shares, {s: r for s, (_, r) in goal.items()}, tokens, wanted, entropy and entropy * math.log(max(len(tokens), 1)))

    plan = [(s, int(b // tokens[s]), int(b - (b // tokens[s]) * tokens[s]), max(1, held[s][1] // BLOCK_TEXTS)) for s, b in budgets.items()]
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, passes int, part long, blocks long"))
    put = texts.join(plan_df, "source").withColumn("block", F.pmod(F.xxhash64("hash", F.lit(seed)), F.col("blocks")))
    # The blocks in a random order, with what the ones before hold; a block is whole, cut or left out of the part of a pass.
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = put.groupBy("source", "block").agg(F.sum("n_tokens").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(order), F.lit(0)))
    put = put.join(blocks, ["source", "block"])
    whole = F.col("before") + F.col("held") <= F.col("part")
    cut = ~whole & (F.col("before") < F.col("part"))
    cols = ["doc_id", "source", "n_tokens", "passes", "more"]

    def fill(t: pd.DataFrame) -> pd.DataFrame:
        """Take texts in their permuted order while they fit; at last one more if that comes closer to the budget."""
        t = t.sort_values(["order", "hash"], kind="stable")
        room = int(t.part.iloc[0] - t.before.iloc[0])
        size, take = t.n_tokens.to_numpy(), np.zeros(len(t), np.int32)
        for i, x in enumerate(size):
            if x <= room:
                take[i], room = 1, room - x
        left = np.flatnonzero(take == 0)
        if len(left) and size[left].min() < 2 * room:
            more = left[size[left].argmin()]
            take[more], over = 1, int(size[more] - room)
            for i in reversed(range(len(t))):  # and leave out others while the budget stays full
                if take[i] and i != more and size[i] <= over:
                    take[i], over = 0, over - size[i]
        return t.assign(more=take)[cols]

    kind = texts.schema["doc_id"].dataType.simpleString()
    cut_rows = put.where(cut).withColumn("order", F.xxhash64("hash", F.lit(seed + 2))).select("doc_id", "source", "n_tokens", "passes", "part", "before", "order", "hash")
    cut_rows = cut_rows.groupBy("source").applyInPandas(fill, f"doc_id {kind}, source string, n_tokens int, passes int, more int")
    used = put.where(~cut).withColumn("more", whole.cast("int")).select(cols).unionByName(cut_rows)
    caps = F.broadcast(spark.createDataFrame([(s, r) for s, (_, r) in goal.items()], "source string, cap int"))
    used = used.join(caps, "source").withColumn("repeats", F.least(F.col("passes") + F.col("more"), F.col("cap")))
    mixture = materialize(used.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats"), "mixture")

    got = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most_repeats"))
    base = spark.createDataFrame([(s, x, r, tokens.get(s, 0), exponent) for s, (x, r) in goal.items()], "source string, target_share double, max_repeats int, available long, exponent double")
    report = base.join(got, "source", "left").fillna(0, ["tokens", "most_repeats"])
    total = Window.partitionBy(F.lit(1))
    report = report.withColumn("share", F.round(F.try_divide(F.col("tokens"), F.sum("tokens").over(total)), 6))
    return mixture, report.select("source", "target_share", "max_repeats", "available", "tokens", "share", "most_repeats", "exponent")
