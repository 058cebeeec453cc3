"""Planning a review from evidence: slots, greedy batches, bibliography and the linked bundle of pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.evidence import is_boilerplate


def first_units(units: DataFrame, kinds: tuple[str, ...] = ("method", "limitation", "contribution")) -> DataFrame:
    """The first unit by unit_id of every paper and kind, without formatting instructions."""
    w = Window.partitionBy("key", "kind").orderBy("unit_id")
    return units.where(F.col("kind").isin(*kinds) & ~is_boilerplate("text")).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def plan_slots(units: DataFrame, members: DataFrame) -> DataFrame:
    """(section, claim_id, kind, text, key, ref): a slot for the first method, limitation and contribution of every paper.

    Methods and contributions go to the paper's cluster, else to `unassigned`, limitations to `gaps`. Slots with the same text and reference
    are one; claim_id is `w_` and 20 digits of a hash.
    """
    f = first_units(units).join(members.select("key", "cluster").dropDuplicates(["key"]), "key", "left")
    section = F.when(F.col("kind") == "limitation", "gaps").otherwise(F.coalesce("cluster", F.lit("unassigned")))
    f = f.select(section.alias("section"), "kind", "text", "key", F.col("unit_id").alias("ref")).where("trim(text) != ''")
    w = Window.partitionBy("text", "ref").orderBy(F.when(F.col("kind") == "method", 0).when(F.col("kind") == "limitation", 1).otherwise(2))
    f = f.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return f.withColumn("claim_id", F.concat(F.lit("w_"), T.short_hash(20, "section", "text", "key", "ref")))


def greedy_batches(items: DataFrame, group: str, order: Column, size: str, capacity: int, most_batches: int | None = None) -> DataFrame:
    """items with batch INT and omitted STRING: in their order, each goes to the open batch if it fits, else opens the next; nothing is split.

    An item larger than the capacity (omitted: exceeds_batch), or of a batch beyond most_batches (omitted: budget), gets a null batch. The rows of a group come sorted,
    batch of rows by batch of rows, so a group of any length takes bounded memory; it is one task, since each place depends on all before it.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    names = items.columns

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used, batch = object(), 0, -1
        for t in tables:
            said: list[int | None] = []
            why: list[str | None] = []
            for g, n in zip(t.column(group).to_pylist(), t.column("_n").to_pylist(), strict=True):
                if g != current:
                    current, used, batch = g, 0, -1
                if n > capacity:
                    said.append(None)
                    why.append("exceeds_batch")
                    continue
                if batch < 0 or used + n > capacity:
                    used, batch = 0, batch + 1
                used += n
                over = most_batches is not None and batch >= most_batches
                said.append(None if over else batch)
                why.append("budget" if over else None)
            kept = [t.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(said, pa.int32()), pa.array(why, pa.string())], [*names, "batch", "omitted"])

    rows = items.withColumn("_o", order).withColumn("_n", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    return rows.repartition(group).sortWithinPartitions(group, "_o").drop("_o").mapInArrow(run, f"{fields}, batch int, omitted string")


def chunks(df: DataFrame, order: list, n: int, group: list[str] | None = None, name: str = "chunk") -> DataFrame:
    """df with a number for every n rows in order, within group if there is one; an order over all rows sorts in ranges first."""
    if group:
        return df.withColumn(name, F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / n).cast("int"))
    from corpusloom.sources.corpus import number_rows

    return number_rows(df, *order, shard_rows=n).withColumnRenamed("shard", name).withColumn(name, F.col(name).cast("int")).drop("row_id")


def bibliography(keys: DataFrame) -> DataFrame:
    """(number, key): distinct keys, numbered in their order."""
    from corpusloom.sources.corpus import number_rows

    return number_rows(keys.select("key").distinct(), "key").select((F.col("row_id") + 1).cast("int").alias("number"), "key")


def review_coverage(papers: DataFrame, slots: DataFrame) -> DataFrame:
    """(key, supported): whether a slot is about the paper."""
    return papers.select("key").distinct().join(slots.select("key").distinct().withColumn("hit", F.lit(True)), "key", "left").select("key", F.col("hit").isNotNull().alias("supported"))


def render_bundle(slots: DataFrame, per_page: int = 25, lines: int = 1000) -> DataFrame:
    """(file, content): Markdown pages per section with links to their evidence, evidence pages of per_page units, the references and an index.

    References and index pages have at most `lines` lines, sections about as many: longer ones go on in files numbered from 1, so no task gathers more than a page.
    """
    refs = chunks(slots.select("ref", "key", "text").dropDuplicates(["ref"]), ["ref"], per_page, name="page")
    b = bibliography(slots).withColumn("sheet", F.floor((F.col("number") - 1) / lines))
    name = lambda stem, sheet: F.concat(stem, F.when(sheet > 0, F.concat(F.lit("-"), sheet.cast("string"))).otherwise(F.lit("")), F.lit(".md"))
    joined = lambda order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n")
    listing = name(F.lit("references"), F.col("sheet"))
    line = F.concat(F.lit("- "), T.escape_markdown("text"), F.lit(" [["), F.col("number").cast("string"), F.lit("]]("), listing, F.lit(") ([evidence](evidence-"), F.col("page").cast("string"), F.lit(".md#"), "ref", F.lit("))"))
    body = slots.join(refs.select("ref", "page"), "ref").join(b, "key").select("section", "claim_id", line.alias("line"))
    # The pages of a section are ranges of a hash of the claim ids.
    held = body.groupBy("section").agg(F.ceil(F.count("*") / lines).alias("sheets"))
    first = F.conv(F.substring(F.sha2("claim_id", 256), 1, 8), 16, 10).cast("long")
    body = body.join(held, "section").withColumn("sheet", F.when(F.col("sheets") > 1, F.floor(first * F.col("sheets") / F.lit(1 << 32))).otherwise(F.lit(0)))
    sections = body.groupBy("section", "sheet").agg(F.concat(F.lit("# "), F.first("section"), F.lit("\n\n"), joined("claim_id")).alias("content"))
    sections = sections.select(name(F.concat(F.lit("section-"), F.col("section")), F.col("sheet")).alias("file"), "content")
    ev = refs.select("page", "ref", F.concat(F.lit('<a id="'), "ref", F.lit('"></a> '), T.escape_markdown("text"), F.lit(" ("), "key", F.lit(")")).alias("line"))
    pages = ev.groupBy("page").agg(joined("ref").alias("content")).select(F.concat(F.lit("evidence-"), F.col("page").cast("string"), F.lit(".md")).alias("file"), "content")
    listed = b.select("sheet", "number", F.concat(F.col("number").cast("string"), F.lit(". "), "key").alias("line")).groupBy("sheet").agg(joined("number").alias("content"))
    listed = listed.select(name(F.lit("references"), F.col("sheet")).alias("file"), "content")
    index = chunks(sections.select("file"), ["file"], lines, name="sheet").select("sheet", "file", F.concat(F.lit("- ["), "file", F.lit("]("), "file", F.lit(")")).alias("line"))
    index = index.groupBy("sheet").agg(joined("file").alias("content")).select(name(F.lit("index"), F.col("sheet")).alias("file"), "content")
    return sections.unionByName(pages).unionByName(listed).unionByName(index)
