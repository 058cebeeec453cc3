"""Sections, sentences, scored snippets, mentions and budgets of parsed documents.

A document has key and sections, an array of structs heading, level, text; the order of the sections is data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Patterns of each kind of statement, the kinds of section it is expected in, and the letter of its ids.
SNIPPETS = {
    "problem": (["we study", "we investigate", "we address", "the problem of", "our goal is", "we consider"], ["always", "other"], "P"),
    "method": (["we propose", "we introduce", "our method", "our approach", "we develop", "we present", "we prune", "we select"], ["method", "always"], "M"),
    "result": ([r"achieve\w*", "accuracy", r"outperform\w*", "we evaluate", r"experiments? (?:on|show)"], ["results"], "R"),
    "limitation": (["limitation", "drawback", "future work", "unstable", "does not", r"fail(?:s|ure)?"], ["limits", "always"], "L"),
    "contribution": ([r"our contributions?", "we make the following contributions", "this paper (?:makes|has) the following"], ["always", "method"], "C"),
}
# Points of a mention by the kind of its section, and the cues around it.
SECTION_WEIGHT = {"results": 4, "method": 2, "always": 3, "limits": 1, "other": 0, "related": -3, "appendix": -2, "biblio": -5}
USE_CUES = [r"\bwe evaluate(?: our)?(?: approach| method)? on\b", r"\bexperiments? on\b", r"\btrained on\b", r"\bbenchmarks?\b", r"\bdatasets?\b"]
HEDGE_CUES = [r"\be\.g\.\b", r"\bfor example\b", r"\bsuch as\b", r"\bincluding\b"]
PER_KIND, IN_ALL = 8, 28


def explode_sections(docs: DataFrame, key: str = "key") -> DataFrame:
    """(key, sec_no, heading, level, text, kind) of every section; null lists give no rows, null texts and headings count as empty."""
    s = docs.select(F.col(key).alias("key"), F.posexplode("sections").alias("sec_no", "s"))
    s = s.select("key", "sec_no", F.coalesce("s.heading", F.lit("")).alias("heading"), "s.level", F.coalesce("s.text", F.lit("")).alias("text"))
    return s.withColumn("kind", T.heading_kind("heading"))


def sentences_of(x) -> Column:
    """Sentences of a text: 40 to 600 characters each; of 20 to 39 they go with the one before, shorter and longer ones are dropped."""

    def step(done: Column, s: Column) -> Column:
        n = F.length(s)
        last = F.array(F.concat(F.element_at(done, -1), F.lit(" "), s))
        glued = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), last)
        return F.when((n < 20) | (n > 600), done).when((n < 40) & (F.size(done) > 0), glued).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(T.sentence_parts(x), F.array().cast("array<string>"), step)


def allowed(kind: str, related: bool = False, appendix: bool = False, biblio: bool = False) -> Column:
    """Section policy: related work, appendices and references only if wanted."""
    k = F.col(kind)
    return ((k != "related") | F.lit(related)) & ((k != "appendix") | F.lit(appendix)) & ((k != "biblio") | F.lit(biblio))


def select_sections(sections: DataFrame, budget: int) -> DataFrame:
    """The sections (key, sec_no, heading, text, kind) that fit a budget of characters, with ord INT, the cut text and its cost.

    In the order of kind and place. The first is always whole; one that doesn't fit is cut at a blank if 400 characters or more are left,
    else skipped while later ones may still fit. Nothing follows once the budget is used up.
    """
    rows = sections.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(T.heading_priority("kind").alias("priority"), "sec_no", "heading", "text", "kind"))).alias("s"))
    cost = lambda heading, text: F.length(heading) + 2 + F.length(text)
    item = "struct<ord:int,sec_no:int,heading:string,kind:string,text:string>"

    def step(acc: Column, s: Column) -> Column:
        used, done = acc["used"], acc["done"]
        whole = cost(s["heading"], s["text"])
        left = F.lit(budget) - used
        room = left - F.length(s["heading"]) - 2
        cut = F.trim(F.when(F.length(s["text"]) <= room, s["text"]).otherwise(F.regexp_replace(F.left(s["text"], F.greatest(room, F.lit(0))), r" [^ ]*$", "")))
        fits = (F.size(done) == 0) | (used + whole <= budget)
        text = F.when(fits, s["text"]).otherwise(cut)
        take = (used < budget) & (fits | ((left >= 400) & (cut != ""))) & ((F.size(done) == 0) | ~acc["full"])
        new = F.struct(F.size(done).alias("ord"), s["sec_no"].alias("sec_no"), s["heading"].alias("heading"), s["kind"].alias("kind"), text.alias("text")).cast(item)
        spent = used + F.when(take, cost(s["heading"], text)).otherwise(0)
        return F.struct(spent.alias("used"), F.when(take, F.concat(done, F.array(new))).otherwise(done).alias("done"), (acc["full"] | (spent >= budget)).alias("full"))

    start = F.struct(F.lit(0).alias("used"), F.array().cast(f"array<{item}>").alias("done"), F.lit(False).alias("full"))
    return rows.select("key", F.explode(F.aggregate("s", start, step)["done"]).alias("x")).select("key", "x.*", cost(F.col("x.heading"), F.col("x.text")).alias("cost"))


def score_snippets(sections: DataFrame, snippets: dict = SNIPPETS, least: float = 3.0) -> DataFrame:
    """(key, sec_no, sent_no, sentence, kind, score): every sentence's best kind, if it reaches least.

    4 points for a pattern of the kind, 3 for a section the kind is expected in, -4 in related work, appendix or references. The first
    kind wins ties; of equal sentences of a document the best, then first, counts.
    """
    rows = sections.select("key", "sec_no", "kind", F.posexplode(sentences_of("text")).alias("sent_no", "sentence")).withColumnRenamed("kind", "section_kind")
    low = F.lower("sentence")
    off = F.when(F.col("section_kind").isin("related", "biblio", "appendix"), -4.0).otherwise(0.0)
    scores = []
    for i, (kind, (patterns, preferred, _)) in enumerate(snippets.items()):
        hit = F.when(low.rlike("|".join(rf"\b{p}\b" for p in patterns)), 4.0).otherwise(0.0)
        scores.append(F.struct((hit + F.when(F.col("section_kind").isin(*preferred), 3.0).otherwise(0.0) + off).alias("score"), F.lit(-i).alias("order"), F.lit(kind).alias("kind")))
    rows = rows.withColumn("best", F.array_max(F.array(*scores))).where(F.col("best.score") >= least)
    rows = rows.select("key", "sec_no", "sent_no", "sentence", "best.kind", "best.score")
    w = Window.partitionBy("key", "sentence").orderBy(F.desc("score"), "sec_no", "sent_no")
    first = Window.partitionBy("key", "sentence")
    rows = rows.withColumn("at", F.min(F.struct("sec_no", "sent_no")).over(first)).withColumn("r", F.row_number().over(w)).where("r = 1")
    return rows.select("key", F.col("at.sec_no").alias("sec_no"), F.col("at.sent_no").alias("sent_no"), "sentence", "kind", "score")


def rank_snippets(scored: DataFrame, snippets: dict = SNIPPETS, per_kind: int = PER_KIND, in_all: int = IN_ALL) -> DataFrame:
    """scored with id, such as M2: at most per_kind of a kind, best first; kinds stop one snippet after in_all is reached in their order."""
    order = F.element_at(F.create_map(*[F.lit(v) for i, k in enumerate(snippets) for v in (k, i)]), F.col("kind"))
    letter = F.element_at(F.create_map(*[F.lit(v) for k, x in snippets.items() for v in (k, x[2])]), F.col("kind"))
    w = Window.partitionBy("key", "kind").orderBy(F.desc("score"), "sec_no", "sent_no")
    rows = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_kind).withColumn("k", order)
    before = Window.partitionBy("key").orderBy("k").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.count("*").over(before))
    # A kind that starts before the cap fills up to it; one that starts at or after it still gives one.
    return rows.where((F.col("r") == 1) | (F.col("before") + F.col("r") <= in_all)).select("key", F.concat(letter, F.col("r").cast("string")).alias("id"), "kind", "sec_no", "sent_no", "sentence", "score")


def span_of(text, piece) -> tuple[Column, Column]:
    """Where a piece stands in a text, from 0, and where it ends; nulls if it isn't there as it stands (its white space or hyphens were normalised)."""
    at = F.nullif(F.position(piece, text), F.lit(0)) - 1
    return at, at + F.length(piece)


def with_spans(pieces: DataFrame, sections: DataFrame, column: str) -> DataFrame:
    """pieces (key, sec_no, column) with start_char and end_char: the place of each in the text of its section, null where normalising has changed it."""
    rows = pieces.join(sections.select("key", "sec_no", F.col("text").alias("_text")), ["key", "sec_no"], "left")
    start, end = span_of(F.col("_text"), F.col(column))
    return rows.withColumn("start_char", start).withColumn("end_char", end).drop("_text").select(*pieces.columns, "start_char", "end_char")


def backfill(sections: DataFrame, scored: DataFrame, kind: str, section_kinds: list[str], most: int = 4) -> DataFrame:
    """scored with up to `most` first sentences (score 1) of sections of the given kinds, for documents that have none of kind."""
    lacking = sections.where(F.col("kind").isin(*section_kinds)).join(scored.where(F.col("kind") == kind).select("key").distinct(), "key", "left_anti")
    rows = lacking.select("key", "sec_no", F.posexplode(F.slice(sentences_of("text"), 1, most)).alias("sent_no", "sentence"))
    w = Window.partitionBy("key").orderBy("sec_no", "sent_no")
    rows = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return scored.unionByName(rows.select("key", "sec_no", "sent_no", "sentence", F.lit(kind).alias("kind"), F.lit(1.0).alias("score")))


def find_mentions(sections: DataFrame, catalog: dict[str, list[str]], least: float, radius: int = 90) -> DataFrame:
    """(key, name, score, sec_no, start, end, quote): the best mention of each name of a catalog of patterns.

    Points: of the section's kind, 4 for a cue of use anywhere in the section, -1 for a hedge within radius, 1 more in results. Ties go to the
    earlier section, pattern and place. Offsets need Python, so sections go through it in Arrow batches.
    """
    compiled = [(n, i, re.compile(p, re.I)) for n, ps in catalog.items() for i, p in enumerate(ps)]
    use, hedge = re.compile("|".join(USE_CUES)), re.compile("|".join(HEDGE_CUES))

    def clean(t: str) -> str:
        return re.sub(r"\s+", " ", re.sub(r"(\w)-\s+(\w)", r"\1\2", t.replace("­", ""))).strip()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, no, kind, text in zip(b.key, b.sec_no, b.kind, b.text, strict=True):
                base = SECTION_WEIGHT.get(kind, 0) + (4.0 if use.search(text.lower()) else 0.0) + (kind == "results")
                for name, i, p in compiled:
                    for m in p.finditer(text):
                        quote = clean(text[max(0, m.start() - radius) : m.end() + radius])
                        score = base - (1.0 if hedge.search(quote.lower()) else 0.0)
                        if score >= least:
                            out.append((key, name, score, no, i, m.start(), m.end(), quote))
            yield pd.DataFrame(out, columns=["key", "name", "score", "sec_no", "pattern", "start", "end", "quote"])

    rows = sections.select("key", "sec_no", "kind", "text").mapInPandas(run, "key string, name string, score double, sec_no int, pattern int, start int, end int, quote string")
    w = Window.partitionBy("key", "name").orderBy(F.desc("score"), "sec_no", "pattern", "start")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "pattern")


# Names of methods that count when a title and its method statement share them.
NAMED_METHODS = ["el2n", "grand", "coreset", "infobatch"]


def local_confidence(snippets: DataFrame, sections: DataFrame, mentions: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(key, confidence) of extraction without a model: 0 without a method snippet of 6 or more; else .55, .2 for a method section, .1 for a
    dataset, .15 for a method's name that the title (titles: key, title) shares, .1 for a statement that something is proposed or introduced, .99 at most."""
    w = Window.partitionBy("key").orderBy("id")
    best = snippets.where("kind = 'method' and score >= 6").withColumn("r", F.row_number().over(w)).where("r = 1")
    best = best.join(sections.select("key", "sec_no", T.normalize_heading("heading").alias("h")), ["key", "sec_no"]).join(mentions.select("key").distinct().withColumn("has", F.lit(True)), "key", "left")
    points = 0.55 + F.when(F.col("h").contains("method") | F.col("h").contains("approach"), 0.2).otherwise(0.0) + F.when(F.col("has"), 0.1).otherwise(0.0)
    points += F.when(F.lower("sentence").rlike(r"\bwe propose\b|\bwe introduce\b"), 0.1).otherwise(0.0)
    if titles is not None:
        best = best.join(titles.groupBy("key").agg(F.lower(F.min("title")).alias("title")), "key", "left")
        both = [F.contains(F.lower("sentence"), F.lit(t)) & F.contains(F.coalesce("title", F.lit("")), F.lit(t)) for t in NAMED_METHODS]
        points += F.when(both[0] | both[1] | both[2] | both[3], 0.15).otherwise(0.0)
    found = best.select("key", F.round(F.least(points, F.lit(0.99)), 3).alias("confidence"))
    return sections.select("key").distinct().join(found, "key", "left").fillna(0.0, ["confidence"])


def ground_records(records: DataFrame, snippets: DataFrame) -> DataFrame:
    """Records of a model against snippets: (key, field, ord, text, kept ARRAY, unknown ARRAY, status).

    records is (key, field, ord, text, evidence_ids). An id counts trimmed and in capitals, else as it stands; unknown ones are dropped and
    listed. A record without any known id is `dropped`, one that lost some `degraded`, else `ok`.
    """
    refs = records.select("key", "field", "ord", "text", F.posexplode_outer("evidence_ids").alias("n", "ref"))
    known = snippets.select("key", F.col("id").alias("hit"))
    refs = refs.join(known, (refs.key == known.key) & (F.upper(F.trim("ref")) == F.col("hit")), "left").drop(known.key)
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("n", F.coalesce("hit", "ref").alias("ref"))))), lambda x: x["ref"])
    got = refs.groupBy("key", "field", "ord", "text").agg(F.array_distinct(listed(F.col("hit").isNotNull())).alias("kept"), F.array_distinct(listed(F.col("hit").isNull() & F.col("ref").isNotNull())).alias("unknown"))
    return got.withColumn("status", F.when(F.size("kept") == 0, "dropped").when(F.size("unknown") > 0, "degraded").otherwise("ok"))


def locate_quotes(quotes: DataFrame, sections: DataFrame) -> DataFrame:
    """quotes (key, quote_no, quote, section) with sec_no, found, start_char and end_char: exact in a section whose heading matches the declared one, relocated in
    another one, invalid where no section of the document holds the normalised quote. Places are null where the section holds it only after normalising."""
    q = quotes.withColumn("q", T.normalize_text("quote"))
    s = sections.select("key", "sec_no", "heading", "text", T.normalize_text("text").alias("t"))
    hits = q.join(s, "key").where((F.col("q") != "") & F.contains("t", F.col("q"))).withColumn("declared", T.headings_match("section", "heading"))
    w = Window.partitionBy("key", "quote_no").orderBy(F.desc("declared"), "sec_no")
    hits = hits.withColumn("r", F.row_number().over(w)).where("r = 1").withColumn("start_char", span_of(F.col("text"), F.col("q"))[0]).withColumn("end_char", span_of(F.col("text"), F.col("q"))[1])
    hits = hits.select("key", "quote_no", "sec_no", F.when(F.col("declared"), "exact").otherwise("relocated").alias("found"), "start_char", "end_char")
    return quotes.join(hits, ["key", "quote_no"], "left").fillna("invalid", ["found"])


def extents(markers: DataFrame, text: str) -> DataFrame:
    """markers (key, pos from 1, end, ..., text) with body: what stands between a marker's end and the next marker, trimmed."""
    w = Window.partitionBy("key").orderBy("pos")
    until = F.coalesce(F.lead("pos").over(w), F.length(text) + 1)
    return markers.withColumn("body", F.trim(F.substring(F.col(text), F.col("end"), F.greatest(until - F.col("end"), F.lit(0)))))
