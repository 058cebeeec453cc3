"""Evidence units, claims and the checks that tie one to the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Kinds of unit that may support each kind of claim.
PERMITTED = {"shared": ["method", "method_keyword", "problem", "contribution"], "difference": ["method", "method_keyword", "result", "limitation", "contribution"], "comparison": ["method", "result", "limitation"]}
# What generated prose must not contain, and formatting instructions that are no evidence.
UNSAFE = r"(?i)https?://|www\.|\[[^\]]+\]|<[^>]+>|\n\s*#"
RANKING = r"(?i)\b(outperform\w*|state.of.the.art|best performance|superior|no prior work|never studied|first ever)\b|vượt trội|chưa (?:từng )?có nghiên cứu"
NUMERIC = r"(?i)\d+(?:\.\d+)?\s*(?:%|pp\b|accuracy\b)"
BOILERPLATE = r"(?i)^(?:the )?(?:abstract paragraph should be indented|manuscript (?:must|should) be (?:formatted|typed)|paper (?:must|should) be formatted)"
PAPER_ID = r"(?i)\b(?:\d{4}\.\d{4,5}|[a-z-]+/\d{7})(?:v\d+)?\b"


def registry(statements: DataFrame) -> DataFrame:
    """Evidence units of statements (key, field, ord, kind, text, ...): with field_path and unit_id, `e_` and 12 digits of a hash of key, path
    and text. ord null means that the field has one statement. Null texts give no unit."""
    path = F.when(F.col("ord").isNull(), F.col("field")).otherwise(F.concat("field", F.lit("["), F.col("ord").cast("string"), F.lit("]")))
    rows = statements.where("text is not null").withColumn("field_path", path)
    return rows.withColumn("unit_id", F.concat(F.lit("e_"), T.short_hash(12, "key", "field_path", "text")))


def coverage(units: DataFrame, papers: DataFrame, kinds: tuple[str, ...] = ("dataset", "metric", "limitation")) -> DataFrame:
    """(key, <kind>_state...): observed if the paper has a unit of the kind, else unknown, never "not evaluated"."""
    have = units.where(F.col("kind").isin(*kinds)).groupBy("key").agg(*[F.max((F.col("kind") == k).cast("int")).alias(k) for k in kinds])
    out = papers.select("key").distinct().join(have, "key", "left")
    return out.select("key", *[F.when(F.col(k) == 1, "observed").otherwise("unknown").alias(f"{k}_state") for k in kinds])


def gap_candidates(units: DataFrame, papers: DataFrame) -> DataFrame:
    """(kind, statement, refs, papers, unknown): one per limitation, and one over all papers about relations that were not observed."""
    own = units.where("kind = 'limitation'").groupBy("key", "field_path", "text").agg(F.sort_array(F.collect_set("unit_id")).alias("refs"))
    own = own.select(F.lit("documented_limitation").alias("kind"), F.col("text").alias("statement"), "refs", F.lit(1).cast("long").alias("papers"), F.lit(0).cast("long").alias("unknown"))
    c = coverage(units, papers)
    whole = c.agg(F.count("*").alias("papers"), F.count_if(F.col("dataset_state") == "unknown").alias("unknown")).where("papers > 0")
    said = "No supported method-dataset evaluation relations were recorded in this extraction snapshot; dataset fields are mentions only."
    return own.unionByName(whole.select(F.lit("relationship_not_observed").alias("kind"), F.lit(said).alias("statement"), F.array().cast("array<string>").alias("refs"), "papers", "unknown"))


def named_papers(texts: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("claim_no",)) -> DataFrame:
    """(keys, named): papers that a text names by id. With a version it is that one; without, the only known one of the id, the bare token
    if there are several, version 1 if there is none. known is (keys, key): the papers known to each text."""
    t = texts.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(PAPER_ID), 0))).alias("token"))
    t = t.withColumn("core", T.id_core("token")).withColumn("version", T.id_version("token"))
    k = known.select(*keys, T.id_core("key").alias("core"), "key").distinct().groupBy(*keys, "core").agg(F.count("*").alias("n"), F.min("key").alias("only"))
    j = t.join(k, [*keys, "core"], "left")
    named = F.when(F.col("version").isNotNull(), F.concat("core", "version")).when(F.col("n") == 1, F.col("only")).when(F.col("n") > 1, F.col("token")).otherwise(F.concat("core", F.lit("v1")))
    return j.select(*keys, named.alias("named")).distinct()


def validate_claims(claims: DataFrame, units: DataFrame, members: DataFrame) -> DataFrame:
    """claims (claim_no, cluster, kind, text, subjects, refs) with status and reason, the reasons joined by `; ` in a fixed order.

    members is (cluster, key): the papers a claim about the cluster may use. Reasons: empty_text, no_subjects, unknown_subjects,
    named_unsupported_subjects, per reference unknown_ref, cross_cluster_ref or wrong_kind, unsupported_subjects,
    shared_requires_two_subjects, difference_requires_both_sides, all_members_claim_incomplete. Null arrays count as empty.
    """
    c = claims.withColumn("subjects", F.array_distinct(F.coalesce("subjects", F.array().cast("array<string>")))).withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))
    allowed = F.element_at(F.create_map(*[F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)) for kv in PERMITTED.items() for v in kv]), F.when(F.col("kind").isin("shared", "subset"), "shared").otherwise(F.col("kind")))
    m = members.select("cluster", "key").distinct()
    # references
    r = c.select("claim_no", "cluster", allowed.alias("allowed"), F.posexplode("refs").alias("n", "ref"))
    r = r.join(units.select(F.col("unit_id").alias("ref"), F.col("key").alias("owner"), F.col("kind").alias("unit_kind")).dropDuplicates(["ref"]), "ref", "left")
    r = r.join(m.select("cluster", F.col("key").alias("owner"), F.lit(True).alias("inside")), ["cluster", "owner"], "left")
    why = F.when(F.col("owner").isNull(), F.concat(F.lit("unknown_ref:"), "ref")).when(F.col("inside").isNull(), F.concat(F.lit("cross_cluster_ref:"), "ref")).when(~F.array_contains("allowed", F.col("unit_kind")), F.concat(F.lit("wrong_kind:"), "ref", F.lit(":"), "unit_kind"))
    r = r.withColumn("why", why).groupBy("claim_no").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("why").isNotNull(), F.struct("n", "why")))), lambda x: x["why"]).alias("ref_reasons"), F.collect_set(F.when(F.col("why").isNull(), F.col("owner"))).alias("supported")
    )
    # subjects
    s = c.select("claim_no", "cluster", F.posexplode("subjects").alias("n", "key")).join(m.withColumn("inside", F.lit(True)), ["cluster", "key"], "left")
    s = s.groupBy("claim_no").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("inside").isNull(), F.struct("n", "key")))), lambda x: x["key"]).alias("unknown"))
    named = named_papers(c.select("claim_no", "text"), c.select("claim_no", F.explode("subjects").alias("key")).union(c.select("claim_no", "cluster").join(m, "cluster").select("claim_no", "key")))
    named = named.groupBy("claim_no").agg(F.sort_array(F.collect_set("named")).alias("named"))
    size = m.groupBy("cluster").agg(F.count("*").alias("members"))
    j = c.join(r, "claim_no", "left").join(s, "claim_no", "left").join(named, "claim_no", "left").join(size, "cluster", "left")
    empty = F.array().cast("array<string>")
    for col in ("ref_reasons", "supported", "unknown", "named"):
        j = j.withColumn(col, F.coalesce(col, empty))
    missing = F.array_except("subjects", "supported")
    extra = F.array_except("named", "subjects")
    some = lambda name, a: F.when(F.size(a) > 0, F.concat(F.lit(f"{name}:"), F.array_join(a, ",")))
    whole = (F.size("subjects") == F.col("members")) & (F.size("unknown") == 0) & (F.size(missing) > 0)
    reasons = F.array(
        F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_text"), F.when(F.size("subjects") == 0, "no_subjects"), some("unknown_subjects", F.col("unknown")), some("named_unsupported_subjects", extra), F.when(F.size("ref_reasons") > 0, F.array_join(F.array_distinct("ref_reasons"), "; ")), some("unsupported_subjects", missing),
        F.when((F.col("kind") == "shared") & (F.size("supported") < 2), "shared_requires_two_subjects"), F.when((F.col("kind") == "difference") & (F.size("supported") < 2), "difference_requires_both_sides"), F.when(whole, "all_members_claim_incomplete"),
        F.when((F.col("kind") == "comparison") & F.coalesce("text", F.lit("")).rlike(NUMERIC), "numeric_comparison_unsupported"),
    )
    j = j.withColumn("reason", F.nullif(F.array_join(reasons, "; "), F.lit("")))
    return j.select("claim_no", "cluster", "kind", F.when(F.col("reason").isNull(), "structurally_validated").otherwise("rejected").alias("status"), "reason")


def template_claims(units: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, kind, text, subjects, refs) without a model: a subset claim for one paper, else a shared claim over the members with a method."""
    w = Window.partitionBy("key").orderBy("unit_id")
    first = units.where("kind = 'method'").withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "unit_id", "text")
    j = members.join(first, "key").groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("key", "unit_id", "text"))).alias("x"))
    one = F.size("x") == 1
    return j.select("cluster", F.when(one, "subset").otherwise("shared").alias("kind"), F.array_join(F.transform("x", lambda v: v["text"]), "; ").alias("text"), F.transform("x", lambda v: v["key"]).alias("subjects"), F.transform("x", lambda v: v["unit_id"]).alias("refs"))


def check_prose(written: DataFrame, slots: DataFrame) -> DataFrame:
    """written (claim_id, text) with the first reason it fails, null if it passes; slots is (claim_id, subjects). Slots nobody wrote come as
    missing_claim."""
    n = F.count("*").over(Window.partitionBy("claim_id"))
    w = written.withColumn("times", n).join(slots.select("claim_id", "subjects", F.lit(True).alias("known")).dropDuplicates(["claim_id"]), "claim_id", "left")
    named = named_papers(w.select("claim_id", "text"), w.select("claim_id", F.explode_outer("subjects").alias("key")).where("key is not null"), ("claim_id",))
    named = named.groupBy("claim_id").agg(F.collect_set("named").alias("named"))
    w = w.join(named, "claim_id", "left")
    foreign = F.size(F.array_except(F.coalesce("named", F.array().cast("array<string>")), F.coalesce("subjects", F.array().cast("array<string>")))) > 0
    t = F.coalesce("text", F.lit(""))
    why = F.when(F.col("known").isNull(), "unknown_claim_id").when(F.col("times") > 1, "duplicate_claim_id").when((F.trim(t) == "") | (F.length(t) > 8000), "empty_or_oversized_text")
    why = why.when(t.rlike(UNSAFE) | t.rlike(RANKING) | t.rlike(NUMERIC), "unsupported_prose_or_citation").when(foreign, "unsupported_named_paper")
    out = w.select("claim_id", why.alias("reason"))
    missing = slots.select("claim_id").join(out.where("reason is null").select("claim_id"), "claim_id", "left_anti").select("claim_id", F.lit("missing_claim").alias("reason"))
    return out.unionByName(missing)


def violations(papers: DataFrame, units: DataFrame, members: DataFrame, unassigned: DataFrame, refs: DataFrame, *, clusters: DataFrame | None = None, cards: DataFrame | None = None, used_clusters: DataFrame | None = None, schema_version: str = "1", digest: str = "-") -> DataFrame:
    """(rule_no, rule, broken): how many rows break each rule of a snapshot. papers (key, core, version), units (unit_id, key, text), members
    (cluster, key), unassigned (key), refs (ref, and perhaps place: summary, comparison or gap); clusters (cluster, size), cards (key, ref) and used_clusters (cluster, place: summary or
    comparison) are checked where given. require_valid raises the first."""
    known = papers.select("key").distinct()
    twice = lambda df, c: df.groupBy(c).count().where("count > 1")
    placed = members.select("key").distinct()
    spark = papers.sparkSession
    fact = lambda bad: spark.range(1 if bad else 0)
    lost = refs.join(units.select(F.col("unit_id").alias("ref")), "ref", "left_anti")
    # The names of the rules.
    rules = [("unsupported_synthesis_schema", fact(schema_version != "1")), ("missing_corpus_digest", fact(not digest.strip())), ("duplicate_paper_key", twice(papers, "key")), ("duplicate_unit_id", twice(units, "unit_id"))]
    if clusters is not None:
        rules.append(("duplicate_cluster_id", twice(clusters, "cluster")))
    rules += [
        ("noncanonical_paper_key", papers.where(F.col("key") != T.paper_key("core", "version"))),
        ("invalid_arxiv_identifier", papers.where(~F.col("key").rlike(r"(?i)^(?:\d{4}\.\d{4,5}|[a-z][a-z0-9.-]*/\d{7})v[1-9]\d*$"))),
    ]
    if cards is not None:
        owner = units.select(F.col("unit_id").alias("ref"), F.col("key").alias("owner"))
        rules.append(("invalid_card_reference", cards.join(owner, "ref", "left").where("owner is null or owner != key")))
    rules.append(("invalid_evidence_owner_or_text", units.where(F.trim(F.coalesce("text", F.lit(""))) == "").select("key").union(units.select("key").join(known, "key", "left_anti"))))
    if clusters is not None:
        held = members.groupBy("cluster").agg(F.count("*").alias("held"))
        rules.append(("invalid_cluster_size", clusters.join(held, "cluster", "left").where("held is null or size is null or size != held")))
    rules += [
        ("unknown_cluster_paper", placed.join(known, "key", "left_anti")), ("duplicate_membership", twice(members, "key")), ("duplicate_unassigned", twice(unassigned, "key")),
        ("assigned_and_unassigned", placed.join(unassigned, "key", "left_semi")), ("unknown_unassigned_paper", unassigned.join(known, "key", "left_anti")),
        ("missing_membership_disposition", known.join(placed.union(unassigned.select("key")), "key", "left_anti")),
    ]
    if used_clusters is not None:
        foreign = used_clusters.join((clusters if clusters is not None else members).select("cluster").distinct(), "cluster", "left_anti")
        rules += [(f"unknown_{x}_cluster", foreign.where(F.col("place") == x)) for x in ("summary", "comparison")]
    if "place" in refs.columns:
        rules += [(f"dangling_{x}_ref", lost.where(F.col("place") == x)) for x in ("summary", "comparison", "gap")]
    else:
        rules.append(("dangling_ref", lost))
    out = None
    for i, (name, bad) in enumerate(rules):
        row = bad.agg(F.count("*").alias("broken")).select(F.lit(i).alias("rule_no"), F.lit(name).alias("rule"), "broken")
        out = row if out is None else out.unionByName(row)
    return out


def require_valid(found: DataFrame) -> None:
    first = found.where("broken > 0").orderBy("rule_no").take(1)
    if first:
        raise ValueError(first[0].rule)


def backlinks(claims: DataFrame) -> DataFrame:
    """(ref, claims): for every reference the claims that use it, in order."""
    r = claims.select("claim_no", F.explode("refs").alias("ref")).distinct()
    return r.groupBy("ref").agg(F.array_join(F.transform(F.sort_array(F.collect_list("claim_no")), lambda x: x.cast("string")), ",").alias("claims"))


def is_boilerplate(x: str) -> Column:
    return F.trim(x).rlike(BOILERPLATE)
