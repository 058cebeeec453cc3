"""Text and extraction queries over papers and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import extraction as X
from corpusloom.plans.base import query, sql_key, table

WS = r"[\t\n\v\f\r \x{85}\p{Z}]"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
#: Names that the test papers can mention, in place of a catalog of datasets.
CATALOG = {n: [rf"\b{n}\b"] for n in ("TidalWeb", "GlacierTab", "MarlinQA", "PebbleVQA")}


def norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace({c}, chr(173), ''), '({WORD})-{WS}+({WORD})', '\\1\\2', 'g'), '{WS}+', ' ', 'g'))"


def heading(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '^(appendix|section|chapter){WS}+', ''), '^[\\d.]+\\s*', ''), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def kind(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({heading(c)}, '{'|'.join(words)}') THEN '{k}'" for k, words in T.HEADING_KINDS) + " ELSE 'other' END"


DOCS = f"""docs AS (SELECT * FROM (SELECT {sql_key('arxiv_id', 'version')} AS key, title, abstract, source_kind, sections, parsed_at,
 row_number() OVER (PARTITION BY {sql_key('arxiv_id', 'version')} ORDER BY parsed_at) AS r FROM paper_doc) WHERE r = 1)"""
SECTIONS = f"""sec AS (SELECT key, sec_no, heading, text, {kind('heading')} AS kind FROM (SELECT key, sec_no, coalesce(s.heading, '') AS heading, coalesce(s.text, '') AS text
 FROM (SELECT key, unnest(sections) AS s, (generate_subscripts(sections, 1) - 1)::INT AS sec_no FROM docs)))"""


def sentences(source: str, keys: str, text: str) -> str:
    return f"""parts AS (SELECT {keys}, trim(p) AS p, i FROM (SELECT {keys}, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT {keys}, string_split(regexp_replace({norm(text)}, '([.!?]) ([A-Z0-9])', '\\1' || chr(31) || '\\2', 'g'), chr(31)) AS l FROM {source}))),
fit AS (SELECT *, CASE WHEN length(p) >= 40 OR row_number() OVER (PARTITION BY {keys} ORDER BY i) = 1 THEN 1 ELSE 0 END AS starts FROM parts WHERE length(p) BETWEEN 20 AND 600),
isl AS (SELECT *, sum(starts) OVER (PARTITION BY {keys} ORDER BY i) AS g FROM fit),
sent AS (SELECT {keys}, (row_number() OVER (PARTITION BY {keys} ORDER BY g) - 1)::INT AS sent_no, sentence FROM (SELECT {keys}, g, string_agg(p, ' ' ORDER BY i) AS sentence FROM isl GROUP BY {keys}, g))"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "paper_doc").withColumn("key", T.paper_key("arxiv_id", "version"))
    w = Window.partitionBy("key").orderBy("parsed_at")
    return p.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


@query(f"SELECT doc_id, sha256({norm('text')}) AS digest, length({norm('text')})::INT AS n FROM documents WHERE text IS NOT NULL")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select("doc_id", T.normalize_text("text").alias("t"))
    return t.select("doc_id", F.sha2("t", 256).alias("digest"), F.length("t").alias("n"))


@query(f"WITH {DOCS}, {SECTIONS} SELECT heading, {heading('heading')} AS norm, kind, count(*) AS n FROM sec GROUP BY ALL")
def heading_class(spark: SparkSession, d: str) -> DataFrame:
    s = X.explode_sections(docs(spark, d)).withColumn("norm", T.normalize_heading("heading"))
    return s.groupBy("heading", "norm", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {sentences('(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)', 'doc_id', 'text')} SELECT doc_id, sent_no, sentence FROM sent")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(X.sentences_of("text")).alias("sent_no", "sentence"))
    return t


def _scores() -> str:
    out = []
    for i, (k, (patterns, preferred, _)) in enumerate(X.SNIPPETS.items()):
        hit = f"(CASE WHEN regexp_matches(lower(sentence), '{'|'.join(chr(92) + 'b' + p + chr(92) + 'b' for p in patterns)}') THEN 4.0 ELSE 0.0 END)"
        pref = "(CASE WHEN kind IN (" + ", ".join(f"'{p}'" for p in preferred) + ") THEN 3.0 ELSE 0.0 END)"
        out.append(f"SELECT key, sec_no, sent_no, sentence, '{k}' AS k, {i} AS o, {hit} + {pref} - (CASE WHEN kind IN ('related', 'biblio', 'appendix') THEN 4.0 ELSE 0.0 END) AS score FROM ss")
    return " UNION ALL ".join(out)


SCORED = f"""{sentences('sec', 'key, sec_no, kind', 'text')},
ss AS (SELECT key, sec_no, kind, sent_no, sentence FROM sent), allk AS ({_scores()}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, sec_no, sent_no ORDER BY score DESC, o) AS r FROM allk) WHERE r = 1 AND score >= 3),
uniq AS (SELECT key, sentence, k, o, score, plc.s AS sec_no, plc.t AS sent_no FROM (SELECT *, row_number() OVER (PARTITION BY key, sentence ORDER BY score DESC, sec_no, sent_no) AS q, min({{'s': sec_no, 't': sent_no}}) OVER (PARTITION BY key, sentence) AS plc FROM best) WHERE q = 1)"""
RANKED = """top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, k ORDER BY score DESC, sec_no, sent_no) AS rn FROM uniq) WHERE rn <= 8),
cap AS (SELECT *, coalesce((SELECT count(*) FROM top u WHERE u.key = t.key AND u.o < t.o), 0) AS before FROM top t)"""


@query(f"WITH {DOCS}, {SECTIONS}, {SCORED}, {RANKED} SELECT c.key, upper(left(k, 1)) || rn AS id, k AS kind, c.sec_no, sent_no, sentence, score::DOUBLE AS score, CASE WHEN strpos(s.text, sentence) > 0 THEN strpos(s.text, sentence) - 1 END::INT AS start_char, CASE WHEN strpos(s.text, sentence) > 0 THEN strpos(s.text, sentence) - 1 + length(sentence) END::INT AS end_char FROM cap c JOIN sec s ON s.key = c.key AND s.sec_no = c.sec_no WHERE rn = 1 OR before + rn <= 28")
def snippet_rank(spark: SparkSession, d: str) -> DataFrame:
    s = X.explode_sections(docs(spark, d))
    return X.with_spans(X.rank_snippets(X.score_snippets(s)), s, "sentence")


@query(f"""WITH {DOCS}, {SECTIONS}, {SCORED},
bf AS (SELECT key, sec_no, sent_no, sentence, row_number() OVER (PARTITION BY key ORDER BY sec_no, sent_no) AS rr FROM sent WHERE kind IN ('method', 'always') AND sent_no < 4 AND key NOT IN (SELECT key FROM uniq WHERE k = 'method'))
SELECT key, k AS kind, count(*) AS n, sum(score)::DOUBLE AS points FROM (SELECT key, k, score FROM uniq UNION ALL SELECT key, 'method', 1.0 FROM bf WHERE rr <= 4) GROUP BY ALL""")
def snippet_backfill(spark: SparkSession, d: str) -> DataFrame:
    s = X.explode_sections(docs(spark, d))
    out = X.backfill(s, X.score_snippets(s), "method", ["method", "always"])
    return out.groupBy("key", "kind").agg(F.count("*").alias("n"), F.sum("score").alias("points"))


@query()
def mention_best(spark: SparkSession, d: str) -> DataFrame:
    return X.find_mentions(X.explode_sections(docs(spark, d)), CATALOG, 2.5)


BUDGET = 6000


@query(f"""WITH RECURSIVE {DOCS}, {SECTIONS},
o AS (SELECT key, sec_no, heading, text, row_number() OVER (PARTITION BY key ORDER BY CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in T.HEADING_PRIORITY.items())} END, sec_no) AS i FROM sec WHERE kind NOT IN ('related', 'appendix', 'biblio')),
f AS (SELECT key, i, 0 AS sec_no, '' AS heading, '' AS text, 0 AS used, 0 AS taken, false AS took FROM o WHERE i = 1),
w(key, i, sec_no, heading, text, used, taken, took) AS (SELECT key, 0::BIGINT, 0, '', '', 0::BIGINT, 0, false FROM f
 UNION ALL SELECT key, i, sec_no, heading, CASE WHEN fits THEN text ELSE cut END, used + CASE WHEN take THEN length(heading) + 2 + length(CASE WHEN fits THEN text ELSE cut END) ELSE 0 END, taken + CASE WHEN take THEN 1 ELSE 0 END, take FROM (
  SELECT *, used < {BUDGET} AND (fits OR ({BUDGET} - used >= 400 AND cut <> '')) AS take FROM (
  SELECT o.key, o.i, o.sec_no, o.heading, o.text, w.used, w.taken, (w.taken = 0 OR w.used + length(o.heading) + 2 + length(o.text) <= {BUDGET}) AS fits,
   trim(CASE WHEN length(o.text) <= {BUDGET} - w.used - length(o.heading) - 2 THEN o.text ELSE regexp_replace(left(o.text, greatest({BUDGET} - w.used - length(o.heading) - 2, 0)), ' [^ ]*$', '') END) AS cut
  FROM w JOIN o ON o.key = w.key AND o.i = w.i + 1)))
SELECT key, (taken - 1)::INT AS ord, sec_no, heading, length(text)::INT AS n, used::INT AS used FROM w WHERE took""")
def section_budget(spark: SparkSession, d: str) -> DataFrame:
    s = X.select_sections(X.explode_sections(docs(spark, d)).where(X.allowed("kind")), BUDGET)
    w = Window.partitionBy("key").orderBy("ord")
    return s.select("key", "ord", "sec_no", "heading", F.length("text").alias("n"), F.sum("cost").over(w).cast("int").alias("used"))


@query(f"""WITH {DOCS}, {SECTIONS}, q AS (SELECT key, sec_no AS quote_no, substr({norm('text')}, 30, 60) AS quote, heading AS section FROM sec),
h AS (SELECT q.key, q.quote_no, s.sec_no, ({heading('section')} <> '' AND {heading('s.heading')} <> '' AND (contains({heading('section')}, {heading('s.heading')}) OR contains({heading('s.heading')}, {heading('section')}))) AS declared
 FROM q JOIN sec s USING (key) WHERE {norm('q.quote')} <> '' AND contains({norm('s.text')}, {norm('q.quote')})),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, quote_no ORDER BY declared DESC, sec_no) AS r FROM h) WHERE r = 1)
SELECT q.key, q.quote_no, q.quote, b.sec_no, CASE WHEN b.key IS NOT NULL AND strpos(t.text, {norm('q.quote')}) > 0 THEN strpos(t.text, {norm('q.quote')}) - 1 END AS start_char, CASE WHEN b.key IS NULL THEN 'invalid' WHEN declared THEN 'exact' ELSE 'relocated' END AS found FROM q LEFT JOIN b ON q.key = b.key AND q.quote_no = b.quote_no LEFT JOIN sec t ON t.key = b.key AND t.sec_no = b.sec_no""")
def quote_grounding(spark: SparkSession, d: str) -> DataFrame:
    s = X.explode_sections(docs(spark, d))
    q = s.select("key", F.col("sec_no").alias("quote_no"), F.substring(T.normalize_text("text"), 30, 60).alias("quote"), F.col("heading").alias("section"))
    return X.locate_quotes(q, s).select("key", "quote_no", "quote", "sec_no", F.col("start_char").cast("long").alias("start_char"), "found")


# Beginnings put before every text, so that each rule has rows.
BEGINNINGS = {"plain": "", "page": "<!DOCTYPE html>", "late": "x <HTML>", "tex": " \n\\", "inside": "see \\section", "paper": "%PDF-1.5 "}


@query("WITH p AS (SELECT doc_id, form, pre || text AS t FROM documents, (VALUES ('plain', ''), ('page', '<!DOCTYPE html>'), ('late', 'x <HTML>'), ('tex', ' ' || chr(10) || chr(92)), ('inside', 'see ' || chr(92) || 'section'), ('paper', '%PDF-1.5 ')) v(form, pre) WHERE text IS NOT NULL) "
       "SELECT doc_id, form, CASE WHEN starts_with(t, '%PDF') THEN 'pdf' WHEN starts_with(ltrim(lower(left(t, 200)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '<!doctype') OR contains(lower(left(t, 200)), '<html') THEN 'html' "
       "WHEN starts_with(ltrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(92)) THEN 'tex' ELSE 'unknown' END AS kind FROM p")
def sniff_kind(spark: SparkSession, d: str) -> DataFrame:
    forms = F.explode(F.create_map(*[F.lit(x) for kv in BEGINNINGS.items() for x in kv])).alias("form", "begin")
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text", forms)
    return t.select("doc_id", "form", T.sniff(F.concat("begin", "text")).alias("kind"))


@query("""SELECT doc_id, (octet_length(encode(text)) + 64)::INT AS tokens, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(left(text, 120), ' [^ ]*$', '') END AS short,
left(sha256(concat_ws('|', source, text)), 12) AS unit FROM documents WHERE text IS NOT NULL""")
def text_measures(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", T.estimate_tokens("text").alias("tokens"), T.trim_to_blank("text", 120).alias("short"), T.short_hash(12, "source", "text").alias("unit"))


@query(f"""WITH {DOCS}, {SECTIONS}, m AS (SELECT key, sec_no, string_split(text, '. ') AS p FROM sec)
SELECT key, sec_no, i::INT AS nth, trim(p[i + 1]) AS body FROM (SELECT key, sec_no, p, unnest(range(1, len(p))) AS i FROM m)""")
def section_extents(spark: SparkSession, d: str) -> DataFrame:
    """What follows every sentence end of a section, up to the next one: markers with their places, and the extents between them."""
    s = X.explode_sections(docs(spark, d)).withColumn("p", F.split("text", r"\. "))
    place = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(i.alias("nth"), (1 + F.length(F.array_join(F.slice("p", 1, i), ". "))).alias("pos")))
    s = s.where("size(p) > 1").select("key", "sec_no", "text", F.explode(place).alias("m")).select("key", "sec_no", "text", "m.*")
    m = s.select(F.concat_ws("#", "key", "sec_no").alias("key"), F.col("key").alias("k"), "sec_no", "nth", "text", "pos", (F.col("pos") + 2).alias("end"))
    return X.extents(m, "text").select(F.col("k").alias("key"), "sec_no", "nth", "body")
