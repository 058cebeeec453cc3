import io
import math
import random
import tarfile

import numpy as np
import pytest

from corpusloom.operators import evidence as E
from corpusloom.operators import extraction as X
from corpusloom.operators import features as V
from corpusloom.operators import identity as I
from corpusloom.operators import metrics as M
from corpusloom.operators import retrieval as R
from corpusloom.operators import review as W
from corpusloom.operators.expansion import model_queries
from corpusloom.sources import corpus as C
from corpusloom.sources import papers as P
from corpusloom.streaming import quota as Q
from tests.test_staging import stop_after


@pytest.fixture(scope="module")
def small(spark):
    corpus = spark.createDataFrame([("r0", [1.0, 0.0]), ("r1", [0.6, 0.8])], "key string, vec array<float>")
    queries = spark.createDataFrame([(1, 0, [1.0, 0.0])], "topic_id long, q_idx int, embedding array<float>")
    meta = spark.createDataFrame([("r0", 2024, "cs.LG"), ("r1", None, "cs.CV")], "key string, year int, matched_categories string")
    return corpus, queries, meta


def keywords(spark, rows):
    return spark.createDataFrame(rows, "topic_id long, pos int, key string")


def test_keyword_hit_outside_the_pool_enters_it(spark, small):
    corpus, queries, meta = small
    got = R.retrieve(corpus, queries, meta, keywords(spark, [(1, 1, "r1"), (1, 2, "unknown")]), pool_size=1).orderBy("rank").collect()
    assert [(r.key, r.keyword_rank, r.broad_score) for r in got] == [("r0", None, 1.0), ("r1", 1, 0.0)]
    assert got[0].rrf_score == pytest.approx(1 / 61, abs=1e-9)


def test_one_ranking_has_no_fused_part_and_null_years_fail(spark, small):
    corpus, queries, meta = small
    got = R.retrieve(corpus, queries, meta, keywords(spark, []), condition=R.passes(2020, None)).collect()
    assert [(r.key, r.rrf_score) for r in got] == [("r0", None)]
    assert R.retrieve(corpus.limit(0), queries, meta, keywords(spark, [])).count() == 0
    assert R.search(corpus, queries.limit(0), 5).count() == 0


def test_search_by_blocks_equals_plain_expressions(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{i:03d}", rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(200)]
    corpus = R.clean_vectors(spark.createDataFrame(rows + rows[:5] + [("null", None), (None, [1.0] * 6)], "paper_key string, matrix array<float>"))
    queries = spark.createDataFrame([(1, i, rng.normal(size=6).tolist()) for i in range(7)], "topic_id long, q_idx int, embedding array<float>")
    a, b = R.search(corpus.repartition(5), queries, 9), R.search_sql(corpus, queries, 9)
    cols = ["topic_id", "q_idx", "key", "pos"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_first_position_of_a_repeat_counts(spark):
    r = spark.createDataFrame([(1, "x", "a", 1), (1, "x", "a", 2), (1, "x", "b", 3)], "topic_id long, ranking string, key string, pos int")
    got = {x.key: x.rrf_score for x in R.fuse_ranks(r).collect()}
    assert got == {"a": pytest.approx(1 / 61), "b": pytest.approx(1 / 63)}


def test_missing_rows_are_an_error(spark):
    ids = spark.createDataFrame([(1, "a"), (2, "z")], "pos int, key string")
    with pytest.raises(LookupError):
        R.require_all(ids, spark.createDataFrame([("a", 1)], "key string, v int"), "key")


def test_model_queries(spark):
    rows = [(1, 'Sure: ```json\n{"queries": ["A  b", "a B", "", "c", "d"]}```'), (2, "no json"), (3, '{"queries": 3}')]
    got = model_queries(spark.createDataFrame(rows, "topic_id long, answer string"), ["topic_id"], "answer", 2).collect()
    assert [(r.topic_id, r.pos, r.expanded) for r in sorted(got, key=lambda r: r.pos)] == [(1, 0, "A b"), (1, 1, "c")]


def test_snippet_cap_is_one_beyond(spark):
    rows = [("d", k, float(9 - s), i, s, f"{k}{s}") for i, k in enumerate(X.SNIPPETS) for s in range(9)]
    df = spark.createDataFrame(rows, "key string, kind string, score double, sec_no int, sent_no int, sentence string")
    got = X.rank_snippets(df).collect()
    count = {k: sum(r.kind == k for r in got) for k in X.SNIPPETS}
    assert list(count.values()) == [8, 8, 8, 4, 1]
    assert min((r.id for r in got if r.kind == "method")) == "M1"


def test_mentions_prefer_results(spark):
    s = spark.createDataFrame([("d", 0, "related", "CIFAR-10 is known."), ("d", 1, "results", "We evaluate on CIFAR-10, for example.")], "key string, sec_no int, kind string, text string")
    got = X.find_mentions(s, {"CIFAR-10": [r"\bCIFAR[- ]?10\b"]}, 2.5).collect()
    assert [(r.sec_no, r.score, r.start) for r in got] == [(1, 8.0, 15)]


def test_budget_skips_and_cuts(spark):
    s = [("d", 0, "Method", "m " * 600, "method"), ("d", 1, "Results", "r " * 2000, "results"), ("d", 2, "Other", "o " * 20, "other")]
    df = spark.createDataFrame(s, "key string, sec_no int, heading string, text string, kind string")
    got = {r.sec_no: r for r in X.select_sections(df, 1300).collect()}
    assert set(got) == {0, 2} and got[0].text == "m " * 600
    got = {r.sec_no: r for r in X.select_sections(df, 2000).collect()}
    assert got[1].text.endswith("r") and sum(r.cost for r in got.values()) <= 2000


def test_quotes_and_references(spark):
    s = spark.createDataFrame([("d", 0, "Method", "alpha beta gamma"), ("d", 1, "Results", "delta epsilon")], "key string, sec_no int, heading string, text string")
    q = spark.createDataFrame([("d", 0, "beta gamma", "3 Methods"), ("d", 1, "delta", "Method"), ("d", 2, "zeta", "Method")], "key string, quote_no int, quote string, section string")
    assert {r.quote_no: r.found for r in X.locate_quotes(q, s).collect()} == {0: "exact", 1: "relocated", 2: "invalid"}
    snip = spark.createDataFrame([("d", "M1")], "key string, id string")
    rec = spark.createDataFrame([("d", "method", 0, "t", [" m1 ", "M9"]), ("d", "result", 0, "t", ["X"]), ("d", "problem", 0, "t", None)], "key string, field string, ord int, text string, evidence_ids array<string>")
    got = {r.field: (r.kept, r.unknown, r.status) for r in X.ground_records(rec, snip).collect()}
    assert got == {"method": (["M1"], ["M9"], "degraded"), "result": ([], ["X"], "dropped"), "problem": ([], [], "dropped")}


def test_inventory_rules(spark):
    rows = [(0, "a.1v1", "a.1", "v1", "ok", "m", ""), (1, "a.1v1", "a.1", "v1", "ok", "m", ""), (2, "a.1v2", "a.1", "v2", "degraded", "m", ""), (3, "bv1", "b", None, "skipped", "m", "boom"), (4, "cv1", "c", "", "ok", "  ", ""), (5, "dv1", "d", "v1", None, "m", "")]
    df = spark.createDataFrame(rows, "idx int, key string, core string, version string, status string, method string, error string")
    got = {r.idx: (r.disposition, r.reason) for r in I.inventory(df).collect()}
    assert got[0] == ("superseded_version", "kept a.1v2") and got[1][0] == "duplicate" and got[2][0] == "accepted" and got[3] == ("skipped", "boom") and got[4][0] == "missing_method" and got[5][0] == "skipped"
    assert {r.idx for r in I.inventory(df, strict=True).where("disposition = 'strict_ok_excluded'").collect()} == {2, 5}
    with pytest.raises(ValueError, match="a.1v1"):
        I.require_no_conflicts(spark.createDataFrame([("a.1v1", "x"), ("a.1v1", "y")], "key string, payload string"))


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([("x", 1), ("y", None), ("x", 1)], "k string, v int")
    b = spark.createDataFrame([("y", None), ("x", 1), ("x", 1)], "k string, v int")
    assert I.corpus_digest(a, "k", "v").first() == I.corpus_digest(b, "k", "v").first() != I.corpus_digest(a.distinct(), "k", "v").first()


def test_average_linkage(spark):
    rows = [("c", "a", [1.0, 0.0]), ("c", "b", [0.99, 0.05]), ("c", "d", [0.0, 1.0]), ("c", "z", [0.0, 0.0]), ("one", "x", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "collection string, key string, vec array<double>")
    got = {(r.collection, r.key): r.cluster for r in V.agglomerate(df, 0.2).collect()}
    assert got == {("c", "a"): 0, ("c", "b"): 0, ("c", "d"): 1, ("c", "z"): 2, ("one", "x"): 0}
    assert V.agglomerate(df.limit(0), 0.2).count() == 0


def test_similar_pairs_against_all_pairs(spark):
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"w{(i * j) % 17}" for j in range(1, 12))) for i in range(40)] + [("null", None), ("e", "")], "key string, text string")
    f = V.tfidf(V.terms(docs))
    own = {}
    for r in f.collect():
        own.setdefault(r.key, {})[r.term] = r.weight
    want = {(a, b) for a in own for b in own if a < b and sum(x * own[b].get(t, 0) for t, x in own[a].items()) >= 0.5}
    assert {(r.a, r.b) for r in V.similar_pairs(f, 0.5, ("term",)).collect()} == want


def test_similar_pairs_meet_in_blocks(spark):
    rng = random.Random(3)
    rows = [(f"d{i:03}", rng.choice("abcdef") if i % 4 else "a", f"t{rng.randrange(60)}" if rng.random() < 0.4 else f"c{rng.randrange(4)}", rng.choice([0.5, 1.0, 2.0, -0.5])) for i in range(150) for _ in range(6)]
    f = spark.createDataFrame(rows + [(None, "a", "t1", 1.0)], "key string, channel string, term string, weight double")
    own = {}
    for k, c, t, w in rows:
        own.setdefault(k, {}).setdefault((c, t), []).append(w)
    own = {k: {t: sum(w) for t, w in v.items()} for k, v in own.items()}
    want = {(a, b): sum(x * own[b].get(t, 0) for t, x in own[a].items()) for a in own for b in own if a < b}
    want = {k: round(v, 9) for k, v in want.items() if v >= 0.8}
    for block in (8000, 40):
        found = V.similar_pairs(f, 0.8, block=block)
        assert {(r.a, r.b): round(r.similarity, 9) for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]  # above the blocks: no row for each term of each pair


def test_claims(spark):
    units = spark.createDataFrame([("2101.00001v1", "method", None, "method", "m1"), ("2101.00002v1", "method", None, "method", "m2"), ("2101.00003v1", "dataset", 0, "dataset", "x")], "key string, field string, ord int, kind string, text string")
    u = E.registry(units)
    ids = {r.key: r.unit_id for r in u.collect()}
    k = sorted(ids)
    members = spark.createDataFrame([("c", k[0]), ("c", k[1])], "cluster string, key string")
    rows = [(1, "c", "shared", "both", [k[0], k[1]], [ids[k[0]], ids[k[1]]]), (2, "c", "shared", "one", [k[0], k[1]], [ids[k[0]]]), (3, "c", "shared", "named 2101.00009v99", [k[0]], [ids[k[0]], "e_nope", ids[k[2]]]), (4, "c", "shared", " ", None, None)]
    got = {r.claim_no: (r.status, r.reason) for r in E.validate_claims(spark.createDataFrame(rows, "claim_no int, cluster string, kind string, text string, subjects array<string>, refs array<string>"), u, members).collect()}
    assert got[1] == ("structurally_validated", None)
    assert "unsupported_subjects:2101.00002v1" in got[2][1] and "shared_requires_two_subjects" in got[2][1] and "all_members_claim_incomplete" in got[2][1]
    assert "named_unsupported_subjects:2101.00009v99" in got[3][1] and "unknown_ref:e_nope" in got[3][1] and "cross_cluster_ref" in got[3][1]
    assert got[4][1].startswith("empty_text; no_subjects")
    t = E.template_claims(u, members).first()
    assert t.kind == "shared" and t.subjects == k[:2]


def test_prose_gate(spark):
    slots = spark.createDataFrame([("w1", ["2101.00001v1"]), ("w2", ["2101.00001v1"]), ("w3", ["2101.00001v1"])], "claim_id string, subjects array<string>")
    text = [("w1", "Fine prose about 2101.00001."), ("w2", "This outperforms all."), ("zz", "x"), ("w3", "see 2101.00002v1"), ("w3", "again")]
    got = sorted((r.claim_id, r.reason) for r in E.check_prose(spark.createDataFrame(text, "claim_id string, text string"), slots).collect() if r.reason)
    assert got == [("w2", "missing_claim"), ("w2", "unsupported_prose_or_citation"), ("w3", "duplicate_claim_id"), ("w3", "duplicate_claim_id"), ("w3", "missing_claim"), ("zz", "unknown_claim_id")]


def test_snapshot_rules(spark):
    papers = spark.createDataFrame([("2101.00001v1", "2101.00001", "v1"), ("2101.00002v2", "2101.00002", "v2")], "key string, core string, version string")
    units = spark.createDataFrame([("e1", "2101.00001v1", "t")], "unit_id string, key string, text string")
    members = spark.createDataFrame([("c", "2101.00001v1")], "cluster string, key string")
    rest = spark.createDataFrame([("2101.00002v2",)], "key string")
    refs = spark.createDataFrame([("e1",)], "ref string")
    E.require_valid(E.violations(papers, units, members, rest, refs))
    with pytest.raises(ValueError, match="missing_membership_disposition"):
        E.require_valid(E.violations(papers, units, members, rest.limit(0), spark.createDataFrame([("e9",)], "ref string")))


def test_greedy_batches_equal_a_loop(spark):
    sizes = [3, 9, 2, 5, 4, 1, 8, 7, 2, 2]
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, i int, s int")
    want, used, batch = [], 0, -1
    for s in sizes:
        if s > 8:
            want.append(None)
            continue
        if batch < 0 or used + s > 8:
            used, batch = 0, batch + 1
        used += s
        want.append(batch)
    from pyspark.sql import functions as F

    got = [r.batch for r in sorted(W.greedy_batches(df, "g", F.col("i"), "s", 8).collect(), key=lambda r: r.i)]
    assert got == want


def test_batches_say_what_they_omit(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 99, 6, 4, 8])] + [(None, 0, None)], "g string, i int, s int")
    got = {(r.g, r.i): (r.batch, r.omitted) for r in W.greedy_batches(df, "g", F.col("i"), "s", 10, 2).collect()}
    assert got == {("g", 0): (0, None), ("g", 1): (None, "exceeds_batch"), ("g", 2): (1, None), ("g", 3): (1, None), ("g", 4): (None, "budget"), (None, 0): (0, None)}


def test_long_pages_go_on(spark):
    rows = [("c", f"w{i:02d}", "method", f"t{i}", f"k{i:02d}", f"e{i}") for i in range(40)]
    files = {r.file: r.content for r in W.render_bundle(spark.createDataFrame(rows, "section string, claim_id string, kind string, text string, key string, ref string"), lines=10).collect()}
    assert {"references.md", "references-3.md", "index.md"} <= set(files) and files["references-3.md"].startswith("31. k30")
    assert sum(c.count("\n- ") for f, c in files.items() if f.startswith("section-")) == 40 and "(references-3.md)" in "".join(files.values())


def test_figures_of_claims_and_records(spark):
    c = spark.createDataFrame([("structurally_validated",), ("rejected",), ("rejected",)], "status string")
    assert tuple(M.citation_keep_rate(c).first()) == (1, 3, 0.333) and tuple(M.citation_keep_rate(c.limit(0)).first()) == (0, 0, None)
    r = spark.createDataFrame([("ok", "m", ["r"]), ("ok", "m", []), ("ok", None, ["r"]), ("degraded", "m", ["r"])], "status string, method string, results array<string>")
    assert M.completeness(r).first()[0] == 0.25 and M.completeness(r.limit(0)).first()[0] == 0.0
    lab = spark.createDataFrame([("supported",), ("unsupported",), ("supported",)], "label string")
    assert tuple(M.support_shares(lab).first()) == (0.667, 0.0, 0.333, 3) and M.support_shares(lab.limit(0)).first().supported == 0.0


def test_cluster_quality_in_blocks(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5))
    rows = [(f"k{i}", f"c{min(i % 7, 5)}" if i else "alone", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [("zero", "c0", [0.0] * 5), ("null", "c0", None)], "key string, cluster string, vec array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, names = 1 - u @ u.T, np.array([r[1] for r in rows])
    for block in (8192, 9):
        got = {r.cluster: r for r in V.cluster_quality(df, block).collect()}
        assert set(got) == set(names)
        for c, r in got.items():
            own = names == c
            assert r.size == own.sum() and r.nearest_other == pytest.approx(d[own][:, ~own].min())
            if own.sum() > 1:
                assert r.mean_within == pytest.approx(d[own][:, own].sum() / (own.sum() * (own.sum() - 1)))
                s = []
                for i in np.flatnonzero(own):
                    a = d[i, own].sum() / (own.sum() - 1)
                    b = min(d[i, names == o].mean() for o in set(names) - {c})
                    s.append((b - a) / max(a, b))
                assert r.silhouette == pytest.approx(np.mean(s))
            else:
                assert r.mean_within is None and r.silhouette == 0.0
    assert V.cluster_quality(df.limit(0)).count() == 0
    one = V.cluster_summary(V.cluster_quality(df.where("cluster = 'c1'"))).first()
    assert one.silhouette is None and one.silhouette_reason and one.n_clusters == 1


def test_bundle_links(spark):
    slots = spark.createDataFrame([("c", "w1", "method", "uses [x]", "k1", "e1"), ("gaps", "w2", "limitation", "weak", "k2", "e2")], "section string, claim_id string, kind string, text string, key string, ref string")
    files = {r.file: r.content for r in W.render_bundle(slots).collect()}
    assert set(files) == {"section-c.md", "section-gaps.md", "evidence-0.md", "references.md", "index.md"}
    assert "\\[x\\]" in files["section-c.md"] and "evidence-0.md#e1" in files["section-c.md"] and files["references.md"] == "1. k1\n2. k2"


def test_ranking_metrics(spark):
    r = spark.createDataFrame([("q", 1, "a"), ("q", 2, "x"), ("q", 3, "b"), ("none", 1, "a")], "query_id string, pos int, key string")
    g = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "c", 1)], "query_id string, key string, grade int")
    got = {x.query_id: x for x in M.ranking_metrics(r, g, (1, 3)).collect()}
    assert got["q"].recall_1 == pytest.approx(1 / 3) and got["q"].recall_3 == pytest.approx(2 / 3) and got["q"].mrr == 1 and got["none"].recall_3 is None
    assert got["q"].ndcg_3 == pytest.approx((3 + 0.5) / (3 + 1 / math.log2(3) + 0.5))
    assert M.macro_mean(M.ranking_metrics(r, g, (1, 3))).first().recall_3 == pytest.approx(2 / 3)


def test_set_and_cluster_scores(spark):
    s = spark.createDataFrame([("a", [" X ", "y"], ["x"]), ("b", [], []), ("c", None, ["x"])], "key string, predicted array<string>, gold array<string>")
    got = {r.key: (r.precision, r.recall, r.f1, r.jaccard) for r in M.set_scores(s).collect()}
    assert got == {"a": (0.5, 1.0, 0.667, 0.5), "b": (1.0, 1.0, 1.0, 1.0), "c": (0.0, 0.0, 0.0, 0.0)}
    c = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", "2", "x"), ("d", "2", "y"), ("e", None, "y")], "key string, predicted string, gold string")
    r = M.cluster_agreement(c).first()
    assert (r.precision, r.recall, r.pred_pairs, r.gold_pairs) == (0.5, 0.333, 2, 3) and r.ari == 0.0


def test_numbered_shards_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i:04d}", float(i)) for i in range(250)], "key string, v double")
    C.write_corpus(df, f"file://{tmp_path}/c", "key", 100)
    got = C.open_corpus(spark, f"file://{tmp_path}/c").orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(250)) and [r.key for r in got] == sorted(r.key for r in got) and got[-1].shard == 2
    m = spark.read.json(f"file://{tmp_path}/c/manifest")
    assert {r.shard for r in C.shard_of(spark.createDataFrame([(0,), (99,), (100,), (249,), (250,)], "row_id long"), m).collect()} == {0, 1, 2}
    made = []
    make = lambda: made.append(1) or df
    for _ in range(2):
        assert C.cached(spark, f"file://{tmp_path}/k", C.fingerprint("a", 1), make).count() == 250
    assert made == [1]


def test_snapshot_reading(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id": "2101.00001", "title": "A\\n b", "abstract": "c", "categories": "cs.LG x.Y", "created": "Mon, 2 Apr 2007 19:18:42 GMT"}\nnot json\n{"id": "2101.00002", "title": "", "abstract": "c", "categories": "cs.LG"}\n')
    raw = C.read_snapshot(spark, f"file://{tmp_path}/s.json")
    got = C.normalize_records(raw, ["cs.LG"], 2000).collect()
    assert [(r.core, r.title, r.year, r.matched_categories) for r in got] == [("2101.00001", "A b", 2007, "cs.LG")]
    with pytest.raises(ValueError, match="abstract|categories|created|title"):
        C.read_strict(spark, f"file://{tmp_path}/s.json", C.S.StructType([C.S.StructField("id", C.S.StringType())]))


def test_archives_and_tex(spark):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        def add(name, text):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))

        add("main.tex", b"\\documentclass{a}\\title{A {Big} Title}\\begin{document}\\begin{abstract}Sum\\end{abstract}\nHello % no\n\\section{Intro}text 5\\% \\cite{x}\\input{sub/more}\\end{document}")
        add("sub/more.tex", b"\\subsection{Deep}inner \\input{main}")
        add("../evil.tex", b"x")
        link = tarfile.TarInfo("link.tex")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(link)
    files = P.unpack(spark.createDataFrame([("p", bytearray(buf.getvalue())), ("bad", bytearray(b"\x1f\x8bxx")), ("n", None)], "key string, content binary"))
    assert {(r.key, r.path) for r in files.collect()} == {("p", "main.tex"), ("p", "sub/more.tex")}
    r = P.parse_tex(files).first()
    assert r.title == "A Big Title" and r.abstract == "Sum" and [(s.heading, s.level) for s in r.sections] == [("Preamble", 1), ("Intro", 1), ("Deep", 2)]
    pages = spark.createDataFrame([("q", "A Title\n\nAbstract\nshort\n1 Introduction\nbody\nReferences\nx"), ("z", "")], "key string, text string")
    got = {x.key: x for x in P.parse_pages(pages).collect()}
    assert got["q"].abstract == "short" and [s.heading for s in got["q"].sections] == ["Preamble", "Abstract", "1 Introduction", "References"] and got["z"].sections == []
    body = "Graph Pruning of Things\nmore\nAbstract: we prune\n3 Graph Pruning\nwe cut ed-\nges\n3.1. Cutting deeper\ntext\nfunctional 4 x\n"
    got = P.parse_pages(spark.createDataFrame([("n", body)], "key string, text string")).first()
    assert got.title == "Graph Pruning of Things" and [(s.heading, s.text) for s in got.sections][1:] == [("3 Graph Pruning", "we cut edges"), ("3.1. Cutting deeper", "text functional 4 x")]
    listed = spark.createDataFrame([("c", ["Front page of a paper", "Methods we use\nthem", "End"], [(1, "Methods", 2), (2, "Last", 3), (1, "Gone", 9)]), ("n", None, None)], "key string, pages array<string>, contents array<struct<level:int,heading:string,page:int>>")
    got = P.parse_pages(listed).collect()
    assert [(s.heading, s.level, s.text) for s in got[0].sections] == [("Methods", 1, "we use them"), ("Last", 2, "End")] and len(got) == 1


def test_quota_replay_and_stream(spark, tmp_path):
    q = Q.Quota(rpm=5, tpm=100, rpd=50, safety=0.8, min_interval_s=0)
    a = Q.Ledger(q)
    assert a.ask(1000.0, 81)[0] == "request_exceeds_token_window"
    assert a.ask(1000.0, 10) == ("admitted", 1000.0) and a.ask(1001.0, 10) == ("deferred", 1015.0)
    assert [a.ask(t, 10)[0] for t in (1015.0, 1030.0, 1045.0)] == ["admitted"] * 3 and a.ask(1060.0, 60) == ("deferred", 1075.0)
    a.report(1060.0, "error")
    a.report(1060.0, "error")
    assert a.closed_until == 1120.0
    rows = [("g", f"2024-01-01 00:{i // 4:02d}:{15 * (i % 4):02d}", 30.0) for i in range(20)] + [("h", "2024-01-01 00:00:00", None)]
    ev = spark.createDataFrame(rows, "grp string, ts string, tokens double").selectExpr("grp", "to_timestamp(ts) AS ts", "tokens")
    batch = {(r.grp, r["at"]): r.decision for r in Q.admit(ev, q).collect()}
    ev.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = Q.admit_stream(spark.readStream.schema(ev.schema).parquet(f"file://{tmp_path}/in"), q)
    run = stream.writeStream.format("memory").queryName("admitted").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").start()
    stop_after(run, 1)
    live = {(r.grp, r["at"]): r.decision for r in spark.table("admitted").collect()}
    assert live == batch and set(batch.values()) == {"admitted", "deferred"}


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    src, dst, cp = (f"file://{tmp_path}/{x}" for x in ("src", "dst", "cp"))
    spark.createDataFrame([(1,)], "i int").coalesce(1).write.parquet(src)
    for extra in (2, 3):
        Q.ingest_once(spark.readStream.schema("i int").parquet(src), dst, cp)
        spark.createDataFrame([(extra,)], "i int").coalesce(1).write.mode("append").parquet(src)
    assert sorted(r.i for r in spark.read.parquet(dst).collect()) == [1, 2]
    with pytest.raises(ValueError):
        Q.resume_offsets(spark.createDataFrame([("other", 5)], "fingerprint string, offset long"), "mine")


def test_run_budgets(spark):
    schema = "run_id string, parent_id string, at double, tokens long, max_attempts long, max_tokens long, deadline_s double"
    r = spark.createDataFrame([("r", None, 1.0, 40, 3, 100, 60.0), ("r", None, 2.0, 40, 9, 900, 600.0), ("r", None, 3.0, 40, 9, 900, 600.0), ("r", None, 61.0, 1, 9, 900, 600.0)], schema)
    assert [x.decision for x in Q.run_budgets(r).orderBy("at").collect()] == ["allowed", "allowed", "run_budget_exhausted", "run_deadline"]
    tree = [("top", None, 0.0, 1, 3, 100, 1e6), ("a", "top", 1.0, 1, 9, 100, 1e6), ("b", "a", 2.0, 1, 9, 100, 1e6), ("c", "top", 3.0, 1, 9, 100, 1e6), ("free", None, 3.0, 1, 9, 100, 1e6)]
    got = {x.run_id: x.decision for x in Q.run_budgets(spark.createDataFrame(tree, schema)).collect()}
    assert got == {"top": "allowed", "a": "allowed", "b": "allowed", "c": "run_budget_exhausted", "free": "allowed"}
    assert Q.run_budgets(r.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Q.run_budgets(spark.createDataFrame([("x", "y", 0.0, 1, 1, 1, 1.0), ("y", "x", 0.0, 1, 1, 1, 1.0)], schema)).count()


def test_agglomerative_joins_papers_of_whole_topics(spark, tmp_path):
    from corpusloom.plans import synthesis

    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    x = base[np.arange(1200) % 60] + 0.35 * rng.normal(size=(1200, 16))
    ids = [f"{2001 + i // 100}.{i:05d}" for i in range(1200)]
    spark.createDataFrame([(1, k, "v1") for k in ids], "topic_id int, arxiv_id string, latest_version string").write.parquet(f"{tmp_path}/paper_hit.parquet")
    spark.createDataFrame([(f"{k}v1", v.tolist()) for k, v in zip(ids, x, strict=True)], "paper_key string, matrix array<float>").write.parquet(f"{tmp_path}/feature_matrix.parquet")
    got = {r.key: r.cluster for r in synthesis.agglomerative(spark, str(tmp_path)).collect()}
    items = spark.createDataFrame([("1", f"{k}v1", v.tolist()) for k, v in zip(ids, x, strict=True)], "collection string, key string, vec array<float>")
    assert got == {r.key: r.cluster for r in V.agglomerate(items, 0.4).collect()} and len(got) == 1200
    assert got[f"{ids[0]}v1"] == got[f"{ids[1140]}v1"]
