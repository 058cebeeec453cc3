from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import names

NICK = [("Theodore", "Theo"), ("susan", "Sue"), ("Richard", "Dick")]


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 3))
def test_banded_distance(a, b, k):
    assert names.within(a, b, k) == (osa(a, b) <= k)


def test_segment_join_against_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 8))) for _ in range(160)})
    t = spark.createDataFrame([("x", w) for w in words] + [(None, "abcd"), ("x", None), ("y", "abcd")], "block string, name string")
    for k in (1, 2):
        got = {(r.a, r.b) for r in names.segment_join(t, t, k).collect()}
        want = {(a, b) for a, b in itertools.permutations(words, 2) if osa(a, b) <= k}
        assert got == want
    same = names.segment_join(t, t, 0, same=True)
    assert {(r.a, r.b) for r in same.where("block = 'x'").collect()} == {(w, w) for w in words}


def hits(spark, lists):
    return spark.createDataFrame([(x, "c", 1) for x in lists], "authors string, spelling string, n int")


def nick(spark):
    return spark.createDataFrame(NICK, "formal string, short_form string")


def groups(spark, lists):
    out = {}
    for r in names.link_spellings(hits(spark, lists), nick(spark)).collect():
        out.setdefault(r.entity, set()).add(r.spelling)
    return {frozenset(v) for v in out.values()}


def test_variants_of_people_and_organisations(spark):
    got = groups(spark, ["Susan D. Wogedelume", "Sue Wogedelume; Wogedelume, S.", "WOGEDELUME Susan", "susan wogedelume and Richard Bruurollund", "S.D. Wogedelume", "Susan Wogedelmue", "Susan Wogedelume", "Peter P. Bruurollund, Dick Bruurollund", "P Bruurollund",
                         "Lurovarmar Collaboration for Tensor Studies", "Lurovarmar Collab. Tensor Stud.; Collab. f. Tensor Stud. Lurovarmar", "The Lurovarmar Collaboration for Tensor Studies", "Süsan Wogedelume", *(f"{w} {k} for {f}" for w, k, f in zip(["Balagdez", "Fenonjun", "Jitedurjun", "Hulasonins"] * 3, ["Collaboration", "Institute", "Laboratory"] * 4, ["Tensor Studies", "Open Data"] * 6)), *(f"{w} Collab. Tensor Stud." for w in ("Mikopol", "Novibant", "Zanubad"))])
    assert frozenset({"Susan D. Wogedelume", "Sue Wogedelume", "Wogedelume, S.", "WOGEDELUME Susan", "susan wogedelume", "S.D. Wogedelume", "Susan Wogedelmue", "Susan Wogedelume", "Süsan Wogedelume"}) in got
    assert frozenset({"Richard Bruurollund", "Dick Bruurollund"}) in got and frozenset({"Peter P. Bruurollund", "P Bruurollund"}) in got
    assert any("Collab. f. Tensor Stud. Lurovarmar" in g and "Lurovarmar Collaboration for Tensor Studies" in g for g in got)


def test_lists_are_cut_as_stated(spark):
    rows = names.spellings(hits(spark, ["A. One, B. Two, and C. Three & D. Four et al.", "Five, E.; F.   Six ;", "et al.", "", None, "  G. Seven  "])).collect()
    assert {r.spelling for r in rows} == {"A. One", "B. Two", "C. Three", "D. Four et al.", "Five, E.", "F. Six", "G. Seven"}


def test_empty_table(spark):
    assert names.link_spellings(hits(spark, []), nick(spark)).count() == 0
    assert names.link_spellings(hits(spark, [None, "", "et al."]), nick(spark).limit(0)).count() == 0


def test_pairs_are_all_pairs(spark):
    e = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "spelling string, entity string")
    assert {tuple(r) for r in names.spelling_pairs(e).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_very_long_and_odd_names(spark):
    got = groups(spark, ["x" * 5000, "!!!", "a", "Ann " + "b" * 300, "Ann " + "b" * 299 + "c"])
    assert sum(len(g) for g in got) == 5


def test_particles_several_given_names_and_two_surnames(spark):
    got = groups(spark, ["Ludwig van Beethoven; L. Beethoven; Beethoven, L. van", "Vincent van Gogh; van Gogh, Vincent; V. van Gogh", "Anna Maria Schmidt; A. M. Schmidt; Schmidt, Anna Maria",
                         "Garcia Lopez, Juan; J. Garcia Lopez; Lopez, J.", "University of Oxford; The University of Oxford", "Susan Wogedelume"])
    assert frozenset({"Ludwig van Beethoven", "L. Beethoven", "Beethoven, L. van"}) in got
    assert frozenset({"Vincent van Gogh", "van Gogh, Vincent", "V. van Gogh"}) in got
    assert frozenset({"Anna Maria Schmidt", "A. M. Schmidt", "Schmidt, Anna Maria"}) in got
    assert any({"Garcia Lopez, Juan", "Lopez, J."} <= g for g in got)
    assert frozenset({"University of Oxford", "The University of Oxford"}) in got


def test_organisations_are_told_by_other_spellings(spark):
    kinds = {r.spelling: r.kind for r in names.with_kinds(names.spellings(hits(spark, ["Alpha Collab. Tensor Stud.", "Beta Collab. Tensor Stud.", "Anna Maria Keller", "Anna Maria Huber", "Maria Anna Huber"])), nick(spark).select("formal").toDF("word")).collect()}
    assert {k for k, v in kinds.items() if v == "org"} == {"Alpha Collab. Tensor Stud.", "Beta Collab. Tensor Stud."}


def test_pairs_of_a_large_entity_are_made_in_blocks(spark):
    from corpusloom.llm.common import pairs_within

    e = spark.createDataFrame([(f"s{i:03d}", "x") for i in range(60)] * 2, "spelling string, entity string")
    assert pairs_within(e, "entity", "spelling", "a", "b", block=7).count() == 60 * 59 // 2


def test_links_are_read_from_tables(spark):
    """The last plan holds none of the steps before it: plans of hundreds of operators, each with its broadcasts, fill the driver's memory."""
    df = names.link_spellings(hits(spark, ["Anna Keller", "A. Keller", "Anna Kellre", "Bert Huber"]), nick(spark))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") <= 1
    found = {r.spelling: r.entity for r in df.collect()}
    assert len(found) == 4 and found["Anna Keller"] != found["Bert Huber"]
