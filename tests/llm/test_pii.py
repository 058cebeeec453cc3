import random

from corpusloom.llm import pii

GIVEN = [("Susan", "Sue"), ("Theodore", "Theo"), ("Oliver", "Ollie")]
SURNAMES = ["Wogedelume", "Bruurollund", "Kovefanello", "Zimekukfeld", "Tamivesins", "Radogemholm", "Yelorunka", "Murisalwick"]


def texts():
    out = []
    for i, s in enumerate(SURNAMES * 6):
        g = ["Susan", "Theodore", "Oliver"][i % 3]
        out.append(f"Dear {g},\n\nThe {SURNAMES[i % 8]} bound holds for the measured decoder in step {i}. Please reach {g} {s} at {g.lower()}.{s.lower()}@mail.example.org or call +44 20 7946 0{100 + i}.\nBuild 202.555.0{130 + i} fixed it. "
                   f"Dropping items older than 2019-05-14 leaves ticket 77/812/4{1000 + i}. SSN 9{10 + i}-3{i % 10}-41{10 + i}. {g} {s} lives at {i + 3} {s} Road, Silig{s[:4].lower()}stad 458{10 + i}.")  # fmt: skip
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "clash", 1, 0.5) for i, t in rows], "doc_id long, text string, kind string, start int, score double")
    given = spark.createDataFrame(GIVEN, "formal string, short_form string")
    return docs, pii.find_spans(docs, given)


def test_kinds_are_found_and_decoys_are_not(spark):
    t = texts()
    _, spans = run(spark, list(enumerate(t)))
    got = {(r.doc_id, r.kind, r.value) for r in spans.collect()}
    for i, text in enumerate(t):
        own = {(k, v) for d, k, v in got if d == i}
        assert ("EMAIL", text.split(" at ")[1].split(" or ")[0]) in own
        assert ("PHONE", f"+44 20 7946 0{100 + i}") in own and ("ID", f"9{10 + i}-3{i % 10}-41{10 + i}") in own
        assert not any("202.555" in v or "2019-05" in v or "77/812" in v for _, v in own)
        assert any(k == "ADDRESS" and v.endswith(f"458{10 + i}") for k, v in own)
        assert not any(k == "NAME" and v == SURNAMES[i % 8] for k, v in own if SURNAMES[i % 8] not in text.split("Please")[1])
    assert sum(k == "NAME" for _, k, _ in got) >= len(t)


def test_redaction_keeps_the_rest(spark):
    docs, spans = run(spark, list(enumerate(texts())) + [(900, None), (901, ""), (902, "nothing here")])
    got = {r.doc_id: r for r in pii.redact(docs, spans).collect()}
    assert got[900].redacted is None and got[901].redacted == "" and got[902].redacted == "nothing here"
    assert "[EMAIL]" in got[0].redacted and "@" not in got[0].redacted and "fixed it." in got[0].redacted


def test_odd_tables(spark):
    for rows in ([], [(1, None)], [(1, "")], [(1, "a" * 300_000), (2, "1 " * 100_000), (3, "@ at (at) dot " * 2000)], [(1, "Mail x.y@z.example"), (1, "Mail x.y@z.example")]):
        _, spans = run(spark, rows)
        assert spans.count() <= 2


def test_votes_are_weighed():
    post = pii.aggregate_votes({"++": 50, "+0": 40, "0-": 60, "00": 30, "+-": 5})
    assert post["++"] > 0.9 and post["+0"] > 0.5 > post["0-"]
    assert pii.aggregate_votes({"+0": 10, "0-": 10})["0-"] < 0.1 and pii.aggregate_votes({"+0": 1000, "00": 3})["00"] < 0.5
    rows = [("++", ["<call"], "1")] * 50 + [("0-", ["<build"], "1")] * 60
    c = pii.Classifier(rows, [0.99] * 50 + [0.01] * 60)
    assert c.score("++", ["<call"], "1") > 0.9 > 0.1 > c.score("0-", ["<build"], "1")


def test_a_span_nothing_votes_for_is_not_kept():
    judge = pii.Judge({"NAME": ({}, pii.Classifier([("000", [], "Ab")], [0.99]))})
    assert judge.score("NAME", "00", [], "Ab") == 0.0 and judge.score("NAME", "0-", [], "Ab") == 0.0 and judge.score("NAME", "+0", [], "Ab") > 0.5


def test_phrases_are_learned():
    odds = pii.phrase_votes([("<call", 50, 49.0), ("<build", 40, 1.0), ("<so", 10, 5.5)], (200, 120.0))
    assert odds["<call"] > 1 and odds["<build"] < -1 and "<so" not in odds
    assert pii.with_phrases("0", ["<call", ">x"], odds) == "+0" and pii.with_phrases("+", ["<build", ">x"], odds) == "-+" and pii.with_phrases("0", ["<new"], odds) == "00" and pii.with_phrases("0", ["<call", ">x"], {"<call": 3.0, ">x": -1.5}) == "00"
    assert pii.around("see\nPlease call Ann Lee, who", 16, 23) == ["<call", "<please call", ">who"]
    assert pii.around("7", 0, 1) == ["<", ">"] and pii.around("a 12 b\n", 5, 6) == ["<a 9", ">\n"]


def test_one_pass_redacts_like_two(spark):
    rows = [*enumerate(texts()), (900, None), (901, ""), (902, "nothing here"), (3, texts()[3])]
    docs, spans = run(spark, rows)
    given = spark.createDataFrame(GIVEN, "formal string, short_form string")
    a = {(r.doc_id, r.redacted, r.n_found) for r in pii.redact(docs, spans).collect()}
    got = pii.redact_documents(docs, given).collect()
    assert {tuple(r) for r in got} == a and len(got) == len(rows)


def test_long_addresses_and_other_wordings(spark):
    long = "Flat 12B, Wogedelume House, 17-19 Bruurollund Road, Siligwogestad 45812"
    other = [f"Kindly forward the parcel to {long} as soon as you can, and if nobody opens give {g} {s} a ring: +44 20 7946 0{200 + i}. Write {g.lower()}.{s.lower()} (at) post (dot) example (dot) org instead." for i, (g, s) in enumerate(zip(["Susan", "Oliver"] * 4, SURNAMES, strict=True))]
    _, spans = run(spark, [*enumerate(texts()), *((500 + i, x) for i, x in enumerate(other))])
    own = {}
    for r in spans.where("doc_id >= 500").collect():
        own.setdefault(r.doc_id - 500, set()).add((r.kind, r.value))
    for i, x in enumerate(other):
        assert ("ADDRESS", long) in own[i] and ("PHONE", f"+44 20 7946 0{200 + i}") in own[i] and any(k == "EMAIL" for k, _ in own[i]) and any(k == "NAME" and SURNAMES[i] in v for k, v in own[i])


def test_given_names_are_learned_from_all_whole_texts(spark):
    rows = [*enumerate(texts()), (900, "the step holds. " * 2000 + "\nDear Ivo,\n\nthe step holds.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame(GIVEN, "formal string, short_form string")
    for most in (5_000, 30):  # every text in the sample of the shape model, or about half of them
        got = pii.find_spans(docs, given, shape_texts=most).where("kind = 'NAME' and doc_id = 900").collect()
        assert [r.value for r in got] == ["Ivo"]


def test_emails_from_their_signs_equal_a_search_of_the_whole_text():
    rng = random.Random(1)
    parts = ["a", "bob", "x.y", "@", " @ ", " at ", "(at)", " [at] ", "{ AT }", " dot ", ".", "com", " ", "de", "+", "-", "_", "é", "²", "at", "AT", "\n", "(ät)", "(dot)", "dot", "@@", "1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(3, 14))) for _ in range(20_000)]
    want = [[m.span() for m in pii.EMAIL.finditer(t)] if pii.MAYBE_EMAIL.search(t) else [] for t in texts]
    assert sum(map(bool, want)) > 100
    assert [[m.span() for m in pii._emails_in(t)] for t in texts] == want


def test_patterns_look_at_their_first_character():
    """So that a stretch of small letters costs one look a character, not one for every way to write an address or a number."""
    for pattern in (pii.ADDRESS, pii.PHONE, pii.ID):
        assert pattern.pattern.startswith("(?=[")
    assert [m[0] for m in pii.ADDRESS.finditer("at Elm House, High Street, Leeds or ٣ Elm Road, York, C/ Mayor 4, 28013 Madrid")] == ["Elm House, High Street, Leeds", "٣ Elm Road, York", "C/ Mayor 4, 28013 Madrid"]
