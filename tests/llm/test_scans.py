import random
import re
import time
from collections import Counter

from corpusloom.llm import scans

CLEAN = " ".join(["we compare the decoder with a state-dependent observation and the measurement remains effective although modern kernels fail"] * 40)


def decoder():
    return scans.Decoder(dict(scans.count_words(iter([CLEAN]))))


def changes(text, title="On the decoder of things under pressure"):
    return scans.repair(text, title, scans.repeated_lines([text]), decoder())[0]


def test_words_over_line_ends():
    got = changes("the mea-\nsurement and a state-\ndependent obser¬\nvation, the deco­\nder although ker- \nnels")
    assert [i for k, i in got if k == "join"] == ["measurement", "state-dependent", "observation", "decoder", "kernels"]


def test_misread_words_keep_their_case():
    got = changes("the rneasurement rernains and altbough the dccoder Decocler the kerne| käme the observatíon")
    fixed = [i for k, i in got if k == "fix"]
    assert fixed[:4] == ["measurement", "remains", "although", "decoder"] and "kernel" in fixed[4:] or "observation" in fixed


def test_page_lines_are_dropped_and_words_joined_over_them():
    text = "we compare the mea-\n\n   — 12 —\n On the decoder of things\n\nsurement with a decoder\nand\nPage 13 of 20\nfail\n\nf(x) = 3 x\n(7)"
    got = changes(text)
    assert [i for k, i in got if k == "drop"] == ["— 12 —", "On the decoder of things", "Page 13 of 20"]
    assert ("join", "measurement") in got


def test_paragraphs_are_continuous():
    text = "We compare the decoder with a state-dependent\nobservation and the mea-\nsurement remains.\n\nAlthough modern kernels fail\nwe compare."
    _, out = scans.repair(text, None, Counter(), decoder(), compose=True)
    assert out == "We compare the decoder with a state-dependent observation and the measurement remains.\n\nAlthough modern kernels fail we compare."


def test_clean_text_stays(spark):
    rows = [("a", "T", "pdf", [("H", 1, CLEAN), ("E", 1, ""), ("N", 1, None)], "x"), ("a", "T", "pdf", [("H", 1, CLEAN), ("E", 1, ""), ("N", 1, None)], "x"), ("b", None, "pdf", None, "x"), ("c", "T", "tex", [("H", 1, "rneasurement\n12\n")], "x"), ("d", "T", None, [], "x"), ("e", "T", "pdf", [("H", 1, "long " * 50_000)], "x")]
    docs = spark.createDataFrame(rows, "key string, title string, source_kind string, sections array<struct<heading:string,level:int,text:string>>, changes string")
    got = scans.repair_documents(docs).collect()
    assert len(got) == 7 and {r.key for r in got} == {"a", "e"} and all(not r.changes for r in got)
    assert scans.repair_documents(docs.limit(0)).count() == 0


def test_readings_do_not_depend_on_the_size_of_the_corpus():
    words = {"steps": 4000, "stcps": 8, "kernel": 9000, "kerncl": 2, "measurement": 3000, "mea": 2, "surement": 2, "the": 50_000, "tables": 20, "alpha": 60, "omega": 60}
    text = "the stcps the kerncl the mea\nsurement the alpha-\nomega the tables the steps"
    want = [("fix", "steps"), ("fix", "kernel"), ("join", "measurement"), ("join", "alpha-omega")]
    for times in (1, 10, 1000):
        d = scans.Decoder({w: n * times for w, n in words.items()})
        assert scans.repair(text, None, Counter(), d)[0] == want


def test_blanks_are_lost_and_found():
    text = "thedecoder and the de coder although decoderremains effec tive"
    _, out = scans.repair(text, None, Counter(), decoder(), compose=True)
    assert out == "the decoder and the decoder although decoder remains effective"


def test_misread_letters_over_a_lost_sign():
    got, out = scans.repair("the dec\nocler and the mea-\nsurernent", None, Counter(), decoder(), compose=True)
    assert got == [("join", "decoder"), ("fix", "decoder"), ("join", "measurement"), ("fix", "measurement")] and out == "the decoder and the measurement"


def test_frequent_misreadings_and_fragments_are_repaired():
    words = {"the": 600_000, "measurement": 90_000, "rneasurement": 250, "mea": 50, "surement": 50, "of": 300_000, "kernel": 40_000}
    text = "the rneasurement of the mea\nsurement of the kernel"
    got, out = scans.repair(text, None, Counter(), scans.Decoder(words), compose=True)
    assert got == [("fix", "measurement"), ("join", "measurement")] and out == "the measurement of the measurement of the kernel"


def test_true_words_stay_apart():
    words = {"in": 30_000, "put": 900, "input": 900, "base": 900, "line": 900, "baseline": 500, "the": 60_000, "however": 2_000}
    text = "the in\nput of the base\nline in put base line however"
    got, _ = scans.repair(text, None, Counter(), scans.Decoder(words))
    assert got == []


def test_a_thousand_flowing_lines_are_one_paragraph():
    lines = ["we compare the decoder with a measurement and modern kernels although the"] * 1000
    assert scans.paragraphs(lines, [False] * 1000) == [0]
    assert scans.paragraphs([*lines, "kernels fail.", "We compare the decoder"], [False] * 1001 + [True]) == [0, 1001]


def test_the_vocabulary_is_cut_by_shares(spark):
    rows = [("a", [("H", 1, "common " * 5000 + "rare rare once")])] * 3
    docs = spark.createDataFrame(rows, "key string, sections array<struct<heading:string,level:int,text:string>>")
    assert scans.vocabulary(docs) == ({"common": 15_000, "rare": 6, "once": 3}, 15_009)
    assert scans.vocabulary(docs, least=0.001)[0] == {"common": 15_000}


def test_words_are_counted_as_by_plain_patterns():
    rnd = random.Random(3)
    parts = ["we", "l'eau", "it's", "naïve", "x²", "a-b", "mea-", "--", "-", "obser¬", "deco­", "(kernel),", "12", "f(x)=3", "ab_cd"]
    plain = re.compile(rf"\S+[{scans.HYPHENS}][ \t]*\n\s*\S*")
    for _ in range(300):
        text = "".join(rnd.choice(parts) + rnd.choice([" ", "\n", " \n", "\n\n", "\t", "\r\n", ""]) for _ in range(rnd.randint(0, 40)))
        assert scans.count_words(iter([text])) == Counter(scans.WORDS.findall(plain.sub(" ", text)))


def test_a_long_token_is_counted_in_time():
    began = time.process_time()
    assert scans.count_words(iter(["the " + "x" * 100_000 + " the mea-\nsurement"])) == {"the": 2, "x" * 100_000: 1}
    assert time.process_time() - began < 3


def test_prefixes_are_looked_up_once():
    class Seen(list):
        lookups = 0

        def __getitem__(self, i):
            Seen.lookups += 1
            return super().__getitem__(i)

    d = decoder()
    words = list(d.words)
    d.words = Seen(words)
    streams = [f"{a} {b[:3]}\x02{b[3:]} {c}" for a in words for b in words for c in words if len(b) > 5 and b.isalpha()]
    for stream in streams:
        assert "".join(x[2] for x in d.read(stream)) == stream.replace("\x02", "")
    assert Seen.lookups < 20 * len(streams)


def test_readings_under_bounds_are_the_cheapest():
    words = {"the": 60_000, "then": 9_000, "hen": 20, "modern": 800, "mode": 700, "rn": 3, "m": 40, "in": 30_000, "put": 900, "input": 900, "fine-grained": 40, "fine": 300, "grained": 2, "dim": 70, "clim": 2}
    d = scans.Decoder(words)
    free = scans.Decoder(words)
    free._bounds = lambda low: (float("inf"), [0.0] * (len(low) + 1))
    rnd = random.Random(5)
    for _ in range(1500):
        stream = "".join(rnd.choice([*words, "thc", "rnodem", "clirn", "lnput", "qq"]) + rnd.choice([" ", "\n", "\x02", "-", ""]) for _ in range(rnd.randint(1, 4))).strip(" \n\x02")
        assert (d.read(stream), d.memo[stream][0]) == (free.read(stream), free.memo[stream][0])
