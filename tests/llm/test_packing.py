import math
import itertools
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import mixing, packing
from corpusloom.llm.tokens import TOKENIZER, encoding

needs_tokenizer = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no tokenizer file here")


def padding(bounds, sizes, counts):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(sizes, counts, strict=True))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_bounds_are_optimal(hist, most):
    sizes = sorted(hist)
    counts = [hist[x] for x in sizes]
    got = packing.bucket_bounds(sizes, counts, most)
    best = min(padding((*c, sizes[-1]), sizes, counts) for c in itertools.combinations(sizes[:-1], min(most, len(sizes)) - 1))
    assert len(got) <= max(most, 1) and padding(got, sizes, counts) == best


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 25), min_size=1, max_size=12))
def test_plan_places_every_item_once(hist):
    bounds = sorted(hist)
    counts = [hist[b] for b in bounds]
    plan, made = packing.plan_batches(bounds, counts, 30)
    load, seen = [0] * made, {}
    for k, rank, number, first, q in plan:
        for r in range(number):
            load[first + r // q] += bounds[k]
            seen[k, rank + r] = seen.get((k, rank + r), 0) + 1
    assert all(x <= 30 for x in load) and all(v == 1 for v in seen.values())
    assert len(seen) == sum(counts)
    assert made <= 1.25 * max(sum(b * c for b, c in zip(bounds, counts, strict=True)) / 30, sum(c for b, c in zip(bounds, counts, strict=True) if b > 15)) + 12 or min(bounds) > 10


@needs_tokenizer
def test_windows_hold_whole_texts(spark):
    texts = [(i, "word " * (1 + 7 * i % 90)) for i in range(200)] + [(900, "long text " * 900), (901, None), (902, ""), (903, "same"), (903, "same")]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in texts], "doc_id long, text string, window_name string, n_tokens int")
    wins = spark.createDataFrame([("a", 128), ("b", 1000), ("none", 0), ("null", None)], "window_name string, capacity_tokens int")
    rows = packing.pack(docs, wins).collect()
    enc = encoding()
    size = {i: len(enc.encode_ordinary(t or "")) for i, t in texts}
    for name, cap in (("a", 128), ("b", 1000)):
        own = [r for r in rows if r.window_name == name]
        load, pieces = {}, {}
        for r in own:
            load[r.container] = load.get(r.container, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
        assert max(load.values()) <= cap and set(pieces) == {i for i, n in size.items() if n}
        for i, p in pieces.items():
            assert sum(n for _, n in p) == size[i] * (2 if i == 903 else 1) and (size[i] > cap or len(p) == (2 if i == 903 else 1))
        assert sum(load.values()) / len(load) / cap > 0.85
    report = {r.window_name: r for r in packing.fill_report(packing.pack(docs, wins), wins).collect()}
    assert report["a"].filled > 0.85 and report["a"].fullest <= 128
    assert packing.pack(docs.limit(0), wins).count() == 0 and packing.pack(docs, wins.limit(0)).count() == 0


@needs_tokenizer
def test_mixture_reaches_its_shares(spark):
    rows = [(i, f"text number {i} of {s} " + "filler " * (i % 13), s, "x") for i, s in enumerate((["a"] * 300 + ["B "] * 100 + ["c-d"] * 40 + [None] * 5 + ["other"] * 5))]
    rows += [(5000, rows[0][1], "a", "x"), (5001, None, "a", "x"), (5002, "", "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repeats string")
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c_d", 0.2, 3), ("absent", 0.1, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix(docs, goal)
    got = mixture.collect()
    assert len({r.doc_id for r in got}) == len(got) and 5000 not in {r.doc_id for r in got}
    cap = {"a": 1, "b": 2, "c_d": 3}
    assert all(1 <= r.repeats <= cap[r.source] for r in got)
    rep = {r.source: r for r in report.collect()}
    assert rep["a"].share == pytest.approx(0.5, abs=0.02) and rep["b"].share == pytest.approx(0.3, abs=0.02) and rep["c_d"].share == pytest.approx(0.2, abs=0.02)
    assert rep["absent"].tokens == 0
    assert mixing.mix(docs.limit(0), goal)[0].count() == 0 and mixing.mix(docs, goal.limit(0))[0].count() == 0


def test_exponent_is_the_smallest_that_fits():
    shares, repeats, tokens = {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, {"a": 900, "b": 100}
    budgets, a = mixing.choose_budgets(shares, repeats, tokens)
    assert a == 0 and budgets == {"a": 100, "b": 100}
    budgets, a = mixing.choose_budgets(shares, repeats, tokens, wanted=500)
    assert 0 < a < 1 and sum(budgets.values()) == pytest.approx(500) and budgets["b"] <= 100 + 1e-6
    budgets, a = mixing.choose_budgets(shares, repeats, tokens, wanted=5000)
    assert a == 1 and sum(budgets.values()) == pytest.approx(1000)
    assert mixing.choose_budgets({}, {}, {}) == ({}, 0.0)


def test_target_entropy():
    tokens = {"a": 1000, "b": 100, "c": 10, "none": 0}
    for share in (0.2, 0.5, 0.9):
        want = share * math.log(3)
        weights, exponent = mixing.weights_of_entropy(want, tokens)
        assert abs(mixing.entropy_of(weights) - want) < 1e-6 and exponent > 0 and abs(sum(weights.values()) - 1) < 1e-9
    assert mixing.weights_of_entropy(9.0, tokens)[1] == 0.0 and mixing.weights_of_entropy(1.0, {}) == ({}, 0.0)
    budgets, exponent = mixing.choose_budgets(dict.fromkeys("abc", 1 / 3), dict.fromkeys("abc", 2), tokens, entropy=0.9 * math.log(3))
    assert abs(budgets["c"] - 20) < 1e-6 and budgets["a"] > budgets["b"] > budgets["c"]


def test_a_wanted_size_moves_the_exponent(spark):
    docs = spark.createDataFrame([(i, f"{i} " + "word " * (5 + i % 7), "big" if i % 10 else "small") for i in range(600)], "doc_id long, text string, source string")
    goal = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    exact = {r.source: r for r in mixing.mix(docs, goal)[1].collect()}
    grown = {r.source: r for r in mixing.mix(docs, goal, wanted=0.7)[1].collect()}
    assert exact["big"].exponent == 0.0 and 0 < grown["big"].exponent < 1 and grown["small"].most_repeats == 2
    whole = 0.7 * sum(r.available for r in grown.values())
    assert abs(sum(r.tokens for r in grown.values()) - whole) < 0.02 * whole
