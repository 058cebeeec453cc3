import numpy as np
import pytest

from corpusloom.llm import clusters, neighbours, vectors

SCHEMA = "paper_key string, matrix array<float>, shard int, vec string, salt int"


def table(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], 7, "clash", 1) for k, v in rows], SCHEMA)


def made(groups=12, members=9, dim=24, seed=3, noise=0.25):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        for m in range(members if g else 25):
            x = c + noise * rng.normal(size=dim) / np.sqrt(dim)
            out.append((f"g{g:02d}m{m:02d}", (x * rng.uniform(0.5, 2)).tolist()))
    out += [(f"lone{i}", rng.normal(size=dim).tolist()) for i in range(15)]
    return out


def unit(rows):
    x = np.array([v for _, v in rows], np.float32).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_groups_are_found_whole_and_described(spark):
    rows = made()
    got = clusters.group_similar(table(spark, rows + rows[:3]))
    found = {}
    for r in got.collect():
        found.setdefault(r.cluster_id, set()).add(r.key)
    want = {}
    for k, _ in rows:
        if k[0] == "g":
            want.setdefault(k[:3], set()).add(k)
    assert {frozenset(v) for v in found.values()} == {frozenset(v) for v in want.values()}
    pairs = clusters.pairs_of_groups(got).count()
    assert pairs == sum(len(v) * (len(v) - 1) // 2 for v in want.values())
    titles = spark.createDataFrame([(k, f"graph pruning of {k[:3]}words and other things") for k, _ in rows], "key string, title string")
    about = {r.cluster_id: r for r in clusters.describe_groups(got, titles).collect()}
    assert about["g00m00"].size == 25 and len(about["g00m00"].typical_keys) == 3 and about["g00m00"].top_keywords


def test_neighbours_against_brute_force(spark):
    rows = made(noise=0.5)
    x = unit(rows)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -1)
    want = set()
    for i in range(len(rows)):
        for j in sorted(range(len(rows)), key=lambda j: (-s[i, j], rows[j][0]))[:5]:
            if s[i, j] >= 0.8:
                want.add(tuple(sorted((rows[i][0], rows[j][0]))))
    got = {tuple(r) for r in neighbours.neighbour_pairs(neighbours.most_similar(table(spark, rows))).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.1 * len(want)


def test_equal_vectors_answer_each_other_by_key(spark):
    same = [(f"k{i:03d}", [1.0, 2.0, 3.0]) for i in range(40)]
    got = {}
    for r in neighbours.most_similar(table(spark, same)).collect():
        got.setdefault(r.key, []).append((r.rank, r.other))
    assert [o for _, o in sorted(got["k039"])] == ["k000", "k001", "k002", "k003", "k004"]
    assert [o for _, o in sorted(got["k002"])] == ["k000", "k001", "k003", "k004", "k005"]
    assert clusters.group_similar(table(spark, same)).first().size == 40


BAD = [(None, [1.0, 2.0]), ("null", None), ("zero", [0.0, 0.0]), ("nan", [float("nan"), 1.0]), ("inf", [float("inf"), 1.0]), ("hole", [None, 1.0]), ("empty", []), ("long", [1.0, 2.0, 3.0])]


@pytest.mark.parametrize("rows", [[], BAD[:7], [*BAD, ("one", [1.0, 0.0])]])
def test_odd_rows_and_empty_tables(spark, rows):
    t = table(spark, rows)
    assert clusters.group_similar(t).count() == 0
    assert neighbours.most_similar(t).count() == 0


def test_vectors_are_scaled_in_double_precision(spark):
    rows = [("tiny", [1e-30, 2e-30]), ("big", [3e30, 4e30]), ("twice", [1.0, 1.0]), ("twice", [1.0, 1.0]), *BAD[:7]]
    got = {r.key: r.vec for r in vectors.clean_vectors(table(spark, rows)).collect()}
    assert set(got) == {"tiny", "big", "twice"}
    assert got["big"] == pytest.approx([0.6, 0.8], abs=1e-7) and all(abs(sum(x * x for x in v) - 1) < 1e-12 for v in got.values())


def test_tree_keeps_its_bound_and_its_sums():
    x = unit(made(groups=40, members=8))
    tree = vectors.CFTree(x.shape[1], 0.98, most=50)
    tree.insert(np.ones(len(x)), x)
    n, ls = tree.entries()
    assert len(n) <= 50 and n.sum() == len(x) and np.allclose(ls.sum(0), x.sum(0), atol=1e-3)


def test_hot_shards_are_cut():
    assert vectors.salts_of(np.array([10.0, 1e6])) == [1, 167]


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = neighbours.PrunedGraph(x)
    ids, _ = g.search(x.astype(np.float32), beam=48)
    s = x @ x.T
    hit = sum(len(set(ids[i][:6]) & set(np.argsort(-s[i])[:6])) for i in range(len(x)))
    assert hit / (6 * len(x)) >= 0.9


def test_every_vector_gets_its_k_nearest(spark):
    rows = made(noise=0.5)
    x = unit(rows)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -1)
    got = {}
    for r in neighbours.most_similar(table(spark, rows), k=7, least=-1.0).collect():
        got.setdefault(r.key, []).append(r.other)
    assert len(got) == len(rows) and all(len(v) == 7 for v in got.values())
    hit = sum(len(set(got[rows[i][0]]) & {rows[j][0] for j in np.argsort(-s[i])[:7]}) for i in range(len(rows)))
    assert hit >= 0.9 * 7 * len(rows)


def test_two_levels_of_centres_ask_like_one():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    two = vectors.Centres(np.ones(len(x)), x, 300, one_level=100, near=8)
    assert 250 <= len(two.fine) <= 350 and two.load.sum() == len(x)
    got, new = two.nearest(x, 3)
    want = np.argsort(-(x @ two.fine.T), axis=1)[:, :3]
    assert new.all() and np.mean([len(set(a) & set(b)) / 3 for a, b in zip(got, want, strict=True)]) > 0.95
    few = vectors.Centres(np.ones(2), x[:2], 2)
    near, new = few.nearest(x[:2], 3)
    assert near.shape == (2, 3) and new.tolist() == [[True, True, False]] * 2


def test_the_summary_grows_with_the_rows():
    assert vectors.entries_for(1000) == vectors.SUMMARY_ENTRIES and vectors.entries_for(30_000_000) == 40_000 and vectors.entries_for(10**12) == 2 * vectors.MOST_SHARDS


def lone(n, dim=96, seed=4):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_a_full_tree_does_not_fall_to_a_few_entries():
    x = lone(12_000)
    tree = vectors.CFTree(x.shape[1], 0.98, most=500)
    tree.insert(np.ones(len(x)), x)
    n, _ = tree.entries()
    assert 125 <= len(n) <= 500 and n.sum() == len(x)


def test_shards_hold_about_what_they_should(spark):
    x = lone(6000, 24)
    rows = spark.createDataFrame([(f"k{i:04d}", v) for i, v in enumerate(x.tolist())], "key string, vec array<double>")
    centres, load = vectors.shard_centres(rows, 24, len(x), 200)
    assert load.sum() == len(x) and load.max() < 3 * 200 and 15 <= len(load) <= 60
    real = np.bincount(centres.nearest(x, 1)[0][:, 0], minlength=len(load))
    assert abs(real - load).sum() < 0.3 * len(x)


def test_one_shard_gives_all_neighbours(spark):
    x = lone(1500, 48)
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    got = {}
    for r in neighbours.most_similar(table(spark, [(f"k{i:04d}", v) for i, v in enumerate(x.tolist())]), least=-1.0).collect():
        got.setdefault(int(r.key[1:]), []).append((r.rank, int(r.other[1:])))
    assert all([o for _, o in sorted(got[i])] == np.argsort(-s[i])[:5].tolist() for i in range(len(x)))
