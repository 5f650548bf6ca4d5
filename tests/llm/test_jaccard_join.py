import re

import numpy as np
import pyarrow as pa
import pytest

from gneiss.llm import jaccard_join as jj
from gneiss.llm.common import flat
from gneiss.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, k):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    s = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(s)
    for a in range(len(ids)):
        for b in range(a):
            x, y = s[ids[a]], s[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                u, v = find(ids[a]), find(ids[b])
                root[max(u, v)] = min(u, v)
    return {i: (len(s[i]), find(i)) for i in s}


def made(seed, n=250):
    rng = np.random.default_rng(seed)
    bases = [[f"w{x}" for x in rng.integers(0, 3000, rng.choice([2, 3, 5, 8, 30, 80, 200, 700]))] for _ in range(25)]
    rows = []
    for i in rng.permutation(n).tolist():
        w = list(bases[rng.integers(len(bases))])
        for _ in range(rng.integers(0, 4)):
            at, m = rng.integers(0, len(w) + 1), rng.integers(0, 1 + len(w) // 12 + 1)
            w[at : at + m] = [f"n{x}" for x in rng.integers(0, 10**6, m)]
        rows.append((i, " ".join(w).upper() if i % 5 == 0 else "\n ".join(w)))
    return [*rows, (901, None), (902, ""), (903, " \t"), (904, "a b"), (905, "A  B"), (906, "é" * 9000), (907, "x y " * 3000), (908, "x y " * 3001)]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 60), (3, 100)])
def test_against_brute_force(spark, k, percent):
    rows = made(k)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "'x' AS cells").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(df, k, percent).collect()}
    assert got == brute(rows, k, percent)


@pytest.mark.parametrize("percent", [80, 85])
def test_unrelated_sets_hardly_meet(percent):
    """Sets without a common shingle share keys of empty blocks only: a few of all pairs, at every size within a band."""
    rng, met, n = np.random.default_rng(3), 0, 200
    for size in range(360, 460, 10):
        first = np.arange(n + 1) * size
        owner, key = jj.sketch_keys(np.sort(rng.integers(0, 1 << 63, (n, size)).astype(np.uint64)).ravel(), first, percent)
        c = np.unique(key, return_counts=True)[1]
        met += int((c * (c - 1) // 2).sum())
    assert met < 0.05 * 10 * n * (n - 1) // 2


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_similar_sets_share_a_key(percent):
    """Pairs at the bound, of sizes from few shingles to many, whatever blocks they leave out."""
    rng = np.random.default_rng(percent)
    for _ in range(1500):
        n = int(rng.choice([1, 2, 3, 4, 5, 7, 10, 20, 40, 90, 300, 700]))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        lost = int(rng.integers(0, n - -(-percent * n // 100) + 1))
        b = a[lost:]
        more = (100 * len(b) // percent) - n  # the most new ones at which the similarity still reaches the bound
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, max(0, more)).astype(np.uint64)]))
        assert jj.similar(a, b, percent)
        owner, key = jj.sketch_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
        assert len(np.intersect1d(key[owner == 0], key[owner == 1]))


def test_large_components_use_several_cells(spark):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            w[at] = f"n{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    rows = [(i, t) for i, t in rows if t not in {x for _, x in rows[:i]}]  # this stage gets one document of each class
    df = spark.createDataFrame(rows, "id long, text string")
    want = brute(rows, 4, 85)
    pairs = jj.candidate_pairs(df, 4, 85, 3)
    value, first = jj.shingle_sets(*flat(pa.array([t for _, t in rows])), 4)
    sets = spark.createDataFrame(list(zip([i for i, _ in rows], np.diff(first).tolist(), jj.folded_sketches(value, first), strict=True)), "id long, n long, sketch binary")
    pairs = jj.sketch_links(pairs, sets, 85, 3, cell_size=6)
    links = jj.verified_links(df, pairs, 4, 85, cell_size=7)
    label = {r["v"]: r["label"] for r in connected_components(links).collect()}
    assert {i: label.get(i, i) for i, _ in rows} == {i: c for i, (_, c) in want.items()}
    assert len(set(label.values())) < len(rows)


@pytest.mark.parametrize("percent", [30, 60, 80, 95])
def test_folded_sketches_bound_the_difference(percent):
    rng = np.random.default_rng(percent)
    base = rng.integers(0, 1 << 63, 900).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(20, 900)], rng.integers(0, 1 << 63, rng.integers(0, 90)).astype(np.uint64)])) for _ in range(60)]
    first = np.cumsum([0, *map(len, sets)])
    c = jj.Sketches(np.diff(first), jj.folded_sketches(np.concatenate(sets), first), percent)
    for i in range(60):
        near = set(c.near(i).tolist())
        assert near >= {j for j in range(60) if jj.similar(sets[i], sets[j], percent)}
    far = jj.Sketches(np.array([200, 210]), jj.folded_sketches(rng.integers(0, 1 << 63, 410).astype(np.uint64), np.array([0, 200, 410])), 80)
    assert far.near(0).tolist() == [0]


def test_edge_cases(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (5, "a b c d e")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jj.jaccard_components(df, 4, 85).collect() if r["doc_id"]) == [(1, 2, 1), (1, 2, 1), (5, 2, 1)]
    assert jj.jaccard_components(df.limit(0), 4, 85).count() == 0
    assert [r["doc_id"] for r in jj.drop_near_copies(df.filter("doc_id > 0").distinct()).collect()] == [1]


def test_repeated_ids_are_documents_of_their_own(spark):
    base = " ".join(f"w{x}" for x in range(40))
    rows = [(4, base), (4, "quite another text of six words"), (6, base + " end"), (6, base + " end"), (2, "quite another text of six words"), (None, base), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS `_gone`", "2 AS row_key", "3 AS component")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jj.jaccard_components(df, 4, 85).collect())
    assert got == [(-1, 37, -1), (2, 3, 2), (4, 3, 2), (4, 37, 4), (6, 38, 4), (6, 38, 4), (9, 0, 9)]
    kept = jj.drop_near_copies(df, 4, 85)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in kept.collect()) == sorted([(-1, base), (2, rows[4][1]), (4, base), (9, "")])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (50, 60), (60, 50)], "u long, v long")
    assert {r["v"]: r["label"] for r in connected_components(edges).collect()} == {i: 0 for i in range(1, 41)} | {60: 50}
