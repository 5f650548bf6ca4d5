import hashlib
import re

import numpy as np
import pytest

from gneiss.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    out = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def made(seed, n=120):
    rng = np.random.default_rng(seed)
    base = [[f"w{x}" for x in rng.integers(0, 40, 60)] for _ in range(4)]
    rows = []
    for i in rng.permutation(n).tolist():
        w = []
        for _ in range(rng.integers(0, 5)):
            b = base[rng.integers(4)]
            s = rng.integers(0, 40)
            w += b[s : s + rng.integers(1, 40)] if rng.random() < 0.7 else [f"u{x}" for x in rng.integers(0, 10**6, rng.integers(1, 30))]
        rows.append((int(i) * 3, [" ", "\n", "\t "][i % 3].join(w)))
    return [*rows, (1000, None), (1001, ""), (1002, "  "), (1003, "é " * 40), (1004, "é " * 30 + "x" * 5000), (None, "w1 " * 30)]


@pytest.mark.parametrize(("size", "hot"), [(13, 4096), (13, 3), (5, 4096), (7, 2), (20, 5), (1, 4096)])
def test_against_brute_force(spark, size, hot, monkeypatch):
    rows = made(size + hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS id", "'m' AS marks", "1 AS bucket").repartition(3)
    monkeypatch.setattr(sd, "HOT", hot)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sd.substring_dedup(df, size).collect()}
    assert got == brute(rows, size)


@pytest.mark.parametrize("hot", [1, 4, 4096])
def test_stages_without_spark(hot, monkeypatch):
    """Each text its own batch, so that nothing is found within a task, with short and long prefixes."""
    import pyarrow as pa

    monkeypatch.setattr(sd, "HOT", hot)
    rows, size, groups = [r for r in made(7, 60) if r[0] is not None], 13, 3
    batches = [pa.record_batch({"id": pa.array([i]), "text": pa.array([t], pa.string()), "part": pa.array([0], pa.int64())}) for i, t in rows]

    def grouped(parts, f):
        t = pa.Table.from_batches(parts)
        return pa.concat_tables([f(t.filter(pa.array(t["bucket"].to_numpy() == g))) for g in sorted(set(t["bucket"].to_pylist()))])

    def with_marks(t, kind):
        m = {}
        for r in t.to_pylist():
            if r["kind"] == kind:
                m.setdefault(r["id"], []).append(r["v"])
        return [b.append_column("marks", pa.array([m.get(b["id"][0].as_py())], pa.list_(pa.int64()))) for b in batches]

    first = grouped([x for b in batches for x in sd._local(iter([b]), size, 5, groups)], sd._repeated)
    parts = [x for b in with_marks(first, 0) for x in sd._suffixes(iter([b]), size, 5, groups)]
    got = {}
    for b in with_marks(grouped(parts, lambda t: sd._subtrees(t, size, 5)), 1):
        r = next(sd._digest(iter([b]), size)).to_pylist()[0]
        got[r["doc_id"]] = (r["n_words"], r["n_removed"], r["kept_sha256"])
    assert got == brute(rows, size)


def test_spans_and_texts(spark):
    common = " ".join(f"c{k}" for k in range(20))
    rows = [(1, f"a b {common} d"), (2, f"{common}  e"), (3, f"x {common} y {common}"), (4, "left\n alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, sd.repeat_spans(df, 13).collect())) == [(2, 0, 20), (3, 1, 20), (3, 22, 20)]
    assert {r["id"]: r["text"] for r in sd.kept_texts(df, 13).collect()} == {1: rows[0][1], 2: "e", 3: "x y", 4: "left\n alone"}
    assert sd.substring_dedup(df.limit(0), 13).count() == 0
    whole = sd.without_repeats(df.selectExpr("doc_id", "text", "length(text) AS n_chars", "null AS marks", "7 AS id"), 13)
    assert whole.columns == ["doc_id", "text", "n_chars", "marks", "id"]
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in whole.collect()} == {1: (rows[0][1], len(rows[0][1])), 2: ("e", 1), 3: ("x y", 3), 4: ("left\n alone", 11)}


def test_repeated_and_null_ids_and_clashing_names(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, f"{a} {b}"), (5, f"{b} {c}"), (5, None), (7, f"{c} x {a}"), (7, "own words"), (None, f"{a} {c}"), (None, a), (9, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars", "doc_id AS id", "1 AS part", "2 AS marks", "3 AS row", "4 AS `_new_id`", "5 AS touched")
    got = sd.without_repeats(df, 13)
    assert got.columns == df.columns
    want = [(5, rows[0][1]), (5, rows[1][1]), (5, None), (7, "x"), (7, "own words"), (None, rows[5][1]), (None, a), (9, "")]
    assert sorted(((r["doc_id"] or -1), r["text"] or "") for r in got.collect()) == sorted(((i or -1), t or "") for i, t in want)
    assert {(r["doc_id"], r["n_words"], r["n_removed"]) for r in sd.substring_dedup(df, 13).collect() if r["doc_id"] == 7} == {(7, 61, 60), (7, 2, 0)}
