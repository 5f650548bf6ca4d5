import hashlib
import io
import itertools
import math
import re
import zlib

import numpy as np
import pytest

from gneiss.llm import langid, toxicity, warc
from gneiss.llm.queries import QUERIES, table


def phrases(text, data):
    """Longest matches, one after the other; a byte that data lacks is a phrase of its own."""
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in data:
            k += 1
        n, at = n + 1, at + k
    return n


def test_suffix_automaton_and_greedy_parse():
    rng = np.random.default_rng(0)
    data = bytes(rng.choice(list(b"abc"), 200).tolist())
    p = langid.Parser(data)
    texts = [bytes(rng.choice(list(b"abcd"), n).tolist()) for n in (0, 1, 5, 60, 255)]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = langid.parse_counts([p], buf, off)[:, 0].tolist()
    assert got == [phrases(t, data) for t in texts]


def test_long_texts_are_one_sequence():
    rng = np.random.default_rng(3)
    both = [bytes(rng.choice(list(b"abc"), 3000, p=w).tolist()) for w in ([0.6, 0.3, 0.1], [0.2, 0.3, 0.5])]
    texts = [bytes(rng.choice(list(b"abcd"), n).tolist()) for n in (256, 257, 0, 512, 5000)] + [both[0][100:1900], both[1][5:2600], b"a" * 1500]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = langid.parse_counts([langid.Parser(d) for d in both], np.frombuffer(b"".join(texts), np.uint8), off)
    want = np.array([[phrases(t, d) for d in both] for t in texts])
    assert got.tolist() == want.tolist() and got.argmin(axis=1).tolist() == want.argmin(axis=1).tolist()


def test_language_accuracy_and_edge_cases(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op4_langid"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 8)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 -- 3", "de"), (103, "und der hund", None), (103, "und der hund", None), (104, "ж", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "2 AS held_out", "3 AS score")
    out = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert [out[i]["lang_pred"] for i in (100, 101, 102, 103)] == ["und", "und", "und", "de"] and out[104]["lang_pred"] in ("de", "en")
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.identify(df.limit(0)).count() == 0


def test_costs_are_normalised(spark):
    """The winner and the score against plain parsing, with short texts and training texts of unequal size."""
    rng = np.random.default_rng(6)
    words = {x: ["".join(rng.choice(list(abc), rng.integers(2, 7))) for _ in range(60)] for x, abc in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "aeioumnr"))}
    say = lambda x, n: " ".join(rng.choice(words[x], n))
    rows = [(i, say(x, n), x) for x, docs, n in (("aa", 40, 60), ("bb", 3, 5), ("cc", 10, 20)) for i in rng.integers(0, 10**6, docs).tolist()]
    rows += [(2 * 10**6 + i, say(x, n), None) for i, (x, n) in enumerate([(x, n) for x in words for n in (1, 1, 2, 3, 8, 40)])]
    rows += [(3 * 10**6, "e", None), (3 * 10**6 + 1, "zz qq", None), (3 * 10**6 + 1, "zz qq", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = {}
    for i, t, x in rows:
        if x and zlib.crc32(str(i).encode()) % 4 != 2:
            train.setdefault(x, []).append((i, t))
    plain = langid.learn(spark.createDataFrame([(i, t, x) for x, v in train.items() for i, t in v], "id long, text string, lang string"), "text", "lang", "id")
    assert {x: sorted(v.decode().split()) for x, v in plain.items()} == {x: sorted(" ".join(t for _, t in v).split()) for x, v in train.items()}
    for r, (i, t) in zip(sorted(langid.identify(df).collect(), key=lambda r: r["doc_id"]), sorted((i, t) for i, t, _ in rows), strict=True):
        cost = {x: phrases(t.encode(), d) * np.log2(len(d)) for x, d in plain.items()}
        best = min(sorted(cost), key=cost.get)
        assert (r["doc_id"], r["lang_pred"]) == (i, best)
        assert np.isclose(r["score"], 1 / sum(2 ** (cost[best] - c) for c in cost.values()))


def test_many_languages_and_long_texts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ALL", 6)
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 50)
    rows = [(10 * x + i, "word " * (3 if i else 100), f"l{x}") for x in range(4) for i in range(5)] + [(99, "z" * 400, "long")]
    got = langid.learn(spark.createDataFrame(rows, "id long, text string, lang string"), "text", "lang", "id")
    assert {x: len(v) for x, v in got.items()} == {f"l{x}": 16 for x in range(4)} | {"long": 51}


def test_sampled_texts_are_learned_whole(spark):
    texts = [("abc " * 1500 + f"tail{'xyz'[i % 3]}{chr(97 + i % 26)}{chr(97 + i // 26)} ").strip() for i in range(40)]
    got = langid.learn(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "id long, text string, lang string"), "text", "lang", "id")
    assert len(got["en"]) == sum(len(t) + 1 for t in texts) and all(t.split()[-1].encode() in got["en"] for t in texts)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    e, t, first = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([0, 4, 4, 5, 9])
    got = toxicity.marginals(e, first, t)[0]
    for a, b in itertools.pairwise(first):
        w = np.zeros(b - a)
        total = 0.0
        for y in itertools.product((0, 1), repeat=b - a):
            s = np.exp(sum(e[a + i] for i in range(b - a) if y[i]) + sum(t[y[i - 1], y[i]] for i in range(1, b - a)))
            total += s
            w += s * np.array(y)
        if b > a:
            assert np.allclose(w / total, got[a:b])


def test_scores_and_spans_equal_plain_loops(spark):
    """Tokens, features, marginals, the document's score and the spans, one text after the other."""
    rng = np.random.default_rng(12)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(10) for j in range(6)]
    texts = [" ".join([*rng.choice(vocab, rng.integers(1, 40)), *(["Scum,", "vile-é"] if i % 3 == 0 else [])]) for i in range(90)]
    y = np.array([int(i % 3 == 0) for i in range(90)])
    m = toxicity.fit(texts, y, np.ones(90))
    rows = [(i, t) for i, t in enumerate([*texts[:25], "", None, "Scum scum 12 vile-é", "x" * 50])] + [(3, "scum of another row"), (None, "scum")]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()
    bins = {int(h): int(b) for h, b in zip(m.words, m.bins, strict=True)}
    assert len(out) == len(rows)
    for r, (i, t) in zip(out, rows, strict=True):
        raw = (t or "").encode()
        found = [(x.start(), x.end(), x[0].lower()) for x in re.finditer(rb"[A-Za-z\x80-\xff]+", raw)]
        b = [bins.get(int(toxicity.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]), toxicity.NEUTRAL) for *_, w in found]
        e = [m.weights[0, b[k - 1] if k else toxicity.NEUTRAL] + m.weights[1, b[k]] + m.weights[2, b[k + 1] if k + 1 < len(b) else toxicity.NEUTRAL] for k in range(len(b))]
        n = len(e)
        f, g = [[0.0, 0.0] for _ in e], [[0.0, 0.0] for _ in e]
        add = lambda a, c: max(a, c) + math.log1p(math.exp(-abs(a - c)))
        for k in range(n):
            for s in (0, 1):
                f[k][s] = s * e[k] + (add(f[k - 1][0] + m.trans[0, s], f[k - 1][1] + m.trans[1, s]) if k else 0.0)
        for k in range(n - 2, -1, -1):
            for s in (0, 1):
                g[k][s] = add(m.trans[s, 0] + g[k + 1][0], m.trans[s, 1] + e[k + 1] + g[k + 1][1])
        p = [1 / (1 + math.exp(f[k][0] + g[k][0] - f[k][1] - g[k][1])) for k in range(n)]
        x = [1.0, math.log1p(sum(p)), max(p, default=0.0), math.log1p(n) / 10]
        want = 1 / (1 + math.exp(-sum(a * c for a, c in zip(x, m.doc, strict=True))))
        assert math.isclose(r["score"], want, rel_tol=1e-9) and r["predicted"] == int(want >= 0.5) and r["doc_id"] == i
        assert r["spans"] == [v for k in range(n) if p[k] >= 0.5 for v in found[k][:2]] and r["n_toxic"] == sum(v >= 0.5 for v in p)
    assert any(r["n_toxic"] for r in out)


def test_rows_are_dropped_by_their_own_text(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join([*words[i % 40 : i % 40 + 8], *(["scum", "vile"] if i % 2 else [])])) for i in range(200)] + [(1, "w1 w2 w3"), (None, "scum vile w3"), (None, "w5")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS `_gone`", "2 AS judged_text", "array(1, 2) AS score")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(200)] + [(None, 1)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in kept.collect()) == sorted([(i, t) for i, t in rows[:200] if not i % 2] + [(1, "w1 w2 w3"), (-1, "w5")])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.96
    assert got[got.toxic == 1].predicted.mean() > 0.8 and got[got.toxic == 0].predicted.mean() < 0.02
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (4, "a " * 9000)], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS score")
    assert toxicity.score(odd, toxicity.learn(odd, labels.limit(0))).count() == 4
    assert toxicity.score(odd.limit(0), 0.5).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 0), (4, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.learn(odd, one)).count() == 4
    row = toxicity.score(docs.filter("doc_id = %d" % got[(got.predicted == 1) & (got.n_toxic > 0)].doc_id.min()), toxicity.learn(docs, labels)).first()
    assert len(row["spans"]) == 2 * row["n_toxic"]


def test_bundles():
    w = warc.BundleWriter()
    rows = [(i, f"u{i}", bytes([i % 251]) * (i * 9000 % 90001)) for i in range(40)]
    for i, u, b in rows:
        w.add(i, warc.record(i, u, b, hashlib.sha1(b).hexdigest(), None))
    data, index = w.finish(), w.index
    import zstandard

    assert len(w.frames) > 3
    r = warc.BundleReader(io.BytesIO(data), len(data))
    for (i, _, b), (_, frame, offset, _) in reversed(list(zip(rows, index, strict=True))):
        head, body = r.record(frame, offset)
        assert body == b and head["WARC-Record-ID"] == f"<urn:page:{i}>"
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 40  # readers that know no seek table skip it
    with pytest.raises(ValueError):
        warc.BundleReader(io.BytesIO(data[:-3]), len(data) - 3)


def test_warc_rows(spark):
    long = "é" * 600
    rows = [(1, "a", long), (5, "b", long), (3, None, long), (7, "c", None), (8, "d", ""), (9, "e", "x" * 999), (10, "f", "x" * 999), (11, "g\r", "y" * 200000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS keeper")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in warc.archive_and_read(df).collect()}
    for i, _, h in rows:
        raw = (h or "").encode()
        assert got[i] == (len(raw), "revisit" if i in (1, 3) else "response", 5 if i in (1, 3) else None, hashlib.sha1(raw).hexdigest())
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_warc_repeated_and_null_ids(spark):
    a, b = "a" * 1500, "b" * 1500
    rows = [(1, a), (9, a), (1, b), (None, a), (None, b), (9, a), (4, "c" * 1200), (4, "c" * 1200)]
    df = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string").selectExpr("*", "1 AS copy", "2 AS payload", "3 AS keeper")
    got = warc.archive_and_read(df).collect()
    sha = {t: hashlib.sha1(t.encode()).hexdigest() for _, t in rows}
    want = [(1, sha[a], "revisit", 9), (9, sha[a], "response", None), (1, sha[b], "response", None), (None, sha[a], "response", None), (None, sha[b], "response", None), (9, sha[a], "response", None), (4, sha["c" * 1200], "response", None), (4, sha["c" * 1200], "response", None)]
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got)
