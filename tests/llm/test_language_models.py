import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from gneiss.llm import kneser_ney as kn
from gneiss.llm import pieces_sampler as ps
from gneiss.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = tokenizer_path("piece_bpe_32k.model")


def tokens(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + ["</s>"]


def brute(rows, min_context):
    """The trigram model with dictionaries."""
    train = [tokens(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    grams = lambda s: zip(["<s>", "<s>", *s[:-2]] if len(s) > 1 else ["<s>"], ["<s>", *s[:-1]], s, strict=True)
    uni = collections.Counter(w for s in train for w in s)
    tri = collections.Counter(g for s in train for g in grams(s))
    n, v = sum(uni.values()), len(uni)
    pair = collections.Counter((b, c) for _, b, c in tri)
    word = collections.Counter(c for _, c in pair)

    def kinds(counts, key):
        total, seen = collections.Counter(), collections.defaultdict(collections.Counter)
        for g, c in counts.items():
            total[key(g)] += c
            seen[key(g)][min(c, 3)] += 1
        return total, seen

    d3, d2, d1 = (kn.discounts([sum(c == i for c in x.values()) for i in range(1, 5)]) for x in (tri, pair, word))
    t3, s3 = kinds(tri, lambda g: g[:2])
    t2, s2 = kinds(pair, lambda g: g[0])
    rest = sum(d1[min(c, 3) - 1] for c in word.values())
    cut = lambda c, d: c - d[min(c, 3) - 1] if c else 0

    def prob(a, b, c):
        p = (cut(word[c], d1) + rest / (v + 1)) / len(pair) if pair else 1.0
        if t2[b]:
            p = (cut(pair[b, c], d2) + sum(d2[k - 1] * m for k, m in s2[b].items()) * p) / t2[b]
        if t3[a, b] >= min_context:
            p = (cut(tri[a, b, c], d3) + sum(d3[k - 1] * m for k, m in s3[a, b].items()) * p) / t3[a, b]
        return p

    out = {}
    for i, t in rows:
        s = tokens(t)
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s)
        out[i] = (len(s), sum(uni[w] > 0 for w in s), n, base, sum(math.log10(prob(*g)) for g in grams(s)))
    for a, b in [("<s>", "<s>"), *list(t3)[:5], ("zzz", "w1"), ("zzz", "qqq")]:
        if pair:
            assert math.isclose(sum(prob(a, b, c) for c in [*uni, "unknown word"]), 1.0, rel_tol=1e-9)
    return out


def made():
    rng = np.random.default_rng(4)
    rows = [(i, " \n".join(f"W{min(99, int(x))}" for x in rng.exponential(9, rng.integers(0, 60)))) for i in range(150)]
    return [*rows, (500, None), (501, ""), (502, "zzz qqq"), (503, "w1 " * 4000), (None, "w2 w3")]


@pytest.mark.parametrize(("min_context", "groups"), [(1, 8), (2, 8), (2, 40)])
def test_scores_equal_brute_force(spark, min_context, groups, monkeypatch):
    """40 groups: frequent words and the begin token are split over several."""
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS held_out").repartition(3)
    want = brute(rows, min_context)
    monkeypatch.setattr(kn, "buckets", lambda *a: groups)
    split = kn.split_words(df.selectExpr("doc_id AS id", "text"), 40)
    assert len(split.words) > 3 and kn.BEGIN in split.words.tolist() and len(split.common) > 20
    for r in kn.score(df, min_context=min_context).collect():
        n, known, train, base, model = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, train)
        assert math.isclose(r["base_score"], base, abs_tol=1e-9, rel_tol=1e-9) and math.isclose(r["score"], model, abs_tol=1e-9, rel_tol=1e-9)
    assert kn.score(df.limit(0)).count() == 0


def test_repeated_rows_count_each(spark):
    rows = [(1, "a b c a b"), (1, "a b c a b"), (1, "c c"), (2, "a b c"), (2, "a b c"), (None, "a b c")]
    got = sorted(((r["doc_id"] or -1), r["n_tokens"], r["train_tokens"], round(r["score"], 9)) for r in kn.score(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    train = sum(len(tokens(t)) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10)
    assert len(got) == len(rows) and {r[2] for r in got} == {train} and got[1:] == sorted(got[1:])
    one = kn.score(spark.createDataFrame(rows * 2, "doc_id long, text string")).first()
    assert one["train_tokens"] == 2 * train


def test_contexts_seen_once_are_scored(spark):
    """By default no trigram is left out, whatever its context's count."""
    want, cut = brute(made(), 1), brute(made(), 2)
    assert sum(not math.isclose(want[i][4], cut[i][4], rel_tol=1e-3) for i in want) > 20
    for r in kn.score(spark.createDataFrame(made(), "doc_id long, text string")).collect():
        assert math.isclose(r["score"], want[r["doc_id"]][4], abs_tol=1e-9, rel_tol=1e-9)


@pytest.mark.parametrize("n", [0, 1, 1000, kn.TABLE_KEYS - 1, 4 * kn.TABLE_KEYS])
def test_stored_keys_are_found_and_many_take_four_bytes(tmp_path, monkeypatch, n):
    """Also where keys share their first 16, 32 or all of their 40 bits, and at both ends."""
    monkeypatch.setattr(kn, "_tag", lambda: "0")
    rng = np.random.default_rng(n)
    key = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    key[: n // 10] = (7 << 48) + (key[: n // 10] >> np.uint64(16))
    key[n // 10 : n // 8] = (9 << 32) + (key[n // 10 : n // 8] >> np.uint64(32))
    key[n // 8 : n // 8 + 2] = np.array([0, (1 << 64) - 1], np.uint64)[:n]
    key.sort()
    kn._save_keys(f"file://{tmp_path}", "x", key)
    short = np.unique(key >> np.uint64(24))
    q = np.unique(np.concatenate([short, rng.integers(0, 1 << 40, 1000, dtype=np.uint64), short[:5000] + np.uint64(1)]) & kn.KEY40)
    p = kn.Arrays(f"file://{tmp_path}").place("x", q)
    assert ((p >= 0) == np.isin(q, short)).all()
    assert (key[p[p >= 0]] >> np.uint64(24) == q[p >= 0]).all()
    if n > kn.TABLE_KEYS:
        assert sum(f.stat().st_size for f in tmp_path.iterdir()) < 4 * n


def test_large_groups_equal_brute_force(spark, monkeypatch):
    """One group of more trigrams than TABLE_KEYS."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.exponential(1, 1000) ** 3 * 100)) for i in range(250)]
    monkeypatch.setattr(kn, "buckets", lambda *a: 1)
    want = brute(rows, 1)
    for r in kn.score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert math.isclose(r["score"], want[r["doc_id"]][4], rel_tol=1e-9)
    train = [["<s>", "<s>", *tokens(t)] for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    assert len({g for s in train for g in zip(s, s[1:], s[2:], strict=False)}) > kn.TABLE_KEYS


def test_messages_hold_differences():
    """What a task sends comes back whole, and takes less than eight bytes for each word that is not common."""
    rng = np.random.default_rng(7)
    text = " ".join(f"w{int(x)}" for x in rng.integers(0, 40000, 60000)).encode()
    buf, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    common = kn.words_of(np.frombuffer(b"w5 w1 nowhere w3", np.uint8), np.array([0, 16]))[0][:4]
    rows = kn._counted(buf, off, kn.Layout(1, np.zeros(0, np.uint64), np.zeros(0, np.uint64), common))
    _, u, v, w, c = kn._trigrams(kn.pa.table({"kind": [r[1] for r in rows], "data": kn.pa.array([r[3] for r in rows], kn.pa.binary())}), (kn.BOTH,), common)
    seq, first = kn.words_of(buf, off)
    want = collections.Counter(zip(*(x.tolist() for x in (*kn.before(seq, first, kn.BEGIN), seq)), strict=True))
    assert dict(zip(zip(u.tolist(), v.tolist(), w.tolist(), strict=True), c.tolist(), strict=True)) == want
    data = kn.zstandard.ZstdDecompressor().decompress(rows[0][3])
    assert len(common) < len(set(seq.tolist())) and int(np.frombuffer(data, "<i8", 4)[1]) < 7.5 * len(set(seq.tolist()))


@pytest.mark.parametrize(("k", "n", "most"), [(0, 0, 0), (0, 9, 2), (3, 3, 1), (5, 20000, 20), (300, 100_000, 700), (90_000, 100_000, 12500)])
def test_places_of_common_words_come_back(k, n, most):
    """Few of many take a byte or two each, not a bit for each of the many."""
    place = np.sort(np.random.default_rng(k).choice(n, k, replace=False)) if n else np.zeros(0, np.int64)
    data = kn.pack_places(place, n)
    assert kn.unpack_places(data, n).tolist() == place.tolist() and len(data) <= most


def test_counts_beyond_a_byte():
    few, many = kn.small_counts(np.array([1, 255, 3, 254, 10**6]))
    assert few.tolist() == [1, 255, 3, 254, 255] and many.tolist() == [[1, 255], [4, 10**6]]


TEXTS = ["", None, "Hello world", "  two  spaces ", "new\nline\ttab\r", "▁ literal ▁mark", "日本語 emoji 🙂🙃", "x" * 3000, "\x00\x7f", " ", "naïve café"]


def test_lossless_and_reproducible(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, "Hello world"), (None, "Hello world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS pieces")
    one = sorted((str(r["doc_id"]), r["pieces"]) for r in ps.sample_pieces(df, PATH).collect())
    assert one == sorted((str(r["doc_id"]), r["pieces"]) for r in ps.sample_pieces(df.repartition(5), PATH).collect())
    text = {r["doc_id"]: r["text"] for r in ps.decode_pieces(ps.sample_pieces(df, PATH), PATH).collect()}
    assert all(text[i] == (t or "") for i, t in enumerate(TEXTS))
    assert all(r["lossless"] for r in ps.sample_digests(df, PATH).collect())
    assert one != sorted((str(r["doc_id"]), r["pieces"]) for r in ps.sample_pieces(df, PATH, seed=1).collect())


@pytest.mark.parametrize("word", ["token", "é🙂", "aaaa"])
def test_sampled_frequencies_equal_enumeration(word):
    t = ps.Lattices(PATH, 0.4)
    raw = (" " + word).encode()
    logp = {t.text[i]: p for i, p in zip(t.id.tolist(), t.logp.tolist(), strict=True) if i >= 0}

    def paths(s):
        if not s:
            yield (), 0.0
        for ch in [len(s.decode()[0].encode())] if s else []:
            if s[:ch] not in logp:
                for rest, p in paths(s[ch:]):
                    yield tuple(int(t.byte_id[x]) for x in s[:ch]) + rest, p + ch * t.byte_logp
        for k in range(1, len(s) + 1):
            if s[:k] in logp:
                for rest, p in paths(s[k:]):
                    yield (t.text.index(s[:k], 259), *rest), p + logp[s[:k]]

    weight = {k: math.exp(p) for k, p in paths(raw)}
    total, n = sum(weight.values()), 20000
    text = word.encode()
    ids, at = t.sample(np.frombuffer(text * n, np.uint8), np.arange(n + 1) * len(text), np.arange(n).astype(np.uint64))
    got = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True))
    assert set(got) <= set(weight)
    for k, w in weight.items():
        p = w / total
        assert abs(got[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


M64 = (1 << 64) - 1


def spread(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_sample(t, text, row, seed):
    """Forward filtering and backward sampling of one text with dictionaries and whole numbers."""
    piece = {t.text[i]: (i, p) for i, p in zip(t.id.tolist(), t.logp.tolist(), strict=True) if i >= 0}
    m1, m2, m3 = (int(x) for x in (ps.M1, ps.M2, ps.M3))
    raw = (" " + text).encode() if text else b""
    seeds, out = (row + seed * m3) & M64, []
    for u, unit in enumerate(re.findall(rb" *[^ ]+| +$", raw)):
        edges, alpha = {}, [0.0] + [-math.inf] * len(unit)
        chars = [i for i in range(len(unit)) if unit[i] & 0xC0 != 0x80]
        for c, i in enumerate(chars):
            end = chars[c + 1] if c + 1 < len(chars) else len(unit)
            for j in range(i + 1, min(len(unit), i + t.longest) + 1):
                if unit[i:j] in piece:
                    edges.setdefault(j, []).append((i, *piece[unit[i:j]]))
            if unit[i:end] not in piece:
                for j in range(i, end):
                    edges.setdefault(j + 1, []).append((j, int(t.byte_id[unit[j]]), t.byte_logp))
        upto = {}
        for j in range(1, len(unit) + 1):
            if j in edges:
                e = sorted(edges[j], key=lambda x: x[1])
                top = max(p + alpha[i] for i, _, p in e)
                w = [math.exp(p + alpha[i] - top) for i, _, p in e]
                alpha[j] = top + math.log(sum(w))
                upto[j] = [(min(1.0, sum(x / sum(w) for x in w[: k + 1])), i, own) for k, (i, own, _) in enumerate(e)]
        at, step, got = len(unit), 0, []
        key = spread((spread(seeds ^ m1) + u * m3) & M64)
        while at:
            r = spread((key + step * m2) & M64) >> (64 - ps.DRAW_BITS)
            at, own = next((i, own) for k, (p, i, own) in enumerate(upto[at]) if k + 1 == len(upto[at]) or r < math.floor(p * (1 << ps.DRAW_BITS)))
            got.append(own)
            step += 1
        out += got[::-1]
    return out


@pytest.mark.parametrize("seed", [0, 7])
def test_digests_equal_plain_sampling(spark, seed):
    texts = [*TEXTS, "The quick brown fox jumps over the lazy dogs  again", "ééé naïveté straße 東京 ▁x"]
    rows = [(i * 7, t) for i, t in enumerate(texts)] + [(0, "another text"), (None, "null id"), (-5, "negative")]
    t = ps.Lattices(PATH, 1.0)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_pieces"], r["pieces_sha256"], r["lossless"]) for r in ps.sample_digests(spark.createDataFrame(rows, "doc_id long, text string"), PATH, seed=seed).collect())
    want = []
    for i, x in rows:
        ids = plain_sample(t, x or "", (i or 0) & M64, seed)
        want.append((str(i), len((x or "").encode()), len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True))
    assert got == sorted(want)


def test_draws_do_not_depend_on_the_memo(monkeypatch):
    """The same segmentations from a fresh memo, from a nearly full one, and with draws at both ends of a node's range."""
    fresh, full = ps.Lattices(PATH, 1.0), ps.Lattices(PATH, 1.0)
    rng = np.random.default_rng(3)
    junk = " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 9)) for _ in range(60000)).encode()
    full.sample(np.frombuffer(junk, np.uint8), np.array([0, len(junk)]), np.zeros(1, np.uint64))
    assert full.nodes > 500_000
    text = "Some ordinary sentences about naïve segmentations".encode()
    one = lambda t: t.sample(np.frombuffer(text * 50, np.uint8), np.arange(51) * len(text), np.arange(50).astype(np.uint64))[0].tolist()
    assert one(fresh) == one(full)
    # as if the memo had almost all nodes that it may have
    far = ps.Lattices(PATH, 1.0)
    far.nodes = 2 * ps.MEMO_EDGES
    assert one(far) == one(fresh)
    far.learn(np.array([1], np.uint64), np.frombuffer(b" word", np.uint8), np.array([0, 5]))
    at = int(far.end[np.searchsorted(far.known, np.uint64(1))])
    heads = far.cdf >> ps.DRAW_BITS
    own = np.flatnonzero((heads == at) | ((heads == at + 1) & (far.cdf & ((1 << ps.DRAW_BITS) - 1) == 0)))
    for r in (0, 1, (1 << ps.DRAW_BITS) - 1):
        assert np.searchsorted(far.cdf, (at << ps.DRAW_BITS) + r, "right") in own
