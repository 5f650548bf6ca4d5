import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.llm import exact_dedup, flac, packing
from gneiss.llm.queries import tokenizer_path

TEXTS = [(1, "a b  c"), (2, "a b c"), (3, None), (4, ""), (5, "x" * 70000), (6, "x" * 70000), (7, " a b c"), (8, "é" * 40), (9, "a\tb\n\nc")]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS id", "1 AS recipe", "2 AS length")


def test_flac_round_trip_and_damage():
    rng = np.random.default_rng(1)
    xs = [rng.integers(-128, 128, n) for n in (64, 1024, 1025, 5000)] + [np.zeros(64, int), np.cumsum(rng.integers(-2, 3, 3000)).clip(-128, 127)]
    media = flac.encode(xs)
    got, blocks = flac.decode(media)
    assert all((a == b).all() for a, b in zip(xs, got, strict=True))
    assert [n for _, n in blocks[3]] == [1024, 1024, 1024, 1024, 904]
    assert (flac.read_samples(media[3], 2000, 1500) == xs[3][2000:3500]).all()
    assert len(media[5]) < 0.7 * 3000
    for at in (-1, -40, -900):
        bad = bytearray(media[3])
        bad[at] ^= 16
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    wide = [np.cumsum(rng.integers(-200, 201, 2500)).clip(-32768, 32767)]
    assert (flac.decode(flac.encode(wide, 16))[0][0] == wide[0]).all()


class Writer:
    def __init__(self):
        self.s = ""

    def put(self, v, n):
        self.s += format(v & ((1 << n) - 1), f"0{n}b") if n else ""

    def rice(self, v, k):
        u = (v << 1) ^ (v >> 63)
        self.s += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self):
        self.s += "0" * (-len(self.s) % 8)
        return bytes(int(self.s[i : i + 8], 2) for i in range(0, len(self.s), 8))


def crc(data, poly, bits):
    c = 0
    for byte in data:
        c ^= byte << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ (poly if c >> (bits - 1) else 0)) & ((1 << bits) - 1)
    return c


@pytest.mark.parametrize("mode", [1, 8, 9, 10])
def test_flac_stereo_partitions_escapes_wasted_bits(mode):
    """A frame written bit by bit: verbatim or fixed-2 subframes, two partitions of which one is escaped, no seek table."""
    rng = np.random.default_rng(mode)
    left = rng.integers(-50, 50, 32) * 2
    right = left + rng.integers(-3, 4, 32) * 2
    a, b = {1: (left, right), 8: (left, left - right), 9: (left - right, right), 10: ((left + right) >> 1, left - right)}[mode]
    w = Writer()
    w.put(0xFFF8, 16), w.put(6, 4), w.put(4, 4), w.put(mode, 4), w.put(1, 3), w.put(0, 1), w.put(0, 8), w.put(31, 8)
    w.put(crc(w.bytes(), 0x07, 8), 8)
    for c, x in enumerate((a, b)):
        bps = 8 + ((mode, c) in ((8, 1), (9, 0), (10, 1)))
        if c == 0 and mode != 10:  # even values: one wasted bit, verbatim
            w.put(1 << 1 | 1, 8), w.put(1, 1)
            for v in x >> 1:
                w.put(int(v), bps - 1)
            continue
        w.put(10 << 1, 8)
        for v in x[:2]:
            w.put(int(v), bps)
        res = np.diff(x, 2)
        w.put(1, 2), w.put(1, 4), w.put(31, 5), w.put(12, 5)
        for v in res[:14]:
            w.put(int(v), 12)
        w.put(4, 5)
        for v in res[14:]:
            w.rice(int(v), 4)
    frame = w.bytes()
    frame += crc(frame, 0x8005, 16).to_bytes(2, "big")
    pcm = np.stack([left, right], 1)
    info = (32).to_bytes(2, "big") * 2 + bytes(6) + ((8000 << 44) | (1 << 41) | (7 << 36) | 32).to_bytes(8, "big") + hashlib.md5(pcm.astype("i1").tobytes()).digest()
    got, _ = flac.decode([b"fLaC\x80\x00\x00\x22" + info + frame])
    assert (got[0] == pcm).all()


def test_flac_query_columns(spark):
    """Every column beside plain loops over the padded bytes; a stream does not depend on the texts that are coded with it."""
    stored = flac.write_pcm(flac.encode_texts(docs(spark)))
    rows = {r["doc_id"]: r for r in flac.media_features(stored).collect()}
    for i, t in TEXTS:
        raw = (t or "").encode()
        pad = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        s = [x - 128 for x in pad]
        crossings = sum((x < 0) != (y < 0) for x, y in zip(s, s[1:], strict=False))
        assert r["feature"] == f"blocks={-(-len(pad) // 1024)};peak={max(map(abs, s))};crossings={crossings};energy={sum(x * x for x in s)}"
        (media,) = flac.encode([np.array(s)])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    assert rows[5]["media_sha256"] == rows[6]["media_sha256"] and rows[3]["media_sha256"] == rows[4]["media_sha256"]
    assert flac.media_features(flac.write_pcm(flac.encode_texts(docs(spark, [])))).count() == 0


def test_pcm_blocks_are_seekable(spark):
    rng = np.random.default_rng(3)
    xs = {1: rng.integers(-128, 128, 5000), 2: rng.integers(-128, 128, 64), None: np.zeros(1024, int)}
    wide = np.cumsum(rng.integers(-200, 201, 2500)).clip(-32768, 32767)
    rows = [(i, len(x), flac.encode([x])[0]) for i, x in xs.items()] + [(2, 2500, flac.encode([wide], 16)[0])]
    stored = flac.write_pcm(spark.createDataFrame(rows, "id long, n_bytes long, media binary").withColumn("blocks", F.lit(1)))
    own = [(b["sample_offset"], b["n_samples"]) for b in flac.pcm_blocks(stored).filter("id = 1").orderBy("block").collect()]
    assert own == [(0, 1024), (1024, 1024), (2048, 1024), (3072, 1024), (4096, 904)]
    raw = [(i, x.astype("<i1").tobytes(), 1) for i, x in xs.items()] + [(2, wide.astype("<i2").tobytes(), 2)]
    for start, count in ((0, 10), (1000, 1100), (1024, 1024), (2047, 2), (4990, 500), (6000, 5)):
        got = sorted((str(r["id"]), bytes(r["pcm"])) for r in flac.pcm_range(stored, start, count).collect())
        assert got == sorted((str(i), x[start * w : (start + count) * w]) for i, x, w in raw)
    damaged = bytearray(rows[0][2])
    damaged[-900] ^= 16
    with pytest.raises(Exception, match="differs|residual|sync|reserved|seek table"):
        flac.write_pcm(spark.createDataFrame([(1, 5000, bytes(damaged))], "id long, n_bytes long, media binary"))


@pytest.mark.parametrize("size", [16, 1])
def test_exact_dedup(spark, size):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark), digest_size=size).collect()}
    assert {i: r["keep_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 8, 9: 1}
    assert got[1]["group_size"] == 3 and got[1]["kept"] and not got[9]["kept"]
    assert got[9]["text_sha256"] == hashlib.sha256(b"a b c").hexdigest()
    kept = exact_dedup.drop_copies(docs(spark))
    assert kept.columns == ["doc_id", "text", "id", "recipe", "length"] and kept.count() == 5
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_colliding_digests_are_widened(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(map(str, rng.integers(0, 9, 5)))) for i in range(400)]
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(docs(spark, rows), digest_size=1).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert got == {i: first[t] for i, t in rows}


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(bins) if r >= n]
        if fit:
            bins[min(fit, key=bins.__getitem__)] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_best_fit_runs_equal_item_by_item():
    rng = np.random.default_rng(5)
    for capacity in (7, 50, 200):
        for _ in range(20):
            lengths = rng.integers(1, capacity + 1, rng.integers(0, 120)).tolist()
            bins = Counter()
            for length, rank, at, offset in (runs := sorted(packing.best_fit_runs(dict(Counter(lengths)), capacity))):
                following = [r[1] for r in runs if r[0] == length and r[1] > rank]
                for k in range((min(following) if following else lengths.count(length)) - rank):
                    bins[at + k] += length
            assert sorted(capacity - b for b in bins.values()) == plain_best_fit(lengths, capacity)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [*TEXTS, (10, "Hello, WORLD's 42nd <|endoftext|> don't\x0bstop Ωσ Σ. é x y"), (11, "word " * 9000), (12, "hi")]
    got = packing.pack_documents(docs(spark, rows), path).toPandas()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids)
        for r in own.itertuples():
            assert r.start == 4096 * r.piece
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.values == np.concatenate([[0], np.cumsum(s.length)[:-1]])).all() and s.length.sum() <= 4096
    assert got.sequence_id.nunique() == len(plain_best_fit(got.length.tolist(), 4096))
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "x y"), (2, "x  y"), (2, "other text"), (None, "x y"), (None, "alone"), (1, "x y"), (3, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS `_gone`", "2 AS row_key", "3 AS first_key")
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"] or -1), r["text"] or "") for r in kept.collect()) == [(-1, "alone"), (1, "x y"), (2, "other text"), (3, "")]
    got = exact_dedup.exact_dedup(df).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in got) == [(-1, -1, 1, True), (-1, 1, 4, False), (1, 1, 4, True), (1, 1, 4, True), (2, 1, 4, False), (2, 2, 1, True), (3, 3, 2, True), (3, 3, 2, True)]
    packed = packing.pack_documents(df, tokenizer_path("word_bpe_49k.json")).toPandas()
    assert len(packed) == len(rows) and packed.sequence_id.nunique() == 1


def test_word_memo_starts_anew(monkeypatch):
    path = tokenizer_path("word_bpe_49k.json")
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 5)) for _ in range(40)) + " It's  42!" for _ in range(30)]
    t = packing.WordTokenizer(path)
    monkeypatch.setattr(packing, "MEMO", 100)
    monkeypatch.setattr(packing, "SLICE", 7)
    for x in texts:
        raw = np.frombuffer(x.encode(), np.uint8)
        assert t.encode(raw, np.array([0, len(raw)]))[0].tolist() == t.t.encode(x, add_special_tokens=False).ids
        assert len(t.known) <= 100 and (np.diff(t.known.astype(object)) > 0).all()


def test_many_items_of_a_length_are_salted(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 10)
    monkeypatch.setattr(packing, "SALTS", 4)
    rng = np.random.default_rng(2)
    rows = [(int(i % 50), 0, 0, int(n), int(i)) for i, n in enumerate(rng.choice([3, 3, 3, 5, 7, 20], 400))]
    got = packing.pack(spark.createDataFrame(rows, "id long, piece int, start long, length long, crc long"), 20).toPandas()
    assert sorted(got.ids_crc32) == list(range(400))
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.values == np.concatenate([[0], np.cumsum(s.length)[:-1]])).all() and s.length.sum() <= 20
    assert got.sequence_id.nunique() == len(plain_best_fit([r[3] for r in rows], 20))
