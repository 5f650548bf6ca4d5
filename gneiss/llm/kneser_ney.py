"""Interpolated modified Kneser-Ney trigram model, counted in Spark and scored from memory-mapped sorted hash arrays.

Words are lower-cased (A-Z) runs of bytes other than white space; two begin tokens open each text, one end token closes it.
With u v w a trigram, tasks count their trigrams and send them, packed with a dictionary of their words, to the group of
the middle word v: there the counts after each context (u, v) and the numbers of different words before each pair (v, w)
meet. A word that is the middle of more than a group's usual share is split: its trigrams go by u to the groups that count
contexts and by w to those that count pairs. Which words are split follows from a bounded sample of texts; it changes where
things are counted, not what. Groups write sorted arrays to the shared folder and send on what they have of each word;
word groups add that up. Discounts come from counts of counts over all groups.

Every context is stored and scored by default. `min_context` above 1 leaves out contexts that were seen less often, which
then count as unseen (their trigrams still count for discounts, pairs and words). Probabilities sum to one over the
vocabulary and the unknown word in all cases.

Words are told apart by 64-bit hashes. Stored keys are 40 bits within a group of bounded size, so about one of a million
look-ups of an unseen pair, context or trigram finds another's count. Null and empty texts are the end token alone. Unknown
words share one event of 1/(V+1) at the lowest level. With no training text every probability is 1/(V+1) = 1.

Each row counts and is scored by its own text: repeated rows are counted each, rows of one id alike. Rows whose id is null
are scored, not learned from. Empty tables give empty results. Columns other than id and text are not read.
"""

from __future__ import annotations

import io
import tempfile
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import buckets, column, crc32_mod, flat, gathered, lean, map_groups, pieces, scratch_path, ship, two_columns
from gneiss.llm.substring_dedup import ROWS, _rows, pack, unpack
from gneiss.llm.text import LOWER, M1, M3, mix, span_hashes, split
from gneiss.llm.warc import file_system, store

END, BEGIN = np.uint64(1), np.uint64(2)
#: MB of input for each group; text bytes that a task counts at a time; arrays that a worker keeps mapped.
GROUP_MB, COUNTED_BYTES, MAPS = 8, 12 << 20, 4096
#: Texts, and characters of each, from which the words to be split and the common ones are chosen; most of the latter.
SAMPLE_TEXTS, SAMPLE_CHARS, COMMON = 4000, 5000, 100_000
#: Keys of an array from which on it is stored with a table of where each value of their first 16 bits begins (262 kB).
TABLE_KEYS = 1 << 17
LOW8, KEY40 = np.uint64(255), np.uint64((1 << 40) - 1)


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, first index per text) as hashes, with an end token per text."""
    low = LOWER[buf]
    x = split(low, off)
    h = span_hashes(low, x.start, x.length)
    h[h <= BEGIN] += np.uint64(3)
    return np.insert(h, x.first[1:], END), x.first + np.arange(len(x.first))


def before(w: np.ndarray, first: np.ndarray, begin) -> tuple[np.ndarray, np.ndarray]:
    """(word before the previous, previous word) of each word; begin before a text's first."""
    u, v = np.full_like(w, begin), np.full_like(w, begin)
    v[1:] = w[:-1]
    v[first[:-1]] = begin
    u[1:] = v[:-1]
    u[first[:-1]] = begin
    return u, v


def word_group(word: np.ndarray, groups: int) -> np.ndarray:
    return ((mix(word) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


@dataclass
class Layout:
    groups: int
    words: np.ndarray  #: the words that are split, sorted, and into how many groups
    ways: np.ndarray
    common: np.ndarray  #: frequent words, the most frequent first, which records name by their places


def part(layout: Layout, v: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The group of a middle word; of a split one, that of its neighbour."""
    groups, words, ways = layout.groups, layout.words, layout.ways
    g = word_group(v, groups)
    if len(words):
        p = np.minimum(np.searchsorted(words, v), len(words) - 1)
        m = np.flatnonzero(words[p] == v)
        g[m] = (g[m] + (mix(side[m] ^ M1) % ways[p[m]]).astype(np.int64)) % groups
    return g


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * M3 + b)


def heads(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


def spans(a: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    at = heads(a).tolist()
    return zip(at, [*at[1:], len(a)], strict=True) if at else iter(())


BOTH, CONTEXT, PAIR = 0, 1, 2


def _count(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    for x in gathered(batches, limit=COUNTED_BYTES):
        rows = _counted(*flat(column(x, "text")), layout)
        yield _rows(rows)


def numbered(seq: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, number of each token, places in common of the words that are there): the common words first, the most frequent ahead, then the others by hash."""
    words, w = np.unique(seq, return_inverse=True)
    by = np.argsort(common)
    p = by[np.minimum(np.searchsorted(common, words, sorter=by), len(common) - 1)] if len(common) else np.zeros(len(words), np.int64)
    known = common[p] == words if len(common) else np.zeros(len(words), bool)
    common_at = np.flatnonzero(known)
    order = np.concatenate([common_at[np.argsort(p[known])], np.flatnonzero(~known)])
    number = np.empty(len(words), np.uint64)
    number[order] = np.arange(len(words), dtype=np.uint64)
    return words[order], number[w], np.sort(p[known])


def pack_places(place: np.ndarray, n: int) -> bytes:
    """Rising places among n: differences, or a bit for each of the n where that is no longer."""
    steps = pack(np.diff(place, prepend=0))
    if len(steps) < (n + 7) // 8:
        return steps
    there = np.zeros(n, bool)
    there[place] = True
    return np.packbits(there).tobytes()


def unpack_places(data: bytes, n: int) -> np.ndarray:
    if len(data) < (n + 7) // 8:
        return np.cumsum(unpack(data, 1)[0])
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), count=n))


def _counted(buf: np.ndarray, off: np.ndarray, layout: Layout) -> list[tuple]:
    """Packed trigrams of some texts by group and kind."""
    seq, first = words_of(buf, off)
    words, w, common = numbered(np.append(seq, BEGIN), layout.common)
    del seq
    if len(words) >= 1 << 21 and len(off) > 2:  # numbers of three words must fit into 64 bits
        half = len(off) // 2
        return _counted(buf[: off[half]], off[: half + 1], layout) + _counted(buf[off[half] :], off[half:] - off[half], layout)
    if len(words) >= 1 << 21:
        raise ValueError("a single text has more than two million different words")
    u, v = before(w[:-1], first, w[-1])
    key = (v << np.uint64(42)) | (u << np.uint64(21)) | w[:-1]
    del u, v, w
    key.sort()
    at = heads(key)
    c, key = np.diff(np.append(at, len(key))).astype(np.int32), key[at]
    low = np.uint64((1 << 21) - 1)
    v, u, w = (x.astype(np.int32) for x in (key >> np.uint64(42), key >> np.uint64(21) & low, key & low))
    del key, at
    left = word_group(words, layout.groups).astype(np.int32)[v]
    right = left.copy()
    m = np.flatnonzero(np.isin(words, layout.words)[v])
    left[m], right[m] = part(layout, words[v[m]], words[u[m]]), part(layout, words[v[m]], words[w[m]])
    rows, number, z = [], np.zeros(len(words), np.int64), zstandard.ZstdCompressor(level=1)
    for kind, g, m in ((BOTH, left, left == right), (CONTEXT, left, left != right), (PAIR, right, left != right)):
        m = np.flatnonzero(m)
        m = m[np.argsort(g[m], kind="stable")]  # within a group still by middle word
        for lo, hi in spans(g[m]):
            i = m[lo:hi]
            own = np.unique(np.concatenate([u[i], v[i], w[i]]))
            number[own] = np.arange(len(own))
            k = int(np.searchsorted(own, len(common)))
            at = heads(v[i])
            x = number[u[i]]  # rises within a middle word, as words do: sent as differences
            steps = np.diff(x, prepend=0)
            steps[at] = x[at]
            parts = [pack_places(common[own[:k]], len(layout.common)), pack(np.diff(words[own[k:]], prepend=np.uint64(0))), pack(number[v[i[at]]], np.diff(np.append(at, len(i)))), pack(steps, number[w[i]], c[i])]
            rows.append((int(g[i[0]]), kind, 0, z.compress(np.array([len(x) for x in parts], "<i8").tobytes() + b"".join(parts))))
    return rows


def _trigrams(group: pa.Table, kinds: tuple[int, ...], common: np.ndarray) -> tuple[np.ndarray, ...]:
    """The group's different trigrams of these kinds: key, u, v, w, count, sorted by key."""
    got, z = ([], [], [], []), zstandard.ZstdDecompressor()
    for kind, packed in zip(group["kind"].to_pylist(), group["data"], strict=True):
        if kind in kinds:
            data = z.decompress(packed.as_buffer())
            at = np.cumsum([32, *np.frombuffer(data, "<i8", 4)]).tolist()
            words = np.concatenate([common[unpack_places(data[at[0] : at[1]], len(common))], np.cumsum(unpack(data[at[1] : at[2]], 1)[0])])
            first, times = unpack(data[at[2] : at[3]], 2)
            steps, w, c = unpack(data[at[3] :], 3)
            times, u = times.astype(np.int64), np.cumsum(steps)
            begin = np.cumsum(times) - times
            u -= np.repeat(u[begin] - steps[begin], times)
            for x, y in zip(got, (words[u], np.repeat(words[first], times), words[w], c.astype(np.int32)), strict=True):
                x.append(y)
    u, v, w, c = ((np.concatenate(x), x.clear())[0] if x else np.zeros(0, np.uint64) for x in got)
    key = pair_key(pair_key(u, v), w)
    order = np.argsort(key)
    at = heads(key[order])
    c = np.add.reduceat(c[order], at, dtype=np.int64) if len(at) else c.astype(np.int64)
    own = order[at]
    return key[own], u[own], v[own], w[own], c


def _tag() -> str:
    from pyspark import TaskContext

    return str(TaskContext.get().taskAttemptId())


def _save(folder: str, name: str, x: np.ndarray) -> None:
    f = io.BytesIO()
    np.save(f, x)
    store(f"{folder}/{name}.npy", f.getvalue(), _tag())


def _save_keys(folder: str, name: str, key: np.ndarray) -> None:
    """Sorted 64-bit keys by their upper 40 bits; of many keys the first 16 of these are told by where the key stands."""
    key = key >> np.uint64(24)
    kind, bits = (np.uint16, 16) if len(key) >= TABLE_KEYS else (np.uint32, 0)
    _save(folder, f"{name}-start", np.searchsorted(key, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(40 - bits)).astype(np.uint32))
    _save(folder, f"{name}-high", (key >> np.uint64(8)).astype(kind))
    _save(folder, f"{name}-low", (key & LOW8).astype(np.uint8))


def small_counts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes; those of 255 and more apart, as (index, count)."""
    big = np.flatnonzero(c >= 255)
    return np.minimum(c, 255).astype(np.uint8), np.stack([big, c[big]], axis=1).astype(np.int64)


def _save_counts(folder: str, name: str, c: np.ndarray) -> None:
    few, many = small_counts(c)
    _save(folder, f"{name}-few", few)
    _save(folder, f"{name}-many", many)


def kinds_of(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per run: the counts' sum, and how many are one, two and more."""
    if not len(at):
        return np.zeros((0, 4), np.int64)
    return np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (c, c == 1, c == 2, c >= 3)], axis=1)


def _by_word(rows: list[tuple], kind: int, word: np.ndarray, groups: int, *values: np.ndarray) -> None:
    """Appends packed rows of sorted words for the groups of the words."""
    g = word_group(word, groups)
    order = np.argsort(g, kind="stable")
    for lo, hi in spans(g[order]):
        i = order[lo:hi]
        rows.append((int(g[i[0]]), kind, 0, pack(word[i], *(x[i] for x in values))))


def _contexts(group: pa.Table, folder: str, layout: Layout, min_context: int) -> pa.Table:
    groups = layout.groups
    g, rows, split_here = group["bucket"][0].as_py(), [], any(k != BOTH for k in group["kind"].to_pylist())
    tri, u, v, w, c = _trigrams(group, (BOTH, CONTEXT), layout.common)
    sums = [("tri", [(c == i).sum() for i in range(1, 5)])]
    ctx = pair_key(u, v)
    order = np.argsort(ctx)
    at = heads(ctx[order])
    stats = kinds_of(c[order], at)
    kept = stats[:, 0] >= min_context
    of = np.empty(len(tri), bool)
    of[order] = np.repeat(kept, np.diff(np.append(at, len(order))))
    _save_keys(folder, f"tri-{g}", tri[of])
    _save_counts(folder, f"tri-{g}", c[of])
    _save_keys(folder, f"ctx-{g}", ctx[order][at][kept])
    stats = stats[kept]
    some = np.flatnonzero(stats[:, 0] > 1)  # contexts with one trigram have code 0
    _, first, code, n = np.unique(pair_key(pair_key(*stats[some, :2].T.astype(np.uint64)), pair_key(*stats[some, 2:].T.astype(np.uint64))), return_index=True, return_inverse=True, return_counts=True)
    often = np.argsort(-n, kind="stable")  # frequent statistics have small codes, which take a byte
    rank = np.empty(len(n), np.int64)
    rank[often] = np.arange(1, len(n) + 1)
    codes = np.zeros(len(stats), np.int64)
    codes[some] = rank[code.ravel()]
    _save_counts(folder, f"ctx-{g}-code", codes)
    _save(folder, f"ctx-{g}-table", np.concatenate([[[1, 1, 0, 0]], stats[some[first[often]]]]))
    del order, at, stats, ctx, of, code, codes
    if split_here:
        tri, u, v, w, c = _trigrams(group, (BOTH, PAIR), layout.common)
    key = pair_key(v, w)
    order = np.argsort(key)
    at = heads(key[order])
    own = order[at]
    lead, times = np.diff(np.append(at, len(order))), np.add.reduceat(c[order], at) if len(at) else c
    v, w = v[own], w[own]
    _save_keys(folder, f"pair-{g}", key[own])
    _save_counts(folder, f"pair-{g}", lead)
    sums.append(("pair", [(lead == i).sum() for i in range(1, 5)]))
    order = np.argsort(v)
    at = heads(v[order])
    _by_word(rows, 2, v[order][at], groups, *kinds_of(lead[order], at).T)
    order = np.argsort(w)
    at = heads(w[order])
    if len(at):
        _by_word(rows, 0, w[order][at], groups, np.diff(np.append(at, len(order))), np.add.reduceat(times[order], at))
    rows.append((0, 1, 0, np.array([n for _, x in sums for n in x], np.int64).tobytes()))
    return pa.Table.from_batches([_rows(rows)])


STATS = "name string, value long"
#: A word's occurrences, the different words before it, and of what follows it: pairs' sum, and how many are one, two, more.
WORD = ("count", "before", "total", "one", "two", "more")


def _words(group: pa.Table, folder: str) -> pa.Table:
    g, out, parts = group["bucket"][0].as_py(), [], []
    for kind, data in zip(group["kind"].to_pylist(), group["data"].to_pylist(), strict=True):
        if kind == 1:
            out += [(f"{name}{i}", n) for (name, i), n in zip(((x, i) for x in ("tri", "pair") for i in range(1, 5)), np.frombuffer(data, np.int64).tolist(), strict=True)]
        else:
            word, *x = unpack(data, 3 if kind == 0 else 5)
            values = np.zeros((len(word), 6), np.int64)
            values[:, (1, 0) if kind == 0 else (2, 3, 4, 5)] = np.stack(x, axis=1).astype(np.int64)
            parts.append((word, values))
    if parts:
        word, values = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        order = np.argsort(word, kind="stable")
        at = heads(word[order])
        values = np.add.reduceat(values[order], at, axis=0)
        _save(folder, f"word-{g}-key", word[order][at])
        for i, name in enumerate(WORD):
            _save_counts(folder, f"word-{g}-{name}", values[:, i])
        count, lead = values[:, 0], values[:, 1]
        out += [("words", int((count > 0).sum())), ("tokens", int(count.sum())), ("pairs", int(lead.sum())), ("word3+", int((lead >= 3).sum()))]
        out += [(f"word{i}", int((lead == i).sum())) for i in range(1, 5)]
    return pa.table([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64())], names=["name", "value"])


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more from n1..n4; a half where counts of counts are missing."""
    if n[0] == 0:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [(i + 1) - (i + 2) * y * n[i + 1] / n[i] if n[i] else y for i in range(3)]
    return [min(max(x, 0.0), i + 1.0) for i, x in enumerate(d)]


def split_words(texts: DataFrame, groups: int) -> Layout:
    """Middle words whose share of a sample of texts is above half a group's, and into how many groups they go."""
    h = F.xxhash64("id")
    least = [r["h"] for r in texts.select(h.alias("h")).orderBy("h").limit(SAMPLE_TEXTS).collect()]  # only then texts, so that no task sends more than are taken
    rows = texts.filter(h <= least[-1]).select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).limit(2 * SAMPLE_TEXTS).collect() if least else []
    v = before(*words_of(*flat(pa.array([r["text"] or "" for r in rows], pa.string()))), BEGIN)[1] if rows else np.zeros(0, np.uint64)
    words, n = np.unique(v, return_counts=True)
    ways = np.ceil(2 * groups * n / max(1, len(v))).astype(np.uint64)
    m = (ways > 1) & (n >= 20)
    often = np.argsort(-n, kind="stable")[: min(int((n > 1).sum()), COMMON)]
    return Layout(groups, words[m], np.minimum(ways[m], np.uint64(groups)), words[often])


def train(texts: DataFrame, groups: int, min_context: int = 1) -> tuple[str, dict]:
    """Counts (id, text) rows into arrays under a new folder; returns it with the model's sums and discounts."""
    folder, layout = scratch_path(texts.sparkSession, "ngrams"), split_words(texts, groups)
    # as many partitions as groups: a task reads a few groups, however large the input
    sent = map_groups(texts.mapInArrow(lean(partial(_count, layout=layout)), ROWS).repartition(groups, "bucket"), "bucket", lambda t: _contexts(t, folder, layout, min_context), ROWS)
    words = map_groups(sent, "bucket", lambda t: _words(t, folder), STATS)
    s = {r["name"]: r["v"] for r in words.groupBy("name").agg(F.sum("value").alias("v")).collect()}
    get = lambda k: s.get(k, 0)
    model = {"layout": layout, "words": get("words"), "tokens": get("tokens"), "pairs": get("pairs")}
    for x in ("tri", "pair", "word"):
        model[f"{x}_d"] = discounts([get(f"{x}{i}") for i in range(1, 5)])
    model["word_rest"] = float(np.dot(model["word_d"], [get("word1"), get("word2"), get("word3+")]))
    return folder, model


class Arrays:
    """The model's arrays, mapped into memory; from a store that cannot be mapped, a copy is. At most MAPS are kept."""

    def __init__(self, folder: str):
        self.fs, self.root = file_system(folder)
        self.open: OrderedDict[str, np.ndarray | None] = OrderedDict()

    def get(self, name: str) -> np.ndarray | None:
        if name in self.open:
            self.open.move_to_end(name)
            return self.open[name]
        path = f"{self.root}/{name}.npy"
        if self.fs.get_file_info(path).type == pafs.FileType.NotFound:
            x = None
        elif isinstance(self.fs, pafs.LocalFileSystem):
            x = np.load(path, mmap_mode="r").view(np.ndarray)
        else:
            with tempfile.NamedTemporaryFile(suffix=".npy") as f:  # unlinked at once; the map keeps it
                with self.fs.open_input_file(path) as src:
                    while block := src.read(8 << 20):
                        f.write(block)
                f.flush()
                x = np.load(f.name, mmap_mode="r").view(np.ndarray)
        if x is not None and not len(x):
            x = None
        self.open[name] = x
        if len(self.open) > MAPS:
            self.open.popitem(last=False)
        return x

    def place(self, name: str, q: np.ndarray) -> np.ndarray:
        """Where sorted 40-bit queries stand among the stored keys; -1 where they do not."""
        start, high, low = (self.get(f"{name}-{x}") for x in ("start", "high", "low"))
        if high is None:
            return np.full(len(q), -1)
        a, b = (q >> np.uint64(8)).astype(high.dtype), (q & LOW8).astype(np.uint8)
        first, last = (q >> np.uint64(8 * high.itemsize + 8)).astype(np.int64), len(high) - 1
        p, end = start[first].astype(np.int64), start[first + 1].astype(np.int64)
        step = 1 << int((end - p).max(initial=0)).bit_length() >> 1
        while step:  # the keys from start[first] up to p are smaller
            i = p + step
            p = np.where((i <= end) & (high[np.minimum(i - 1, last)] < a), i, p)
            step >>= 1
        out, open_ = np.full(len(q), -1), np.arange(len(q))
        while len(open_):
            i = np.minimum(p[open_], last)
            same = (high[i] == a[open_]) & (p[open_] < end[open_])
            hit = same & (low[i] == b[open_])
            out[open_[hit]] = i[hit]
            open_ = open_[same & ~hit]
            p[open_] += 1
        return out

    def counts(self, name: str, p: np.ndarray) -> np.ndarray:
        """Stored counts at places (0 at -1)."""
        few, many = self.get(f"{name}-few"), self.get(f"{name}-many")
        if few is None:
            return np.zeros(len(p), np.int64)
        x = few[np.maximum(p, 0)].astype(np.int64)
        top = np.flatnonzero(x == 255)
        if len(top):
            x[top] = many[np.searchsorted(many[:, 0], np.maximum(p[top], 0)), 1]
        x[p < 0] = 0
        return x


def by_group(g: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, places, how many of them each key has, sorted different 40-bit keys) of the queries of each group."""
    q = (g.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24))
    order = np.argsort(q)
    q = q[order]
    at = heads(q)
    q, at = q[at], np.append(at, len(order))
    for lo, hi in spans(q >> np.uint64(40)):
        yield int(q[lo] >> np.uint64(40)), order[at[lo] : at[hi]], np.diff(at[lo : hi + 1]), q[lo:hi] & KEY40


def look_up(arrays: Arrays, layout: Layout, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """(trigram counts, contexts' statistics, pairs' counts, statistics of each previous word, of each word)."""
    groups = layout.groups
    words, number = np.unique(np.concatenate([v, w]), return_inverse=True)
    facts, g = np.zeros((len(words), 6), np.int64), word_group(words, groups)
    for k in np.unique(g).tolist():
        i = np.flatnonzero(g == k)
        key = arrays.get(f"word-{k}-key")
        if key is not None:
            p = np.minimum(np.searchsorted(key, words[i]), len(key) - 1)
            p[key[p] != words[i]] = -1
            facts[i] = np.stack([arrays.counts(f"word-{k}-{name}", p) for name in WORD], axis=1)
    pair, tri, stats = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64), np.zeros((len(w), 4), np.int64)
    for k, i, n, q in by_group(part(layout, v, w), pair_key(v, w)):
        pair[i] = np.repeat(arrays.counts(f"pair-{k}", arrays.place(f"pair-{k}", q)), n)
    context, g = pair_key(u, v), part(layout, v, u)
    for k, i, n, q in by_group(g, context):
        p = arrays.place(f"ctx-{k}", q)
        hit = p >= 0
        if hit.any():
            stats[i[np.repeat(hit, n)]] = np.repeat(arrays.get(f"ctx-{k}-table")[arrays.counts(f"ctx-{k}-code", p[hit])], n[hit], axis=0)
    some = np.flatnonzero(stats[:, 0])
    for k, i, n, q in by_group(g[some], pair_key(context[some], w[some])):
        tri[some[i]] = np.repeat(arrays.counts(f"tri-{k}", arrays.place(f"tri-{k}", q)), n)
    return tri, stats, pair, facts[number[: len(v)]], facts[number[len(v) :]]


def probabilities(m: dict, tri: np.ndarray, stats: np.ndarray, pair: np.ndarray, prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    """P(word | the two words before)."""
    lost = lambda c, d: np.array([0.0, *d])[np.minimum(c, 3)]
    uniform = 1 / (m["words"] + 1)
    if not m["pairs"]:
        return np.full(len(tri), uniform)
    p = (word[:, 1] - lost(word[:, 1], m["word_d"]) + m["word_rest"] * uniform) / m["pairs"]
    for c, s, d in ((pair, prev[:, 2:], m["pair_d"]), (tri, stats, m["tri_d"])):
        p = np.where(s[:, 0] > 0, (c - lost(c, d) + (s[:, 1:] @ np.array(d)) * p) / np.maximum(s[:, 0], 1), p)
    return p


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_context: int = 1) -> DataFrame:
    """Trains on rows with crc32(id) mod 10 <> 0 (not on null ids) and scores all rows; perplexity is 10 ^ (-score / n_tokens)."""
    ship(df.sparkSession)
    docs = two_columns(df, id_col, text_col).withColumn("held_out", F.coalesce(crc32_mod("id", 10) == 0, F.lit(False)))
    folder, m = train(docs.filter("not held_out and id is not null").select("id", "text"), buckets(df, GROUP_MB), min_context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(folder)
        for x in pieces(batches):
            w, first = words_of(*flat(column(x, "text")))
            u, v = before(w, first, BEGIN)
            tri, stats, pair, prev, word = look_up(arrays, m["layout"], u, v, w)
            docs = len(first) - 1
            doc = np.repeat(np.arange(docs), np.diff(first))
            base = np.log10((word[:, 0] + 0.1) / (m["tokens"] + 0.1 * (m["words"] + 1)))
            model = np.log10(probabilities(m, tri, stats, pair, prev, word))
            by = lambda v: np.bincount(doc, weights=v, minlength=docs)
            yield pa.record_batch(
                [column(x, "id"), column(x, "held_out"), pa.array(np.diff(first), pa.int64()), pa.array(by(word[:, 0] > 0).astype(np.int64)), pa.array(np.full(docs, m["tokens"]), pa.int64()), pa.array(by(base)), pa.array(by(model))],
                names=[f.split()[0] for f in SCORES.split(", ")],
            )

    return docs.mapInArrow(lean(run), SCORES)
