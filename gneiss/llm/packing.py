"""Best-fit-decreasing packing of token sequences with a segment tree over remaining capacities.

Tokens: texts split at white space, each distinct word is tokenised once per worker and batch (this tokenizer drops white
space and never joins across it), ids are gathered by position. Documents longer than the capacity are cut.

Packing: what best fit decreasing does depends on lengths only, so it runs on the histogram of lengths (at most `capacity`
numbers, counted in Spark), not on documents. Bins with the same content form one interval of sequence numbers; the segment
tree finds the tightest remaining capacity that fits in logarithmic time and a whole interval is filled at once. The
result is a list of runs (length, rank range -> sequence range, offset). Items get their rank within their length from
counts per salted group, so that no window holds all items of one length, and look their run up.

Null and empty texts hold the end id alone. Rows of one id and rows whose id is null are documents of their own, each with
pieces from 0 on. Empty tables give empty results. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import column, flat, lean, longs, pieces, save, ship, two_columns
from gneiss.llm.text import span_hashes, split

CAPACITY, END_ID = 4096, 1
#: Distinct words that a worker remembers; then it starts anew. Words given to the tokenizer, and text bytes cut, at a time.
MEMO, SLICE, CUT_BYTES = 1_000_000, 8192, 2 << 20

_memo: dict = {}


class WordTokenizer:
    """ids of texts by a word-wise tokenizer, through a memo of words; its size is bounded by MEMO and one chunk's words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes; where each word's ids begin, and how many it has
        self.at, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, new: np.ndarray, raw: bytes, start: list[int], length: list[int]) -> None:
        """new: sorted hashes of words that are not known; their bytes are in raw."""
        count, ids = [], [self.ids]
        for lo in range(0, len(new), SLICE):
            words = [raw[x : x + k].decode() for x, k in zip(start[lo : lo + SLICE], length[lo : lo + SLICE], strict=True)]
            got = [e.ids for e in self.t.encode_batch_fast(words, add_special_tokens=False)]
            count += map(len, got)
            ids.append(np.fromiter((x for g in got for x in g), np.uint32))
        count, base, p = np.array(count, np.int64), len(self.ids), np.searchsorted(self.known, new)
        self.ids = np.concatenate(ids)
        self.at = np.insert(self.at, p, base + np.cumsum(count) - count)
        self.count, self.known = np.insert(self.count, p, count), np.insert(self.known, p, new)

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        w = split(buf, off)
        if not len(w):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        h, first, back = np.unique(span_hashes(buf, w.start, w.length), return_index=True, return_inverse=True)
        if len(self.known) + len(h) > MEMO:
            self.forget()
        p = np.searchsorted(self.known, h)
        new = np.flatnonzero(self.known[np.minimum(p, len(self.known) - 1)] != h) if len(self.known) else np.arange(len(h))
        if len(new):
            self.learn(h[new], buf.tobytes(), w.start[first[new]].tolist(), w.length[first[new]].tolist())
            p = np.searchsorted(self.known, h)
        at, count = self.at[p][back], self.count[p][back]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(at - (ends - count), count) + np.arange(int(ends[-1]))]
        return ids, np.concatenate([[0], ends])[w.first]


def tokenizer(path: str) -> WordTokenizer:
    if path not in _memo:
        _memo[path] = WordTokenizer(path)
    return _memo[path]


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    t = tokenizer(path)
    for b in pieces(batches, limit=CUT_BYTES):
        ids, off = t.encode(*flat(column(b, "text")))
        n = np.diff(off) + 1  # with the end id
        full = np.insert(ids, off[1:], end_id).astype("<u4")
        begin = off[:-1] + np.arange(len(n))
        per = -(-n // capacity)
        doc = np.repeat(np.arange(len(n)), per)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        start = piece * capacity
        length = np.minimum(capacity, n[doc] - start)
        x = (begin[doc] + start).tolist()
        raw = memoryview(full.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(x, length.tolist(), strict=True)]
        yield pa.record_batch({"id": column(b, "id").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "crc": pa.array(crc, pa.int64())})


def cut_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, crc): the pieces of each document's ids."""
    ship(df.sparkSession)
    return two_columns(df, id_col, text_col).mapInArrow(lean(partial(_cut, path=path, capacity=capacity, end_id=end_id)), "id long, piece int, start long, length long, crc long")


class CapacityTree:
    """A segment tree over remaining capacities 0..n; each leaf holds intervals of equal open bins."""

    def __init__(self, n: int):
        self.size = 1
        while self.size <= n:
            self.size *= 2
        self.open = [False] * (2 * self.size)
        self.leaf: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _mark(self, r: int) -> None:
        i = r + self.size
        self.open[i] = bool(self.leaf[r])
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def add(self, r: int, interval: tuple[int, int]) -> None:
        self.leaf[r].append(interval)
        if len(self.leaf[r]) == 1:
            self._mark(r)

    def pop(self, r: int) -> tuple[int, int]:
        got = self.leaf[r].pop()
        if not self.leaf[r]:
            self._mark(r)
        return got

    def tightest(self, need: int) -> int:
        """The smallest remaining capacity of at least need that an open bin has; -1 if none."""
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best fit decreasing on a histogram of lengths: (length, first rank, first sequence, offset) of each run of items."""
    tree, runs, bins = CapacityTree(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            r = tree.tightest(length)
            at, many = tree.pop(r) if r >= 0 else (bins, todo)
            r = r if r >= 0 else capacity
            fit = r // length  # a bin, once chosen, stays the tightest until no more fit
            whole = min(many, todo // fit)
            rest = min(fit, todo - whole * fit) if whole < many else 0
            for n, first, count in ((fit, at, whole), (rest, at + whole, 1)):
                if n and count:
                    for j in range(n):
                        runs.append((length, rank + j * count, first, capacity - r + j * length))
                    rank, todo = rank + n * count, todo - n * count
                    tree.add(r - n * length, (first, count))
            used = whole + (rest > 0)
            if at == bins:
                bins += used
            elif used < many:
                tree.add(r, (at + used, many - used))
    return runs


#: Ranks of a length are counted within salts of at most about this many rows; a length of many rows has SALTS at least.
SALT_ROWS, SALTS = 8192, 64


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (saved; with length in 1..capacity, id, piece) plus sequence_id and offset."""
    spark = items.sparkSession
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    lengths = sorted(counts)
    salts = [max(-(-counts[n] // SALT_ROWS), min(SALTS, -(-counts[n] // SALTS))) for n in lengths]
    salted = items.join(F.broadcast(spark.createDataFrame(list(zip(lengths, salts, strict=True)), "length long, salts int")), "length")  # at most capacity rows
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "crc"), F.col("salts")).cast("int"))
    # ranks before each (length, salt); at most capacity * SALTS rows and one for each SALT_ROWS items
    begin = np.concatenate([[0], np.cumsum(salts)]).astype(np.int64)
    first = np.zeros(begin[-1], np.int64)
    row = {n: i for i, n in enumerate(lengths)}
    for r in salted.filter("salts > 1").groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect() if any(x > 1 for x in salts) else ():
        first[begin[row[r["length"]]] + r["salt"]] = r["n"]
    total = np.cumsum(first) - first
    first = total - np.repeat(total[begin[:-1]], salts) if lengths else total
    runs = np.array(sorted(best_fit_runs(counts, capacity)), np.int64).reshape(-1, 4)
    # bounded: its size follows the number of distinct lengths and salts, not that of documents
    shared = spark.sparkContext.broadcast((np.array(lengths, np.int64), begin, first, runs))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece")).cast("long") - 1)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, begin, first, runs = shared.value
        key = runs[:, 0] * (1 << 48) + runs[:, 1]
        for b in batches:
            n, salt = longs(b, "length"), longs(b, "salt")
            rank = longs(b, "rank") + first[begin[np.searchsorted(lengths, n)] + salt]
            i = np.searchsorted(key, n * (1 << 48) + rank, "right") - 1
            yield pa.record_batch([column(b, "id"), column(b, "piece"), column(b, "start"), column(b, "length"), column(b, "crc"), pa.array(runs[i, 2] + rank - runs[i, 1]), pa.array(runs[i, 3])], names=[f.split()[0] for f in schema.split(", ")])

    return ranked.mapInArrow(lean(place), schema)


def pack_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(save(cut_documents(df, path, id_col, text_col, capacity, end_id), "pieces"), capacity)
