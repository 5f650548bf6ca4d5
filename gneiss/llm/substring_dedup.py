"""Substring deduplication with prefix-partitioned suffix trees over words.

A window (W consecutive words) is removed where the same words also start in a document with a smaller id. The suffix tree
of the corpus is never built whole. Its suffixes are sparse: of each window only the suffix at its anchor counts, the
K-word prefix with the least hash in the window, so equal windows choose the same suffix and about 2/(W-K+2) of all
positions are suffixes.

1. Tasks find repeats among their own texts (that also collapses hot passages to one copy per task) and send the prefixes
   of the rest, packed, by prefix. A prefix that only one document has is dropped: its subtree has no internal node.
2. Suffixes under a kept prefix go, with the words around them, to the group of that prefix. A prefix with more than
   `hot` suffixes is lengthened by half of what is left of the window, to the right and to the left, so that each window
   still meets its equals in one of both groups. Groups are sized to a task's memory.
3. Each group sorts its suffixes and takes the longest common prefixes of neighbours: the internal nodes of the group's
   subtree. A window that begins o words before its anchor is repeated where suffixes share a node of depth W-o and the o
   words to the left; all but the node's smallest document are marked. Unions of marked windows are the maximal repeats; they travel as runs.

Words are compared by 48-bit and prefixes by 64-bit hashes; a window counts as equal if all its word hashes are.

Null and empty texts have no words and stay as they are. Rows whose id is null neither remove nor lose words. Rows of one
id are parts of one document: each has its own positions and keeps its own words, no window crosses from one to the next,
and windows within one document do not count. Empty tables give empty results. Columns other than id and text are not
read; without_repeats hands them on, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gneiss.llm.common import buckets, column, flat, ids_repeat, lean, longs, map_groups, pieces, save, ship
from gneiss.llm.text import M3, Words, join_words, mix, span_hashes, split, window_hashes

#: Words of an anchor's prefix, suffixes of a prefix from which on it is lengthened, MB of input for each group.
PREFIX, HOT, GROUP_MB = 5, 4096, 6
_KEY48 = np.uint64((1 << 48) - 1)


def shorter(x: np.ndarray) -> np.ndarray:
    """Unsigned integers as bytes, plane by plane, without the planes that are zero throughout."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return np.concatenate([np.array([width], np.uint8), x.view(np.uint8).reshape(-1, 8)[:, :width].T.ravel()])


def longer(raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n integers from bytes of shorter(), and the bytes after them."""
    width = int(raw[0])
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw[1 : 1 + n * width].reshape(width, n).T
    return out.view(np.uint64).ravel(), raw[1 + n * width :]


def pack(*columns: np.ndarray) -> bytes:
    """Columns of one length of integers from 0 on."""
    return np.concatenate([np.array([len(columns[0])], "<u8").view(np.uint8), *map(shorter, columns)]).tobytes()


def unpack(raw: bytes, k: int) -> list[np.ndarray]:
    a = np.frombuffer(raw, np.uint8)
    n, rest, out = int(a[:8].view("<u8")[0]), a[8:], []
    for _ in range(k):
        x, rest = longer(rest, n)
        out.append(x)
    return out


def windows(w: Words, size: int) -> np.ndarray:
    """The starts of all windows: positions from which a text has size words."""
    last = w.first[1:][w.doc] - size
    return np.flatnonzero(np.arange(len(w)) <= last)


def anchors(h: np.ndarray, at: np.ndarray, size: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor, and the prefix hashes of all positions."""
    v = window_hashes(h, prefix)
    n = size - prefix + 1
    if not len(at):
        return at, v
    least, have = v.copy(), 1
    while have < n:  # sliding minima by doubling
        step = min(have, n - have)
        np.minimum(least[: len(least) - step], least[step:], out=least[: len(least) - step])
        have += step
    want, out, left = least[at], np.full(len(at), -1, np.int64), np.arange(len(at))
    for o in range(n):
        hit = v[at[left] + o] == want[left]
        out[left[hit]] = at[left[hit]] + o
        left = left[~hit]
    return out, v


def runs(ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marked windows as (document, start << RUN | number of consecutive ones)."""
    if not len(ids):
        return ids, start
    order = np.lexsort((start, ids))
    ids, start = ids[order], start[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (start[1:] > start[:-1] + 1) | (np.arange(1, len(ids)) % RUN_MOST == 0)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(ids)) - 1
    return ids[at], (start[at] << RUN) | (start[last] - start[at] + 1)


#: Bits of a run's length, and the longest run.
RUN, RUN_MOST = 20, (1 << 20) - 1
ROWS = "bucket int, kind int, id long, data binary"
MARKS = "kind int, id long, v long"


def _marks(kind: int, ids: np.ndarray, v: np.ndarray) -> pa.Table:
    return pa.table({"kind": pa.array(np.full(len(ids), kind), pa.int32()), "id": pa.array(ids.astype(np.int64)), "v": pa.array(v.astype(np.int64))})


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "kind", "id", "data"])


def _bucket(key: np.ndarray, groups: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _local(batches: Iterator[pa.RecordBatch], size: int, prefix: int, groups: int) -> Iterator[pa.RecordBatch]:
    """kind 0: packed prefixes of a bucket; kind 1: windows of a document that are repeats within this task's texts."""
    for b in pieces(batches):
        buf, off = flat(column(b, "text"))
        ids, part = longs(b, "id"), longs(b, "part")
        w = split(buf, off)
        h = span_hashes(buf, w.start, w.length)
        at = windows(w, size)
        if not len(at):
            continue
        doc_id = ids[w.doc[at]]
        wh = window_hashes(h, size)[at]
        order = np.lexsort((doc_id, wh))
        new = np.concatenate([[True], wh[order][1:] != wh[order][:-1]])
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the smallest document's window of the same hash
        again = doc_id[order] > doc_id[head]
        p, q = at[order[again]], at[head[again]]
        same = np.ones(len(p), bool)
        for j in range(size):
            same &= h[p + j] == h[q + j]
        done = np.zeros(len(w), bool)
        done[p[same]] = True
        base, p = int(ids.min()), p[same]
        i, v = runs(ids[w.doc[p]] - base, p - w.first[w.doc[p]] + part[w.doc[p]])
        rows = [(int(wh[0] >> np.uint64(33)) % groups, 1, base, pack(i.astype(np.uint64), v))] if len(p) else []
        a, v = anchors(h, at[~done[at]], size, prefix)
        a = np.unique(a)
        key = v[a]
        to = _bucket(key, groups)
        order = np.lexsort((key, to))
        a, key, to = a[order], key[order], to[order]
        cut = np.searchsorted(to, np.arange(groups + 1))
        d = w.doc[a]
        for g in np.flatnonzero(np.diff(cut)).tolist():
            s = slice(cut[g], cut[g + 1])
            rows.append((g, 0, base, pack(key[s] & _KEY48, (ids[d[s]] - base).astype(np.uint64), a[s] - w.first[d[s]] + part[d[s]])))
        yield _rows(rows)


def _repeated(group: pa.Table) -> pa.Table:
    """Which prefixes of a bucket several documents have. kind 0: their positions, last bit: hot; kind 1: runs, as they came."""
    kind, out = group["kind"].to_numpy(), []
    for k in (0, 1):
        part = group.filter(pa.array(kind == k))
        if not len(part):
            continue
        got = [(i, unpack(x, 3 - k)) for i, x in zip(part["id"].to_pylist(), part["data"].to_pylist(), strict=True)]
        ids = np.concatenate([g[1 - k].astype(np.int64) + i for i, g in got])
        if k:
            out.append(_marks(1, ids, np.concatenate([g[1] for _, g in got])))
            continue
        key, pos = np.concatenate([g[0] for _, g in got]), np.concatenate([g[2] for _, g in got])
        order = np.argsort(key, kind="stable")
        key, ids, pos = key[order], ids[order], pos[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(begin, len(key)))
        several = np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin)
        sel = np.repeat(several, count)
        out.append(_marks(0, ids[sel], (pos[sel] << np.uint64(1)) | np.repeat(count > HOT, count)[sel].astype(np.uint64)))
    return pa.concat_tables(out)


def lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists as (row, value)."""
    n = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(col)), n), col.flatten().to_numpy(zero_copy_only=False)


def _suffixes(batches: Iterator[pa.RecordBatch], size: int, prefix: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Packed suffixes for each group: document, position, the range of windows' offsets, and the words around."""
    more = (size - prefix) // 2
    for b in pieces(batches):
        b = b.filter(column(b, "marks").is_valid())
        if not b.num_rows:
            continue
        buf, off = flat(column(b, "text"))
        ids, part = longs(b, "id"), longs(b, "part")
        w = split(buf, off)
        h = span_hashes(buf, w.start, w.length)
        at = windows(w, size)
        a, v = anchors(h, at, size, prefix)
        state = np.zeros(len(w), np.uint8)  # 1: kept prefix, 3: a hot one
        d, x = lists(column(b, "marks"))
        p = w.first[d] + (x >> 1) - part[d]
        ok = (p >= w.first[d]) & (p < w.first[d + 1])
        state[p[ok]] = 1
        state[p[ok & (x & 1 == 1)]] = 3
        keep = state[a] > 0
        a, at = a[keep], at[keep]
        if not len(a):
            continue
        begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        p, most, least = a[begin], a[begin] - at[begin], a[begin] - at[np.append(begin[1:], len(a)) - 1]
        hot = state[p] == 3
        # (position, its group's key, least and most offset of the windows that it stands for)
        longer_key = window_hashes(h, prefix + more)
        right, left = hot & (least <= size - prefix - more), hot & (most > size - prefix - more)
        sets = [
            (p[~hot], v[p[~hot]], least[~hot], most[~hot]),
            (p[right], longer_key[p[right]], least[right], np.minimum(most[right], size - prefix - more)),
            (p[left], longer_key[p[left] - more], np.maximum(least[left], size - prefix - more + 1), most[left]),
        ]
        p, key, least, most = (np.concatenate(x) for x in zip(*sets, strict=True))
        to = _bucket(mix(key), groups)
        order = np.argsort(to, kind="stable")
        p, to, least, most = p[order], to[order], least[order], most[order]
        cut = np.searchsorted(to, np.arange(groups + 1))
        base = int(ids.min())
        h48 = h & _KEY48
        rows = []
        for g in np.flatnonzero(np.diff(cut)).tolist():
            s = slice(cut[g], cut[g + 1])
            n = most[s] + size - least[s]
            ends = np.cumsum(n)
            src = np.repeat(p[s] - most[s] - (ends - n), n) + np.arange(ends[-1])
            d = w.doc[p[s]]
            head = pack((ids[d] - base).astype(np.uint64), p[s] - w.first[d] + part[d], least[s], most[s])
            ctx = np.ascontiguousarray(h48[src]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            rows.append((g, len(head), base, head + ctx))
        yield _rows(rows)


def subtree_repeats(ids: np.ndarray, least: np.ndarray, most: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The subtree of one group: (suffix, offset) of each window that a smaller document has too.

    right[i] holds the words from suffix i on, left[i] those before it, nearest first.
    """
    order = np.lexsort(right.T[::-1])
    shared = np.logical_and.accumulate(right[order][1:] == right[order][:-1], axis=1).sum(axis=1)  # longest common prefixes
    found = []
    key = np.zeros(len(ids), np.uint64)
    for o in range(int(most.max()) + 1):
        if o:
            key = mix(key * M3 + left[:, o - 1])
        live = order[(least[order] <= o) & (o <= most[order])]
        if len(live) < 2:
            continue
        node = np.concatenate([[0], np.cumsum(shared < size - o)])  # nodes of depth size - o, in sorted order
        at = np.empty(len(ids), np.int64)
        at[order] = node
        rank = np.lexsort((ids[live], key[live], at[live]))
        s = live[rank]
        new = np.concatenate([[True], (at[s][1:] != at[s][:-1]) | (key[s][1:] != key[s][:-1])])
        first = ids[s][np.flatnonzero(new)[np.cumsum(new) - 1]]
        hit = s[ids[s] > first]
        found.append(np.stack([hit, np.full(len(hit), o)]))
    out = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return out[0], out[1]


def _subtrees(group: pa.Table, size: int, prefix: int) -> pa.Table:
    heads, ctx = [], []
    for n, base, data in zip(group["kind"].to_pylist(), group["id"].to_pylist(), group["data"].to_pylist(), strict=True):
        i, p, least, most = (x.astype(np.int64) for x in unpack(data[:n], 4))
        heads.append((i + base, p, least, most))
        ctx.append(np.frombuffer(data, np.uint8, offset=n).reshape(-1, 6))
    ids, p, least, most = (np.concatenate(x) for x in zip(*heads, strict=True))
    flat_ctx = np.zeros((sum(map(len, ctx)) + 1, 8), np.uint8)
    flat_ctx[:-1, :6] = np.concatenate(ctx)
    word = flat_ctx.view(np.uint64).ravel()
    n = most + size - least
    begin = np.cumsum(n) - n
    j = np.arange(size)
    right = np.where(j < (size - least)[:, None], word[np.minimum((begin + most)[:, None] + j, len(word) - 1)], 0)
    j = np.arange(max(1, int(most.max())))
    left = np.where(j < most[:, None], word[np.maximum((begin + most)[:, None] - 1 - j, 0)], 0)
    s, o = subtree_repeats(ids, least, most, left, right, size)
    return _marks(1, *runs(ids[s], p[s] - o))


def marked_rows(df: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, whole: bool = False) -> DataFrame:
    """(id, text, part, marks[, row]): each row with the runs of its document's repeated windows (null where there are none).

    part is where the row's positions begin within its document; row holds, if wanted, all columns of the input.
    """
    spark = df.sparkSession
    ship(spark)
    prefix = min(prefix, size)
    own = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if whole else []
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(0).cast("long").alias("part"), *own)
    if ids_repeat(df, id_col):  # a row's positions then follow those of the rows before it; a text has at most as many words as bytes
        before = Window.partitionBy("id").orderBy(F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
        rows = save(rows.withColumn("part", F.when(F.col("id").isNull(), 0).otherwise(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).over(before), F.lit(0))).cast("long")), "parts")
    docs = rows.select("id", "text", "part")
    groups = buckets(df, GROUP_MB)
    sent = docs.filter("id is not null").mapInArrow(lean(partial(_local, size=size, prefix=prefix, groups=groups)), ROWS)
    first = save(map_groups(sent, "bucket", _repeated, MARKS), "prefixes")

    def with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
        return rows.join(marks.groupBy(F.col("id").alias("key")).agg(F.collect_list("v").alias("marks")), F.col("id") == F.col("key"), "left").drop("key")

    suffixes = with_marks(docs, first.filter("kind = 0")).mapInArrow(lean(partial(_suffixes, size=size, prefix=prefix, groups=groups)), ROWS)
    global_marks = map_groups(suffixes, "bucket", lambda t: _subtrees(t, size, prefix), MARKS)
    return with_marks(rows, first.filter("kind = 1").unionByName(global_marks))


def removed(w: Words, marks: pa.Array, part: np.ndarray, size: int) -> np.ndarray:
    """Per word, whether a marked window covers it."""
    step = np.zeros(len(w) + 1, np.int64)
    d, v = lists(marks)
    s = w.first[d] + (v >> RUN) - part[d]
    end = np.minimum(s + (v & RUN_MOST) + size - 1, w.first[d + 1])
    ok = (s >= w.first[d]) & (s < end)
    np.add.at(step, s[ok], 1)
    np.add.at(step, end[ok], -1)
    return np.cumsum(step)[:-1] > 0


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        buf, off = flat(column(b, "text"))
        w = split(buf, off)
        gone = removed(w, column(b, "marks"), longs(b, "part"), size)
        out, at = join_words(buf, w, ~gone)
        raw = out.tobytes()
        n = np.diff(w.first)
        cut = np.bincount(w.doc[gone], minlength=len(n))
        yield pa.record_batch([column(b, "id"), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())], names=[f.split()[0] for f in RESULT.split(", ")])


def digests(marked: DataFrame, size: int) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    return marked.mapInArrow(lean(partial(_digest, size=size)), RESULT)


def _spans(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        buf, off = flat(column(b, "text"))
        w = split(buf, off)
        gone = np.concatenate([[False], removed(w, column(b, "marks"), longs(b, "part"), size), [False]])
        edge = gone[1:] != gone[:-1]
        edge[w.first[:-1]] |= gone[1:][w.first[:-1]] & gone[w.first[:-1]]
        ids, rows = column(b, "id").to_pylist(), []
        starts = np.flatnonzero(gone[1:] & edge[: len(gone) - 1])
        for s in starts.tolist():
            d, e = int(w.doc[s]), s + 1
            while e < w.first[d + 1] and gone[e + 1]:
                e += 1
            rows.append((ids[d], s - int(w.first[d]), e - s))
        yield pa.record_batch([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["doc_id", "first_word", "n_words"])


def repeat_spans(df: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_word, n_words): the maximal repeated stretches that removal takes out."""
    return marked_rows(df, size, id_col, text_col).mapInArrow(lean(partial(_spans, size=size)), "doc_id long, first_word long, n_words long")


def kept_bytes(b: pa.RecordBatch, size: int) -> tuple[np.ndarray, list[str]]:
    """Which rows lose words, and every row's text."""
    buf, off = flat(column(b, "text"))
    w = split(buf, off)
    gone = removed(w, column(b, "marks"), longs(b, "part"), size)
    touched = np.bincount(w.doc[gone], minlength=b.num_rows) > 0
    out, at = join_words(buf, w, ~gone)
    raw, old = out.tobytes(), column(b, "text").to_pylist()
    return touched, [raw[at[i] : at[i + 1]].decode() if t else old[i] for i, t in enumerate(touched.tolist())]


def _kept(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        yield pa.record_batch([column(b, "id"), pa.array(kept_bytes(b, size)[1], pa.string())], names=["id", "text"])


def kept_texts(df: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): texts without their repeated stretches; texts that have none are unchanged."""
    return marked_rows(df, size, id_col, text_col).mapInArrow(lean(partial(_kept, size=size)), "id long, text string")


def _kept_rows(batches: Iterator[pa.RecordBatch], size: int, text_at: int) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        touched, text = kept_bytes(b, size)
        row = column(b, "row")
        cols = [pa.array(text, pa.string()) if i == text_at else c for i, c in enumerate(row.flatten())]
        yield pa.record_batch([*cols, pa.array(touched)], names=[str(i) for i in range(len(cols))] + ["touched"])


def without_repeats(df: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """df with the texts that remain; chars_col, where df has it, follows texts that change. Other columns are kept as they are.

    A row whose id is null keeps its text.
    """
    text_at = df.columns.index(text_col)
    schema = StructType([StructField(str(i), StringType() if i == text_at else f.dataType) for i, f in enumerate(df.schema)]).add("touched", "boolean")
    new = marked_rows(df, size, id_col, text_col, whole=True).mapInArrow(lean(partial(_kept_rows, size=size, text_at=text_at)), schema)

    def out(i: int, name: str) -> Column:
        c = F.col(f"`{i}`")
        if name == chars_col:
            c = F.when(F.col("touched"), F.length(F.col(f"`{text_at}`"))).otherwise(c)
        return c.cast(df.schema[i].dataType).alias(name)

    return new.select(*[out(i, c) for i, c in enumerate(df.columns)])


def substring_dedup(df: DataFrame, size: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return digests(marked_rows(df, size, id_col, text_col), size)
