"""SentencePiece segmentations sampled by forward filtering and backward sampling over the piece lattice.

A text gets one leading space; spaces belong to the unit that follows them, and no piece of the vocabulary crosses from a
letter into a space, so the lattice factorises into units. Units that occur again share their lattice: per byte position
the pieces that end there, with forward-filtered probabilities. Sampling walks all units of a batch back from their ends
at once; each step's random number is a hash of (seed, row id, unit, step) and is compared with whole-number thresholds of its
node, so a row's segmentation depends on nothing else, neither on its batch nor on what the worker has seen before.

Piece weights fall with the vocabulary's rank as rank^-alpha. A character that is no piece is spelled in byte pieces, as is
a literal U+2581, so decoding gives back every text byte for byte. Pieces with a space inside are not used: no sampled
segmentation joins two words. Null and empty texts have no pieces. Rows with one id and one text get one segmentation, rows
of one id and different texts one each; null ids count as 0. Empty tables give empty results. Columns other than id and
text are not read.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gneiss.llm.common import column, flat, lean, pieces, ship, two_columns
from gneiss.llm.text import M1, M2, M3, mix, span_hashes

#: Edges of remembered lattices in a worker; beyond, it starts anew. Weight of a byte piece, as a rank.
MEMO_EDGES, BYTE_RANK = 8_000_000, 1 << 20
#: A step compares a whole number of so many bits with its node's thresholds; node and number share 64 bits.
DRAW_BITS = 36
SPACE_MARK = "▁"


class Lattices:
    """Lattices of units seen so far, in flat arrays."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_id, self.text, found = np.zeros(256, np.int64), [b""] * sp.get_piece_size(), {}
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.text[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                raw = p.replace(SPACE_MARK, " ").encode()
                if b" " not in raw.lstrip(b" "):
                    found[raw] = i
                    self.text[i] = raw
        self.longest = max(map(len, found))
        # one table of all pieces and their beginnings: piece id or -1, weight, and whether a longer piece begins so
        inner = {k[:j] for k in found for j in range(1, len(k))}
        known = sorted(inner | set(found))
        n = np.array([len(k) for k in known])
        h = self._roll(np.frombuffer(b"".join(known), np.uint8), np.cumsum(n) - n, n)
        ids = np.array([found.get(k, -1) for k in known])
        rank = np.array([-sp.get_score(int(i)) if i >= 0 else 0 for i in ids])
        self._place(h, ids, -alpha * np.log(2 + np.maximum(rank, 0)), np.array([k in inner for k in known]))
        self.byte_logp = -alpha * np.log(BYTE_RANK)
        self.size = np.array([len(x) for x in self.text])
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self._clear()

    def _place(self, h: np.ndarray, ids: np.ndarray, logp: np.ndarray, more: np.ndarray) -> None:
        """Open addressing by the hash's low bits, at most one slot in eight taken; the entry after the last stands for an empty slot."""
        self.mask = np.uint64((1 << (8 * len(h)).bit_length()) - 1)
        self.slot = np.full(int(self.mask) + 1, len(h), np.int32)
        at, left = h & self.mask, np.arange(len(h))
        while len(left):
            free = self.slot[at[left]] == len(h)
            self.slot[at[left[free]]] = left[free]
            left = left[self.slot[at[left]] != left]
            at[left] = (at[left] + np.uint64(1)) & self.mask
        self.hash, self.id = np.append(h, np.uint64(0)), np.append(ids, -1)
        self.logp, self.more = np.append(logp, 0.0), np.append(more, False)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash; the empty one where there is none."""
        empty = len(self.hash) - 1
        at = h & self.mask
        found = self.slot[at]
        open_ = np.flatnonzero((found != empty) & (self.hash[found] != h))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & self.mask
            found[open_] = self.slot[at[open_]]
            open_ = open_[(found[open_] != empty) & (self.hash[found[open_]] != h[open_])]
        return found

    @staticmethod
    def _roll(buf: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        h = np.zeros(len(start), np.uint64)
        for j in range(int(n.max()) if len(n) else 0):
            m = n > j
            h[m] = mix(h[m] * M3 + buf[start[m] + j].astype(np.uint64) + np.uint64(1))
        return h

    def _clear(self) -> None:
        self.known, self.end = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.cdf, self.src, self.piece, self.nodes = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def _in(self, table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.minimum(np.searchsorted(table, h), len(table) - 1)
        return table[p] == h, p

    def learn(self, h: np.ndarray, buf: np.ndarray, off: np.ndarray) -> None:
        """Adds units (bytes at off) with forward-filtered probabilities; node i of a unit is its byte position i."""
        n = np.diff(off)
        unit = np.repeat(np.arange(len(n)), n)
        left = off[1:][unit] - np.arange(len(buf))  # bytes to the unit's end
        boundary = (buf & 0xC0) != 0x80
        at, acc = np.flatnonzero(boundary), np.zeros(int(boundary.sum()), np.uint64)
        begin, length, ids, logp = [], [], [], []
        single = np.zeros(len(buf), bool)
        wide = np.where(buf >= 0xF0, 4, np.where(buf >= 0xE0, 3, np.where(buf >= 0xC0, 2, 1)))
        for size in range(1, self.longest + 1):
            live = left[at] >= size
            at, acc = at[live], acc[live]
            acc = mix(acc * M3 + buf[at + size - 1].astype(np.uint64) + np.uint64(1))
            p = self._find(acc)
            more, hit = self.more[p], self.id[p] >= 0
            begin.append(at[hit])
            length.append(np.full(int(hit.sum()), size))
            ids.append(self.id[p[hit]])
            logp.append(self.logp[p[hit]])
            single[at[hit & (wide[at] == size)]] = True
            at, acc = at[more], acc[more]
            if not len(at):
                break
        head = np.maximum.accumulate(np.where(boundary, np.arange(len(buf)), 0))
        spell = np.flatnonzero(~single[head])
        begin = np.concatenate([*begin, spell])
        length = np.concatenate([*length, np.ones(len(spell), np.int64)])
        ids = np.concatenate([*ids, self.byte_id[buf[spell]]])
        logp = np.concatenate([*logp, np.full(len(spell), self.byte_logp)])
        u = unit[begin]
        node = begin + u  # each unit has one node more than bytes
        to = node + length
        depth = begin + length - off[u]
        order = np.argsort((to << len(self.text).bit_length()) | ids)  # no two edges share both
        node, to, ids, logp, depth = node[order], to[order], ids[order], logp[order], depth[order]
        small = np.uint16 if int(n.max()) < 1 << 16 else np.int64  # short numbers are sorted by digits
        level = np.argsort(depth.astype(small), kind="stable")
        by_node, by_to, by_logp, depth = node[level], to[level], logp[level], depth[level]
        alpha = np.full(len(buf) + len(n), -np.inf)
        alpha[off[:-1] + np.arange(len(n))] = 0.0
        cut = np.searchsorted(depth, np.arange(int(n.max()) + 2))
        q = np.zeros(len(to))
        for d in range(1, int(n.max()) + 1):
            s = slice(cut[d], cut[d + 1])
            if cut[d] == cut[d + 1]:
                continue
            score = by_logp[s] + alpha[by_node[s]]
            heads = np.flatnonzero(np.concatenate([[True], by_to[s][1:] != by_to[s][:-1]]))
            top = np.maximum.reduceat(score, heads)
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(score))))
            w = np.exp(score - top[group])
            total = np.add.reduceat(w, heads)
            alpha[by_to[s][heads]] = top + np.log(total)
            q[s] = w / total[group]
        p = np.empty(len(to))
        p[level] = q
        heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        size = np.diff(np.append(heads, len(to)))
        # each node's running sums are its own, so that they do not depend on what else is learned at the same time
        for j in range(1, int(size.max())):
            k = heads[size > j] + j
            p[k] += p[k - 1]
        upto = np.floor(np.minimum(p, 1.0) * (1 << DRAW_BITS)).astype(np.int64)
        upto[heads + size - 1] = 1 << DRAW_BITS
        self.cdf = np.concatenate([self.cdf, ((to + self.nodes) << DRAW_BITS) + upto])
        self.src = np.concatenate([self.src, (node + self.nodes).astype(np.int32)])
        self.piece = np.concatenate([self.piece, ids.astype(np.int32)])
        order = np.argsort(k := np.concatenate([self.known, h]), kind="stable")
        self.known, self.end = k[order], np.concatenate([self.end, off[1:] + np.arange(len(n)) + self.nodes])[order]
        self.nodes += len(buf) + len(n)

    def sample(self, buf: np.ndarray, off: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sampled piece ids of all texts, and offsets."""
        some = np.diff(off) > 0
        lead = off[:-1][some]
        buf = np.insert(buf, lead, 32)
        off = off + np.concatenate([[0], np.cumsum(some)])
        space = buf == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[off[:-1][some]] = True
        start = np.flatnonzero(start)
        n = np.diff(np.append(start, len(buf)))
        first = np.searchsorted(start, off)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        h, where, back = np.unique(span_hashes(buf, start, n), return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._in(self.known, h)[0]) if len(self.known) else np.arange(len(h))
        if len(self.cdf) + 4 * int(n[where[new]].sum()) > MEMO_EDGES:
            self._clear()
            new = np.arange(len(h))
        if len(new):
            s, m = start[where[new]], n[where[new]]
            ends = np.cumsum(m)
            self.learn(h[new], buf[np.repeat(s - (ends - m), m) + np.arange(ends[-1])], np.concatenate([[0], ends]))
        if not len(h):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        end = self.end[np.searchsorted(self.known, h)][back]
        stop = end - n  # each unit's node 0
        key = mix(mix(seeds.astype(np.uint64) ^ M1)[doc] + (np.arange(len(doc)) - first[doc]).astype(np.uint64) * M3)
        lane = np.argsort(end, kind="stable")  # near nodes together: look-ups stay in the cache
        node, got, step = end[lane], [], np.uint64(0)
        while len(lane):
            r = (mix(key[lane] + np.array([step]) * M2) >> np.uint64(64 - DRAW_BITS)).astype(np.int64)
            e = np.searchsorted(self.cdf, (node << DRAW_BITS) + r, "right")
            got.append((lane, self.piece[e]))
            node = self.src[e].astype(np.int64)
            more = node > stop[lane]
            lane, node, step = lane[more], node[more], step + np.uint64(1)
        count = np.zeros(len(doc), np.int64)
        for k, (lane, _) in enumerate(got):
            count[lane] = k + 1
        ends = np.cumsum(count)
        out = np.zeros(int(ends[-1]), np.int32)
        for k, (lane, ids) in enumerate(got):
            out[ends[lane] - 1 - k] = ids
        return out, np.concatenate([[0], ends])[first]

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' bytes from their piece ids, and offsets; each text loses its leading space."""
        n = self.size[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        out = self.bytes[np.repeat(self.begin[ids] - (ends - n), n) + np.arange(total)]
        off = np.concatenate([[0], ends])[at]
        some = np.diff(at) > 0
        return np.delete(out, off[:-1][some]), off - np.concatenate([[0], np.cumsum(some)])


def lattices(path: str, alpha: float) -> Lattices:
    memo = sys.modules[__name__].__dict__.setdefault("_lattices", {})
    if (path, alpha) not in memo:
        memo[path, alpha] = Lattices(path, alpha)
    return memo[path, alpha]


def _sampled(df: DataFrame, path: str, alpha: float, seed: int, id_col: str, text_col: str, digest: bool, schema: str) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = lattices(path, alpha)
        for b in pieces(batches):
            buf, off = flat(column(b, "text"))
            rows = column(b, "id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids, at = t.sample(buf, off, rows.view(np.uint64) + np.uint64(seed) * M3)
            if not digest:
                yield pa.record_batch([column(b, "id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], names=["doc_id", "pieces"])
                continue
            raw = ids.astype("<i4")
            sha = [hashlib.sha256(raw[x:y].tobytes()).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            text, begin = t.decode_all(ids, at)
            same = np.diff(begin) == np.diff(off)
            if same.all():  # else texts are compared one by one
                wrong = np.concatenate([[0], np.cumsum(text != buf)])
                same = wrong[off[1:]] == wrong[off[:-1]]
            else:
                same = np.array([text[p:q].tobytes() == buf[x:y].tobytes() for p, q, x, y in zip(begin[:-1], begin[1:], off[:-1], off[1:], strict=True)])
            yield pa.record_batch([column(b, "id"), pa.array(np.diff(off), pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(sha, pa.string()), pa.array(same)], names=[f.split()[0] for f in schema.split(", ")])

    return two_columns(df, id_col, text_col).mapInArrow(lean(run), schema)


def sample_pieces(df: DataFrame, path: str, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pieces): a sampled segmentation of every row's text."""
    return _sampled(df, path, alpha, seed, id_col, text_col, False, "doc_id long, pieces array<int>")


def sample_digests(df: DataFrame, path: str, alpha: float = 1.0, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_pieces, pieces_sha256 (little-endian 32-bit ids), lossless (decoding gave the text back)."""
    return _sampled(df, path, alpha, seed, id_col, text_col, True, "doc_id long, n_bytes long, n_pieces long, pieces_sha256 string, lossless boolean")


def decode_pieces(df: DataFrame, path: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """(doc_id, text) from (doc_id, pieces)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = lattices(path, 1.0)
        for b in batches:
            text = [t.decode_all(np.array(x, np.int64), np.array([0, len(x)]))[0].tobytes().decode() if x is not None else None for x in column(b, pieces_col).to_pylist()]
            yield pa.record_batch([column(b, id_col), pa.array(text, pa.string())], names=["doc_id", "text"])

    return df.select(id_col, pieces_col).mapInArrow(lean(run), "doc_id long, text string")
