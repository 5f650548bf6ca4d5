"""N-gram Jaccard join by parity sketches.

A document's set are the hashes of its distinct shingles. Its sketch has one parity bit per hash value, cut into blocks;
a block's parities are kept as the XOR of the hashes in it, which is equal when they are. A shingle that only one of two
sets has changes one block, so the number of differing blocks (a Hamming distance) is at most the symmetric difference,
which at similarity t is at most (1-t)/(1+t) of the sizes' sum. By pigeonhole, with more blocks than that one is equal:
sets of a size band (and the band below) join on (block, XOR). Some spare blocks let a set leave out its empty ones, which
unrelated sets share: without this a star would grow with the input, and its pairs with the square.

1. Sets that are identical are one class, whose least document stands for it.
2. Packed keys meet in groups; each key links its documents to the least one. What a document leads so is its star, and
   two similar sets meet in the star of a key that they share.
3. Stars compare folded sketches, about one bit a shingle: what is further apart than the bound is no link, and of the rest
   a spanning forest is enough. Its components contain those of the true links.
4. A component's sets go to one cell, or to several where it is large, each with the component's leader. A cell links what
   is similar to the leader, and compares every other set with all sets of the cell through a prefix-filtered index of rare
   shingles; every link is verified on the whole sets. Sets that no leader took visit the other cells of their component,
   so no link is lost and no group's pairs are all listed. Large stars are split the same way.
5. Verified links give components.

Words are lower-cased (A-Z) runs of bytes other than white space. Fewer words than a shingle: the whole sequence is the
set's one member. Null texts and texts without words have empty sets and link with nothing. Shingles are compared by
64-bit hashes. Rows whose id is null get n_shingles and no component, and link with nothing. Rows that share an id are
documents of their own. Empty tables give empty results; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import buckets, column, flat, ids_repeat, lean, longs, map_groups, pieces, save, ship, two_columns, with_row_key
from gneiss.llm.graph import connected_components
from gneiss.llm.substring_dedup import _KEY48, _bucket, lists, pack, unpack
from gneiss.llm.text import LOWER, M1, M3, mix, span_hashes, split, window_hashes

#: MB of input per group of keys; sets in a cell; folded sketches in a cell.
GROUP_MB, CELL, SKETCH_CELL = 4, 1024, 4096
#: Text bytes that become shingles at a time: less than other operators take, for a shingle has about twenty numbers here.
SHINGLED_BYTES = 3 << 20
#: Spare blocks per hundred; enough for nearly all empty blocks of a band's smallest partners.
SPARE = 12


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, and where each text's begin."""
    buf = LOWER[buf]
    w = split(buf, off)
    h = span_hashes(buf, w.start, w.length)
    n = np.diff(w.first)
    grams = window_hashes(h, k)
    last = w.first[1:][w.doc] - k
    at = np.flatnonzero(np.arange(len(w)) <= last)
    doc, value = w.doc[at], grams[at]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.array([int(mix(np.add.reduce(h[w.first[d] : w.first[d + 1]] * (M3 ** np.arange(n[d], dtype=np.uint64)), keepdims=True) + n[d].astype(np.uint64))[0]) for d in short], np.uint64)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, own])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(off)))


def set_digests(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set (0 of an empty one)."""
    n = np.diff(first)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ M1), dtype=np.uint64)])
    return np.where(n > 0, mix(total[first[1:]] - total[first[:-1]]) ^ mix(n.astype(np.uint64)), 0)


def band_edges(most: int, percent: int) -> np.ndarray:
    """Sizes at which bands begin: similar sets are in one band or in neighbouring ones."""
    e = [1]
    while e[-1] <= most:
        e.append(e[-1] * 100 // percent + 1)
    return np.array([*e, e[-1] * 100 // percent + 1], np.int64)


def band_blocks(edges: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Per band: blocks, and how many of them a set may leave out because they are empty."""
    worst = (100 - percent) * 2 * (np.append(edges[1:], edges[-1] * 2) - 1) // (100 + percent)
    spare = np.where(worst > 0, -(-SPARE * worst // 100) + 1, 0)
    return worst + 1 + spare, spare


def sketch_keys(value: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of the blocks of every set, in its own band and as the smaller partner in the next.

    A set leaves out its first empty blocks, as many as are spare. Similar sets have more equal blocks than that; one that is
    not empty or, where all are empty, the last of them is left out by neither.
    """
    n = np.diff(first)
    edges = band_edges(int(n.max()) if len(n) else 0, percent)
    blocks, spare = band_blocks(edges, percent)
    band = np.searchsorted(edges, n, "right") - 1
    owner = np.repeat(np.arange(len(n)), n)
    place, sets, keys = (mix(value) >> np.uint64(32)), [], []
    for up in (0, 1):
        b = band + up
        count = np.where(n > 0, blocks[b], 0)
        begin = np.concatenate([[0], np.cumsum(count)])
        x = np.zeros(begin[-1], np.uint64)
        slot = begin[owner] + ((place * count[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, v = slot[order], value[order]
        head = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
        full = np.zeros(begin[-1], bool)
        if len(head):
            x[slot[head]] = np.bitwise_xor.reduceat(v, head)
            full[slot[head]] = True
        who = np.repeat(np.arange(len(n)), count)
        which = np.arange(begin[-1]) - begin[who]
        empty = np.flatnonzero(~full)  # by set, in order
        nth = np.arange(len(empty)) - np.searchsorted(who[empty], np.arange(len(n)))[who[empty]]
        keep = full
        keep[empty[nth >= spare[b[who[empty]]]]] = True
        sets.append(who[keep])
        keys.append(mix(x[keep] ^ mix((b[who[keep]] * (1 << 32) + which[keep]).astype(np.uint64))))
    return np.concatenate(sets), np.concatenate(keys)


def folded_sketches(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each set's parities of its hashes' last bits; as many bits as the power of two from its size on, at least 64.

    The lower half XOR the upper half is the sketch of half the width, so that neighbouring widths can be compared.
    """
    n = np.diff(first)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(n)), n)
    at = begin[owner] + (mix(value) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    raw = np.packbits((np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[begin[d] // 8 : begin[d + 1] // 8] for d in range(len(n))]


def _digest_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, limit=SHINGLED_BYTES):
        value, first = shingle_sets(*flat(column(b, "text")), k)
        yield pa.record_batch({"id": column(b, "id"), "n": pa.array(np.diff(first), pa.int64()), "set": pa.array(set_digests(value, first).view(np.int64)), "sketch": pa.array(folded_sketches(value, first), pa.binary())})


def _key_rows(batches: Iterator[pa.RecordBatch], k: int, percent: int, groups: int) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, limit=SHINGLED_BYTES):
        ids = longs(b, "id")
        value, first = shingle_sets(*flat(column(b, "text")), k)
        digest = set_digests(value, first)
        order = np.lexsort((ids, digest))
        same = np.zeros(len(ids), bool)
        same[order[1:]] = digest[order][1:] == digest[order][:-1]
        s, key = sketch_keys(value, first, percent)
        one = ~same[s]  # of identical sets in this batch the least id's keys are enough
        s, key = s[one], key[one]
        to = _bucket(key, groups)
        order = np.lexsort((key, to))
        s, key, to = s[order], key[order] & _KEY48, to[order]
        cut, base = np.searchsorted(to, np.arange(groups + 1)), int(ids.min())
        rows = [(g, base, pack(key[cut[g] : cut[g + 1]], (ids[s[cut[g] : cut[g + 1]]] - base).astype(np.uint64))) for g in np.flatnonzero(np.diff(cut)).tolist()]
        yield _rows(rows)


ROWS = "bucket int, id long, data binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "id", "data"])


def _pairs_of_keys(group: pa.Table, groups: int) -> pa.Table:
    """Each key's documents linked to the least of them; packed again by pair, since most pairs share many keys."""
    got = [(i, unpack(x, 2)) for i, x in zip(group["id"].to_pylist(), group["data"].to_pylist(), strict=True)]
    key, ids = np.concatenate([g[0] for _, g in got]), np.concatenate([g[1].astype(np.int64) + i for i, g in got])
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    u = ids[np.flatnonzero(new)[np.cumsum(new) - 1]]
    keep = u < ids
    u, v = u[keep], ids[keep]
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v = u[new], v[new]
    to = (mix(u.astype(np.uint64) * M3 + v.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
    rows, base = [], int(u.min()) if len(u) else 0
    for g in np.unique(to).tolist():
        m = to == g
        rows.append((g, base, pack((u[m] - base).astype(np.uint64), (v[m] - base).astype(np.uint64))))
    return pa.Table.from_batches([_rows(rows)])


def _distinct_pairs(group: pa.Table) -> pa.Table:
    got = [(i, unpack(x, 2)) for i, x in zip(group["id"].to_pylist(), group["data"].to_pylist(), strict=True)]
    u, v = (np.concatenate([g[c].astype(np.int64) + i for i, g in got]) for c in (0, 1))
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return pa.table({"u": u[new], "v": v[new]})


def candidate_pairs(docs: DataFrame, k: int, percent: int, groups: int) -> DataFrame:
    """(u, v): documents that share a sketch block with the least document of that block."""
    keys = docs.mapInArrow(lean(partial(_key_rows, k=k, percent=percent, groups=groups)), ROWS)
    packed = map_groups(keys, "bucket", lambda t: _pairs_of_keys(t, groups), ROWS)
    return map_groups(packed, "bucket", lambda t: _distinct_pairs(t), "u long, v long")


# ---------------------------------------------------------------- folded sketches

MEMBER, LEADER, VISITOR = 0, 1, 2


class Sketches:
    """The folded sketches of a cell by width, each width sorted by set size, with a union-find over what is near."""

    def __init__(self, n: np.ndarray, sketches: list[bytes], percent: int):
        self.n, self.percent, self.root = n, percent, list(range(len(n)))
        width = np.array([len(x) // 8 for x in sketches], np.int64)
        self.width, self.at, self.rows, self.folds = width, {}, {}, {}
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            at = at[np.argsort(n[at], kind="stable")]
            rows = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), np.uint64).reshape(len(at), w)
            self.at[w], self.rows[w] = at, rows
        self.own = np.empty(len(n), np.int64)
        for at in self.at.values():
            self.own[at] = np.arange(len(at))

    def find(self, i: int) -> int:
        return _find(self.root, i)

    def folded(self, w: int, to: int) -> np.ndarray:
        """The sketches of w words folded to a number of words that is not larger."""
        if w == to:
            return self.rows[w]
        if (w, to) not in self.folds:
            self.folds[w, to] = np.bitwise_xor.reduce(self.rows[w].reshape(len(self.rows[w]), w // to, to), axis=1)
        return self.folds[w, to]

    def near(self, i: int) -> np.ndarray:
        """Sets whose symmetric difference to set i may be small enough."""
        n, w, out = int(self.n[i]), int(self.width[i]), []
        low, high = -(-self.percent * n // 100), n * 100 // self.percent
        for other, at in self.at.items():
            a, b = np.searchsorted(self.n[at], [low, high + 1])
            if a == b:
                continue
            to = min(w, other)
            x, y = self.folded(w, to)[self.own[i]], self.folded(other, to)[a:b]
            far = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            out.append(at[a:b][far * (100 + self.percent) <= (100 - self.percent) * (n + self.n[at[a:b]])])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def link(self, i: int) -> list[int]:
        """Joins set i with what is near; those that were not yet in its tree."""
        new = []
        for j in self.near(i).tolist():
            a, b = self.find(i), self.find(j)
            if a != b:
                self.root[max(a, b)] = min(a, b)
                new.append(j)
        return new


def _find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def _near_in_cells(group: pa.Table, percent: int) -> pa.Table:
    """kind 0: a forest (u, v) over what is near in each cell; kind 1: members (u) of star v that are not near its leader."""
    star, cell, role, ids, n = (group[c].to_numpy() for c in ("star", "cell", "role", "id", "n"))
    data = group["sketch"].to_pylist()
    order = np.lexsort((ids, role != LEADER, cell, star))
    star_o, cell_o = star[order], cell[order]
    head = np.flatnonzero(np.concatenate([[True], (star_o[1:] != star_o[:-1]) | (cell_o[1:] != cell_o[:-1])]))
    kind, us, vs = [], [], []
    for lo, hi in zip(head.tolist(), [*head[1:].tolist(), len(order)], strict=True):
        at = order[lo:hi]
        c, own = Sketches(n[at], [data[i] for i in at.tolist()], percent), ids[at]
        if (role[at] == VISITOR).any():
            probes, left = np.flatnonzero(role[at] == VISITOR), []
        else:
            taken = c.link(0)
            us += [own[0]] * len(taken)
            vs += own[taken].tolist()
            probes = left = np.setdiff1d(np.arange(1, len(at)), taken)
        for i in probes.tolist():
            new = c.link(i)
            us += [own[i]] * len(new)
            vs += own[new].tolist()
        kind += [0] * (len(us) - len(kind)) + [1] * len(left)
        us += own[left].tolist()
        vs += [star[at[0]]] * len(left)
    return pa.table([pa.array(kind, pa.int32()), pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["kind", "u", "v"])


def sketch_links(pairs: DataFrame, sets: DataFrame, percent: int, groups: int, cell_size: int = SKETCH_CELL) -> DataFrame:
    """Stars (u, v) and sets (id, n, sketch) -> pairs (u, v) within the bound that connect all such pairs of a star."""
    star = save(pairs.filter("u <> v").select("u", "v").distinct(), "stars")
    sizes = save(star.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / cell_size).cast("int").alias("cells")), "star-sizes")  # a large star's rows can then be split
    cells = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    leads = sizes.select(F.col("u").alias("id"), F.col("u").alias("star"), cells.alias("cell"), F.lit(LEADER).alias("role"))
    split = star.join(sizes.hint("merge"), "u").select(F.col("v").alias("id"), F.col("u").alias("star"), F.pmod(F.xxhash64("v"), F.col("cells")).cast("int").alias("cell"), F.lit(MEMBER).alias("role"), "cells")

    def run(sent: DataFrame) -> DataFrame:
        full = sent.join(sets.select("id", "n", "sketch").hint("merge"), "id").withColumn("bucket", F.pmod(F.xxhash64("star", "cell"), F.lit(groups)))
        return save(map_groups(full, "bucket", lambda t: _near_in_cells(t, percent), "kind int, u long, v long"), "near")

    first = run(split.drop("cells").unionByName(leads))
    links = first.filter("kind = 0").select("u", "v")
    wide = split.filter("cells > 1")
    if wide.limit(1).count():
        visits = first.filter("kind = 1").select(F.col("u").alias("id"), F.col("v").alias("star")).join(wide, ["id", "star"])
        visits = visits.withColumn("to", cells).filter("`to` <> cell").select("id", "star", F.col("to").alias("cell"), F.lit(VISITOR).alias("role"))
        hosts = wide.drop("cells").join(visits.select("star", "cell").distinct(), ["star", "cell"], "left_semi")
        links = links.unionByName(run(hosts.select("id", "star", "cell", "role").unionByName(visits)).filter("kind = 0").select("u", "v"))
    return links


# ---------------------------------------------------------------- verification


def _ship(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row per cell that a document is sent to: its role there and its set."""
    for b in pieces(batches, limit=SHINGLED_BYTES):
        value, first = shingle_sets(*flat(column(b, "text")), k)
        doc, cell = lists(column(b, "cells"))
        _, role = lists(column(b, "roles"))
        raw = value.tobytes()
        data = [raw[8 * first[d] : 8 * first[d + 1]] for d in doc.tolist()]
        yield pa.record_batch([pa.array(cell), pa.array(role.astype(np.int32)), column(b, "id").take(pa.array(doc)), pa.array(data, pa.binary())], names=["cell", "role", "id", "data"])


SHIPPED = "cell long, role int, id long, data binary"


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets' Jaccard similarity reaches percent."""
    if not (100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) > 0):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


class Sets:
    """The sets of a cell with ids, links found so far, and an index of their rarest shingles."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        self.root = list(range(len(ids)))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        return _find(self.root, i)

    def test(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        if a == b or not similar(self.sets[i], self.sets[j], self.percent):
            return False
        self.root[max(a, b)] = min(a, b)
        self.links.append((self.ids[i], self.ids[j]))
        return True

    def search(self, probes: list[int]) -> None:
        """Finds links of each probe with all sets: two similar sets share one of their rarest shingles."""
        n = np.array([len(s) for s in self.sets], np.int64)
        token, rank = np.unique(np.concatenate(self.sets), return_inverse=True)
        freq = np.bincount(rank)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((rank, freq[rank], owner))
        owner, rank = owner[order], rank[order]
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        head = place < (n - (-(-self.percent * n // 100)) + 1)[owner]
        owner, rank = owner[head], rank[head]
        by = np.argsort(rank, kind="stable")
        t_rank, t_owner = rank[by], owner[by]
        cut = np.searchsorted(t_rank, np.arange(len(token) + 1))
        begin = np.searchsorted(owner, np.arange(len(n) + 1))
        for i in probes:
            near = [t_owner[cut[r] : cut[r + 1]] for r in rank[begin[i] : begin[i + 1]].tolist()]
            for j in np.unique(np.concatenate(near)).tolist() if near else ():
                if j != i:
                    self.test(i, j)


def _verify(group: pa.Table, percent: int) -> pa.Table:
    """kind 0: links (u, v) of a cell; kind 1: members (u) that the leader did not take."""
    role = group["role"].to_pylist()
    ids, sets = group["id"].to_pylist(), [np.frombuffer(x, np.uint64) for x in group["data"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (role[i] != LEADER, ids[i]))
    role, c = [role[i] for i in order], Sets([ids[i] for i in order], [sets[i] for i in order], percent)
    if VISITOR in role:
        c.search([i for i, r in enumerate(role) if r == VISITOR])
        left = []
    else:
        left = [i for i in range(1, len(ids)) if not c.test(0, i)]
        c.search(left)
    out = [(0, u, v) for u, v in c.links] + [(1, c.ids[i], c.ids[i]) for i in left]
    return pa.table([pa.array([r[x] for r in out], t) for x, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["kind", "u", "v"])


def _run_cells(docs: DataFrame, sent: DataFrame, k: int, percent: int) -> DataFrame:
    """sent (id, cell, role) -> what the cells found, saved."""
    to = sent.groupBy(F.col("id").alias("key")).agg(F.collect_list("cell").alias("cells"), F.collect_list("role").alias("roles"))
    shipped = docs.join(to.hint("merge"), F.col("id") == F.col("key")).select("id", "text", "cells", "roles").mapInArrow(lean(partial(_ship, k=k)), SHIPPED)
    return save(map_groups(shipped, "cell", lambda t: _verify(t, percent), "kind int, u long, v long"), "links")


def verified_links(docs: DataFrame, pairs: DataFrame, k: int, percent: int, cell_size: int = CELL) -> DataFrame:
    """Enough verified links (u, v) to connect whatever similar documents connect; docs have unique ids."""
    part = connected_components(pairs)
    members = part.select(F.col("v").alias("id"), "label").unionByName(part.select(F.col("label").alias("id"), "label").distinct())
    sizes = part.groupBy("label").agg(F.ceil((F.count(F.lit(1)) + 1) / cell_size).cast("int").alias("cells"))
    members = save(members.join(sizes, "label").withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int")), "members")
    # texts move once; later joins read only those of candidates. The hint keeps the plan the same at every size
    docs = save(docs.join(members.select(F.col("id").alias("key")).hint("merge"), F.col("id") == F.col("key"), "left_semi"), "candidates")
    name = lambda label, cell: F.xxhash64(label, cell)
    leads = members.filter("id = label").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    own = members.filter("id <> label").select("id", name("label", "cell").alias("cell"), F.lit(MEMBER).alias("role"))
    first = _run_cells(docs, own.unionByName(leads.select("id", name("label", "cell").alias("cell"), F.lit(LEADER).alias("role"))), k, percent)
    links = first.filter("kind = 0").select("u", "v")
    wide = members.filter("cells > 1")
    if wide.limit(1).count():
        visits = first.filter("kind = 1").select(F.col("u").alias("id")).join(wide, "id").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).filter("`to` <> cell")
        visits = visits.select("id", name("label", "to").alias("cell"), F.lit(VISITOR).alias("role"))
        hosts = wide.filter("id <> label").select("id", name("label", "cell").alias("cell"), F.lit(MEMBER).alias("role"))
        hosts = hosts.join(visits.select("cell").distinct(), "cell", "left_semi").select("id", "cell", "role")
        links = links.unionByName(_run_cells(docs, hosts.unionByName(visits), k, percent).filter("kind = 0").select("u", "v"))
    return links


def _linked(docs: DataFrame, groups: int, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """docs (id, text; ids that are not null are unique) -> every row's (id, n), and (key, component) of ids with sets."""
    sets = save(docs.mapInArrow(lean(partial(_digest_rows, k=k)), "id long, n long, set long, sketch binary"), "sets")
    known = docs.filter("id is not null")
    some = sets.filter("n > 0 and id is not null")
    reps = save(some.groupBy("n", "set").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    of = save(some.join(reps.drop("sketch").hint("merge"), ["n", "set"]).select("id", "rep"), "reps")
    pairs = candidate_pairs(known, k, percent, groups)
    pairs = pairs.join(of.select(F.col("id").alias("u"), F.col("rep").alias("ru")), "u").join(of.select(F.col("id").alias("v"), F.col("rep").alias("rv")), "v")
    near = sketch_links(pairs.select(F.col("ru").alias("u"), F.col("rv").alias("v")), reps.withColumnRenamed("rep", "id"), percent, groups)
    label = connected_components(verified_links(known, near, k, percent))
    out = of.join(label, of["rep"] == label["v"], "left").select(F.col("id").alias("key"), F.coalesce("label", "rep").alias("component"))
    return sets.select("id", "n"), out


def jaccard_components(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least id reachable by links, itself included).

    Where an id occurs in several rows, each row is a document of its own.
    """
    ship(df.sparkSession)
    groups = buckets(df, GROUP_MB)
    if not ids_repeat(df, id_col):
        sets, out = _linked(two_columns(df, id_col, text_col), groups, k, percent)
        return sets.join(out, F.col("id") == F.col("key"), "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    keyed, key = with_row_key(df, id_col)
    rows = two_columns(keyed, id_col, text_col, key).withColumn("own", F.when(F.col("id").isNotNull(), F.col("key")))
    sets, out = _linked(rows.select(F.col("own").alias("id"), "text"), groups, k, percent)
    part = save(rows.filter("own is not null").select("id", "own").join(out, F.col("own") == F.col("key")).select("id", "own", "component"), "parts")
    least = part.groupBy("component").agg(F.min("id").alias("component_id"))
    part = part.join(least, "component").select("own", "component_id")
    n = sets.filter("id is not null").select(F.col("id").alias("own"), "n")
    known = rows.filter("own is not null").select("id", "own").join(n, "own").join(part, "own", "left")
    lost = sets.filter("id is null").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return known.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")).unionByName(lost)


def drop_near_copies(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with one row, one with the least id, of each component; rows whose id is null stay."""
    keyed, key = with_row_key(df, id_col)
    ship(df.sparkSession)
    rows = two_columns(keyed, id_col, text_col, key).filter("id is not null")
    _, out = _linked(rows.select(F.col("key").alias("id"), "text"), buckets(df, GROUP_MB), k, percent)
    part = save(rows.select("id", F.col("key").alias("own")).join(out, F.col("own") == F.col("key")).select("id", "own", "component"), "parts")
    first = save(part.groupBy("component").agg(F.min(F.struct("id", "own")).getField("own").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "firsts")
    gone = part.join(first.hint("merge"), "component").filter("own <> first").select(F.col("own").alias(key))
    return keyed.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
