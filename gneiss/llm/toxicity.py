"""Toxic spans by a linear-chain conditional random field.

Labels mark documents, so tokens are labelled first: in a toxic document, a word whose log-odds of occurring in toxic
rather than clean training documents reaches TOKEN_ODDS. The field has two states; its features are the log-odds bins of
a token and of its two neighbours, and transitions. Forward-backward marginals give each token's probability; a document's
score is a logistic function of their sum, of the largest, and of the length.

Tokens are runs of letters (ASCII letters, lower-cased, and all bytes of longer characters).

Learning takes a bounded sample, SAMPLE labelled rows of each class (least hash of the id; of a text of more than
SAMPLE_CHARS characters that many), with the classes' true proportion as weights. Scoring reads whole texts. Empty and null
texts get the score of an empty document. Without labels of both classes every score is the (smoothed) share of toxic ones.

Labels: of several for one id the largest counts; null ids and labels other than 0 and 1 are not used; of several documents
with one id the least text is learned from. Every row is scored by its own text, whatever its id. Empty tables give empty
results. Columns other than id and text are not read; drop_toxic hands them on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import column, crc32_mod, flat, fresh, give_back, lean, pieces, settle, ship
from gneiss.llm.text import LETTERS, Words, span_hashes, split

SAMPLE, TOKEN_ODDS, SEGMENT = 1200, 2.5, 64
#: Characters of a sampled text that are learned; only longer ones are cut, and only for learning.
SAMPLE_CHARS = 1 << 16
#: Text bytes scored at a time: less than other operators take, for a token has about twenty numbers here.
SCORED_BYTES = 3 << 20
#: Upper edges of the log-odds bins; a word of no evidence is in the bin of 0.
EDGES = np.array([-3.0, -1.5, -0.5, 0.5, 1.5, 2.5, 3.5, 4.5])
NEUTRAL = int(np.searchsorted(EDGES, 0.0))


@dataclass
class Model:
    words: np.ndarray  # sorted hashes of words that are not neutral
    bins: np.ndarray
    weights: np.ndarray  # [3, bins]: state 1 against 0, for the previous, own and next token's bin
    trans: np.ndarray  # [2, 2] logs
    doc: np.ndarray  # bias, log sum, largest, log length


def bins_of(m: Model, h: np.ndarray) -> np.ndarray:
    if not len(m.words):
        return np.full(len(h), NEUTRAL)
    p = np.minimum(np.searchsorted(m.words, h), len(m.words) - 1)
    return np.where(m.words[p] == h, m.bins[p], NEUTRAL)


def emissions(weights: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per token the log-odds of state 1 from its features; beyond a sequence's ends neighbours are neutral."""
    prev, nxt = np.full(len(b), NEUTRAL), np.full(len(b), NEUTRAL)
    prev[1:], nxt[:-1] = b[:-1], b[1:]
    inner = first[:-1][first[:-1] < len(b)]
    prev[inner] = NEUTRAL
    last = first[1:][first[1:] > 0] - 1
    nxt[last] = NEUTRAL
    return weights[0, prev] + weights[1, b] + weights[2, nxt]


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(state 1) of each token, forward ratios, backward ratios), all sequences side by side."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, most = first[:-1][order], int(n.max()) if len(n) else 0
    live = np.searchsorted(-n[order], -np.arange(most), "left").tolist()
    x, t = np.exp(np.clip(e, -30, 30)), np.exp(trans)
    fwd, bwd = np.empty(len(e)), np.empty(len(e))
    r = np.empty(len(n))
    for i, m in enumerate(live):
        at = begin[:m] + i
        r = x[at] if i == 0 else x[at] * (t[0, 1] + t[1, 1] * r[:m]) / (t[0, 0] + t[1, 0] * r[:m])
        fwd[at] = r
    b = np.ones(len(n))
    end = begin + n[order] - 1
    for i, m in enumerate(live):
        at = end[:m] - i
        if i:
            v = x[at + 1] * b[:m]
            b = (t[1, 0] + t[1, 1] * v) / (t[0, 0] + t[0, 1] * v)
        bwd[at] = b[:m]
    odds = fwd * bwd
    return odds / (1 + odds), fwd, bwd


def fit_field(b: np.ndarray, y: np.ndarray, first: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transitions by gradient ascent (Adam) on the conditional likelihood."""
    k = len(EDGES) + 1
    w, t = np.zeros(3 * k + 4), None
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    inner = np.ones(len(b), bool)
    inner[first[:-1][first[:-1] < len(b)]] = False
    at = np.flatnonzero(inner)
    prev, nxt = np.full(len(b), NEUTRAL), np.full(len(b), NEUTRAL)
    prev[at], nxt[at - 1] = b[at - 1], b[at]
    seen = np.concatenate([np.bincount(f, weights=y, minlength=k) for f in (prev, b, nxt)] + [np.bincount(2 * y[at - 1] + y[at], minlength=4).astype(float)])
    for step in range(1, steps + 1):
        weights, t = w[: 3 * k].reshape(3, k), w[3 * k :].reshape(2, 2)
        e = weights[0, prev] + weights[1, b] + weights[2, nxt]
        p, fwd, bwd = marginals(e, first, t)
        x = np.exp(np.clip(e[at], -30, 30))
        x *= bwd[at]
        own = fwd[at - 1]
        pair = [np.full(len(at), np.exp(t[0, 0])), np.exp(t[0, 1]) * x, np.exp(t[1, 0]) * own, np.exp(t[1, 1]) * own * x]
        norm = 1 / sum(pair)
        want = np.concatenate([np.bincount(f, weights=p, minlength=k) for f in (prev, b, nxt)] + [[v @ norm for v in pair]])
        g = (seen - want) / max(1, len(b)) * 100 - 1e-3 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w = w + 0.15 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return w[: 3 * k].reshape(3, k), w[3 * k :].reshape(2, 2)


def doc_features(p: np.ndarray, w: Words) -> np.ndarray:
    docs = len(w.first) - 1
    n = np.diff(w.first)
    total = np.bincount(w.doc, weights=p, minlength=docs)
    top = np.zeros(docs)
    np.maximum.at(top, w.doc, p)
    return np.stack([np.ones(docs), np.log1p(total), top, np.log1p(n) / 10], axis=1)


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray) -> Model:
    """A model from labelled texts and the weight of each."""
    buf, off = flat(pa.array(texts, pa.string()))
    buf = LETTERS[buf]
    w = split(buf, off)
    h = span_hashes(buf, w.start, w.length)
    uniq, inv = np.unique(h, return_inverse=True)
    pairs = np.unique(inv.astype(np.int64) * len(texts) + w.doc)
    word, doc = pairs // len(texts), pairs % len(texts)
    hit = np.bincount(word, weights=y[doc], minlength=len(uniq))
    miss = np.bincount(word, weights=1 - y[doc], minlength=len(uniq))
    odds = np.log((hit + 0.25) / (y.sum() + 0.5)) - np.log((miss + 0.25) / ((1 - y).sum() + 0.5))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - np.sqrt(1 / (hit + 0.5) + 1 / (miss + 0.5)), 0)  # less a standard error
    b = np.searchsorted(EDGES, odds)
    keep = b != NEUTRAL
    bins = b[inv]
    label = ((odds[inv] >= TOKEN_ODDS) & (y[w.doc] == 1)).astype(np.int64)
    cuts = np.unique(np.concatenate([w.first, np.arange(0, len(w), SEGMENT)]))  # training sequences of at most SEGMENT tokens
    weights, trans = fit_field(bins, label, cuts) if len(w) else (np.zeros((3, len(EDGES) + 1)), np.zeros((2, 2)))
    p = marginals(emissions(weights, bins, w.first), w.first, trans)[0]
    x, d = doc_features(p, w), np.zeros(4)
    for _ in range(50):  # Newton's steps of a weighted logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ d, -30, 30)))
        g = x.T @ (weight * (y - q)) - 0.05 * d
        d = d + np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(4), g)
    return Model(uniq[keep], b[keep], weights, trans, d)


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold: bool = True) -> Model | float:
    """A model of the sample; without both classes the share of toxic labels. fold: leave out crc32(id) mod 5 = 0."""
    lab = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    if fold:
        lab = lab.filter(crc32_mod("id", 5) != 0)
    lab = lab.groupBy("id").agg(F.max("y").alias("y"))
    count = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(count) < 2:
        return (count.get(1, 0) + 0.5) / (sum(count.values()) + 1)
    least = [lab.filter(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(SAMPLE) for c in (0, 1)]  # each partition sends SAMPLE rows at most
    top = least[0].unionByName(least[1])
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.substring(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 1, SAMPLE_CHARS).alias("text")).join(F.broadcast(top), "id").groupBy("id").agg(F.min(F.struct("text", "y")).alias("r")).select("id", "r.text", "r.y").collect()  # 2 * SAMPLE rows at most
    rows.sort(key=lambda r: (r["id"], r["text"]))
    y = np.array([r["y"] for r in rows], np.int64)
    if not 0 < y.sum() < len(y):
        return (count[1] + 0.5) / (sum(count.values()) + 1)
    share = np.where(y == 1, count[1] / y.sum(), count[0] / (1 - y).sum())
    settle()
    model = fit([r["text"] for r in rows], y, share * len(y) / share.sum())
    give_back()
    return model


def token_marginals(m: Model, buf: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
    buf = LETTERS[buf]
    w = split(buf, off)
    b = bins_of(m, span_hashes(buf, w.start, w.length))
    return w, marginals(emissions(m.weights, b, w.first), w.first, m.trans)[0]


def text_scores(m: Model | float, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, Words | None, np.ndarray | None]:
    """Each text's score, its tokens and their marginals (none of both where the model is a share)."""
    if isinstance(m, float):
        return np.full(len(off) - 1, m), None, None
    w, p = token_marginals(m, buf, off)
    return 1 / (1 + np.exp(-np.clip(doc_features(p, w) @ m.doc, -30, 30))), w, p


def score(df: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic, spans (byte offsets of tokens of marginal >= 0.5, as start and end) of each row."""
    ship(df.sparkSession)
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("held_out", F.coalesce(crc32_mod("id", 5) == 0, F.lit(False)))
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=SCORED_BYTES):
            buf, off = flat(column(b, "text"))
            s, w, p = text_scores(shared.value, buf, off)
            if w is None:
                count, spans = np.zeros(b.num_rows, np.int64), [[]] * b.num_rows
            else:
                hit = np.flatnonzero(p >= 0.5)
                count = np.bincount(w.doc[hit], minlength=b.num_rows)
                at = np.stack([w.start[hit] - off[w.doc[hit]], w.start[hit] + w.length[hit] - off[w.doc[hit]]], axis=1).ravel()
                spans = [x.tolist() for x in np.split(at, 2 * np.cumsum(count)[:-1])]
            yield pa.record_batch([column(b, "id"), column(b, "held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(count, pa.int64()), pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "held_out", "score", "predicted", "n_toxic", "spans"])

    return d.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int, n_toxic long, spans array<long>")


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the rows whose texts the model predicts to be toxic; each row is judged by its own text, whatever its id."""
    model = learn(df, labels, id_col, text_col, fold=False)
    ship(df.sparkSession)
    shared, text = df.sparkSession.sparkContext.broadcast(model), fresh("judged_text", df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text, SCORED_BYTES):
            s = text_scores(shared.value, *flat(column(b, text)))[0]
            yield b.select(b.schema.names[:-1]).filter(pa.array(s < 0.5))

    return df.withColumn(text, F.col(f"`{text_col}`").cast("string")).mapInArrow(lean(run), df.schema)
