"""Language identification by cross-parsing entropy.

Per language a suffix automaton holds labelled text. A text is parsed greedily against each automaton into longest
matches. A phrase names a place in the labelled text, which costs the logarithm of that text's length; so a language's
cost is its number of phrases times log2 of the bytes it was learned from, and the least cost (divided by the text's
length: the cross-entropy) wins; ties go to the first language in alphabetical order. A byte that the language does not
have is a phrase of its own, and the phrase that is open at a text's end counts. Texts are lower-cased (A-Z), runs of
other ASCII than letters become one space, and parsed as one sequence: blocks of BLOCK bytes all at once, then again those
whose block before ended in another state than they began with, until none did.

Learning takes of each language a bounded sample of its rows: SAMPLE_DOCS texts (fewer where there are more than 16
languages, SAMPLE_ALL in all), those of at most SAMPLE_BYTES bytes first and then by the least hash of their id; of a
longer text, which is taken only where shorter ones do not suffice, its first SAMPLE_BYTES bytes. Prediction reads whole
texts. Null texts and texts without a letter are `und` with score 0. With nothing to learn from, everything is `und`. The
score is the winner's share of 2^-cost.

Rows are judged one by one: repeated rows get equal results, null ids are not learned from, empty tables give empty
results, and columns other than id, text and language are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.llm.common import column, crc32_mod, flat, lean, pieces, ship
from gneiss.llm.text import LETTERS, LOWER, squeeze

SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_BYTES, BLOCK = 48, 768, 1 << 15, 256
#: A phrase that ends, in a table's entry; twice that where the byte is a phrase of its own as well.
FAIL = np.int32(1 << 29)


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all substrings; state 0 is the root."""
    trans, link, length, last = [{}], [-1], [0], 0
    for c in data:
        cur = len(trans)
        trans.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p >= 0:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


class Parser:
    """An automaton as one table: next state times width, with FAIL for each phrase that ends before or with the byte."""

    def __init__(self, data: bytes):
        self.cost = np.log2(max(2, len(data)))  # bits that name a place in the labelled text
        trans = suffix_automaton(data)
        seen = sorted(set(data))
        self.width = len(seen) + 2  # the last two: bytes not seen, and padding
        self.code = np.full(256, len(seen), np.int32)
        self.code[seen] = np.arange(len(seen))
        root = np.zeros(self.width, np.int32)
        for c, s in trans[0].items():
            root[self.code[c]] = s * self.width
        table = np.tile(root | FAIL, (len(trans), 1))
        for s, t in enumerate(trans):
            for c, to in t.items():
                table[s, self.code[c]] = to * self.width
        table[1:, -2] = 2 * FAIL
        table[:, -1] = np.arange(len(trans)) * self.width  # padding changes nothing
        self.table = table.ravel()

    def phrases(self, blocks: np.ndarray, live: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ended phrases, last state) of each block from its start state; blocks run down, live masks padding."""
        code = self.code[blocks]
        code[~live] = self.width - 1
        s, n = start, np.zeros(blocks.shape[1], np.int32)
        for row in code:
            s = self.table[s + row]
            n += s >> 29
            s &= FAIL - 1
        return n, s

    def joined(self, blocks: np.ndarray, live: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Phrases of each block where a text's parse goes on from block to block; head marks texts' first blocks."""
        start = np.zeros(blocks.shape[1], np.int32)
        n, end = self.phrases(blocks, live, start)
        while len(redo := np.flatnonzero(~head[1:] & (end[:-1] != start[1:])) + 1):
            start[redo] = end[redo - 1]
            n[redo], end[redo] = self.phrases(blocks[:, redo], live[:, redo], start[redo])
        return n + (np.append(head[1:], True) & (end > 0))  # the phrase that is open at a text's end


def parse_counts(parsers: list[Parser], buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Phrases of each text (row) against each parser."""
    n = np.diff(off)
    per = -(-n // BLOCK)
    doc = np.repeat(np.arange(len(n)), per)
    begin = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * BLOCK
    t = np.arange(BLOCK)[:, None]
    live = t < np.minimum(BLOCK, off[doc + 1] - begin)
    blocks = buf[np.minimum(begin + t, max(len(buf) - 1, 0))] if len(buf) else np.zeros((BLOCK, 0), np.uint8)
    head = np.diff(doc, prepend=-1) > 0
    out = np.zeros((len(n), len(parsers)), np.int64)
    for k, p in enumerate(parsers):
        out[:, k] = np.bincount(doc, weights=p.joined(blocks, live, head), minlength=len(n))
    return out


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_letter = (LOWER[buf] >= 97) & (LOWER[buf] <= 122)
    c = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = c[off[1:]] > c[off[:-1]]
    high = np.concatenate([[0], np.cumsum(buf >= 128)])
    for i in np.flatnonzero(~out & (high[off[1:]] > high[off[:-1]])).tolist():
        out[i] = any(ch.isalpha() for ch in buf[off[i] : off[i + 1]].tobytes().decode())
    return out


def learn(train: DataFrame, text_col: str, lang_col: str, id_col: str) -> dict[str, bytes]:
    """The sampled texts of each language as one byte string: at most SAMPLE_ALL * SAMPLE_BYTES bytes, or a text a language."""
    langs = train.select(F.col(lang_col)).distinct().count()
    each = max(1, min(SAMPLE_DOCS, SAMPLE_ALL // max(1, langs)))
    text = F.col(text_col)
    ranked = train.select(F.col(lang_col).alias("lang"), F.substring(text, 1, SAMPLE_BYTES).alias("text"), (F.octet_length(text) > SAMPLE_BYTES).alias("long"), F.xxhash64(id_col).alias("h"), F.col(id_col).alias("k"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "k", "text"))).filter(F.col("r") <= each)
    out: dict[str, bytes] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r["lang"], r["r"])):
        raw = np.frombuffer(r["text"].encode()[:SAMPLE_BYTES], np.uint8)
        out[r["lang"]] = out.get(r["lang"], b"") + squeeze(LETTERS[raw], np.array([0, len(raw)]))[0].tobytes() + b" "
    return dict(sorted(out.items()))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns from rows with crc32(id) mod 4 <> 2."""
    spark = df.sparkSession
    ship(spark)
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    held = F.coalesce(crc32_mod("id", 4) == 2, F.lit(False))
    sample = learn(d.filter(~held & F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("id").isNotNull()), "text", "lang", "id")
    langs, key = list(sample), repr(sample)
    shared = spark.sparkContext.broadcast(sample)  # bounded, see learn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = sys.modules[__name__].__dict__.setdefault("_parsers", {})
        if key not in memo:
            memo.clear()
            memo[key] = [Parser(v) for v in shared.value.values()]
        for b in pieces(batches):
            buf, off = flat(column(b, "text"))
            ok = has_letter(buf, off) & bool(langs)
            buf, off = squeeze(LETTERS[buf], off)
            pred, score = ["und"] * len(ok), np.zeros(len(ok))
            if langs:
                cost = parse_counts(memo[key], buf, off) * np.array([p.cost for p in memo[key]])
                best = cost.argmin(axis=1)
                score = np.where(ok, 1 / np.exp2(np.maximum(cost.min(axis=1, keepdims=True) - cost, -1000)).sum(axis=1), 0.0)
                pred = [langs[k] if o else "und" for k, o in zip(best.tolist(), ok.tolist(), strict=True)]
            yield pa.record_batch([column(b, "id"), column(b, "held_out"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return d.select("id", "text", held.alias("held_out")).mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")
