"""Exact deduplication by content-defined chunk recipes.

Texts are normalised (each run of white space to one space) and cut where an 8-byte window's hash says so. Every distinct
chunk's bytes move once to verify that its digest names only those bytes; a document then is its ordered list of verified
identifiers, and only these lists are compared, so long texts are not moved again.

Null texts count as empty; empty texts equal each other. Repeated rows are rows of one group. A row whose id is null is
never a keeper unless all ids of its group are null. Of rows with the keeper's id and text exact_dedup calls each kept;
drop_copies leaves one of them. Rows of one id and different texts are different documents. Empty tables give empty
results. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import column, flat, lean, pieces, save, ship, two_columns, with_row_key
from gneiss.llm.text import M1, squeeze, words64

#: Chunks: 2 KiB on average (as many bits of the window hash are zero), 64 KiB at most.
CUT_BITS, MAX_CHUNK = 11, 1 << 16


def cut_points(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk boundaries of all texts (starts, with the end appended) and each text's number of chunks."""
    n = len(buf)
    stop = np.zeros(n + 1, bool)
    if n >= 8:
        hit = np.flatnonzero((words64(buf)[: n - 7] * M1) >> np.uint64(64 - CUT_BITS) == 0) + 8
        doc = np.searchsorted(off, hit - 1, "right") - 1
        stop[hit[hit - 8 >= off[doc]]] = True
    stop[off] = True
    at = np.flatnonzero(stop)
    gap = np.diff(at)
    if len(gap) and gap.max() > MAX_CHUNK:
        extra = [np.arange(at[i] + MAX_CHUNK, at[i + 1], MAX_CHUNK) for i in np.flatnonzero(gap > MAX_CHUNK)]
        at = np.unique(np.concatenate([at, *extra]))
    first = np.searchsorted(at, off)
    return at, np.diff(first)


def _recipes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        buf, off = squeeze(*flat(column(b, "text")))
        at, count = cut_points(buf, off)
        raw = buf.tobytes()
        ids = [hashlib.blake2b(raw[x:y], digest_size=size).digest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        ends = np.cumsum(count).tolist()
        yield pa.record_batch(
            {
                **({"key": column(b, "key")} if "key" in b.schema.names else {}),
                "id": column(b, "id"),
                "recipe": pa.array([b"".join(ids[e - c : e]) for c, e in zip(count.tolist(), ends, strict=True)], pa.binary()),
                "sha": pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.string()),
            }
        )


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        buf, off = squeeze(*flat(column(b, "text")))
        at, _ = cut_points(buf, off)
        raw = buf.tobytes()
        own = {c for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for c in (raw[x:y],)}
        if own:
            rows = list(own)
            yield pa.record_batch({"digest": pa.array([hashlib.blake2b(c, digest_size=size).digest() for c in rows], pa.binary()), "bytes": pa.array(rows, pa.binary())})


def chunk_table(docs: DataFrame, size: int) -> DataFrame:
    """One row per digest: the least and the greatest of the byte strings it names (equal when verified)."""
    made = docs.mapInArrow(lean(partial(_chunks, size=size)), "digest binary, bytes binary")
    return made.groupBy("digest").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi"))


def recipes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_size: int = 16, key_col: str | None = None) -> DataFrame:
    """([key,] id, recipe, sha): each text as the concatenated verified identifiers of its chunks, and its normalised SHA-256.

    If any digest names two byte strings, identifiers of twice the width are taken and verified again.
    """
    ship(df.sparkSession)
    docs = two_columns(df, id_col, text_col, key_col)
    while chunk_table(docs, digest_size).filter("lo <> hi").limit(1).count():
        if digest_size >= 64:
            raise RuntimeError("two chunks share a 512-bit digest")
        digest_size = min(64, 2 * digest_size)
    return save(docs.mapInArrow(lean(partial(_recipes, size=digest_size)), ("key long, " if key_col else "") + "id long, recipe binary, sha string"), "recipes")


def copy_groups(r: DataFrame, *more) -> DataFrame:
    """One row per recipe that several rows have: its least id, its size and what else is asked for.

    It is written, so that both sides of a join with it come from files: a recipe with very many rows can then be split.
    """
    return save(r.groupBy("recipe").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), *more).filter("group_size > 1"), "groups")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_size: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. The smallest id of a group stays."""
    r = recipes(df, id_col, text_col, digest_size)
    found = r.join(copy_groups(r).hint("merge"), "recipe", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return found.select(F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the rows that are copies; of equal texts one row with the smallest id stays."""
    keyed, key = with_row_key(df, id_col)
    r = recipes(keyed, id_col, text_col, key_col=key)
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("key"))).getField("key").alias("first_key")
    gone = r.join(copy_groups(r, first).hint("merge"), "recipe").filter("key <> first_key").select(F.col("key").alias(key))
    return keyed.join(gone, key, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
