"""Connected components by alternating large-star and small-star rounds; labels are the components' least vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import save


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs -> (v, label) for every vertex but the least of each component.

    Nulls and loops are ignored; repeated edges count once. Each round is written to the shared folder, so a lost executor
    costs a round at most. Rounds grow with the logarithm of the longest chain.
    """
    e = save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = _relink(both, both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), True)
        e = _relink(e, e.groupBy("u").agg(F.min("v").alias("m")), False)
        now = _digest(e)
        if now == seen:
            return e.select(F.col("u").alias("v"), F.col("v").alias("label"))
        seen = now


def _relink(e: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """A large-star or small-star step. The least neighbours are written, so that both sides of the join are plain
    exchanges and a vertex with very many edges can be split over tasks."""
    joined = e.join(save(least, "least").hint("merge"), "u")
    if large:
        new = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s")).select("s.*")
    return save(new.filter("u <> v").distinct(), "edges")
