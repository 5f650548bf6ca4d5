"""Order-dependent operators. Positions of a whole column come in two passes, block totals first, so no task holds all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gneiss.errors import NumericError
from gneiss.functions.exprs import INF
from gneiss.scratch import save

BLOCK = 1 << 16


def cumulative(df: DataFrame, index: str, value: str, out: str, product: bool = False, block: int = BLOCK, lane: list[str] | None = None) -> DataFrame:
    """Running sum or product along an integer index of each lane: inside blocks of the index, then from the blocks' totals."""
    agg, lane = F.product if product else F.sum, lane or []
    d = df.withColumn("_b", F.floor(F.col(index) / block))
    totals = d.groupBy(*lane, "_b").agg(agg(value).alias("_t"))
    before = agg("_t").over(Window.partitionBy(*lane).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select(*[F.col(c).alias(f"_l{k}") for k, c in enumerate(lane)], F.col("_b").alias("_bt"), before.alias("_p"))  # a row a block
    inner = agg(value).over(Window.partitionBy(*lane, "_b").orderBy(index).rowsBetween(Window.unboundedPreceding, 0))
    unit = F.lit(1.0 if product else 0).cast(df.schema[value].dataType)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_l{k}")) for k, c in enumerate(lane)], F.col("_b") == F.col("_bt"))
    d = d.withColumn("_in", inner).join(before, same)
    carry = F.coalesce("_p", unit)
    return d.withColumn(out, carry * F.col("_in") if product else carry + F.col("_in")).drop("_b", "_in", "_p", "_bt", *[f"_l{k}" for k in range(len(lane))])


def ranks(df: DataFrame, lane: list[str], order: list[Column], out: str) -> DataFrame:
    """Each row's place from 0 within its lane. Rows are dealt by ranges of (lane, order), so one lane can fill many tasks;
    places come from the row's number in its range and the ranges' counts of each lane. order has to tell rows apart."""
    names = [f"_o{k}" for k in range(len(order))]
    d = df.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)])
    keys = [F.col(c).asc() for c in [*lane, *names]]
    # written once: the bounds of ranges come from a sample, and both uses below have to see the same ones
    d = save(d.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*names).withColumn("_m", F.monotonically_increasing_id()), "ranges")
    d = d.withColumn("_range", F.shiftright("_m", 33))
    part = d.groupBy("_range", *lane).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*lane).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_l{k}") for k, c in enumerate(lane)], (before - F.col("_first")).alias("_shift"))  # a row a range and lane in it
    same = F.col("_range") == F.col("_r")
    for k, c in enumerate(lane):
        same = same & F.col(c).eqNullSafe(F.col(f"_l{k}"))
    return d.join(part, same).withColumn(out, F.col("_m") + F.col("_shift")).drop("_m", "_range", "_r", "_shift", *[f"_l{k}" for k in range(len(lane))])


def lane_order(value: str) -> list[Column]:
    """Ascending, -0.0 before 0.0, NaN last."""
    v = F.col(value)
    return [v.asc(), F.when(v == 0, F.pow(v, F.lit(-1.0)) == INF).otherwise(F.lit(True)).asc()]


def argsort(df: DataFrame, lane: list[str], index: str, value: str, out: str = "rank") -> DataFrame:
    """Each row's place in its lane's stable ascending order."""
    v = F.col(value)
    return ranks(df, lane, [v, F.when(v == 0, F.pow(v, F.lit(-1.0)) == INF).otherwise(F.lit(True)), F.col(index)], out)


def sort(df: DataFrame, lane: list[str], index: str, value: str) -> DataFrame:
    """(lane, i0, v): each lane's values in ascending order, NaN last."""
    return argsort(df, lane, index, value, "i0").select(*lane, "i0", F.col(value).alias("v"))


def smallest(df: DataFrame, lane: list[str], index: str, value: str, k: int) -> DataFrame:
    """The first k of each lane with their rank (Spark limits groups before the shuffle, so only k rows a task and lane move)."""
    w = Window.partitionBy(*lane).orderBy(*lane_order(value), F.col(index).asc())
    return df.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def argpartition(df: DataFrame, lane: list[str], index: str, value: str, positions: list[int]) -> DataFrame:
    """(lane, index, part): part k has the rows between the k-th and the next of the sorted positions, in any order inside."""
    cut = sorted(set(positions))
    part = sum((F.when(F.col("_rank") >= p, 1).otherwise(0) for p in cut), F.lit(0))
    return argsort(df, lane, index, value, "_rank").select(*lane, index, part.alias("part"))


def searchsorted(haystack: DataFrame, value: str, needles: DataFrame, key: str, side: str = "left") -> DataFrame:
    """Per needle, how many values are smaller (left) or not larger (right).

    Needles and counted distinct values are sorted together by ranges; a needle's place less its place among needles is
    replaced by the sum of counts before it, which running totals of blocks of places give.
    """
    own = needles.select(F.col(key).alias("v")).distinct().select("v", F.lit(0 if side == "left" else 1).alias("t"), F.lit(0).cast("bigint").alias("c"))
    hay = haystack.groupBy(F.col(value).cast(needles.schema[key].dataType).alias("v")).agg(F.count(F.lit(1)).alias("c")).select("v", F.lit(1 if side == "left" else 0).alias("t"), "c")
    placed = ranks(own.unionByName(hay), [], [F.col("v"), F.col("t")], "at")
    found = cumulative(placed, "at", "c", "position").filter(F.col("t") == (0 if side == "left" else 1)).select(F.col("v").alias("_v"), "position")
    return needles.join(found, F.col(key) == F.col("_v")).drop("_v")


def unique(df: DataFrame, index: str, value: str) -> DataFrame:
    """Distinct values (0.0 and -0.0 are one, NaNs are one) with counts and first index."""
    return df.groupBy((F.col(value) + F.lit(0)).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("first_index"))


def unique_inverse(df: DataFrame, index: str, value: str) -> DataFrame:
    """(index, inverse): the place of each row's value among the ascending distinct values."""
    distinct = ranks(unique(df, index, value).select(F.col("value").alias("_value")), [], [F.col("_value")], "inverse")
    return df.join(distinct, (F.col(value) + F.lit(0)).eqNullSafe(F.col("_value"))).select(index, "inverse")


def take(df: DataFrame, index: str, positions: DataFrame, position: str, n: int, mode: str = "raise") -> DataFrame:
    """Rows at positions; negative ones count from the end; wrap and clip as modes."""
    p = F.col(position)
    at = {"raise": F.when((p < -n) | (p >= n), F.raise_error(F.lit("take: index out of range"))).otherwise(F.pmod(p, F.lit(n))), "wrap": F.pmod(p, F.lit(n)), "clip": F.greatest(F.lit(0), F.least(p, F.lit(n - 1)))}[mode]
    return positions.withColumn("_at", at.cast("bigint")).join(df, F.col("_at") == F.col(index)).drop("_at")


def put(df: DataFrame, index: str, value: str, writes: DataFrame) -> DataFrame:
    """writes (at, pos, new): the last write of a place wins."""
    last = writes.groupBy("at").agg(F.max_by("new", "pos").alias("_new"))
    return df.join(last, F.col(index) == F.col("at"), "left").withColumn(value, F.coalesce("_new", value)).drop("at", "_new")


def shuffled_rank(df: DataFrame, key: str, seed: int, out: str) -> DataFrame:
    """A seeded permutation: each row's position from 0 in the order of a hash of its unique key.

    Ranks come inside 4096 ranges of the hash and from the ranges' totals, so no task holds all rows.
    """
    h = F.xxhash64(F.lit(seed), F.col(key))
    d = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 52))
    total = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = total.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    return d.withColumn("_r", inner).join(F.broadcast(before), "_b").withColumn(out, F.col("_s") + F.col("_r")).drop("_b", "_h", "_r", "_s")  # 4096 rows at most


def choice(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement; more than there are is an error."""
    if n > (have := df.count()):
        raise NumericError(f"{n} of {have} rows")
    return shuffled_rank(df, key, seed, "_p").filter(F.col("_p") < n).drop("_p")


def choice_with_replacement(df: DataFrame, index: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, and the row's columns): n independent draws of rows numbered 0, 1, ... by index."""
    if not (have := df.count()):
        raise NumericError("no rows")
    d = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    at = F.pmod(F.xxhash64(F.lit(seed), F.col("draw")), F.lit(have))
    return d.withColumn("_at", at).join(df, F.col("_at") == F.col(index)).drop("_at")
