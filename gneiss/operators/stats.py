"""Grouped statistics; every function takes optional keys, so a whole column and its lanes are one implementation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.exprs import NAN, variance
from gneiss.operators.ordering import cumulative, ranks

MODES = ("linear", "lower", "higher", "nearest", "midpoint")


def describe(df: DataFrame, value: str, keys: list[str], digits: int = 6) -> DataFrame:
    """Count, mean, variances, skewness, excess kurtosis, median and 0.9-quantile of each group (population moments)."""
    x = F.col(value).cast("double")
    aggs = {"mean": F.avg(x), "var0": variance(x), "var1": variance(x, 1), "skew": F.skewness(x), "kurt": F.kurtosis(x)}
    moments = df.groupBy(*keys).agg(F.count(x).alias("n"), *[F.round(a, digits).alias(k) for k, a in aggs.items()])
    q = quantiles_at(df.select(*keys, x.alias("_x")), "_x", keys, {"median": 0.5, "q90": 0.9})
    q = q.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.round("median_linear", digits).alias("median"), F.round("q90_linear", digits).alias("q90"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] or [F.lit(True)]
    return moments.join(q, reduce(Column.__and__, same)).drop(*[f"_k{i}" for i in range(len(keys))])


def quantiles_at(df: DataFrame, value: str, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """(keys, <name>_lower, _higher, _nearest, _linear, _midpoint of each quantile); ties of nearest go up, a NaN makes all of its group NaN.

    Distinct values' counts get places by ranges of (keys, value) and running totals by blocks of places, so a group of any size spreads over tasks.
    """
    if any(not 0 <= q <= 1 for q in qs.values()):
        raise ValueError("q must lie in [0, 1]")
    c = df.groupBy(*keys, F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    c = cumulative(ranks(c, keys, [F.col("x")], "_at"), "_at", "c", "hi", lane=keys).withColumn("lo", F.col("hi") - F.col("c"))
    n = df.groupBy(*[F.col(k).alias(f"_n{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))
    same = [F.col(k).eqNullSafe(F.col(f"_n{i}")) for i, k in enumerate(keys)] or [F.lit(True)]
    c = c.join(n, reduce(Column.__and__, same))  # a row a group
    cols, spoilt = [], F.bool_or(F.isnan(F.col("x").cast("double")))
    for name, q in qs.items():
        r = F.lit(q) * (F.col("n") - 1)
        at = lambda k: F.max(F.when((F.col("lo") <= k) & (k < F.col("hi")), F.col("x")))
        lower, higher, part = at(F.floor(r)), at(F.ceil(r)), F.max(r - F.floor(r))
        modes = {"lower": lower, "higher": higher, "nearest": at(F.floor(r + 0.5)), "linear": lower + (higher - lower) * part, "midpoint": (lower + higher) / 2}
        cols += [F.when(spoilt, F.lit(NAN)).otherwise(v).alias(f"{name}_{m}") for m, v in modes.items()]
    return c.groupBy(*keys).agg(*cols)


def quantiles(df: DataFrame, value: str, keys: list[str], q: float) -> DataFrame:
    """The q-quantile in each interpolation mode."""
    g = quantiles_at(df, value, keys, {"q": q})
    return g.select(*keys, *[F.col(f"q_{m}").alias(m) for m in ("lower", "higher", "nearest", "linear", "midpoint")])


def weighted(df: DataFrame, x: str, w: str, keys: list[str]) -> DataFrame:
    """Weighted mean and population variance, the latter about the mean of a first pass."""
    m = df.groupBy(*keys).agg((F.sum(F.col(w) * F.col(x)) / F.sum(w)).alias("wmean"))
    d = df.join(F.broadcast(m) if not keys else m, keys) if keys else df.crossJoin(F.broadcast(m))  # one row when there are no keys
    return d.groupBy(*keys).agg(F.first("wmean").alias("wmean"), (F.sum(F.col(w) * (F.col(x) - F.col("wmean")) ** 2) / F.sum(w)).alias("wvar"))


def covariance_matrix(df: DataFrame, columns: list[str], ddof: int = 0, correlation: bool = False) -> DataFrame:
    """(a, b, v) for every pair of columns, in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def entry(a: str, b: str) -> Column:
        c = F.covar_pop(a, b)
        if correlation:
            s = F.stddev_pop(a) * F.stddev_pop(b)
            return F.when(s == 0, F.raise_error(F.lit("zero variance"))).otherwise(c / s)
        return c * F.count(F.lit(1)) / (F.count(F.lit(1)) - ddof)

    row = df.agg(*[entry(a, b).alias(f"_{k}") for k, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"_{k}").alias("v")) for k, (a, b) in enumerate(pairs) for x, y in {(a, b), (b, a)}]
    return row.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def covariance(df: DataFrame, x: str, y: str, keys: list[str], ddof: int = 0) -> DataFrame:
    """(keys, cov) of each lane; null where it has no more rows than ddof."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(F.when(n > ddof, F.covar_pop(x, y) * n / F.when(n > ddof, n - ddof)).alias("cov"))


def weighted_covariance(df: DataFrame, x: str, y: str, w: str, keys: list[str]) -> DataFrame:
    """(keys, wcov, wcorr): about weighted means; wcorr is null where a side does not vary."""
    mean = lambda c: (F.sum(F.col(w) * F.col(c)) / F.sum(w))
    m = df.groupBy(*keys).agg(mean(x).alias("_mx"), mean(y).alias("_my"))
    d = df.join(m, keys) if keys else df.crossJoin(F.broadcast(m))  # one row when there are no keys
    a, b, k = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my"), F.col(w)
    s = d.groupBy(*keys).agg((F.sum(k * a * b) / F.sum(k)).alias("wcov"), (F.sum(k * a * a) / F.sum(k)).alias("_x"), (F.sum(k * b * b) / F.sum(k)).alias("_y"))
    return s.select(*keys, "wcov", (F.col("wcov") / F.sqrt(F.when(F.col("_x") * F.col("_y") > 0, F.col("_x") * F.col("_y")))).alias("wcorr"))


def nan_extremes(df: DataFrame, x: str) -> DataFrame:
    """(nanmin, nanmax) past NaNs; no rows or nothing but NaNs is an error."""
    v = F.when(~F.isnan(x), F.col(x))
    why = F.when(F.count(F.lit(1)) == 0, F.lit("no rows")).otherwise(F.lit("all NaN"))
    known = lambda c: F.when(F.count(v) == 0, F.raise_error(why)).otherwise(c)
    return df.agg(known(F.min(v)).alias("nanmin"), known(F.max(v)).alias("nanmax"))
