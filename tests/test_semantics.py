import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss import meta
from gneiss.errors import AxisError, NumericError, ShapeError
from gneiss.functions import exprs as E
from gneiss.operators import linalg, ml, ordering, stats
from gneiss.sources import arrays


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "want"), [("int8", "uint8", "int16"), ("int64", "uint64", "float64"), ("int16", "float32", "float32"), ("int32", "float32", "float64"), ("bool", "int8", "int8"), ("uint32", "int8", "int64")])
def test_promotion_is_numpys(a, b, want):
    assert meta.promote(a, b) == meta.promote(b, a) == want == np.result_type(a, b).name


def test_shapes():
    assert meta.broadcast_shape((3, 1), (1, 4)) == (3, 4) and meta.infer_shape((2, -1), 10) == (2, 5)
    assert meta.slice_bounds(-3, None, 2, 10) == (7, 10, 2)
    for bad in (lambda: meta.broadcast_shape((2,), (3,)), lambda: meta.infer_shape((3, -1), 10), lambda: meta.slice_bounds(0, 1, 0, 3)):
        with pytest.raises(ShapeError):
            bad()
    with pytest.raises(AxisError):
        meta.normalize_axis(2, 2)


@pytest.mark.parametrize("bits", [8, 16, 32, 64])
def test_integers_wrap(spark, bits):
    rng = np.random.default_rng(bits)
    t = np.dtype(f"int{bits}")
    edge = [np.iinfo(t).min, np.iinfo(t).max, -1, 0, 1, *rng.integers(np.iinfo(t).min, np.iinfo(t).max, 5).tolist()]
    rows = [(int(a), int(b)) for a in edge for b in edge]
    x, y = (np.array([r[k] for r in rows], t) for k in (0, 1))
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    a, b = F.col("a"), F.col("b")
    got = df.select(E.add(a, b, bits).alias("s"), E.subtract(a, b, bits).alias("d"), E.multiply(a, b, bits).alias("p"), E.negate(a, bits).alias("n"), E.absolute(a, bits).alias("m")).toPandas()
    with np.errstate(over="ignore"):
        for c, want in (("s", x + y), ("d", x - y), ("p", x * y), ("n", -x), ("m", np.abs(x))):
            assert (got[c].to_numpy() == want).all(), c
    low = int(np.iinfo(t).min)
    assert one(spark, E.int_divide(F.lit(low), F.lit(-1), bits)) == low and one(spark, E.int_divide(F.lit(-7), F.lit(2), bits)) == -3


def test_floats_are_ieee(spark):
    nan, inf = math.nan, math.inf
    rows = [(a, b) for a in (0.0, -0.0, 1.5, -2.5, inf, -inf, nan) for b in (0.0, -0.0, 2.0, -3.0, inf, nan)]
    df = spark.createDataFrame(rows, "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(E.divide(a, b).alias("q"), *[E.compare(o, a, b).alias(o) for o in ("==", "!=", "<", ">=")], E.pair_min(a, b).alias("lo"), E.pair_max(a, b).alias("hi"), E.sign(a).alias("s"), E.round_half_away(a).alias("r")).toPandas()
    x, y = (np.array([r[k] for r in rows]) for k in (0, 1))
    with np.errstate(all="ignore"):
        assert np.array_equal(got.q, x / y, equal_nan=True)
        for o, want in (("==", x == y), ("!=", x != y), ("<", x < y), (">=", x >= y)):
            assert (got[o] == want).all(), o
        assert np.array_equal(got.lo, np.fmin(x, y), equal_nan=True) and np.array_equal(got.hi, np.fmax(x, y), equal_nan=True)
        assert np.array_equal(got.s, np.where(np.isnan(x), x, np.copysign(1, x)), equal_nan=True)
    assert got.r.tolist()[12:24] == [2.0] * 6 + [-3.0] * 6


def test_kernels(spark):
    rng = np.random.default_rng(0)
    rows, ms = [], {}
    for k in range(6):
        m = rng.normal(size=(4, 4))
        ms[k] = m @ m.T + 4 * np.eye(4)
        rows += [(k, i, j, float(ms[k][i, j])) for i in range(4) for j in range(4)]
    df = spark.createDataFrame(rows, "batch bigint, i0 bigint, i1 bigint, v double")

    def result(kernel, k):
        p = linalg.batched(df, kernel).filter(f"batch = {k}").toPandas()
        out = np.zeros((p.i0.max() + 1, p.i1.max() + 1))
        out[p.i0, p.i1] = p.v
        return out

    assert np.allclose(result("inverse", 1) @ ms[1], np.eye(4)) and np.allclose(result("det", 2)[0, 0], np.linalg.det(ms[2]))
    c, r = result("cholesky", 3), result("qr_r", 4)
    assert np.allclose(c @ c.T, ms[3]) and np.allclose(r.T @ r, ms[4].T @ ms[4])
    for bad in ("det", "inverse", "cholesky", "qr_r", "lu_l", "slogdet"):
        with pytest.raises(NumericError):
            linalg.KERNELS[bad](np.ones((2, 3, 3)))
    b = rng.normal(size=(6, 4, 2))
    stack = np.stack([ms[k] for k in range(6)])
    for name in ("solve", "solve_spd", "conjugate_gradient", "solve_transpose"):
        assert np.allclose(linalg.KERNELS[name](stack, b), np.linalg.solve(stack, b)), name
    odd = rng.normal(size=(5, 4, 4))
    p, l, u = linalg.lu(odd)
    assert np.allclose(p @ odd, l @ u) and np.allclose(np.tril(l), l) and np.allclose(np.triu(u), u) and np.abs(l).max() <= 1
    assert np.allclose(linalg.det(odd)[:, 0, 0], np.linalg.det(odd)) and np.allclose(linalg.solve_transpose(odd, b[:5]), np.linalg.solve(odd.transpose(0, 2, 1), b[:5]))
    with pytest.raises(NumericError):
        linalg.eigen(odd)
    tall = rng.normal(size=(3, 6, 2))
    q, r = linalg.qr(tall)
    assert np.allclose(q @ r, tall) and (np.einsum("kii->ki", r) > 0).all() and linalg.matrix_rank(tall).ravel().tolist() == [2.0] * 3
    assert np.isinf(linalg.condition_number(np.array([[[1.0, 0.0], [0.0, 0.0]]]))).all()
    sizes = spark.createDataFrame([(1, 0, 0, 2.0), (2, 0, 0, 1.0), (2, 0, 1, 0.5), (2, 1, 0, 0.5), (2, 1, 1, 3.0)], "batch bigint, i0 bigint, i1 bigint, v double")
    assert {x["batch"]: round(x["v"], 9) for x in linalg.batched(sizes, "det").collect()} == {1: 2.0, 2: 2.75}


def test_order_and_models(spark):
    v = [3.0, -0.0, 0.0, math.nan, 1.0, math.nan, 3.0]
    df = spark.createDataFrame(list(enumerate(v)), "i bigint, v double").withColumn("lane", F.lit(1))
    assert [r["i"] for r in ordering.argsort(df, ["lane"], "i", "v").orderBy("rank").collect()] == [1, 2, 4, 0, 6, 3, 5]
    run = ordering.cumulative(arrays.arange(spark, 1, 101), "i0", "v", "s", block=7)
    assert {r["i0"]: r["s"] for r in run.collect()} == dict(enumerate(np.cumsum(np.arange(1, 101)).tolist()))
    with pytest.raises(NumericError):
        arrays.arange(spark, 0, 3, 0)
    two = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 2.0), (3.0, 6.0, 3.0)], "a double, b double, y double")
    with pytest.raises(NumericError):
        ml.linear_regression(two, ["a", "b"], "y")


def test_ranks_of_hot_lanes_and_quantiles(spark):
    rng = np.random.default_rng(7)
    v = rng.integers(0, 30, 500).astype(float)
    rows = [(i, "hot" if i % 10 else None, float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "i bigint, lane string, v double").repartition(5)
    got = {r["i"]: r["rank"] for r in ordering.argsort(df, ["lane"], "i", "v").collect()}
    for lane in ("hot", None):
        own = sorted((x, i) for i, k, x in rows if k == lane)
        assert [got[i] for _, i in own] == list(range(len(own)))
    q = {r["lane"]: r for r in stats.quantiles(df, "v", ["lane"], 0.3).collect()}
    for lane in ("hot", None):
        own = np.array([x for _, k, x in rows if k == lane])
        assert all(np.isclose(q[lane][m], np.quantile(own, 0.3, method=m)) for m in ("linear", "lower", "higher", "midpoint"))
    assert stats.quantiles(df, "v", [], 0.5).first()["linear"] == np.median(v)
    needles = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 7.5, 12.0, 29.0, 99.0)], "k double")
    for side in ("left", "right"):
        assert all(r["position"] == np.searchsorted(np.sort(v), r["k"], side) for r in ordering.searchsorted(df, "v", needles, "k", side).collect())
    assert ordering.argsort(df.limit(0), ["lane"], "i", "v").count() == 0


def test_stump_features_leaves_and_constants(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (80, 2))
    y = ((x[:, 1] > 2) ^ (rng.random(80) < 0.1)).astype(int)
    df = spark.createDataFrame([(i, int(a), int(b), int(c), 1) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "i int, a int, b int, y int, k int")
    m = ml.decision_stump(df, ["a", "b"], "y").first()
    best = min((min((y[x[:, f] <= c] == 1).sum(), (y[x[:, f] <= c] == 0).sum()) + min((y[x[:, f] > c] == 1).sum(), (y[x[:, f] > c] == 0).sum()), f, c) for f in (0, 1) for c in np.arange(0.5, 5))
    assert (m["errors"], m["feature"], m["threshold"]) == (best[0], "ab"[best[1]], best[2])
    wrong = ml.stump_predict(df, "i", ml.decision_stump(df, ["a", "b"], "y")).join(df, "i").filter("predicted <> y").count()
    assert wrong == m["errors"]
    flat = ml.decision_stump(df, "k", "y").first()
    assert flat["threshold"] is None and flat["left"] == flat["right"] == int(y.sum() > 40)


def test_draws_do_not_depend_on_partitions(spark):
    d = spark.range(20000)
    f = lambda x: {r["id"]: r["u"] for r in x.select("id", E.uniform(3, F.col("id")).alias("u")).collect()}
    one, two = f(d), f(d.repartition(7))
    assert one == two and 0.49 < np.mean(list(one.values())) < 0.51 and 0 <= min(one.values()) and max(one.values()) < 1
    z = d.select(F.avg(E.normal(3, F.col("id"), 2.0, 3.0)).alias("m"), F.stddev(E.normal(3, F.col("id"), 2.0, 3.0)).alias("s")).first()
    assert abs(z["m"] - 2) < 0.1 and abs(z["s"] - 3) < 0.1
