import numpy as np
import pytest

from gneiss.errors import ModelError, NumericError
from gneiss.operators import linalg, ml, ordering, stats


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 2))
    y = (x @ [2.0, -1.0] + 0.3 > 0).astype(int)
    return x, y, spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "i long, a double, b double, y int").cache()


def test_logistic_regression_is_gradient_descent(points):
    x, y, df = points
    w, z = np.zeros(3), np.column_stack([np.ones(len(x)), x])
    for _ in range(12):
        w = w - 0.4 * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) / len(y) + 0.1 * np.array([0, w[1], w[2]]))
    model, steps, done = ml.logistic_regression(df, ["a", "b"], "y", 0.4, 12, l2=0.1)
    assert [r["coefficient"] for r in model.collect()] == pytest.approx(w.tolist()) and steps == 12 and not done
    got = [r["predicted"] for r in ml.predict_binary(df, "i", ["a", "b"], model).orderBy("i").collect()]
    assert got == (z @ w >= 0).astype(int).tolist()
    assert ml.logistic_regression(df, ["a"], "y", tolerance=10.0)[1:] == (1, True)
    with pytest.raises(ModelError):
        ml.logistic_regression(df, ["a"], "i")


def test_perceptron_is_the_online_rule(points):
    x, y, df = points
    w, z, passes, clean = np.zeros(3), np.column_stack([np.ones(len(x)), x]), 0, False
    while passes < 40 and not clean:
        clean, passes = True, passes + 1
        for row, label in zip(z, y, strict=True):
            if (row @ w >= 0) != (label == 1):
                w, clean = w + 0.1 * (2 * label - 1) * row, False
    got = ml.perceptron(df.repartition(5), "i", ["a", "b"], "y", iterations=40).collect()
    assert [r["coefficient"] for r in got] == pytest.approx(w.tolist()) and (got[0]["iterations"], got[0]["converged"]) == (passes, clean)


@pytest.mark.parametrize("weighting", ["uniform", "distance"])
def test_knn_votes(spark, weighting):
    rows = [(0, [0.0], 5), (1, [1.0], 3), (2, [1.0], 5), (3, [-1.0], 3), (4, [9.0], 8)]
    df = spark.createDataFrame(rows, "i long, v array<double>, y long")
    q = spark.createDataFrame([(100, [0.0]), (101, [0.5])], "i long, v array<double>")
    got = {r["q"]: r["predicted"] for r in ml.knn_classify(df, q, "i", "v", "y", 4, weighting).collect()}
    assert got == {100: 5, 101: 5}  # two votes each: 5 is nearer
    mean = {r["q"]: r["predicted"] for r in ml.knn_regress(df, q, "i", "v", "y", 3, weighting).collect()}
    assert mean[100] == (5.0 if weighting == "distance" else pytest.approx(13 / 3)) and mean[101] == pytest.approx(13 / 3)


def test_splits_and_permutations(spark):
    df = spark.range(103).repartition(3)
    p = {r["id"]: r["p"] for r in ordering.shuffled_rank(df, "id", 5, "p").collect()}
    assert sorted(p.values()) == list(range(103)) and p != {i: i for i in p}
    assert p == {r["id"]: r["p"] for r in ordering.shuffled_rank(df.repartition(7), "id", 5, "p").collect()}
    assert ordering.choice(df, "id", 10).distinct().count() == 10
    sizes = {r["fold"]: r["count"] for r in ml.k_fold(df, "id", 4).groupBy("fold").count().collect()}
    assert sizes == {0: 26, 1: 26, 2: 26, 3: 25}
    assert ml.train_test_split(df, "id", 0.25).filter("is_test").count() == 26
    for bad in (lambda: ml.k_fold(df, "id", 1), lambda: ml.train_test_split(df, "id", 0.0)):
        with pytest.raises(ModelError):
            bad()
    with pytest.raises(NumericError):
        ordering.choice(df, "id", 104)


def test_least_squares_and_extremes(spark, points):
    x, _, df = points
    b = x @ [1.5, -2.5] + np.sin(np.arange(len(x)))
    d = spark.createDataFrame([(float(p), float(q), float(v)) for (p, q), v in zip(x, b, strict=True)], "a double, b double, t double").repartition(5)
    assert linalg.least_squares(d, ["a", "b"], "t") == pytest.approx(np.linalg.lstsq(x, b, rcond=None)[0])
    with pytest.raises(NumericError):
        linalg.least_squares(d.withColumn("c", d["a"] * 2), ["a", "c"], "t")
    v = spark.createDataFrame([(float("nan"),), (2.0,), (1.0,)], "x double")
    assert tuple(stats.nan_extremes(v, "x").first()) == (1.0, 2.0)
    for none in (v.filter("isnan(x)"), v.limit(0)):
        with pytest.raises(Exception, match="all NaN|no rows"):
            stats.nan_extremes(none, "x").collect()


def test_logistic_converges(points):
    x, _, df = points
    y = np.sign(np.arange(len(x)) % 3).astype(int)
    d = df.withColumn("y", (df["i"] % 3 != 0).cast("int"))
    model, steps, done = ml.logistic_regression(d, ["a"], "y", 1.0, tolerance=1e-3)
    assert done and steps < 200
    z, w = np.column_stack([np.ones(len(x)), x[:, 0]]), np.array([r["coefficient"] for r in model.collect()])
    assert np.abs(z.T @ (1 / (1 + np.exp(-z @ w)) - y) / len(y)).max() <= 2e-3
