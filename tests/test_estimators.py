import numpy as np
import pytest
from pyspark.sql import functions as F

from gneiss.errors import ModelError, NumericError, ShapeError
from gneiss.operators import estimators as M
from gneiss.operators import layout


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 2))
    y = (x[:, 0] > 0.2).astype(int)
    z = x @ [2.0, -1.0] + 0.5 + rng.normal(size=90) / 10
    w = rng.integers(0, 4, 90)
    data = [(i, float(a), float(b), int(c), float(d), int(e)) for i, ((a, b), c, d, e) in enumerate(zip(x, y, z, w, strict=True))]
    return x, y, z, w, spark.createDataFrame(data, "i long, a double, b double, y int, z double, w int").cache()


CLASSIFIERS = [(M.BinaryLogisticRegression, {"learning_rate": 1.0, "max_iterations": 30}), (M.GaussianNaiveBayes, {}), (M.DecisionStumpClassifier, {}), (M.NearestCentroidClassifier, {}), (M.KnnClassifier, {"k": 3, "search_algorithm": "auto"})]


@pytest.mark.parametrize(("cls", "params"), CLASSIFIERS)
def test_classifiers_follow_the_protocol(rows, cls, params):
    x, y, _, _, df = rows
    m = cls("i", ["a", "b"], "y", **params)
    assert not m.is_fitted and m.get_params() == cls.defaults | params
    with pytest.raises(ModelError):
        m.predict(df)
    got = {r["i"]: r["predicted"] for r in m.fit_predict(df).collect()}
    assert m.is_fitted and len(got) == 90
    assert m.score(df) == pytest.approx(np.mean([got[i] == c for i, c in enumerate(y)])) and m.score(df) > 0.85
    assert not m.copy().is_fitted and m.copy().get_params() == m.get_params()
    assert not m.set_params(**params).is_fitted
    with pytest.raises(ModelError):
        m.set_params(nothing=1)


def test_nearest_neighbours_equal_plain_loops(rows):
    x, y, z, _, df = rows
    near = [sorted(range(90), key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:4] for i in range(90)]
    reg = M.KnnRegressor("i", ["a", "b"], "z", k=4).fit(df)
    got = {r["i"]: r["predicted"] for r in reg.predict(df).collect()}
    assert [got[i] for i in range(90)] == pytest.approx([np.mean([z[j] for j in n]) for n in near])
    for bad in ({"k": 0}, {"weighting": "x"}, {"search_algorithm": "x"}):
        with pytest.raises(ModelError):
            M.KnnRegressor("i", ["a", "b"], "z", **bad)


def test_regressors_equal_numpy(rows):
    x, _, z, w, df = rows
    a = np.column_stack([np.ones(90), x])
    beta = np.linalg.lstsq(a, z, rcond=None)[0]
    m = M.LinearRegression("i", ["a", "b"], "z").fit(df)
    assert [r["coefficient"] for r in m.model.collect()] == pytest.approx(beta.tolist())
    assert m.score(df) == pytest.approx(1 - ((z - a @ beta) ** 2).sum() / ((z - z.mean()) ** 2).sum())
    aug = np.vstack([a * np.sqrt(w)[:, None], np.sqrt(3.0) * np.eye(3)[1:]])
    want = np.linalg.lstsq(aug, np.concatenate([z * np.sqrt(w), [0, 0]]), rcond=None)[0]
    ridge = M.RidgeRegression("i", ["a", "b"], "z", l2_regularization=3.0).fit_weighted(df, "w")
    assert [r["coefficient"] for r in ridge.model.collect()] == pytest.approx(want.tolist())
    for bad in (F.lit(0), F.lit(-1), F.lit(None).cast("int")):
        with pytest.raises(NumericError):
            ridge.fit_weighted(df.withColumn("w", bad), "w")
    with pytest.raises(ModelError):
        M.RidgeRegression("i", ["a"], "z", l2_regularization=-1.0)


def test_zip_map_equals_numpy_broadcasting(spark):
    a, b = np.arange(6.0).reshape(3, 1, 2), np.arange(8.0).reshape(4, 2) * 10
    frame = lambda x: spark.createDataFrame([(*[int(k) for k in i], float(v)) for i, v in np.ndenumerate(x)], ", ".join([f"i{k} long" for k in range(x.ndim)] + ["v double"]))
    for x, y in ((a, b), (b, a), (b, b[:1]), (np.full((1, 1), 2.0), b)):
        want = x - y
        got = layout.zip_map(frame(x), x.shape, frame(y), y.shape, lambda p, q: p - q).collect()
        assert len(got) == want.size and all(want[tuple(r)[:-1]] == r["v"] for r in got)
    got = layout.zip_map(frame(b), b.shape, frame(b), b.shape, lambda i, j, p, q: p + q + i - j, indexed=True).collect()
    assert all(2 * b[r["i0"], r["i1"]] + r["i0"] - r["i1"] == r["v"] for r in got)
    row = layout.atleast(frame(np.arange(3.0)), 1, 3).orderBy("i1").collect()
    assert [tuple(r) for r in row] == [(0, 0, 0, 0.0), (0, 1, 0, 1.0), (0, 2, 0, 2.0)]
    copied = layout.copy_where(frame(b), frame(np.arange(2.0)), (2,), (4, 2)).collect()
    assert all(r["v"] == r["i1"] for r in copied)
    with pytest.raises(ShapeError):
        layout.copy_where(frame(b), frame(b), (4, 2), (2, 2))
    with pytest.raises(TypeError):
        layout.copy_where(frame(b), frame(b), (4, 2), (4, 2), frame(b))
