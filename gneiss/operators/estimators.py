"""Fitted models with the usual protocol, over the functions of gneiss.operators.ml.

fit(df) learns from named columns and returns the model; predict(df) gives (key, predicted); score(df) is the accuracy of a
classifier and the R² of a regressor. Setting parameters makes a model unfitted, and using an unfitted one is a ModelError.
Keys tell rows apart; where they repeat, score counts each pair of rows. Models are a few coefficients or class statistics,
but nearest neighbours keep the training table and read it at each prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.errors import ModelError
from gneiss.operators import ml


class Estimator:
    #: Parameters and their defaults.
    defaults: dict[str, object] = {}
    classifier = True

    def __init__(self, key: str, features: list[str], target: str, **params):
        self.key, self.features, self.target = key, list(features), target
        self._params, self._model = dict(self.defaults), None
        self.set_params(**params)

    def get_params(self) -> dict[str, object]:
        return dict(self._params)

    def set_params(self, **params) -> Estimator:
        if unknown := sorted(set(params) - set(self.defaults)):
            raise ModelError(f"no such parameters: {', '.join(unknown)}")
        merged = self._params | params
        self._check(merged)
        self._params, self._model = merged, None
        return self

    def copy(self) -> Estimator:
        """An unfitted model with the same columns and parameters."""
        return type(self)(self.key, self.features, self.target, **self._params)

    @property
    def is_fitted(self) -> bool:
        return self._model is not None

    @property
    def model(self):
        if self._model is None:
            raise ModelError("the model is not fitted")
        return self._model

    def fit(self, df: DataFrame) -> Estimator:
        self._model = self._fit(df)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return self._predict(df, self.model)

    def fit_predict(self, df: DataFrame) -> DataFrame:
        return self.fit(df).predict(df)

    def score(self, df: DataFrame) -> float:
        both = df.select(F.col(self.key).alias("_k"), F.col(self.target).alias("_y")).join(self.predict(df).withColumnRenamed(self.key, "_k"), "_k")
        if not self.classifier:
            return ml.regression_metrics(both, "_y", "predicted").first()["r2"]
        return both.agg(F.avg((F.col("_y") == F.col("predicted")).cast("double"))).first()[0]

    def _check(self, p: dict) -> None:
        for name, value in p.items():
            if isinstance(value, (int, float)) and not isinstance(value, bool) and not 0 <= value < float("inf"):
                raise ModelError(f"{name}: {value}")

    def _fit(self, df: DataFrame):
        raise NotImplementedError

    def _predict(self, df: DataFrame, model) -> DataFrame:
        raise NotImplementedError


class LinearRegression(Estimator):
    classifier = False

    def _fit(self, df):
        return ml.linear_regression(df, self.features, self.target)

    def _predict(self, df, model):
        return ml.linear_predict(df, self.key, self.features, model)


class RidgeRegression(LinearRegression):
    defaults = {"l2_regularization": 0.0}

    def _fit(self, df):
        return ml.linear_regression(df, self.features, self.target, self._params["l2_regularization"])

    def fit_weighted(self, df: DataFrame, weight: str) -> RidgeRegression:
        self._model = ml.linear_regression(df, self.features, self.target, self._params["l2_regularization"], weight)
        return self


class BinaryLogisticRegression(Estimator):
    defaults = {"learning_rate": 0.1, "max_iterations": 1000, "convergence_tolerance": 1e-6, "l2_regularization": 0.0}

    def _fit(self, df, weight: str | None = None):
        p = self._params
        rows = df.select(*dict.fromkeys([*self.features, self.target, *([weight] if weight else [])])).persist()  # each step reads them
        try:
            terms, self.iterations, self.converged = ml.logistic_regression(rows, self.features, self.target, p["learning_rate"], p["max_iterations"], p["convergence_tolerance"], p["l2_regularization"], weight)
        finally:
            rows.unpersist()
        return terms

    def fit_weighted(self, df: DataFrame, weight: str) -> BinaryLogisticRegression:
        self._model = self._fit(df, weight)
        return self

    def predict_proba(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """(key, probability, predicted)."""
        return ml.predict_binary(df, self.key, self.features, self.model, threshold)

    def _predict(self, df, model):
        return ml.predict_binary(df, self.key, self.features, model).drop("probability")


class GaussianNaiveBayes(Estimator):
    defaults = {"variance_smoothing": 1e-9}

    def _fit(self, df):
        return ml.gaussian_bayes(df, self.target, self.features, self._params["variance_smoothing"])

    def _predict(self, df, model):
        return ml.bayes_predict(df.select(self.key, *self.features), self.key, self.features, model)


class DecisionStumpClassifier(Estimator):
    def _fit(self, df):
        return ml.decision_stump(df, self.features, self.target)

    def _predict(self, df, model):
        return ml.stump_predict(df, self.key, model)


class VectorEstimator(Estimator):
    def _vectors(self, df: DataFrame, *more: str) -> DataFrame:
        return df.select(self.key, F.array(*[F.col(f).cast("double") for f in self.features]).alias("_x"), *more)


class NearestCentroidClassifier(VectorEstimator):
    def _fit(self, df):
        return ml.centroids(self._vectors(df, self.target), self.target, "_x")

    def _predict(self, df, model):
        return ml.nearest_centroid(self._vectors(df), self.key, "_x", model)


class KnnClassifier(VectorEstimator):
    """search_algorithm is accepted for all of the usual names; each gives the same exact rows, so all run as one block product."""

    defaults = {"k": 5, "search_algorithm": "brute_force", "weighting": "uniform", "tree_leaf_size": 1}

    def _check(self, p):
        super()._check(p)
        if p["k"] < 1 or p["tree_leaf_size"] < 1 or p["search_algorithm"] not in ("brute_force", "kd_tree", "ball_tree", "auto") or p["weighting"] not in ("uniform", "distance"):
            raise ModelError(f"parameters of nearest neighbours: {p}")

    def _fit(self, df):
        return self._vectors(df, self.target)

    def _predict(self, df, model):
        vote = ml.knn_classify if self.classifier else ml.knn_regress
        return vote(model, self._vectors(df), self.key, "_x", self.target, self._params["k"], self._params["weighting"]).withColumnRenamed("q", self.key)


class KnnRegressor(KnnClassifier):
    classifier = False
