"""Preprocessing, metrics and classical models as aggregates and joins."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.errors import ModelError
from gneiss.functions.exprs import INF
from gneiss.operators.linalg import solve_normal, squared_distance
from gneiss.operators.ordering import cumulative, ranks, shuffled_rank

#: Rows that a sequential learner takes, and query rows that are broadcast at a time.
SERIAL_ROWS, QUERY_ROWS = 2_000_000, 100_000


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population standard scores; a constant column keeps scale 1."""
    s = df.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in columns]).first()
    return df.select("*", *[((F.col(c) - F.lit(s[c][0])) / F.lit(s[c][1] or 1.0)).alias(f"{c}_scaled") for c in columns])


def min_max_scale(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    s = df.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in columns]).first()
    return df.select("*", *[(F.lit(low) + (F.col(c) - F.lit(s[c][0])) * F.lit((high - low) / ((s[c][1] - s[c][0]) or 1.0))).alias(f"{c}_scaled") for c in columns])


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): ascending classes as 0, 1, ...; distinct values are ranked by ranges."""
    return ranks(df.select(F.col(column).alias("value")).distinct(), [], [F.col("value")], "code")


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """The input with each value's code."""
    return df.join(label_codes(df, column).select(F.col("value").alias("_value"), "code"), F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def label_decode(df: DataFrame, code: str, codes: DataFrame) -> DataFrame:
    """The input with the value of each code; a code that codes does not have is an error."""
    d = df.join(codes.select(F.col("code").alias("_code"), F.col("value"), F.lit(True).alias("_known")), F.col(code) == F.col("_code"), "left")
    return d.withColumn("value", F.when(F.col("_known"), F.col("value")).otherwise(F.raise_error(F.lit("unknown code")))).drop("_code", "_known")


class Scaler:
    """Fitted means and scales (or minima and ranges) of columns, with their inverse."""

    def __init__(self, shift: dict[str, float], scale: dict[str, float]):
        self.shift, self.scale = shift, scale

    @staticmethod
    def standard(df: DataFrame, columns: list[str]) -> Scaler:
        s = df.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in columns]).first()
        return Scaler({c: s[c][0] for c in columns}, {c: s[c][1] or 1.0 for c in columns})

    @staticmethod
    def min_max(df: DataFrame, columns: list[str]) -> Scaler:
        s = df.agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in columns]).first()
        return Scaler({c: s[c][0] for c in columns}, {c: (s[c][1] - s[c][0]) or 1.0 for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(self.scale[c]) for c, m in self.shift.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(self.scale[c]) + F.lit(m) for c, m in self.shift.items()})


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    c = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.avg((a == p).cast("double")).alias("accuracy"))
    ratio = lambda x, y: F.when(y == 0, 0.0).otherwise(x / F.when(y == 0, 1).otherwise(y))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("n", "accuracy", ratio(tp, tp + fp).alias("prec"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Dense over the union of labels."""
    labels = df.select(F.col(actual).alias("l")).union(df.select(predicted)).distinct()
    cells = labels.select(F.col("l").alias("a")).crossJoin(labels.select(F.col("l").alias("p")))  # classes by classes
    n = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return cells.join(n, ["a", "p"], "left").select("a", "p", F.coalesce("n", F.lit(0)).alias("n"))


def log_loss(df: DataFrame, actual: str, p: str) -> DataFrame:
    q = F.when(F.col(actual) == 1, F.col(p)).otherwise(1 - F.col(p))
    return df.agg(F.avg(F.when(q <= 0, F.lit(INF)).otherwise(-F.ln(F.when(q <= 0, 1.0).otherwise(q)))).alias("log_loss"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    d = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), (1 - F.avg(d * d) / F.var_pop(actual)).alias("r2"))


def gini_split(df: DataFrame, value: str, label: str, threshold: float) -> DataFrame:
    """Weighted Gini impurity of a threshold over 0/1 labels."""
    left, one = F.col(value) <= threshold, F.col(label) == 1
    c = df.agg(F.count_if(left).alias("l"), F.count_if(~left).alias("r"), F.count_if(left & one).alias("l1"), F.count_if(~left & one).alias("r1"))
    g = lambda n, k: 1 - (F.col(k) / F.col(n)) ** 2 - ((F.col(n) - F.col(k)) / F.col(n)) ** 2
    return c.select("l", "r", g("l", "l1").alias("gini_left"), g("r", "r1").alias("gini_right"), ((F.col("l") * g("l", "l1") + F.col("r") * g("r", "r1")) / (F.col("l") + F.col("r"))).alias("gini"))


def linear_regression(df: DataFrame, features: list[str], target: str, ridge: float = 0.0, weight: str | None = None) -> DataFrame:
    """One row per coefficient; the intercept's term is (intercept). Rows count by their weight, where one is named."""
    return _terms(df, features, solve_normal(df, features, target, ridge, weight))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): class means of an array column."""
    x = df.select(F.col(label).alias("label"), F.posexplode(vector).alias("k", "v")).groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return x.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest_centroid(df: DataFrame, key: str, vector: str, model: DataFrame) -> DataFrame:
    """The class of the nearest mean; ties go to the lower label. model has a row per class."""
    m = model.agg(F.collect_list(F.struct("label", "centroid")).alias("m"))
    d = df.select(key, vector).crossJoin(F.broadcast(m))  # one row of classes
    best = F.array_min(F.transform("m", lambda s: F.struct(squared_distance(F.col(vector), s["centroid"]).alias("d"), s["label"].alias("l"))))
    return d.select(key, best["l"].alias("predicted"))


def gaussian_bayes(df: DataFrame, label: str, features: list[str], smoothing: float = 1e-9) -> DataFrame:
    """(label, prior, m_<f>, v_<f>): class means and smoothed population variances."""
    n = df.count()
    return df.groupBy(F.col(label).alias("label")).agg((F.count(F.lit(1)) / n).alias("prior"), *[F.avg(f).alias(f"m_{f}") for f in features], *[(F.var_pop(f) + smoothing).alias(f"v_{f}") for f in features])


def bayes_predict(df: DataFrame, key: str, features: list[str], model: DataFrame) -> DataFrame:
    """The most likely class; ties go to the lowest. model has a row per class."""
    score = reduce(lambda a, b: a + b, [F.ln("prior")] + [-0.5 * F.ln(2 * 3.141592653589793 * F.col(f"v_{f}")) - (F.col(f) - F.col(f"m_{f}")) ** 2 / (2 * F.col(f"v_{f}")) for f in features])
    d = df.crossJoin(F.broadcast(model)).select(key, F.struct((-score).alias("s"), F.col("label").alias("l")).alias("c"))
    return d.groupBy(key).agg(F.min("c")["l"].alias("predicted"))


def knn_search(train: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(q, idx, d, rank): each stated query's k nearest rows by squared distance, then index; at most QUERY_ROWS queries go to every task at a time."""
    if (n := queries.count()) > QUERY_ROWS:
        blocks = -(-n // QUERY_ROWS) * 2
        part = F.pmod(F.xxhash64(key), F.lit(blocks))
        return reduce(DataFrame.unionByName, [knn_search(train, queries.filter(part == b), key, vector, k) for b in range(blocks)])
    q = queries.select(F.col(key).alias("q"), F.col(vector).alias("_qv"))
    t = train.select(F.col(key).alias("idx"), F.col(vector).alias("_tv"))
    d = t.crossJoin(F.broadcast(q)).select("q", "idx", squared_distance(F.col("_qv"), F.col("_tv")).alias("d"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d", "idx"))).filter(F.col("rank") <= k)


def decision_stump(df: DataFrame, features: str | list[str], label: str) -> DataFrame:
    """(feature, threshold, errors, left, right): the split with the fewest training errors on 0/1 labels, and the label of either side.

    Ties go to the first feature, then to the smaller threshold; a side's label is its majority, 0 on a tie. Distinct values
    of all features are counted together, placed by ranges and summed up by blocks of places. Where no feature varies there
    is no threshold (null) and both sides have the majority.
    """
    features = [features] if isinstance(features, str) else features
    one = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(c).cast("double").alias("x")) for k, c in enumerate(features)])).alias("s"), F.col(label).cast("int").alias("y"))
    c = one.groupBy("s.f", "s.x").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    c = ranks(c, ["f"], [F.col("x")], "at")
    c = cumulative(cumulative(c, "at", "p", "lp", lane=["f"]), "at", "n", "ln", lane=["f"])
    following = c.select("f", (F.col("at") - 1).alias("at"), F.col("x").alias("nx"))
    tp, tn = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    rp, rn = F.lit(tp) - F.col("lp"), F.lit(tn) - F.col("ln")
    side = lambda p, n: (p > n).cast("int")
    cuts = c.join(following, ["f", "at"]).select("f", (0.5 * F.col("x") + 0.5 * F.col("nx")).alias("threshold"), (F.least("lp", "ln") + F.least(rp, rn)).alias("errors"), side(F.col("lp"), F.col("ln")).alias("left"), side(rp, rn).alias("right"))
    none = df.sparkSession.createDataFrame([(len(features), None, min(tp, tn), int(tp > tn), int(tp > tn))], "f int, threshold double, errors bigint, left int, right int")
    best = cuts.unionByName(none).orderBy(F.col("threshold").isNull(), "errors", "f", "threshold").limit(1)
    names = F.array(*[F.lit(x) for x in [*features, None]])
    return best.select(F.get(names, F.col("f")).alias("feature"), "threshold", "errors", "left", "right")


def stump_predict(df: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """(key, predicted) by a stump's one row."""
    m = model.first()
    if m["threshold"] is None:
        return df.select(key, F.lit(m["left"]).alias("predicted"))
    return df.select(key, F.when(F.col(m["feature"]) <= m["threshold"], m["left"]).otherwise(m["right"]).alias("predicted"))


def linear_predict(df: DataFrame, key: str, features: list[str], model: DataFrame) -> DataFrame:
    """(key, predicted) of a linear model's terms."""
    c = {r["term"]: r["coefficient"] for r in model.collect()}  # a row per feature
    return df.select(key, _linear(features, [c["(intercept)"], *[c[f] for f in features]]).alias("predicted"))


def stratified_split(df: DataFrame, key: str, strata: list[str], ratio: float = 0.25, seed: int = 0) -> DataFrame:
    """The input with is_test: of each class round(n * ratio) rows, at least one on either side, by hashed order."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    size = df.groupBy(*[F.col(c).alias(f"_s{k}") for k, c in enumerate(strata)]).agg(F.count(F.lit(1)).alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s{k}")) for k, c in enumerate(strata)])
    placed = ranks(df, strata, [h, F.col(key)], "_p").join(size, same)
    test = F.greatest(F.lit(1), F.least(F.floor(F.col("_n") * ratio + 0.5), F.col("_n") - 1))
    few = F.when(F.col("_n") < 2, F.raise_error(F.lit("a class has fewer than two rows"))).otherwise(F.col("_p") < test)
    return placed.withColumn("is_test", few).drop("_p", "_n", *[f"_s{k}" for k in range(len(strata))])


def fold(df: DataFrame, key: str, folds: int, seed: int = 0, strata: list[str] | None = None) -> DataFrame:
    """A fold per row by hashed order within strata (or hashed buckets, where there are none)."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    if not strata:
        return df.withColumn("fold", F.pmod(h, F.lit(folds)).cast("int"))
    return ranks(df, strata, [h, F.col(key)], "_p").withColumn("fold", (F.col("_p") % folds).cast("int")).drop("_p")


def knn_neighbors(train: DataFrame, queries: DataFrame, key: str, vector: str, target: str, k: int, weighting: str) -> DataFrame:
    """(q, d, y, w): the neighbours' targets and weights. By distance: 1/d, but where a neighbour's distance is 0 only such ones count."""
    if weighting not in ("uniform", "distance"):
        raise ModelError(f"weighting: {weighting}")
    near = knn_search(train, queries, key, vector, k).join(train.select(F.col(key).alias("idx"), F.col(target).alias("y")), "idx")
    if weighting == "uniform":
        return near.select("q", "d", "y", F.lit(1.0).alias("w"))
    exact = F.min("d").over(Window.partitionBy("q")) == 0  # k rows a query
    w = F.when(exact, (F.col("d") == 0).cast("double")).otherwise(1 / F.sqrt(F.when(F.col("d") > 0, F.col("d"))))
    return near.select("q", "d", "y", w.alias("w")).filter("w > 0")


def knn_classify(train: DataFrame, queries: DataFrame, key: str, vector: str, label: str, k: int, weighting: str = "uniform") -> DataFrame:
    """(q, predicted): the heaviest label; ties go to the smaller total squared distance, then to the lower label."""
    votes = knn_neighbors(train, queries, key, vector, label, k, weighting).groupBy("q", "y").agg(F.sum("w").alias("w"), F.sum("d").alias("d"))
    return votes.groupBy("q").agg(F.min(F.struct(-F.col("w"), F.col("d"), F.col("y")))["y"].alias("predicted"))


def knn_regress(train: DataFrame, queries: DataFrame, key: str, vector: str, target: str, k: int, weighting: str = "uniform") -> DataFrame:
    """(q, predicted): the neighbours' weighted mean."""
    near = knn_neighbors(train, queries, key, vector, target, k, weighting)
    return near.groupBy("q").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("predicted"))


def sigmoid(z):
    """Without overflow at either end."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def _linear(features: list[str], w) -> object:
    return reduce(lambda a, b: a + b, [F.lit(float(w[0]))] + [F.lit(float(x)) * F.col(f) for x, f in zip(w[1:], features, strict=True)])


def logistic_regression(df: DataFrame, features: list[str], label: str, rate: float = 0.1, iterations: int = 1000, tolerance: float = 1e-6, l2: float = 0.0, weight: str | None = None) -> tuple[DataFrame, int, bool]:
    """((term, coefficient), steps taken, whether the last moved by no more than tolerance): full-batch gradient descent from 0.

    A step is one aggregate over the rows, so cache df. The intercept is not penalized. Labels are 0 and 1.
    """
    k = F.col(weight) if weight else F.lit(1.0)
    total, bad = df.agg(F.sum(k), F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1))).first()
    if not total or bad:
        raise ModelError("labels have to be 0 or 1, of rows with weight")
    w, steps, done = np.zeros(len(features) + 1), 0, False
    while steps < iterations and not done:
        e = k * (sigmoid(_linear(features, w)) - F.col(label))
        g = np.array(list(df.agg(F.sum(e).alias("g0"), *[F.sum(e * F.col(f)).alias(f"g{i + 1}") for i, f in enumerate(features)]).first()), np.float64)
        move = rate * (g / total + l2 * np.concatenate([[0.0], w[1:]]))
        w, steps, done = w - move, steps + 1, bool(np.abs(move).max() <= tolerance)
    return _terms(df, features, w), steps, done


def predict_binary(df: DataFrame, key: str, features: list[str], model: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(key, probability, predicted) of a logistic model."""
    c = {r["term"]: r["coefficient"] for r in model.collect()}  # a row per feature
    p = sigmoid(_linear(features, [c["(intercept)"], *[c[f] for f in features]]))
    return df.select(key, p.alias("probability")).withColumn("predicted", (F.col("probability") >= threshold).cast("int"))


def _terms(df: DataFrame, features: list[str], w) -> DataFrame:
    return df.sparkSession.createDataFrame([(n, float(x)) for n, x in zip(["(intercept)", *features], w, strict=True)], "term string, coefficient double")


def perceptron(df: DataFrame, order: str, features: list[str], label: str, rate: float = 0.1, iterations: int = 1000) -> DataFrame:
    """(term, coefficient, iterations, converged): online updates in the rows' order until a pass has no error.

    Each update needs the one before, so one task reads all rows; more than SERIAL_ROWS are refused.
    """
    if (n := df.limit(SERIAL_ROWS + 1).count()) > SERIAL_ROWS or not n:
        raise ModelError(f"a sequential learner takes 1 to {SERIAL_ROWS} rows")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = np.column_stack([np.ones(len(pdf)), pdf[features].to_numpy(np.float64)])
        y = pdf[label].to_numpy(np.int64)
        w, clean, done = np.zeros(x.shape[1]), False, 0
        while done < iterations and not clean:
            at, clean, done = 0, True, done + 1
            while at < len(x):  # everything up to the next error is predicted at once
                wrong = np.flatnonzero((x[at : at + 256] @ w >= 0) != (y[at : at + 256] == 1))
                if not len(wrong):
                    at += 256
                    continue
                at += int(wrong[0])
                w = w + rate * (2 * y[at] - 1) * x[at]
                at, clean = at + 1, False
        return pd.DataFrame({"term": ["(intercept)", *features], "coefficient": w, "iterations": done, "converged": clean})

    return df.select(order, *features, label, F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, "term string, coefficient double, iterations bigint, converged boolean")


def k_fold(df: DataFrame, key: str, folds: int, seed: int = 0) -> DataFrame:
    """A fold per row; of n rows the first n % folds folds have one more."""
    n = df.count()
    if not 2 <= folds <= n:
        raise ModelError(f"{folds} folds of {n} rows")
    size, more = divmod(n, folds)
    p = F.col("_p")
    at = F.when(p < more * (size + 1), F.floor(p / (size + 1))).otherwise(more + F.floor((p - more * (size + 1)) / size))
    return shuffled_rank(df, key, seed, "_p").withColumn("fold", at.cast("int")).drop("_p")


def train_test_split(df: DataFrame, key: str, ratio: float = 0.25, seed: int = 0) -> DataFrame:
    """The input with is_test: round(n * ratio) rows, at least one on either side."""
    n = df.count()
    test = int(n * ratio + 0.5)
    if not 0 < test < n:
        raise ModelError(f"{test} test rows of {n}")
    return shuffled_rank(df, key, seed, "_p").withColumn("is_test", F.col("_p") < test).drop("_p")
