"""Regression by formula: ordinary and weighted least squares, ridge, and MLlib methods."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

#: Most levels of a text predictor.
MAX_LEVELS = 1000


@dataclass
class Formula:
    response: str | None
    terms: list[tuple[str, ...]]
    intercept: bool


def parse_formula(text: str, columns: list[str]) -> Formula:
    """y ~ a + b, y ~ ., a:b, a*b, - 1, ~ a."""
    left, _, right = text.partition("~")
    response = left.strip() or None
    terms: list[tuple[str, ...]] = []
    intercept = True
    for part in right.replace("-", "+ -").split("+"):
        part = part.strip()
        if not part:
            continue
        if part.replace(" ", "") == "-1" or part == "0":
            intercept = False
        elif part == "1":
            intercept = True
        elif part == ".":
            terms += [(c,) for c in columns if c != response]
        elif "*" in part:
            names = [x.strip() for x in part.split("*")]
            terms += [(x,) for x in names] + [tuple(names)]
        else:
            terms.append(tuple(x.strip() for x in part.split(":")))
    for t in terms:
        for c in t:
            if c not in columns:
                raise ValueError(f"no column {c!r}")
    return Formula(response, list(dict.fromkeys(terms)), intercept)


def design(df: DataFrame, formula: Formula, order: list[str] | None = None) -> list[tuple[str, Column]]:
    """(name, column) of each design column; text gives a dummy for each level but the first, by appearance in `order` or sorted."""
    out: list[tuple[str, Column]] = [("(Intercept)", F.lit(1.0))] if formula.intercept else []
    for term in formula.terms:
        if len(term) == 1 and isinstance(df.schema[term[0]].dataType, T.StringType):
            c = term[0]
            at = F.min(F.struct(*order)) if order else F.min(c)
            levels = [r[0] for r in df.where(F.col(c).isNotNull()).groupBy(c).agg(at.alias("at")).orderBy("at").limit(MAX_LEVELS + 1).collect()]
            if len(levels) > MAX_LEVELS:
                raise ValueError(f"{c} has too many levels")
            out += [(f"{c}{v}", F.when(F.col(c) == v, 1.0).otherwise(0.0)) for v in levels[1 if formula.intercept else 0 :]]
        else:
            product = F.lit(1.0)
            for c in term:
                product = product * F.col(c).cast("double")
            out.append((":".join(term), product))
    return out


@dataclass
class ModelResult:
    """Tables of a fitted model; fitted and residuals are lazy columns over the input."""

    source: DataFrame
    names: list[str]
    estimates: list[float]
    rows: list[tuple]
    r_squared: float | None
    columns: list[Column]
    response: str | None
    native: object = None
    scored: DataFrame | None = None
    gains: list[tuple[str, float]] = field(default_factory=list)

    def _table(self, rows, schema: str) -> DataFrame:
        return self.source.sparkSession.createDataFrame(rows, schema)

    def coef(self) -> DataFrame:
        return self._table(list(zip(self.names, self.estimates, strict=True)), "term string, estimate double")

    def summary(self) -> DataFrame:
        return self._table(self.rows, "term string, estimate double, std_error double, t_stat double, p_value double")

    def _predicted(self) -> Column:
        total = F.lit(0.0)
        for c, b in zip(self.columns, self.estimates, strict=True):
            total = total + c * F.lit(b)
        return total

    def fitted(self) -> DataFrame:
        return self.scored if self.scored is not None else self.source.select(self._predicted().alias("fitted"))

    def residuals(self) -> DataFrame:
        return self.source.select((F.col(self.response).cast("double") - self._predicted()).alias("residual"))

    def predict(self, df: DataFrame) -> DataFrame:
        if self.native is not None:
            return self.native(df)
        return df.select(self._predicted().alias("prediction"))

    def importance(self) -> DataFrame:
        return self._table(self.gains, "term string, gain double")


def fit(df: DataFrame, formula: str, method: str = "ols", order: list[str] | None = None, **params) -> ModelResult:
    """Fits ols, ridge (lambda_), wls (weights), or the MLlib methods kmeans (k), pca (k), gbt (iterations, learning_rate).

    The linear methods need one pass: an aggregation of the sums of products of design columns,
    of which there are few, then a small solve.
    """
    f = parse_formula(formula, df.columns)
    parts = design(df, f, order)
    names, columns = [n for n, _ in parts], [c for _, c in parts]
    if method not in ("ols", "ridge", "wls"):
        return _mllib(df, f, parts, method, params)
    y = F.col(f.response).cast("double")
    weight = F.col(params["weights"]).cast("double") if method == "wls" else F.lit(1.0)
    p = len(parts)
    cells = [F.sum(weight * columns[i] * columns[j]).alias(f"w{i}_{j}") for i in range(p) for j in range(i, p)]
    cells += [F.sum(weight * columns[i] * y).alias(f"b{i}") for i in range(p)]
    cells += [F.sum(columns[i] * columns[j]).alias(f"x{i}_{j}") for i in range(p) for j in range(i, p)]
    cells += [F.sum(columns[i] * y).alias(f"c{i}") for i in range(p)]
    cells += [F.count(y).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")]
    whole = y.isNotNull()
    for c in columns:
        whole = whole & c.isNotNull()
    s = df.where(whole).agg(*cells).first()
    if s["n"] <= p:
        raise ValueError("there must be more observations than parameters")
    get = lambda k: np.array([[s[f"{k}{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    a, b = get("w"), np.array([s[f"b{i}"] for i in range(p)])
    if method == "ridge":
        a = a + np.diag([0.0 if names[i] == "(Intercept)" else float(params.get("lambda_", 1.0)) for i in range(p)])
    beta = np.linalg.solve(a, b)
    xx, xy = get("x"), np.array([s[f"c{i}"] for i in range(p)])
    rss = float(s["syy"] - 2 * beta @ xy + beta @ xx @ beta)
    tss = float(s["syy"] - (s["sy"] ** 2 / s["n"] if f.intercept else 0))
    error = np.sqrt(np.maximum(0, rss / (s["n"] - p) * np.diag(np.linalg.inv(xx))))
    rows = []
    for n, e, se in zip(names, beta, error, strict=True):
        t = float(e / se) if se > 0 else float("nan")
        rows.append((n, float(e), float(se), t, math.erfc(abs(t) / math.sqrt(2)) if t == t else float("nan")))
    return ModelResult(df, names, [float(x) for x in beta], rows, 1 - rss / tss if tss else None, columns, f.response)


def _mllib(df: DataFrame, f: Formula, parts, method: str, params: dict) -> ModelResult:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    parts = [(n, c) for n, c in parts if n != "(Intercept)"]
    inputs = [f"__x{i}" for i in range(len(parts))]
    shape = lambda d: VectorAssembler(inputCols=inputs, outputCol="__v", handleInvalid="skip").transform(d.withColumns({k: c.cast("double") for k, (_, c) in zip(inputs, parts, strict=True)}))
    # a task holds and reads again its rows in every round: no more than so many of them
    needed = df.select(*dict.fromkeys([*(x for t in f.terms for x in t), *([f.response] if f.response else [])]))
    data = shape(spread(needed))
    k = int(params.get("k", 2))
    gains: list[tuple[str, float]] = []
    if method == "kmeans":
        model = KMeans(k=k, featuresCol="__v", predictionCol="cluster", seed=int(params.get("seed", 1))).fit(data)
        score = lambda d: model.transform(shape(d)).select("cluster")
    elif method == "pca":
        model = PCA(k=k, inputCol="__v", outputCol="__pc").fit(data)
        score = lambda d: model.transform(shape(d)).select(*(vector_to_array("__pc")[i].alias(f"pc{i + 1}") for i in range(k)))
    elif method in ("gbt", "lightgbm"):
        model = GBTRegressor(featuresCol="__v", labelCol=f.response, maxIter=int(params.get("iterations", 20)), stepSize=float(params.get("learning_rate", 0.1)), seed=1).fit(data.withColumn(f.response, F.col(f.response).cast("double")))
        gains = [(n, float(g)) for (n, _), g in zip(parts, model.featureImportances.toArray(), strict=True)]
        score = lambda d: model.transform(shape(d)).select("prediction")
    else:
        raise ValueError(f"no model method {method!r}")
    fitted = score(df)
    return ModelResult(df, [], [], [], None, [], f.response, score, fitted.withColumnRenamed("prediction", "fitted"), gains)
