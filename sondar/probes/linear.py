"""Linear probes, fitted by aggregates or by MLlib over any number of rows; scoring is a native expression.

Training rows are (label, vec); token rows take their sample's label first. Null vectors
or labels are left out; one class or no row is an error.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame) -> DataFrame:
    vec = F.transform("vec", lambda x: x.cast("double"))
    return df.where("vec IS NOT NULL AND label IS NOT NULL").select((F.col("label") == 1).cast("int").alias("label"), vec.alias("vec"))


def dot(weights: list[float], vec: Column) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(w, vec, lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def standardisation(df: DataFrame) -> tuple[list[float], list[float]]:
    """Mean and population standard deviation, at least 1e-8, of each dimension."""
    v = _rows(df).select(array_to_vector("vec").alias("v"))
    row = v.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).first().s
    n = row["count"]
    if not n:
        raise ValueError("no rows to standardise")
    return row["mean"].tolist(), [max(1e-8, (x * (n - 1) / n) ** 0.5) if n > 1 else 1e-8 for x in row["variance"].tolist()]


@dataclass
class LinearModel:
    """logit = weights . vec + bias."""

    weights: list[float]
    bias: float
    kind: str = "linear"

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        logit = dot(self.weights, F.col("vec")) + F.lit(float(self.bias))
        return df.withColumn("logit", logit).withColumn(name, sigmoid(F.col("logit")))

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f)

    @classmethod
    def load(cls, path: str) -> LinearModel:
        with open(path) as f:
            return cls(**json.load(f))


@dataclass
class MassMean:
    """The difference of the class means; its threshold lies midway between them."""

    normalize: bool = False
    center: bool = True

    def fit(self, df: DataFrame) -> LinearModel:
        v = _rows(df).select("label", array_to_vector("vec").alias("v"))
        stats = {r.label: r for r in v.groupBy("label").agg(Summarizer.mean(F.col("v")).alias("mean"), F.count("*").alias("n")).collect()}
        if len(stats) < 2:
            raise ValueError("a mass-mean probe needs both classes")
        pos, neg = stats[1]["mean"].toArray(), stats[0]["mean"].toArray()
        n1, n0 = stats[1].n, stats[0].n
        middle = (pos * n1 + neg * n0) / (n1 + n0) if self.center else 0 * pos
        direction = pos - neg
        norm = float((direction**2).sum() ** 0.5)
        if self.normalize and norm > 1e-8:
            direction = direction / norm
        bias = -((pos - middle) @ direction + (neg - middle) @ direction) / 2 - middle @ direction
        return LinearModel(direction.tolist(), float(bias), "mass_mean")


@dataclass
class Logistic:
    """Penalised logistic regression on standardised dimensions: mean loss + |w|^2 / (2 C n)."""

    C: float = 1.0
    max_iter: int = 500

    def fit(self, df: DataFrame) -> LinearModel:
        rows = _rows(df)
        counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(counts) < 2:
            raise ValueError("logistic regression needs both classes")
        n = sum(counts.values())
        # MLlib scales by the sample deviation; the factor (n - 1) / n undoes that for the penalty.
        lr = LogisticRegression(featuresCol="v", labelCol="label", maxIter=self.max_iter, regParam=(n - 1) / n / (self.C * n), elasticNetParam=0.0, tol=1e-12, standardization=True)
        model = lr.fit(rows.select(F.col("label").cast("double").alias("label"), array_to_vector("vec").alias("v")))
        return LinearModel(model.coefficients.tolist(), float(model.intercept), "logistic")
