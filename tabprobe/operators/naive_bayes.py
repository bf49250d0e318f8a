"""Gaussian naive Bayes with variance smoothing: one aggregation to fit, expressions to predict.

The fit is a row for each class and feature (count, mean, population variance). Every variance gets ``var_smoothing`` times
the largest variance of a feature over all rows, as the reference's model does, so features that are constant in a class
keep a density. Prediction adds up log densities next to each row; it needs no shuffle and no Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class GaussianNBModel:
    labels: list[float]
    prior: list[float]
    mean: list[list[float]]
    var: list[list[float]]
    features_col: str = "features"

    def scores(self, x: Column) -> Column:
        """Joint log likelihood of the array ``x`` for each class, in the order of ``labels``."""
        out = []
        for p, mu, var in zip(self.prior, self.mean, self.var, strict=True):
            start = math.log(p) - 0.5 * sum(math.log(2 * math.pi * v) for v in var)
            s = F.lit(start)
            for j, (m, v) in enumerate(zip(mu, var, strict=True)):
                d = x[j] - F.lit(m)
                s = s - 0.5 * d * d / F.lit(v)
            out.append(s)
        return F.array(*out)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``: the label of the highest score, the smallest label where scores tie."""
        x = F.col(self.features_col)
        x = vector_to_array(x) if df.schema[self.features_col].dataType.typeName() != "array" else x
        s = df.withColumn("__nb", self.scores(x))
        best = F.array_position("__nb", F.array_max("__nb"))
        return s.withColumn("prediction", F.element_at(F.array(*[F.lit(v) for v in self.labels]), best.cast("int"))).drop("__nb")


class GaussianNB:
    """``fit`` on ``features`` (vector or array of doubles) and ``label``; ``weight`` names a column of row weights."""

    def __init__(self, var_smoothing: float = 1e-9, features_col: str = "features", label_col: str = "label", weight: str | None = None):
        self.var_smoothing, self.features_col, self.label_col, self.weight = var_smoothing, features_col, label_col, weight

    def fit(self, df: DataFrame) -> GaussianNBModel:
        x = F.col(self.features_col)
        x = vector_to_array(x) if df.schema[self.features_col].dataType.typeName() != "array" else x
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        long = df.where(F.col(self.label_col).isNotNull()).select(
            F.col(self.label_col).cast("double").alias("y"), w.alias("w"), F.posexplode(x).alias("j", "v"))
        d = F.col("v")
        # group variances are worked out around the overall mean, so that large means cost no digits
        overall = long.groupBy("j").agg(F.avg(d).alias("centre"), F.var_pop(d).alias("spread")).collect()
        centre = {r["j"]: r["centre"] for r in overall}
        eps = self.var_smoothing * max((r["spread"] for r in overall), default=0.0)
        at = F.array(*[F.lit(float(centre[j])) for j in range(len(centre))])[F.col("j")] if centre else F.lit(0.0)
        d = d - at
        rows = long.groupBy("y", "j").agg(F.sum("w").alias("n"), F.sum(F.col("w") * d).alias("s"), F.sum(F.col("w") * d * d).alias("q")).collect()
        labels = sorted({r["y"] for r in rows})
        got = {(r["y"], r["j"]): r for r in rows}
        size = [got[y, 0]["n"] for y in labels]
        mean, var = [], []
        for y in labels:
            cells = [got[y, j] for j in range(len(centre))]
            mean.append([centre[j] + r["s"] / r["n"] for j, r in enumerate(cells)])
            var.append([max(r["q"] / r["n"] - (r["s"] / r["n"]) ** 2, 0.0) + eps for r in cells])
        total = sum(size)
        if any(v <= 0 for vs in var for v in vs):
            raise ValueError("a feature is constant: var_smoothing must be above 0 and some feature must vary")
        return GaussianNBModel(labels, [n / total for n in size], mean, var, self.features_col)
