"""AdaBoost (SAMME) over weighted depth-1 Spark ML trees (§2.I ada_boost_classifier).

Each round fits a stump with ``weightCol``, measures the weighted error in one
aggregation, and reweights the rows with a projection. The weight column is
checkpointed every few rounds into ``spark.checkpoint.dir`` so the lineage stays
short and a lost executor only recomputes from the last checkpoint.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprobe.session import ensure_checkpoint_dir

CHECKPOINT_EVERY = 5


@dataclass
class AdaBoostModel:
    stumps: list
    alphas: list
    k: int

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.stumps):
            out = (m.setPredictionCol(f"__p{i}").setRawPredictionCol(f"__r{i}").setProbabilityCol(f"__q{i}")
                   .transform(out).drop(f"__r{i}", f"__q{i}"))
        scores = []
        for c in range(self.k):
            s = F.lit(0.0)
            for i, a in enumerate(self.alphas):
                s = s + F.when(F.col(f"__p{i}") == float(c), F.lit(a)).otherwise(F.lit(0.0))
            scores.append(F.struct(s.alias("s"), F.lit(float(c)).alias("c")))
        out = out.withColumn("prediction", F.array_max(F.array(*scores))["c"])
        return out.drop(*[f"__p{i}" for i in range(len(self.stumps))])


def ada_boost_fit(train: DataFrame, k: int, n_estimators: int = 50, learning_rate: float = 1.0,
                  weight: str | None = None, seed: int = 42) -> AdaBoostModel:
    """SAMME: alpha = lr · (ln((1 − err)/err) + ln(k − 1)); misclassified rows gain weight exp(alpha)."""
    ensure_checkpoint_dir(train.sparkSession)
    base = train.select("features", "label", (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("__w"))
    total = base.agg(F.sum("__w")).first()[0]
    w = base.withColumn("__w", F.col("__w") / F.lit(total)).persist(StorageLevel.MEMORY_AND_DISK)
    held = [w]  # this round's rows, and last round's until these are computed
    try:
        return _rounds(w, held, k, n_estimators, learning_rate, seed)
    finally:
        for x in held:
            x.unpersist()


def _rounds(w: DataFrame, held: list[DataFrame], k: int, n_estimators: int, learning_rate: float, seed: int) -> AdaBoostModel:
    stumps, alphas = [], []
    k = max(k, 2)
    for m in range(n_estimators):
        stump = DecisionTreeClassifier(maxDepth=1, weightCol="__w", seed=seed + m).fit(w)
        pred = stump.transform(w).select("features", "label", "__w", "prediction")
        r = pred.agg(F.sum(F.when(F.col("prediction") != F.col("label"), F.col("__w")).otherwise(0.0)).alias("e"),
                     F.sum("__w").alias("s")).first()
        while len(held) > 1:
            held.pop(0).unpersist()
        err = (r["e"] or 0.0) / (r["s"] or 1.0)
        if err >= 1 - 1.0 / k:
            if not stumps:
                stumps.append(stump)
                alphas.append(1.0)
            break
        alpha = learning_rate * (math.log((1 - err) / max(err, 1e-12)) + math.log(k - 1))
        stumps.append(stump)
        alphas.append(alpha)
        if err <= 0:
            break
        w = pred.withColumn("__w", F.col("__w") * F.exp(F.when(F.col("prediction") != F.col("label"), F.lit(alpha))
                                                         .otherwise(F.lit(0.0))) / F.lit(r["s"]))
        w = w.drop("prediction")
        if (m + 1) % CHECKPOINT_EVERY == 0:
            w = w.checkpoint()
        w = w.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(w)
    return AdaBoostModel(stumps, alphas, k)
