"""Supervised classifiers over vectors, trained by Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ready(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col("vec").cast("array<double>"))).withColumn("label", F.col("label").cast("double"))


def softmax_classifier(train: DataFrame, max_iter: int = 50, reg: float = 0.0, tol: float = 1e-6):
    """Multinomial logistic regression of (vec, label): the mean log-likelihood less reg / 2 times the squared weights."""
    return LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg, standardization=False, tol=tol).fit(_ready(train))


def softmax_gradient(model, train: DataFrame, reg: float = 0.0) -> DataFrame:
    """One row: the largest absolute component of the objective's gradient at the model's coefficients, and the rows.

    With reg over 0 the objective has one optimum, where this is 0.  Each task adds X'(P - Y) of its rows; the tasks'
    sums, classes times features long, are added up.
    """
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()

    def add(frames):
        total, n = np.zeros((len(b), w.shape[1] + 1)), 0
        for f in frames:
            x = f.column(0).flatten().to_numpy(zero_copy_only=False).reshape(f.num_rows, -1)
            z = x @ w.T + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(p)), f.column(1).to_numpy().astype(int)] -= 1
            total += p.T @ np.hstack([x, np.ones((len(x), 1))])
            n += f.num_rows
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "g": pa.array([total.ravel()])})

    parts = train.select(F.col("vec").cast("array<double>").alias("vec"), F.col("label").cast("double").alias("label")).mapInArrow(add, "n long, g array<double>")
    rows = train.count()
    penalty = F.lit(np.hstack([reg * w, np.zeros((len(b), 1))]).ravel().tolist())
    summed = parts.select(F.posexplode("g").alias("at", "g")).groupBy("at").agg(F.sum("g").alias("g"))
    return summed.agg(F.max(F.abs(F.col("g") / rows + F.get(penalty, F.col("at")))).alias("gradient"), F.lit(rows).cast("long").alias("rows"))


def mlp_classifier(train: DataFrame, layers: Sequence[int], max_iter: int = 50, seed: int = 1):
    """Feed-forward network with sigmoid hidden units and a softmax output."""
    return MultilayerPerceptronClassifier(layers=list(layers), maxIter=max_iter, seed=seed).fit(_ready(train))


def predict(model, rows: DataFrame) -> DataFrame:
    scored = model.transform(_ready(rows))
    return scored.withColumn("probabilities", vector_to_array("probability")).drop("features", "rawPrediction", "probability")


def evaluate(predictions: DataFrame) -> DataFrame:
    """One row: mean negative log-likelihood and error rate."""
    p = F.get("probabilities", F.col("label").cast("int"))
    return predictions.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-300)))).alias("nll"), F.avg((F.col("prediction") != F.col("label")).cast("double")).alias("error"))
