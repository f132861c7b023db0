"""Classifier heads over frozen token vectors (M9, M10) with Spark ML.

Deviations from the reference are deliberate: the encoder is not fine-tuned
(vectors are inputs), and the hidden layer of ``MultilayerPerceptronClassifier``
uses sigmoid units where the reference used ReLU.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagflow.operators.metrics import argmax


def _features(df: DataFrame, vec_col: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec_col).cast("array<double>")))


def softmax_head(train: DataFrame, score: DataFrame, vec_col: str = "embedding", label_col: str = "label",
                 max_iter: int = 50, tol: float = 1e-6) -> DataFrame:
    """M9: dense layer + softmax (multinomial logistic regression); adds ``pred`` and ``probs``."""
    lr = LogisticRegression(family="multinomial", maxIter=max_iter, tol=tol, labelCol=label_col, featuresCol="features")
    model = lr.fit(_features(train, vec_col))
    out = model.transform(_features(score, vec_col))
    return out.withColumn("probs", vector_to_array("probability")).withColumn("pred", argmax("probs")) \
        .drop("features", "rawPrediction", "probability", "prediction")


def mlp_head(train: DataFrame, score: DataFrame, n_classes: int, vec_col: str = "embedding",
             label_col: str = "label", hidden: int = 128, max_iter: int = 50, seed: int = 0) -> DataFrame:
    """Hidden layer of ``hidden`` units + softmax output; adds ``pred`` and ``probs``."""
    dim = len(train.select(vec_col).first()[0])
    mlp = MultilayerPerceptronClassifier(layers=[dim, hidden, n_classes], maxIter=max_iter, seed=seed,
                                         labelCol=label_col, featuresCol="features")
    model = mlp.fit(_features(train, vec_col))
    out = model.transform(_features(score, vec_col))
    return out.withColumn("probs", vector_to_array("probability")).withColumn("pred", argmax("probs")) \
        .drop("features", "rawPrediction", "probability", "prediction")


def largest_gradient(scored: DataFrame, vec_col: str = "embedding", label_col: str = "label") -> float:
    """Largest entry of the mean log-loss gradient of a softmax layer over its training rows (0 at the optimum)."""
    per = scored.select(F.col(label_col).alias("_y"), F.col(vec_col).alias("_x"), F.posexplode("probs").alias("k", "p"))
    err = per.select("k", (F.col("p") - (F.col("_y") == F.col("k")).cast("double")).alias("e"), "_x")
    each = err.select("k", F.posexplode("_x").alias("d", "x"), "e").groupBy("k", "d").agg(F.avg(F.col("e") * F.col("x")).alias("g"))
    return float(each.agg(F.max(F.abs("g"))).first()[0] or 0.0)


def log_loss(scored: DataFrame, label_col: str = "label") -> float:
    """Mean negative log probability of the labels."""
    return float(scored.agg(F.avg(-F.log(F.greatest(F.get("probs", F.col(label_col).cast("int")), F.lit(1e-300))))).first()[0])
