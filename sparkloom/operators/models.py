"""Models fitted by pyspark.ml, and the parts of representation learning that are DataFrame programs."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import vectors


def logistic_probe(train: DataFrame, test: DataFrame, vector: str, label: str, c: float = 0.1) -> DataFrame:
    """test with `guess` and `chance`: standardised features, classes weighted to be equal, penalty 1 / (c n)."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # a row a class
    n = sum(counts.values())
    weight = F.lit(1.0)
    for value, k in counts.items():
        weight = F.when(F.col(label) == value, n / (len(counts) * k)).otherwise(weight)
    prepared = lambda df: df.withColumn("__f", array_to_vector(F.col(vector)))
    scaler, fitted = Pipeline(stages=[
        StandardScaler(inputCol="__f", outputCol="__s", withMean=True),
        LogisticRegression(featuresCol="__s", labelCol=label, weightCol="__w", regParam=1 / (c * n), standardization=False),
    ]).fit(prepared(train).withColumn("__w", weight)).stages
    # the model's own transformation would send its summary, and so the session, to the tasks
    scale = np.divide(1, scaler.std.toArray(), out=np.zeros(scaler.std.size), where=scaler.std.toArray() > 0)
    rows = fitted.coefficientMatrix.toArray() * scale
    margins = [_linear(vector, w, float(b)) for w, b in zip(rows, fitted.interceptVector.toArray() - rows @ scaler.mean.toArray(), strict=True)]
    if len(margins) == 1:
        return test.withColumns({"guess": (margins[0] > 0).cast("double"), "chance": 1 / (1 + F.exp(-margins[0]))})
    held = test.withColumn("__m", F.array(*margins))
    total = F.aggregate("__m", F.lit(0.0), lambda s, m: s + F.exp(m - F.array_max("__m")))
    return held.withColumns({"guess": (F.array_position("__m", F.array_max("__m")) - 1).cast("double"), "chance": F.exp(F.col("__m")[1] - F.array_max("__m")) / total}).drop("__m")


def _linear(vector: str, weights: np.ndarray, constant: float) -> Column:
    return vectors.dot(F.col(vector), F.array(*(F.lit(float(w)) for w in weights))) + constant


def ridge_probe(train: DataFrame, test: DataFrame, vector: str, value: str, alpha: float = 10.0) -> DataFrame:
    """test with `guess`: linear regression with a squared penalty."""
    n = train.count()
    prepared = lambda df: df.withColumn("__f", array_to_vector(F.col(vector)))
    model = LinearRegression(featuresCol="__f", labelCol=value, regParam=alpha / max(1, n), standardization=False).fit(prepared(train))
    return test.withColumn("guess", _linear(vector, model.coefficients.toArray(), model.intercept))


def regression_errors(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """mae, median_ae, r2 (null where the truth doesn't vary)."""
    err = F.abs(F.col(truth) - F.col(guess))
    var = F.var_pop(truth)
    return df.agg(F.avg(err).alias("mae"), F.median(err).alias("median_ae"), F.when(var > 0, 1 - F.avg(F.pow(F.col(truth) - F.col(guess), 2)) / var).alias("r2"))


def compatibility(train: DataFrame, test: DataFrame, a: str, b: str, label: str, c: float = 1.0) -> DataFrame:
    """test with `chance`: a diagonal bilinear form, that is a logistic model of the products of components."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return logistic_probe(train.withColumn("__x", product), test.withColumn("__x", product), "__x", label, c).drop("__x")


def skip_gram(ctx: DataFrame, size: int, seed: int = 42, least: int = 2, window: int = 100) -> DataFrame:
    """item, vector: skip-gram over contexts as sentences (hierarchical softmax; not negative sampling)."""
    lists = ctx.groupBy("ctx").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("words"))
    model = Word2Vec(vectorSize=size, minCount=least, windowSize=window, seed=seed, inputCol="words", outputCol="v", maxSentenceLength=10_000).fit(lists)
    return model.getVectors().select(F.col("word").alias("item"), vector_to_array("vector").alias("vector"))


def scores_of_sets(sets: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """query, item, score, rank: items near the mean vector of a query's items, which themselves are left out.

    sets: query, item; items: item, vector, a table of a vocabulary's size, which is broadcast.
    """
    centre = vectors.mean(sets.join(items, "item"), ["query"], "vector").withColumnRenamed("vector", "__m")
    scored = centre.join(F.broadcast(items)).select("query", "item", F.round(vectors.cosine(F.col("__m"), F.col("vector")), 9).alias("score"))
    left = scored.join(sets, ["query", "item"], "left_anti")
    from sparkloom.operators.rank import top_k

    return top_k(left, ["query"], [F.desc("score"), "item"], k)


def cross_entropy(logits: Column, targets: Column) -> Column:
    """Mean over a set of targets (indices from 0) of minus the log of the softmax."""
    top = F.array_max(logits)
    log_sum = top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return log_sum - F.aggregate(targets, F.lit(0.0), lambda s, i: s + F.get(logits, i)) / F.size(targets)


def normal_divergence(mean: Column, log_variance: Column) -> Column:
    """Of a diagonal normal from the standard one."""
    part = F.zip_with(mean, log_variance, lambda m, v: 1 + v - m * m - F.exp(v))
    return -0.5 * F.aggregate(part, F.lit(0.0), lambda s, x: s + x)


def padded(values: Column, width: Column | int, pad: int = 0) -> Column:
    """struct(values, mask) of an array brought to a width."""
    width = F.lit(width) if isinstance(width, int) else width
    more = F.greatest(width - F.size(values), F.lit(0))
    return F.struct(F.concat(values, F.array_repeat(F.lit(pad), more)).alias("values"), F.concat(F.array_repeat(F.lit(True), F.size(values)), F.array_repeat(F.lit(False), more)).alias("mask"))
