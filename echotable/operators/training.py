"""Class weights and a linear model over embeddings with ``pyspark.ml``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echotable.functions.config import CRITICAL_CLASSES


def class_weights(rows: DataFrame, label: str, boost: float = 1.5, critical=CRITICAL_CLASSES) -> DataFrame:
    """``rows`` with ``weight``: balanced by class, critical ones boosted."""
    n = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    w = n.crossJoin(total).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("_w"))  # one row
    weight = F.when(F.col(label).isin(*critical), F.col("_w") * boost).otherwise(F.col("_w"))
    return rows.join(w, label).withColumn("weight", weight).drop("_w")


def fit_linear(train: DataFrame, vector: str, label: str, regularisation: float = 0.01, max_iter: int = 50):
    """Scaler and weighted logistic regression; ``vector`` is an array column. Needs ``weight``."""
    rows = train.withColumn("_x", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    steps = [
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True),
        LogisticRegression(featuresCol="_z", labelCol="_y", weightCol="weight", regParam=regularisation, maxIter=max_iter),
    ]
    return Pipeline(stages=steps).fit(rows)


def predict_linear(model, rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with ``predicted``."""
    names = model.stages[0].labels
    x = rows.withColumn("_x", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    scored = x
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("prediction").cast("int") + 1)
    return scored.select(*rows.columns, name.alias("predicted"))


def rank_candidates(trials: DataFrame, family: str, score: str, cost: str, critical_recall: str, floor: float, bin_width: float = 0.005) -> DataFrame:
    """``trials`` with ``place`` in their family: eligible ones first if any, then by score bin, then cheaper."""
    ok = F.col(critical_recall) >= floor
    some = F.max(ok.cast("int")).over(Window.partitionBy(family)) == 1
    order = Window.partitionBy(family).orderBy(F.when(some, ok.cast("int")).otherwise(1).desc(), F.desc(F.round(F.col(score) / bin_width)), cost)
    return trials.withColumn("eligible", ok).withColumn("_some", some).withColumn("place", F.row_number().over(order)).drop("_some")


def member_subsets(rows: DataFrame, members: list[str], actual: str, classes: list[str]) -> DataFrame:
    """``(mask, size, clips, right, accuracy, place)`` of every subset of an ensemble's members; bit i of ``mask`` is member i.

    ``members`` name columns of class scores in the order of ``classes``. A subset predicts the class of the largest sum of
    scores, the first of equals. All subsets are scored in one pass: each sum is a smaller subset's plus one member. The best has
    place 1; of equals the smaller subset, then the smaller mask. At most 12 members; rows with a null score or
    an unknown class are left out; no rows: no subsets.
    """
    if not 1 <= len(members) <= 12:
        raise ValueError("from 1 to 12 members")
    subsets = 1 << len(members)

    def run(pdfs):
        right, clips = np.zeros(subsets, np.int64), 0
        for pdf in pdfs:
            if not len(pdf):
                continue
            truth = pdf["_truth"].to_numpy()
            sums = np.zeros((subsets, len(pdf), len(classes)))
            for i, m in enumerate(members):
                sums[1 << i : 2 << i] = sums[: 1 << i] + np.stack(pdf[m].to_numpy())
            right += (sums.argmax(2) == truth).sum(1)
            clips += len(pdf)
        yield pd.DataFrame({"mask": np.arange(1, subsets), "right": right[1:], "clips": clips})

    known = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(actual))
    usable = rows.where(known > 0)
    for m in members:
        usable = usable.where((F.size(m) == len(classes)) & ~F.exists(m, lambda x: x.isNull()))
    usable = usable.select(*[F.transform(m, lambda x: x.cast("double")).alias(m) for m in members], (known - 1).alias("_truth"))
    total = usable.mapInPandas(run, "mask long, right long, clips long").groupBy("mask").agg(F.sum("right").alias("right"), F.sum("clips").alias("clips")).where("clips > 0")
    total = total.select("mask", F.bit_count("mask").alias("size"), "clips", "right", (F.col("right") / F.col("clips")).alias("accuracy"))
    place = F.row_number().over(Window.orderBy(F.desc("right"), "size", "mask"))  # at most 4,095 rows
    return total.withColumn("place", place)
