"""Probability calibration: Platt scaling, isotonic regression, calibration error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_input(df: DataFrame, prob: str = "raw_prob", label: str = "label") -> int:
    """Validate range, label values and presence of both classes in one pass; gives the number of rows."""
    p, y = F.col(prob), F.col(label)
    row = df.agg(
        F.count("*").alias("n"),
        F.count_if(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).alias("bad_p"),
        F.count_if(y.isNull() | ~y.isin(0, 1)).alias("bad_y"),
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"),
    ).first()
    if row.n == 0:
        raise ValueError("Cannot fit calibrator on empty dataset")
    if row.bad_p:
        raise ValueError("raw_probs must be in range [0, 1]")
    if row.bad_y:
        raise ValueError("y_true must contain only 0 and 1")
    if row.pos == 0 or row.neg == 0:
        raise ValueError(
            f"Calibration set must contain both classes. Got {row.pos} positive and {row.neg} negative samples.")
    return row.n


@dataclass
class Calibrator:
    """A fitted calibrator."""

    method: str
    model: object

    def transform(self, df: DataFrame, prob: str = "raw_prob", out: str = "calibrated_prob") -> DataFrame:
        """Add the calibrated probability, clipped to [0, 1]."""
        if self.method == "platt":
            x = VectorAssembler(inputCols=[prob], outputCol="_x").transform(df)
            x = self.model.transform(x)
            value = vector_to_array("_probability")[1]
            drop = ["_x", "_raw", "_probability", "_prediction"]
        else:
            x = self.model.transform(df.withColumn("_x", F.col(prob).cast("double")))
            value = F.col("_prediction")
            drop = ["_x", "_prediction"]
        return x.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).drop(*drop)


def fit_calibrator(
    df: DataFrame, method: str = "platt", prob: str = "raw_prob", label: str = "label"
) -> Calibrator:
    """Fit Platt scaling (logistic on one column, unit ridge) or isotonic regression."""
    if method not in ("platt", "isotonic"):
        raise ValueError(f"Invalid calibration method: {method}")
    n = check_input(df, prob, label)
    data = df.select(F.col(prob).cast("double").alias(prob), F.col(label).cast("double").alias("_y"))
    if method == "platt":
        # a ridge of weight 1 on the summed loss is 1/n on Spark's mean loss
        x = VectorAssembler(inputCols=[prob], outputCol="_x").transform(data)
        lr = LogisticRegression(
            featuresCol="_x", labelCol="_y", maxIter=1000, regParam=1.0 / n, elasticNetParam=0.0,
            standardization=False, probabilityCol="_probability", predictionCol="_prediction",
            rawPredictionCol="_raw")
        return Calibrator(method, lr.fit(x))
    # rows of equal probability are pooled first: the fit gathers one weighted point per distinct value
    points = data.groupBy(F.col(prob).alias("_x")).agg(F.avg("_y").alias("_y"), F.count("*").cast("double").alias("_n"))
    iso = IsotonicRegression(
        featuresCol="_x", labelCol="_y", weightCol="_n", isotonic=True, predictionCol="_prediction")
    return Calibrator(method, iso.fit(points))


def calibration_error(
    df: DataFrame, prob: str = "calibrated_prob", label: str = "label", bins: int = 10
) -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    slot = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1))
    per_bin = df.groupBy(slot.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(prob).alias("mean_prob"),
        F.avg(F.col(label).cast("double")).alias("observed"))
    gap = F.abs(F.col("mean_prob") - F.col("observed"))
    return per_bin.agg(F.try_divide(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"))
