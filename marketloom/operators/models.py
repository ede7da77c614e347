"""Direction and return models over sliding windows, fitted for all tickers together."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.settings import DEFAULTS, Settings
from marketloom.workspace import written

PENALTIES = (0.001, 0.01, 0.1)
# Largest magnitude a log probability may have in the loss.
LOG_FLOOR = -100.0


@dataclass(frozen=True)
class Models:
    """A fitted pair: probability that the price rises, and the expected return."""

    direction: LogisticRegressionModel
    returns: LinearRegressionModel

    def save(self, path: str) -> None:
        """Store both models under ``path``."""
        self.direction.write().overwrite().save(f"{path}/direction")
        self.returns.write().overwrite().save(f"{path}/returns")

    @staticmethod
    def load(path: str) -> Models:
        """Load a stored pair; a missing one raises."""
        return Models(
            LogisticRegressionModel.load(f"{path}/direction"),
            LinearRegressionModel.load(f"{path}/returns"),
        )


def samples(sequences: DataFrame) -> DataFrame:
    """Windows flattened to one vector per sample, written once because fitting reads them often."""
    flat = sequences.withColumn("features", array_to_vector(F.flatten("sequence"))).drop("sequence")
    return written(flat, "samples")


def fit(train: DataFrame, penalty: float, iterations: int = 20) -> Models:
    """Fit both models on all tickers' training samples."""
    rows = train.filter(F.col("target_return").isNotNull())
    direction = LogisticRegression(
        labelCol="target_direction", regParam=penalty, maxIter=iterations
    ).fit(rows)
    returns = LinearRegression(
        labelCol="target_return", regParam=penalty, maxIter=iterations, solver="l-bfgs"
    ).fit(rows)
    return Models(direction, returns)


def predict(models: Models, rows: DataFrame) -> DataFrame:
    """Add probability, predicted_return and predicted (1 if the probability exceeds 0.5)."""
    scored = models.direction.setPredictionCol("_class").transform(rows)
    scored = models.returns.setPredictionCol("predicted_return").transform(scored)
    return (
        scored.withColumn("probability", vector_to_array("probability")[1])
        .withColumn("predicted", direction_label(F.col("probability")))
        .drop("rawPrediction", "_class", "features")
    )


def direction_label(probability: Column) -> Column:
    """1 for a probability above one half, else 0."""
    return F.when(probability > 0.5, 1).otherwise(0)


def combined_loss(
    df: DataFrame, keys: Sequence[str] = (), settings: Settings = DEFAULTS
) -> DataFrame:
    """Weighted sum of binary cross-entropy (direction) and squared error (return).

    Needs probability, predicted_return, target_direction, target_return; logs are floored.
    """
    p, y = F.col("probability"), F.col("target_direction")
    log_up = F.greatest(F.coalesce(F.ln(p), F.lit(LOG_FLOOR)), F.lit(LOG_FLOOR))
    log_down = F.greatest(F.coalesce(F.ln(1 - p), F.lit(LOG_FLOOR)), F.lit(LOG_FLOOR))
    gap = F.col("predicted_return") - F.col("target_return")
    parts = df.groupBy(*keys).agg(
        F.avg(-(y * log_up + (1 - y) * log_down)).alias("direction_loss"),
        F.avg(gap * gap).alias("return_loss"),
    )
    a = settings.direction_loss_weight
    return parts.withColumn(
        "total_loss", a * F.col("direction_loss") + (1 - a) * F.col("return_loss")
    )


def select(
    train: DataFrame, validation: DataFrame, penalties: Sequence[float] = PENALTIES
) -> tuple[Models, DataFrame]:
    """Fit one pair per penalty and keep the one with the lowest validation loss.

    Returns the winner and the loss table of the candidates, marked ``chosen``.
    """
    candidates = []
    for penalty in penalties:
        models = fit(train, penalty)
        candidates.append((penalty, models, combined_loss(predict(models, validation)).first()))
    best = min(candidates, key=lambda c: c[2]["total_loss"])
    losses = train.sparkSession.createDataFrame(
        [
            (p, loss["direction_loss"], loss["return_loss"], loss["total_loss"], p == best[0])
            for p, _, loss in candidates
        ],
        "penalty double, direction_loss double, return_loss double, total_loss double, "
        "chosen boolean",
    )
    return best[1], losses


def latest_card(requested: DataFrame, predictions: DataFrame, order: str = "date") -> DataFrame:
    """Per requested ticker: last label, its name, confidence and expected return.

    Tickers without a prediction get label 0, confidence one half and return 0.
    """
    last = predictions.groupBy("ticker").agg(
        F.max_by(F.struct("probability", "predicted_return"), order).alias("_last")
    )
    joined = requested.select("ticker").join(last, "ticker", "left")
    p = F.coalesce("_last.probability", F.lit(0.5))
    label = direction_label(p)
    return joined.select(
        "ticker",
        label.alias("predicted_direction"),
        F.when(label == 1, "UP").otherwise("DOWN").alias("direction_label"),
        F.greatest(p, 1 - p).alias("confidence"),
        F.coalesce("_last.predicted_return", F.lit(0.0)).alias("predicted_return"),
    )
