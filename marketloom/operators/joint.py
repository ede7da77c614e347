"""Both heads fitted together on the combined loss, the state of least validation loss kept.

Each iteration is one Spark job over training and validation samples: tasks sum losses and gradients
of their rows, the sums meet by slot (one number per weight, whatever the number of rows), and the driver
moves the weights. Full-batch accelerated gradient steps of a length that the mean squared norm of the samples
proves safe, so there is no learning rate to choose and a lost executor changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.models import LOG_FLOOR, direction_label
from marketloom.settings import DEFAULTS, Settings
from marketloom.sources.tables import read_table, write_table
from marketloom.workspace import written

_SUMS = "slot int, total double"
# Numbers a part of the samples (training, validation) contributes before its gradients.
_COUNT, _DIRECTION, _RETURN, _NORM, _NUMBERS = 0, 1, 2, 3, 4


@dataclass(frozen=True)
class JointModel:
    """Weights of the two heads; the last weight of each is its intercept."""

    direction: np.ndarray
    returns: np.ndarray

    def predict(self, rows: DataFrame) -> DataFrame:
        """Replace ``features`` by probability, predicted_return and predicted; no shuffle, no Python."""
        def score(weights: np.ndarray):
            cells = F.zip_with(
                "_x", F.array(*[F.lit(float(w)) for w in weights[:-1]]), lambda x, w: x * w
            )
            return F.aggregate(cells, F.lit(float(weights[-1])), lambda s, x: s + x)

        return (
            rows.withColumn("_x", vector_to_array("features"))
            .withColumn("probability", 1 / (1 + F.exp(-score(self.direction))))
            .withColumn("predicted_return", score(self.returns))
            .withColumn("predicted", direction_label(F.col("probability")))
            .drop("_x", "features")
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """Store the weights as a table, one row a slot."""
        rows = [(i, float(d), float(r)) for i, (d, r) in enumerate(zip(self.direction, self.returns))]
        write_table(spark.createDataFrame(rows, "slot int, direction double, returns double").coalesce(1), path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> JointModel:
        """Stored weights; a missing table raises."""
        rows = read_table(spark, path).orderBy("slot").collect()
        return JointModel(*(np.array([r[c] for r in rows]) for c in ("direction", "returns")))


def sums(
    x: np.ndarray, up: np.ndarray, gain: np.ndarray, state: JointModel, ahead: JointModel
) -> np.ndarray:
    """Rows, losses of ``state``, squared norms, and the gradients of both heads at ``ahead``, summed."""
    x = np.column_stack([x, np.ones(len(x))])
    z = x @ state.direction
    rise, fall = (np.maximum(-np.logaddexp(0, -s), LOG_FLOOR) for s in (z, -z))
    head = [
        len(x), -(up * rise + (1 - up) * fall).sum(), ((x @ state.returns - gain) ** 2).sum(), (x * x).sum(),
    ]
    odds = np.exp(-np.logaddexp(0, -(x @ ahead.direction)))
    return np.concatenate([head, x.T @ (odds - up), 2 * x.T @ (x @ ahead.returns - gain)])


def _pass(rows: DataFrame, state: JointModel, ahead: JointModel) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the training and over the validation samples, in one job."""
    size = _NUMBERS + 2 * len(state.direction)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((2, size))
        for batch in batches:
            for part in (0, 1):
                some = batch[batch["held"] == bool(part)]
                if len(some):
                    totals[part] += sums(
                        np.stack(some["x"]), some["up"].to_numpy(), some["gain"].to_numpy(), state, ahead
                    )
        yield pd.DataFrame({"slot": np.arange(2 * size, dtype=np.int32), "total": totals.ravel()})

    found = np.zeros(2 * size)
    for r in rows.mapInPandas(task, _SUMS).groupBy("slot").agg(F.sum("total").alias("total")).collect():
        found[r["slot"]] = r["total"]
    return found[:size], found[size:]


def fit(
    train: DataFrame, validation: DataFrame, iterations: int = 50, patience: int = 10,
    settings: Settings = DEFAULTS,
) -> tuple[JointModel, DataFrame]:
    """Fit on ``train`` and return the state of least validation loss, and the losses of all states.

    Samples have ``features`` (vector), ``target_direction``, ``target_return``; those without targets are
    left out. The loss table has ``iteration`` (0: all weights zero), the training and validation total, the
    two parts of the validation loss, and ``chosen``, true for the earliest least validation loss.
    Fitting ends after ``iterations``, or once ``patience`` states in a row were no better. No training or no
    validation sample raises.
    """
    def part(rows: DataFrame, held: bool) -> DataFrame:
        return rows.filter(F.col("target_return").isNotNull() & F.col("target_direction").isNotNull()).select(
            vector_to_array("features").alias("x"), F.col("target_direction").cast("double").alias("up"),
            F.col("target_return").cast("double").alias("gain"), F.lit(held).alias("held"),
        )

    rows = written(part(train, False).unionByName(part(validation, True)), "joint-samples")
    first = rows.select(F.size("x")).first()
    if first is None:
        raise ValueError("no samples to fit on")
    width, a = first[0] + 1, settings.direction_loss_weight
    state = before = JointModel(np.zeros(width), np.zeros(width))
    states, losses = [], []
    for iteration in range(iterations + 1):
        push = max(0, iteration - 1) / (iteration + 2)
        ahead = JointModel(*(
            w + push * (w - b) for w, b in
            ((state.direction, before.direction), (state.returns, before.returns))
        ))
        own, held = _pass(rows, state, ahead)
        if not own[_COUNT] or not held[_COUNT]:
            raise ValueError("training and validation samples are both needed")
        (up, gain), (held_up, held_gain) = (
            (s[_DIRECTION] / s[_COUNT], s[_RETURN] / s[_COUNT]) for s in (own, held)
        )
        states.append(state)
        losses.append((
            iteration, float(a * up + (1 - a) * gain), float(held_up), float(held_gain),
            float(a * held_up + (1 - a) * held_gain),
        ))
        best = min(range(len(losses)), key=lambda i: losses[i][4])
        if iteration - best >= patience:
            break
        # The curvature of a head is at most the mean squared norm, times 1/4 and 2.
        slopes = own[_NUMBERS:].reshape(2, width) / own[_NORM]
        before, state = state, JointModel(
            ahead.direction - 4 * slopes[0], ahead.returns - slopes[1] / 2
        )
    table = train.sparkSession.createDataFrame(
        [(*row, i == best) for i, row in enumerate(losses)],
        "iteration int, train_loss double, direction_loss double, return_loss double, "
        "total_loss double, chosen boolean",
    )
    return states[best], table
