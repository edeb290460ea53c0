"""Training in steps: gradients summed over stored features, the best step kept by macro F1, runs that resume.

The head is one linear output, or one dense tanh layer below it, which learns as well. A step is one pass over the training
features: every task sums loss and gradient of its rows, tasks are summed in groups, and FAN_IN rows of the
model's size reach the driver, which moves the weights (Adam, with a rate that falls linearly to nothing). Every few steps
the model is evaluated on the held-out rows and written down with all that the next step needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribado.operators.evaluation import macro_metrics
from cribado.session import materialize
from cribado.sources.files import resolve

#: Sums that reach the driver in a step.
FAN_IN = 32
#: Fixed values of the optimizer.
DECAY_1, DECAY_2, EPSILON = 0.9, 0.999, 1e-8
STATE = "step int, loss double, weights array<double>, first array<double>, second array<double>"
METRICS = ("precision", "recall", "f1_macro", "accuracy")


@dataclass(frozen=True)
class Head:
    """`hidden` units below the output, or none; weights are one flat array."""

    inputs: int
    hidden: int = 0

    @property
    def size(self) -> int:
        return self.hidden * (self.inputs + 2) + 1 if self.hidden else self.inputs + 1

    def start(self, seed: int) -> np.ndarray:
        """Nothing for the output; the layer starts random, as equal units would stay equal."""
        weights = np.zeros(self.size)
        if self.hidden:
            spread = np.random.default_rng(seed).normal(size=self.hidden * self.inputs) / np.sqrt(self.inputs)
            weights[: self.hidden * self.inputs] = spread
            weights[self.hidden * (self.inputs + 1) : -1] = np.random.default_rng(seed + 1).normal(size=self.hidden) / np.sqrt(self.hidden)
        return weights

    def _layers(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = self.hidden * self.inputs
        return weights[:cut].reshape(self.hidden, self.inputs), weights[cut : cut + self.hidden], weights[cut + self.hidden : -1]

    def predict(self, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not self.hidden:
            return x @ weights[:-1] + weights[-1]
        layer, offset, out = self._layers(weights)
        return np.tanh(x @ layer.T + offset) @ out + weights[-1]

    def loss_and_slope(self, weights: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of squared errors, and its gradient."""
        if not self.hidden:
            error = x @ weights[:-1] + weights[-1] - y
            return float(error @ error), 2 * np.append(error @ x, error.sum())
        layer, offset, out = self._layers(weights)
        units = np.tanh(x @ layer.T + offset)
        error = units @ out + weights[-1] - y
        back = error[:, None] * out * (1 - units**2)
        slope = np.concatenate([(back.T @ x).ravel(), back.sum(axis=0), error @ units, [error.sum()]])
        return float(error @ error), 2 * slope


@dataclass
class Trained:
    """The weights of the best step, and a row of metrics per evaluated step."""

    head: Head
    weights: np.ndarray
    history: list[dict] = field(default_factory=list)

    @property
    def best_step(self) -> int:
        return next(h["step"] for h in self.history if h["best"])


def move(weights: np.ndarray, first: np.ndarray, second: np.ndarray, slope: np.ndarray, step: int, steps: int, rate: float):
    """One step of the optimizer; `step` counts from 1."""
    first = DECAY_1 * first + (1 - DECAY_1) * slope
    second = DECAY_2 * second + (1 - DECAY_2) * slope**2
    now = rate * (1 - (step - 1) / steps)
    level = first / (1 - DECAY_1**step)
    return weights - now * level / (np.sqrt(second / (1 - DECAY_2**step)) + EPSILON), first, second


def _matrix(batch: pa.RecordBatch, inputs: int) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column("x")
    if batch.num_rows and pc.max(pc.list_value_length(x)).as_py() != pc.min(pc.list_value_length(x)).as_py():
        raise ValueError("features of different lengths")
    return np.asarray(x.flatten(), np.float64).reshape(batch.num_rows, inputs), np.asarray(batch.column("y"), np.float64)


def _added(table: pa.Table) -> pa.Table:
    table = table.sort_by("part")
    slope = np.array(table.column("slope").to_pylist()).sum(axis=0)
    made = {"part": [table.column("part")[0].as_py()], "loss": [sum(table.column("loss").to_pylist())], "slope": [slope.tolist()]}
    return pa.table(made, schema=pa.schema([("part", pa.int32()), ("loss", pa.float64()), ("slope", pa.list_(pa.float64()))]))


def _loss_and_slope(rows: DataFrame, head: Head, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed over all rows, in an order that does not change from run to run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope = 0.0, np.zeros(head.size)
        for batch in batches:
            one, more = head.loss_and_slope(weights, *_matrix(batch, head.inputs))
            loss, slope = loss + one, slope + more
        columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([loss]), pa.array([slope.tolist()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "loss", "slope"])

    schema = "part int, loss double, slope array<double>"
    sums = rows.mapInArrow(run, schema)
    if rows.rdd.getNumPartitions() > FAN_IN:
        sums = sums.groupBy(F.col("part") % FAN_IN).applyInArrow(lambda table: _added(table), schema)
    found = sorted(sums.collect())
    return sum(r.loss for r in found), np.sum([r.slope for r in found], axis=0)


def _pairs(rows: DataFrame, head: Head, weights: np.ndarray) -> DataFrame:
    """`(y, pred, n)`: rounded labels and predictions, counted in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch, head.inputs)
            pairs = np.stack([np.rint(y), np.clip(np.rint(head.predict(weights, x)), 0, 5)], axis=1).astype(np.int32)
            found, n = np.unique(pairs, axis=0, return_counts=True)
            columns = [pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "pred", "n"])

    return rows.mapInArrow(run, "y int, pred int, n long").groupBy("y", "pred").agg(F.sum("n").alias("n"))


def _stored(rows: DataFrame, features: str, label: str) -> DataFrame:
    kept = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    return materialize(kept.dropna())


def train_steps(
    train: DataFrame,
    test: DataFrame,
    features: str = "features",
    label: str = "label",
    steps: int = 600,
    every: int = 60,
    rate: float = 0.05,
    hidden: int = 0,
    seed: int = 42,
    output: str | None = None,
) -> Trained:
    """Train for `steps` steps, evaluate every `every` and keep the step with the best macro F1 (the first of equals).

    `features` is an array column. Rows without features or label are left out. With `output` each evaluated step is stored there with
    the optimizer's state, and a call that finds such steps goes on from the last; data and settings must be the same.
    """
    spark = train.sparkSession
    train, test = _stored(train, features, label), _stored(test, features, label)
    shape = train.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("inputs")).first()
    if not shape.n or test.isEmpty():
        raise ValueError("nothing to train on, or nothing to evaluate with")
    head = Head(shape.inputs, hidden)
    weights, first, second, done = head.start(seed), np.zeros(head.size), np.zeros(head.size), 0
    history: list[dict] = []
    kept: dict[int, np.ndarray] = {}
    if output:
        filesystem, folder = resolve(output)
        filesystem.create_dir(folder)
        schema = f"{STATE}, {', '.join(f'{m} double' for m in METRICS)}"
        for row in sorted(spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(output).collect()):
            history.append({"step": row.step, "loss": row.loss, **{m: row[m] for m in METRICS}})
            kept[row.step] = np.array(row.weights)
            weights, first, second, done = kept[row.step], np.array(row.first), np.array(row.second), row.step

    for step in range(done + 1, steps + 1):
        loss, slope = _loss_and_slope(train, head, weights)
        weights, first, second = move(weights, first, second, slope / shape.n, step, steps, rate)
        if step % every == 0 or step == steps:
            found = macro_metrics(_pairs(test, head, weights)).first()
            entry = {"step": step, "loss": loss / shape.n, **{m: found[m] for m in METRICS}}
            history.append(entry)
            kept[step] = weights
            if output:
                state = (step, entry["loss"], weights.tolist(), first.tolist(), second.tolist(), *(entry[m] for m in METRICS))
                df = spark.createDataFrame([state], f"{STATE}, {', '.join(f'{m} double' for m in METRICS)}")
                df.coalesce(1).write.mode("overwrite").parquet(f"{output}/step-{step:08d}")
    best = max(history, key=lambda h: (round(h["f1_macro"], 12), -h["step"]))["step"]
    return Trained(head, kept[best], [{**h, "best": h["step"] == best} for h in history])


def predict_trained(trained: Trained, rows: DataFrame, features: str = "features", output: str = "score") -> DataFrame:
    """Add the score of every row; rows without features have none."""
    head, weights = trained.head, trained.weights

    def score(batches):
        for x in batches:
            known = x.notna()
            out = np.full(len(x), np.nan)
            if known.any():
                out[known.to_numpy()] = head.predict(weights, np.stack(x[known].to_list()).astype(np.float64))
            yield pd.Series(out).where(known.to_numpy(), None)

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(output, F.pandas_udf(score, "double")(F.col(features).cast("array<double>")))
