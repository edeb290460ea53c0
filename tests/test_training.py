"""Training in steps against a plain run over all rows, with and without a layer; resumed runs; odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cribado.operators import training
from cribado.operators.training import Head, move, predict_trained, train_steps


def data(spark, n=240, width=6, parts=3):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, width))
    y = np.clip(np.rint(2.5 + 1.5 * np.tanh(x @ rng.normal(size=width)) + 0.3 * rng.normal(size=n)), 0, 5)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, features array<double>, label double")
    return x, y, df.repartition(parts, "id")


def macro_f1(y, pred):
    scores = []
    for c in set(y) | set(pred):
        hits = np.sum((y == c) & (pred == c))
        scores.append(2 * hits / (np.sum(y == c) + np.sum(pred == c)))
    return float(np.mean(scores))


def plain(x, y, test_x, test_y, head, steps, every, rate, seed=42):
    weights, m, v, out = head.start(seed), np.zeros(head.size), np.zeros(head.size), []
    for step in range(1, steps + 1):
        loss, slope = head.loss_and_slope(weights, x, y)
        weights, m, v = move(weights, m, v, slope / len(x), step, steps, rate)
        if step % every == 0 or step == steps:
            pred = np.clip(np.rint(head.predict(weights, test_x)), 0, 5)
            out.append((step, loss / len(x), macro_f1(test_y, pred), weights))
    return out


@pytest.mark.parametrize("hidden", [0, 5])
def test_steps_equal_a_plain_run(spark, monkeypatch, hidden):
    monkeypatch.setattr(training, "FAN_IN", 2)  # sums in groups first
    x, y, df = data(spark, parts=5)
    found = train_steps(df.filter("id < 180"), df.filter("id >= 180"), steps=25, every=10, hidden=hidden)
    expected = plain(x[:180], y[:180], x[180:], y[180:], Head(6, hidden), 25, 10, 0.05)
    assert [h["step"] for h in found.history] == [10, 20, 25]
    for mine, (step, loss, f1, _) in zip(found.history, expected):
        assert (mine["loss"], mine["f1_macro"]) == (pytest.approx(loss, abs=1e-9), pytest.approx(f1, abs=1e-12))
    best = max(expected, key=lambda e: (round(e[2], 12), -e[0]))
    assert found.best_step == best[0] and np.allclose(found.weights, best[3], atol=1e-9)
    assert found.history[-1]["loss"] < found.history[0]["loss"]
    scored = {r.id: r.score for r in predict_trained(found, df).collect()}
    assert np.allclose([scored[i] for i in range(240)], found.head.predict(found.weights, x), atol=1e-12)


def test_the_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(5)
    for head in (Head(4), Head(4, 3)):
        weights, x, y = rng.normal(size=head.size), rng.normal(size=(20, 4)), rng.normal(size=20)
        _, slope = head.loss_and_slope(weights, x, y)
        for i in range(head.size):
            step = np.zeros(head.size)
            step[i] = 1e-6
            rise = head.loss_and_slope(weights + step, x, y)[0] - head.loss_and_slope(weights - step, x, y)[0]
            assert slope[i] == pytest.approx(rise / 2e-6, rel=1e-4, abs=1e-4)


def test_a_broken_fit_resumes(spark, tmp_path, monkeypatch):
    _, _, df = data(spark)
    train, test = df.filter("id < 180"), df.filter("id >= 180")
    whole = train_steps(train, test, steps=12, every=3, hidden=2)
    calls = []
    original = training._loss_and_slope

    def breaking(*args):
        calls.append(1)
        if len(calls) == 8:
            raise RuntimeError("lost")
        return original(*args)

    monkeypatch.setattr(training, "_loss_and_slope", breaking)
    with pytest.raises(RuntimeError, match="lost"):
        train_steps(train, test, steps=12, every=3, hidden=2, output=str(tmp_path / "steps"))
    again = train_steps(train, test, steps=12, every=3, hidden=2, output=str(tmp_path / "steps"))
    assert len(calls) == 8 + 6  # steps 7 to 12: those up to 6 were stored
    assert again.history == whole.history and np.array_equal(again.weights, whole.weights)
    calls.clear()
    assert train_steps(train, test, steps=12, every=3, hidden=2, output=str(tmp_path / "steps")).best_step == whole.best_step
    assert not calls


def test_rows_without_features_are_left_out(spark):
    _, _, df = data(spark)
    holes = df.union(spark.createDataFrame([(900, None, 1.0), (901, [1.0] * 6, None)], df.schema))
    one = train_steps(df.filter("id < 180"), df.filter("id >= 180"), steps=2, every=2)
    other = train_steps(holes.filter("id < 180 OR id = 900"), holes.filter("id >= 180"), steps=2, every=2)
    assert one.history[0]["loss"] == pytest.approx(other.history[0]["loss"], abs=1e-9)
    scored = predict_trained(one, holes.filter("id >= 900")).orderBy("id").collect()
    assert scored[0].score is None and scored[1].score is not None
    with pytest.raises(ValueError, match="nothing"):
        train_steps(df.limit(0), df)
    odd = df.union(spark.createDataFrame([(902, [1.0], 1.0)], df.schema))
    with pytest.raises(Exception, match="different lengths|reshape"):
        train_steps(odd, df.filter(F.col("id") >= 180), steps=1)
