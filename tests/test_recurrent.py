"""Folds against the equations, integer layers within their bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.functions import tensor
from folioworks.operators import decode, recurrent


def rows(spark, x, line=0):
    return spark.createDataFrame([(line, y, i, x[y, i].tolist()) for y in range(x.shape[0]) for i in range(x.shape[1])], "line_id long, y int, x int, features array<double>")


def dense(df, line=0):
    got = {(r.y, r.x): r.features for r in df.where(f"line_id = {line}").collect()}
    h, w = max(y for y, _ in got) + 1, max(x for _, x in got) + 1
    return np.array([[got[y, x] for x in range(w)] for y in range(h)])


def test_lstm_equals_the_kernel(spark):
    rnd = np.random.RandomState(1)
    gates = [rnd.uniform(-2, 2, (3, 2 + 3 + 1)) for _ in range(4)]
    x, z = rnd.uniform(-3, 3, (4, 9, 2)).astype(np.float32), rnd.uniform(-30, 30, (1, 5, 2)).astype(np.float32)
    both = rows(spark, x).unionByName(rows(spark, z, 7)).repartition(3)
    table = recurrent.gate_table(spark, gates)
    for summary in (False, True):
        out = recurrent.lstm(both, table, 3, summary)
        assert np.allclose(dense(out), tensor.lstm(x, gates, summary), atol=1e-6) and np.allclose(dense(out, 7), tensor.lstm(z, gates, summary), atol=1e-6)
    assert recurrent.lstm(both.where("false"), table, 3).count() == 0


def test_sequences_advance_together(spark, monkeypatch):
    """One array operation a step for all sequences of a length, in groups of bounded size; no fold of lambdas by place."""
    rnd = np.random.RandomState(4)
    gates = [rnd.uniform(-1, 1, (2, 1 + 2 + 1)) for _ in range(4)]
    x = rnd.uniform(-1, 1, (6, 11, 1)).astype(np.float32)
    monkeypatch.setattr(recurrent, "CELLS", 300)
    out = recurrent.lstm(rows(spark, x[:4]).unionByName(rows(spark, x[:, :7], 3)), recurrent.gate_table(spark, gates), 2)
    assert np.allclose(dense(out), tensor.lstm(x[:4], gates), atol=1e-6) and np.allclose(dense(out, 3), tensor.lstm(x[:, :7], gates), atol=1e-6)
    flat = recurrent.lstm_2d(rows(spark, x), recurrent.gate_table(spark, [rnd.uniform(-1, 1, (2, 6)) for _ in recurrent.GATES]), 2)
    for df in (out, flat):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_states_are_clipped(spark):
    gates = [np.array([[9.0, 0.0, 9.0]])] * 4
    x = np.ones((1, 130, 1), np.float32)
    assert np.allclose(dense(recurrent.lstm(rows(spark, x), recurrent.gate_table(spark, gates), 1)), tensor.lstm(x, gates), atol=1e-6)


def plain_2d(x, gates, size):
    """The equations, place by place."""
    h, w, _ = x.shape
    state, out = np.zeros((h + 1, w + 1, size)), np.zeros((h + 1, w + 1, size))
    for i in range(h):
        for j in range(w):
            source = np.concatenate((x[i, j], out[i + 1, j].astype(np.float32), out[i, j + 1].astype(np.float32)))
            cell, into, keep, show, above = (tensor.affine(g, source) for g in gates)
            s = state[i + 1, j] * tensor.logistic(keep) + state[i, j + 1] * tensor.logistic(above) + tensor.tanh(cell) * tensor.logistic(into)
            state[i + 1, j + 1] = np.clip(s, -tensor.STATE_LIMIT, tensor.STATE_LIMIT)
            out[i + 1, j + 1] = tensor.tanh(state[i + 1, j + 1]) * tensor.logistic(show)
    return out[1:, 1:]


@pytest.mark.parametrize("shape", [(5, 7, 2), (6, 3, 1), (1, 4, 2), (4, 1, 1)])
def test_lstm_in_two_dimensions(spark, shape):
    rnd = np.random.RandomState(2)
    x, size = rnd.uniform(-2, 2, shape).astype(np.float32), 2
    gates = [rnd.uniform(-1, 1, (size, shape[2] + 2 * size + 1)) for _ in recurrent.GATES]
    got = dense(recurrent.lstm_2d(rows(spark, x).repartition(3), recurrent.gate_table(spark, gates), size))
    assert got.shape == (*shape[:2], size) and np.allclose(got, plain_2d(x, gates, size), atol=1e-6)


def test_integer_layers_stay_within_their_bound(spark):
    rnd = np.random.RandomState(3)
    w = rnd.normal(0, 1, (5, 9))
    w[1, :-1] = 0
    x = rnd.normal(0, 1, (3, 20, 8))
    x[0, 0] = 0
    x[2] *= 1e6
    weights = spark.createDataFrame([(w.tolist(),)], "w array<array<double>>")
    out = recurrent.integer_layer(rows(spark, x), recurrent.quantised(weights)).collect()
    assert len(out) == 60
    for r in out:
        want = tensor.affine(w, x[r.y, r.x])
        assert (np.abs(np.array(r.features) - want) <= np.array(r.bound) + 1e-9 * np.abs(want)).all()
        xs, ws = np.abs(x[r.y, r.x]).max() / 127, np.abs(w[:, :-1]).max(1) / 127
        half = lambda v: np.sign(v) * np.floor(np.abs(v) + 0.5)
        q = half(x[r.y, r.x] / xs) if xs else np.zeros(8)
        assert r.dots == [int((half(row / s) if s else row * 0) @ q) for row, s in zip(w[:, :-1], ws)]
    # softmax through 8-bit steps: scores off by e at most move a probability by a factor of exp(2 e)
    soft = recurrent.integer_layer(rows(spark, x[:2]), recurrent.quantised(weights)).select("y", "x", "bound", decode.softmax(F.col("features")).alias("p")).collect()
    for r in soft:
        want = tensor.softmax(tensor.affine(w, x[r.y, r.x]))
        assert (np.abs(np.log(np.array(r.p)) - np.log(want)) <= 2 * max(r.bound) + 1e-9).all()
