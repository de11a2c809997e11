"""Queries of recurrent and integer layers. Registered in the catalog's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tensor
from ..operators import recurrent
from . import adapters as A
from .catalog import _WEIGHT_SQL, PIX, _gates, _tensor_rows, _tensors, _weights, query

SIZE = 4


def planes(s: SparkSession, d: str) -> DataFrame:
    """Tiles as tensors of one feature from -1 to 1."""
    # Spark divides in double precision
    value = (F.col("v") / F.lit(127.5)).cast("float") - F.lit(1).cast("float")
    return A.pixels(s, d).select(F.col("image_id").alias("line_id"), "y", "x", F.array(value.cast("float").cast("double")).alias("features"))


def _lookup(v: str, f: str) -> str:
    at = f"(abs({v}) * 256)"
    low, high = f.format(x=f"(floor({at}) / 256)"), f.format(x=f"((floor({at}) + 1) / 256)")
    return f"(CASE WHEN {at} >= 4095 THEN 1 ELSE {low} + ({high} - {low}) * ({at} - floor({at})) END)"


def _tanh(v: str) -> str:
    return f"(sign({v}) * {_lookup(v, 'tanh({x})')})"


def _logistic(v: str) -> str:
    plain = _lookup(v, "(1 / (1 + exp(-{x})))")
    return f"(CASE WHEN {v} < 0 THEN 1 - {plain} ELSE {plain} END)"


def _lstm_sql(last: bool) -> str:
    """A step in three parts: sums of the gates, their activations, states and outputs."""
    gates = [[[float(v) for v in r] for r in g] for g in _gates(1, SIZE)]
    dots = []
    for g in gates:
        dots.append("[" + ", ".join(f"f.v * {r[0]!r}::DOUBLE + " + " + ".join(f"a.o[{j + 1}]::FLOAT::DOUBLE * {r[1 + j]!r}::DOUBLE" for j in range(SIZE)) + f" + {r[-1]!r}::DOUBLE" for r in g) + "]")
    sums = f"SELECT a.image_id, a.y, a.x + 1 AS x, a.s, {', '.join(f'{d} AS g{k}' for k, d in enumerate(dots))} FROM cells a JOIN inputs f ON f.image_id = a.image_id AND f.y = a.y AND f.x = a.x + 1"
    act = f"SELECT image_id, y, x, s, [{_tanh('v')} FOR v IN g0] AS c, " + ", ".join(f"[{_logistic('v')} FOR v IN g{k}] AS h{k}" for k in (1, 2, 3)) + f" FROM ({sums})"
    state = f"SELECT image_id, y, x, [least(100.0, greatest(-100.0, s[i] * h2[i] + c[i] * h1[i])) FOR i IN range(1, {SIZE + 1})] AS s, h3 FROM ({act})"
    step = f"SELECT image_id, y, x, s, [{_tanh('s[i]')} * h3[i] FOR i IN range(1, {SIZE + 1})] AS o FROM ({state})"
    zeros = "[" + ", ".join(["0.0::DOUBLE"] * SIZE) + "]"
    out = "0 AS x" if last else "x"
    return f"""{PIX.replace("WITH ", "WITH RECURSIVE ", 1)}, inputs AS MATERIALIZED (SELECT image_id, y, x, (v::FLOAT / 127.5::FLOAT - 1::FLOAT)::DOUBLE AS v FROM pixels),
    cells(image_id, y, x, s, o) AS (SELECT DISTINCT image_id, y, -1, {zeros}, {zeros} FROM inputs UNION ALL {step})
    SELECT image_id, y, {out}, (i - 1)::INT AS feature, round(o[i]::FLOAT::DOUBLE, 5) + 0.0 AS value FROM cells, range(1, {SIZE + 1}) AS r(i) WHERE {"x = 63" if last else "x >= 0"}"""


def _features(df: DataFrame) -> DataFrame:
    flat = df.select(F.col("line_id").alias("image_id"), "y", "x", F.posexplode("features").alias("feature", "value"))
    return flat.withColumn("value", F.round(F.col("value").cast("double"), 5) + F.lit(0.0))


def _kernel(summary: bool):
    """Tiles as whole arrays, rows of a tile side by side: the quick form."""
    run = _tensor_rows(lambda x: tensor.lstm(x, _gates(1, SIZE), summary))
    return lambda s, d: run(s, d).withColumn("value", F.round("value", 5) + F.lit(0.0))


def _fold(summary: bool):
    return lambda s, d: _features(recurrent.lstm(planes(s, d), recurrent.gate_table(s, _gates(1, SIZE)), SIZE, summary))


for _summary, _name in ((False, "nn_lstm"), (True, "nn_lstm_summary")):
    query(_name, _lstm_sql(_summary))(_kernel(_summary))
    query(f"{_name}_fold", _lstm_sql(_summary))(_fold(_summary))


def gates_2d(n: int, size: int) -> list[np.ndarray]:
    rnd = np.random.RandomState(5)
    return [rnd.uniform(-1, 1, (size, n + 2 * size + 1)) for _ in recurrent.GATES]


@query("nn_lstm_2d")
def _(s, d):
    return _features(recurrent.lstm_2d(planes(s, d), recurrent.gate_table(s, gates_2d(1, 2)), 2))


_STEPS = f"""x AS (SELECT line_id, t, i - 1 AS c, CAST(embedding[i] AS DOUBLE) AS v FROM logits, range(1, 65) AS q(i)),
    xs AS (SELECT *, max(abs(v)) OVER (PARTITION BY line_id, t) / 127 AS s FROM x), xq AS (SELECT line_id, t, c, s, CASE WHEN s > 0 THEN round(v / s) ELSE 0 END::BIGINT AS q FROM xs),
    w AS (SELECT r, c, {_WEIGHT_SQL.format(c="c")} AS v FROM range(0, 3) AS o(r), range(0, 64) AS p(c)), ws AS (SELECT *, max(abs(v)) OVER (PARTITION BY r) / 127 AS s FROM w), wq AS (SELECT r, c, s, round(v / s)::BIGINT AS q FROM ws)"""


@query("nn_int8", f"WITH {A.LOGITS}, {_STEPS} SELECT line_id, t, r::INT AS r, sum(xq.q * wq.q)::BIGINT AS dot, round(sum(xq.q * wq.q) * any_value(wq.s) * any_value(xq.s) + {_WEIGHT_SQL.format(c='64')}, 6) + 0.0 AS v FROM xq JOIN wq USING (c) GROUP BY line_id, t, r")
def _(s, d):
    """Every timestep of the logits through a matrix of 8-bit steps."""
    out = recurrent.integer_layer(_tensors(s, d), recurrent.quantised(_weights(s)))
    each = out.select("line_id", F.col("x").alias("t"), F.posexplode(F.arrays_zip("dots", "features")).alias("r", "v"))
    return each.select("line_id", "t", "r", F.col("v.dots").alias("dot"), (F.round("v.features", 6) + F.lit(0.0)).alias("v"))
