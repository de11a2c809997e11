"""Loss, alignment and gradients against all paths of short lines, and training of a worn layer."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.operators import alignment
from folioworks.plans import training_queries as Q

BLANK, CODES = 2, 3


def reads(path):
    return [c for c, _ in itertools.groupby(path) if c != BLANK]


def paths(frames, label):
    for path in itertools.product(range(CODES), repeat=len(frames)):
        if reads(path) == label:
            yield path, math.prod(f[c] for f, c in zip(frames, path))


@pytest.fixture(scope="module")
def short(spark):
    rnd = np.random.RandomState(5)
    made, labels = [], [[], [0], [1], [0, 0], [0, 1], [1, 1, 1], [0, 1, 0], [1, 0, 0, 1]]
    for i, label in enumerate(labels):
        for j in range(4):
            f = rnd.rand(j + 2, CODES) + 0.05
            made.append((i * 10 + j, (f / f.sum(1, keepdims=True)).tolist(), label))
    probs = spark.createDataFrame([(i, t, f) for i, frames, _ in made for t, f in enumerate(frames)], "line_id long, t int, features array<double>")
    want = spark.createDataFrame([(i, label) for i, _, label in made], "line_id long, label array<int>")
    return made, alignment.framed(probs.repartition(5), want, BLANK)


def test_loss_sums_all_paths(short):
    made, lines = short
    got = {r.line_id: r.loss for r in alignment.ctc_loss(lines, BLANK).collect()}
    for i, frames, label in made:
        total = sum(p for _, p in paths(frames, label))
        assert got[i] == (pytest.approx(-math.log(total), abs=1e-9) if total else math.inf)


def test_alignment_is_the_likeliest_path(short):
    made, lines = short
    got, spans = {}, {}
    path = alignment.align(lines, BLANK)
    for r in path.orderBy("line_id", "t").collect():
        got.setdefault(r.line_id, []).append(r.code)
    for r in alignment.spans(path).orderBy("line_id", "idx").collect():
        spans.setdefault(r.line_id, []).append((r.code, r.start, r.end))
    for i, frames, label in made:
        best = max(paths(frames, label), key=lambda x: x[1], default=None)
        assert got.get(i) == (list(best[0]) if best else None)
        if best:
            assert [c for c, _, _ in spans.get(i, [])] == label and all(got[i][t] == c for c, a, b in spans.get(i, []) for t in range(a, b))


def test_occupancy_counts_all_paths(short):
    made, lines = short
    got = {(r.line_id, r.t, r.code): r.p for r in alignment.occupancy(lines, BLANK).collect()}
    for i, frames, label in made:
        each = list(paths(frames, label))
        total = sum(p for _, p in each)
        for t in range(len(frames)):
            for c in range(CODES):
                want = sum(p for path, p in each if path[t] == c) / total if total else 0
                assert got.get((i, t, c), 0) == pytest.approx(want, abs=1e-9)


def training_rows(spark, n, seed):
    rnd = random.Random(seed)
    rows = [(i, t, [rnd.random() for _ in range(8)]) for i in range(n) for t in range(rnd.randint(4, 9))]
    return spark.createDataFrame(rows, "line_id long, t int, features array<double>")


def test_gradient_equals_finite_differences(spark):
    rows = training_rows(spark, 6, 1)
    labels = Q.greedy_labels(alignment.scored(rows, Q.TRUE_LAYER))
    layer = [[2.0 * (i == j) + 0.1 * ((i * 3 + j) % 5) for j in range(9)] for i in range(8)]
    slope, loss, n = alignment.gradient(rows, labels, layer, 7)
    assert n == 6 and loss / n == pytest.approx(alignment.mean_loss(rows, labels, layer, 7), abs=1e-8)
    for i, j in ((3, 5), (7, 8)):
        moved = []
        for e in (1e-4, -1e-4):
            other = [list(r) for r in layer]
            other[i][j] += e
            moved.append(alignment.mean_loss(rows, labels, other, 7) * n)
        assert slope[i][j] == pytest.approx((moved[0] - moved[1]) / 2e-4, abs=1e-4)


def test_training_mends_a_worn_layer_whatever_the_partitions(spark):
    rows = training_rows(spark, 40, 2)
    labels = Q.greedy_labels(alignment.scored(rows, Q.TRUE_LAYER))
    held = F.col("line_id") % 4 == 2
    layer, report = alignment.fine_tune(rows.repartition(1), labels, Q.WORN_LAYER, 7, held, 3, 0.2)
    assert report[-1]["held_loss"] < report[0]["held_loss"] and report[-1]["train_loss"] < report[0]["train_loss"]
    assert report[-1]["held_edits"] < report[0]["held_edits"]
    # other partitions, and other labels of the held-out lines, give the same layer
    wrong = labels.withColumn("label", F.when(held, F.array(F.lit(1).cast("int"))).otherwise(F.col("label")))
    again, other = alignment.fine_tune(rows.repartition(7), wrong.repartition(3), Q.WORN_LAYER, 7, held, 3, 0.2)
    assert layer == again and [r["train_loss"] for r in report] == [r["train_loss"] for r in other] and report[0]["held_loss"] != other[0]["held_loss"]


def test_training_without_lines(spark):
    rows = training_rows(spark, 2, 3).where("false")
    labels = spark.createDataFrame([], "line_id long, label array<int>")
    layer, report = alignment.fine_tune(rows, labels, Q.WORN_LAYER, 7, F.lit(False), 1)
    assert layer == Q.WORN_LAYER and [r["train_loss"] for r in report] == [0, 0]


def test_codes_as_letters(spark):
    r = spark.createDataFrame([("3 0 12",), ("",)], "x string").select(alignment.code_letters("x").alias("x")).collect()
    assert [len(x.x) for x in r] == [3, 0] and r[0].x[0] != r[0].x[1]
