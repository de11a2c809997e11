"""CTC loss, forced alignment and training of the output layer, as folds over a line's timesteps.

A line is one row: its frames in order of time, and its label's states, the label with blanks
around every code. Paths stay in a state, go on to the next, or skip a blank between two
different codes. Forward and backward sums are one fold, run over a line and over its mirror
image; the fold is of array functions, so nothing leaves the JVM. Lines are a text line's length,
a corpus of any number of them splits by line. Gradients are summed over lines as whole
numbers of 2^-32, so a result depends neither on partitions nor on their order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut
from . import decode, layers
from .decode import let

NEVER = float("-inf")
#: Least probability of a code at a timestep, so that logarithms are finite.
LEAST = 1e-300
#: Gradients and losses are summed in units of 2^-32; decimals of 38 digits hold sums of 10^18 lines.
UNIT = 1 << 32


def states(label: Column, blank: int) -> Column:
    """The codes of a label's states: blank, code, blank, ..., code, blank."""
    pairs = F.flatten(F.transform(label, lambda c: F.array(F.lit(blank).cast("int"), c.cast("int"))))
    return F.concat(pairs, F.array(F.lit(blank).cast("int")))


def framed(probs: DataFrame, labels: DataFrame, blank: int) -> DataFrame:
    """(line_id, frames, states) of probs(line_id, t, features) and labels(line_id, label); lines without a label are left out."""
    inner = F.transform(F.array_sort(F.collect_list(F.struct("t", "features"))), lambda s: s["features"].cast("array<double>"))
    return probs.groupBy("line_id").agg(inner.alias("frames")).join(labels.select("line_id", states(F.col("label"), blank).alias("states")), "line_id")


def emission(frame: Column, code: Column) -> Column:
    return F.ln(F.greatest(F.get(frame, code), F.lit(LEAST)))


def sources(at: Column, names: Column, s: Column, blank: int) -> Column:
    """What a state can be reached from: values of ``at`` for staying, for going on, for skipping a blank."""
    never = lambda v: F.coalesce(v, F.lit(NEVER))
    own = F.get(names, s)
    skips = (own != blank) & (F.coalesce(F.get(names, s - 2), F.lit(blank)) != own)
    return F.array(F.get(at, s), never(F.get(at, s - 1)), F.when(skips, never(F.get(at, s - 2))).otherwise(NEVER))


def log_sum(values: Column) -> Column:
    """Logarithm of the sum of an array's exponentials."""
    whole = lambda x, m: m + F.ln(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - m)))
    return let(values, lambda x: let(F.array_max(x), lambda m: F.when(m == NEVER, NEVER).otherwise(whole(x, m))))


def start(names: Column) -> Column:
    """Before the first frame a path is at the first state; from there it stays or goes on, as it should begin."""
    return F.transform(names, lambda c, s: F.when(s == 0, 0.0).otherwise(NEVER))


def forward(frames: Column, names: Column, blank: int) -> Column:
    """By timestep, by state: log probability of all paths up to it, its own emission included."""
    step = lambda at, frame: F.transform(names, lambda c, s: emission(frame, c) + log_sum(sources(at, names, s, blank)))
    grown = F.aggregate(frames, F.array(start(names)), lambda so_far, frame: F.concat(so_far, F.array(step(F.element_at(so_far, -1), frame))))
    return F.slice(grown, F.lit(2), F.size(frames))


def likelihood(ends: Column, names: Column) -> Column:
    """Log probability of a label from the last timestep's sums: paths end in the last code or the blank behind it."""
    last = F.size(names) - 1
    return log_sum(F.array(F.get(ends, last), F.coalesce(F.get(ends, last - 1), F.lit(NEVER))))


def ctc_loss(lines: DataFrame, blank: int) -> DataFrame:
    """(line_id, loss): minus the log probability of all paths that read as the label; infinite if the line is too short."""
    step = lambda at, frame: F.transform("states", lambda c, s: emission(frame, c) + log_sum(sources(at, F.col("states"), s, blank)))
    ends = F.aggregate("frames", start(F.col("states")), step)
    return lines.select("line_id", (-likelihood(ends, F.col("states"))).alias("loss"))


def with_paths(lines: DataFrame, blank: int) -> DataFrame:
    """lines with ahead and back, log sums of the paths to and from each state at each timestep, and whole, of all paths; lines too short for their label go."""
    back = F.transform(F.reverse(forward(F.reverse("frames"), F.reverse("states"), blank)), lambda v: F.reverse(v))
    both = F.struct(forward(F.col("frames"), F.col("states"), blank).alias("ahead"), back.alias("back"))
    # an explode of one struct keeps the folds from being run once for each use
    both = lines.withColumn("both", F.explode(F.array(both))).select(*lines.columns, "both.*")
    return both.withColumn("whole", likelihood(F.element_at("ahead", -1), F.col("states"))).where(F.col("whole") > NEVER)


def shares(at: Column, names: Column, total: Column) -> Column:
    """By state, its code and the share of all paths that are in it at a timestep; at has frames, ahead and back."""
    share = lambda c, s: F.exp(F.get(at["ahead"], s) + F.get(at["back"], s) - emission(at["frames"], c) - total)
    return F.transform(names, lambda c, s: F.struct(c.alias("code"), share(c, s).alias("v")))


def occupancy(lines: DataFrame, blank: int) -> DataFrame:
    """(line_id, t, code, p): share of a label's paths that are in a state of the code at t; lines too short for their label have no rows."""
    each = with_paths(lines, blank).select("line_id", "states", "whole", F.posexplode(F.arrays_zip("frames", "ahead", "back")).alias("t", "at"))
    each = each.select("line_id", "t", F.explode(shares(F.col("at"), F.col("states"), F.col("whole"))).alias("s"))
    return each.groupBy("line_id", "t", "s.code").agg(F.sum("s.v").alias("p"))


def align(lines: DataFrame, blank: int) -> DataFrame:
    """(line_id, t, state, code) of the likeliest path that reads as the label; of equals, staying goes before going on before skipping.

    The fold keeps the best value and the way there of every state and timestep, then the
    ways are followed from the end. Lines too short for their label have no rows.
    """
    names = F.col("states")
    best = lambda frame, c, x: let(F.array_max(x), lambda m: F.struct((emission(frame, c) + m).alias("v"), (F.array_position(x, m) - 1).cast("int").alias("way")))
    step = lambda at, frame: F.transform(names, lambda c, s: let(sources(at, names, s, blank), lambda x: best(frame, c, x)))
    first = F.transform(start(names), lambda v: F.struct(v.alias("v"), F.lit(0).alias("way")))
    values = lambda so_far: F.transform(F.element_at(so_far, -1), lambda c: c["v"])
    grown = lines.withColumn("grown", F.aggregate("frames", F.array(first), lambda so_far, frame: F.concat(so_far, F.array(step(values(so_far), frame)))))
    last, n = values(F.col("grown")), F.size(names)
    before = F.coalesce(F.get(last, n - 2), F.lit(NEVER))
    ended = grown.where(F.greatest(F.get(last, n - 1), before) > NEVER).withColumn("end", n - 1 - (before > F.get(last, n - 1)).cast("int"))
    # from the last frame to the first: the state at each, by the way into the state behind it
    ways = F.slice(F.reverse("grown"), F.lit(1), F.size("frames") - 1)
    back = F.aggregate(ways, F.array(F.col("end")), lambda path, at: F.concat(path, F.array(F.element_at(path, -1) - F.get(at, F.element_at(path, -1))["way"])))
    each = ended.select("line_id", "states", F.posexplode(F.reverse(back)).alias("t", "state"))
    return each.select("line_id", "t", "state", F.get("states", F.col("state")).alias("code"))


def spans(path: DataFrame) -> DataFrame:
    """(line_id, idx, code, start, end) of a label's codes in an alignment; odd states are codes."""
    codes = path.where(F.col("state") % 2 == 1).groupBy("line_id", F.floor(F.col("state") / 2).cast("int").alias("idx"), "code")
    return codes.agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"))


# -- training the output layer ------------------------------------------------


def layer(weights: list[list[float]]) -> Column:
    """A matrix as a column, rows with the bias last; as small as the model's output layer."""
    return F.array(*(F.array(*map(F.lit, map(float, row))) for row in weights))


def scored(rows: DataFrame, weights: list[list[float]]) -> DataFrame:
    """probs of rows(line_id, t, features): the layer's softmax."""
    return rows.select("line_id", "t", decode.softmax(layers.affine(F.col("features"), layer(weights))).alias("features"))


def whole(v: Column) -> Column:
    return F.sum(F.round(v * UNIT).cast("decimal(30,0)"))


def gradient(rows: DataFrame, labels: DataFrame, weights: list[list[float]], blank: int) -> tuple[list[list[float]], float, int]:
    """(gradient of the summed loss by weights, the summed loss, number of lines) over all lines that their label fits.

    At a timestep the loss grows with a code's score by its probability less its share of the
    label's paths; that times the features, summed by Spark, is the gradient. The loss and the
    number of lines are summed beside it. Only these sums reach the driver.
    """
    y = decode.softmax(layers.affine(F.col("features"), layer(weights)))
    inputs = F.concat(F.col("features").cast("array<double>"), F.array(F.lit(1.0)))
    each = rows.select("line_id", F.struct("t", y.alias("y"), inputs.alias("x")).alias("f"))
    lines = each.groupBy("line_id").agg(F.array_sort(F.collect_list("f")).alias("f")).join(labels.select("line_id", states(F.col("label"), blank).alias("states")), "line_id")
    lines = lines.select("states", F.transform("f", lambda f: f["y"]).alias("frames"), F.transform("f", lambda f: f["x"]).alias("inputs"))
    both = with_paths(lines, blank).select("states", "whole", F.posexplode(F.arrays_zip("frames", "ahead", "back", "inputs")).alias("t", "at"))
    pair = lambda code, v: F.struct(code.cast("int").alias("code"), v.alias("v"))
    paths = F.transform(shares(F.col("at"), F.col("states"), F.col("whole")), lambda s: pair(s["code"], -s["v"]))
    # codes -1 and -2, with the last input alone, stand for the loss and the line
    own = F.when(F.col("t") == 0, F.array(pair(F.lit(-1), -F.col("whole")), pair(F.lit(-2), F.lit(1.0)))).otherwise(F.array().cast("array<struct<code:int,v:double>>"))
    parts = F.concat(F.transform(F.col("at.frames"), lambda v, k: pair(k, v)), paths, own)
    flat = both.select("at.inputs", F.explode(parts).alias("p")).select("p.*", F.posexplode("inputs").alias("j", "x"))
    last = len(weights[0]) - 1
    sums = flat.where(f"code >= 0 or j = {last}").groupBy("code", "j").agg(whole(F.col("v") * F.col("x")).alias("g")).collect()
    found = {(r.code, r.j): int(r.g) / UNIT for r in sums}
    return [[found.get((k, j), 0.0) for j in range(last + 1)] for k in range(len(weights))], found.get((-1, last), 0.0), round(found.get((-2, last), 0.0))


def mean_loss(rows: DataFrame, labels: DataFrame, weights: list[list[float]], blank: int) -> float:
    got = ctc_loss(framed(scored(rows, weights), labels, blank), blank).where(F.col("loss") < float("inf"))
    r = got.agg(whole(F.col("loss")).alias("loss"), F.count("*").alias("n")).first()
    return int(r.loss or 0) / UNIT / max(r.n, 1)


def misread(rows: DataFrame, labels: DataFrame, weights: list[list[float]], blank: int) -> tuple[int, int]:
    """(edits, codes): edit distance of best paths to labels, and the labels' length, over all lines."""
    read = decode.greedy(scored(rows, weights), blank)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "code"))), lambda s: s["code"].cast("string")), " ")
    read = read.groupBy("line_id").agg(text.alias("read"))
    want = labels.select("line_id", "label", F.array_join("label", " ").alias("want"))
    both = want.join(read, "line_id", "left").fillna("", ["read"])
    return both.agg(F.sum(F.levenshtein(code_letters("read"), code_letters("want"))), F.sum(F.size("label"))).first()[:]


def code_letters(column: str) -> Column:
    """One letter for each code of a text of numbers, so that edit distances count codes."""
    codes = F.filter(F.split(column, " "), lambda c: c != "")
    return F.array_join(F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(F.hex(c.cast("int") + 0x4E00), 4, "0")), "UTF-16BE")), "")


#: Shares of the old means in Adam's running means of slopes and of their squares.
MEAN, SQUARE = 0.9, 0.99


def fine_tune(rows: DataFrame, labels: DataFrame, weights: list[list[float]], blank: int, held: Column, steps: int = 8, rate: float = 1.0) -> tuple[list[list[float]], list[dict]]:
    """The output layer after steps by Adam's rule on the lines that ``held`` (of line_id) is false for, and a report.

    rate is about how far a weight moves in a step. The report has the mean losses of trained
    and of held-out lines, and the held-out lines' misreadings, before the first step and after each.
    """
    mine = cut(rows.withColumn("held", held))
    known = cut(labels.withColumn("held", held))
    split = lambda df, is_held: df.where(F.col("held") == is_held).drop("held")
    w = np.array(weights)
    mean, square, report = np.zeros_like(w), np.zeros_like(w), []
    for step in range(steps + 1):
        slope, loss, n = gradient(split(mine, False), split(known, False), w.tolist(), blank)
        edits, codes = misread(split(mine, True), split(known, True), w.tolist(), blank)
        report.append({"step": step, "train_loss": loss / max(n, 1), "held_loss": mean_loss(split(mine, True), split(known, True), w.tolist(), blank), "held_edits": edits or 0, "held_codes": codes or 0})
        if step < steps and n:
            g = np.array(slope) / n
            mean, square = MEAN * mean + (1 - MEAN) * g, SQUARE * square + (1 - SQUARE) * g * g
            w = w - rate * (mean / (1 - MEAN ** (step + 1))) / (np.sqrt(square / (1 - SQUARE ** (step + 1))) + 1e-8)
    return w.tolist(), report
