"""Queries of CTC loss, alignment and training. Registered in the catalog's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, decode
from . import adapters as A
from .catalog import BLANK8, query


def greedy_labels(probs: DataFrame) -> DataFrame:
    """(line_id, label): what the best path reads; lines that read nothing have an empty label."""
    codes = F.transform(F.array_sort(F.collect_list(F.struct("idx", "code"))), lambda s: s["code"])
    read = decode.greedy(probs, BLANK8).groupBy("line_id").agg(codes.alias("label"))
    return decode.widths(probs).join(read, "line_id", "left").select("line_id", F.coalesce("label", F.array().cast("array<int>")).alias("label"))


def labelled_lines(s: SparkSession, d: str) -> DataFrame:
    probs = A.probs8(s, d)
    return alignment.framed(probs, greedy_labels(probs), BLANK8)


_NEVER = "'-infinity'::DOUBLE"


def _sources(s: str, v: str) -> str:
    """SQL of the three values a state (from 1 on) is reached from."""
    skip = f"CASE WHEN ext[{s}] <> {BLANK8} AND {s} > 2 AND ext[{s} - 2] <> ext[{s}] THEN {v}[{s} - 2] ELSE {_NEVER} END"
    return f"[{v}[{s}], CASE WHEN {s} > 1 THEN {v}[{s} - 1] ELSE {_NEVER} END, {skip}]"


def _lse(values: str) -> str:
    return f"(SELECT CASE WHEN list_max(q) = {_NEVER} THEN {_NEVER} ELSE list_max(q) + ln(list_sum([exp(z - list_max(q)) FOR z IN q])) END FROM (SELECT {values} AS q))"


_LABELS = f"""WITH RECURSIVE {A.PROBS8}, {A.greedy_sql(BLANK8)},
    labels AS (SELECT line_id, coalesce(list(code ORDER BY idx) FILTER (WHERE code IS NOT NULL), []) AS label FROM (SELECT DISTINCT line_id FROM logits) LEFT JOIN symbols USING (line_id) GROUP BY line_id),
    lines AS MATERIALIZED (SELECT line_id, [{BLANK8}] || flatten([[c, {BLANK8}] FOR c IN label]) AS ext, (SELECT max(t) + 1 FROM score s WHERE s.line_id = labels.line_id) AS width FROM labels),
    frames AS MATERIALIZED (SELECT line_id, t, list(ln(p) ORDER BY code) AS e FROM score GROUP BY line_id, t)"""


def _fold(name: str, ext: str, frame: str) -> str:
    """A recursive table (line_id, t, v): log sums of paths by state; rows of each step one state list."""
    three = _sources("s", "v")
    big = f"list_max({three})"
    lse = f"CASE WHEN {big} = {_NEVER} THEN {_NEVER} ELSE {big} + ln(list_sum([exp(z - {big}) FOR z IN {three}])) END"
    return f"""{name}(line_id, t, v) AS (SELECT line_id, -1, [CASE WHEN s = 1 THEN 0.0::DOUBLE ELSE {_NEVER} END FOR s IN range(1, len(ext) + 1)] FROM lines
    UNION ALL SELECT a.line_id, a.t + 1, [f.e[ext[s] + 1] + {lse} FOR s IN range(1, len(ext) + 1)] FROM {name} a JOIN (SELECT line_id, {ext} AS ext, width FROM lines) l USING (line_id) JOIN frames f ON f.line_id = a.line_id AND f.t = {frame})"""


_AHEAD = _fold("ahead", "ext", "a.t + 1")
_BACK = _fold("back", "list_reverse(ext)", "l.width - 2 - a.t")
_END = f"CASE WHEN len(v) > 1 THEN greatest(v[-1], v[-2]) + ln(exp(v[-1] - greatest(v[-1], v[-2])) + exp(v[-2] - greatest(v[-1], v[-2]))) ELSE v[1] END"


@query("ctc_loss", f"{_LABELS}, {_AHEAD} SELECT line_id, round(-({_END}), 6) AS loss FROM ahead JOIN lines USING (line_id) WHERE t = width - 1")
def _(s, d):
    """The loss of what each line's best path reads."""
    return alignment.ctc_loss(labelled_lines(s, d), BLANK8).select("line_id", F.round("loss", 6).alias("loss"))


@query(
    "ctc_gradient",
    f"""{_LABELS}, {_AHEAD}, {_BACK}, ends AS (SELECT line_id, {_END} AS total FROM ahead JOIN lines USING (line_id) WHERE t = width - 1),
    states AS (SELECT a.line_id, a.t, s, l.ext[s] AS code, exp(a.v[s] + b.v[len(l.ext) + 1 - s] - f.e[l.ext[s] + 1] - total) AS p FROM ahead a JOIN lines l USING (line_id) JOIN back b ON b.line_id = a.line_id AND b.t = l.width - 1 - a.t
        JOIN frames f ON f.line_id = a.line_id AND f.t = a.t JOIN ends e ON e.line_id = a.line_id, LATERAL (SELECT unnest(range(1, len(l.ext) + 1)) AS s) WHERE a.t >= 0),
    held AS (SELECT line_id, t, code, sum(p) AS p FROM states GROUP BY ALL)
    SELECT s.line_id, s.t, s.code, round(s.p - coalesce(h.p, 0), 6) + 0.0 AS gradient FROM score s LEFT JOIN held h USING (line_id, t, code)""",
)
def _(s, d):
    """How the loss grows with each code's score at each timestep."""
    probs = A.probs8(s, d)
    held = alignment.occupancy(labelled_lines(s, d), BLANK8)
    each = probs.select("line_id", "t", F.posexplode("features").alias("code", "y")).join(held, ["line_id", "t", "code"], "left")
    return each.select("line_id", "t", "code", (F.round(F.col("y") - F.coalesce("p", F.lit(0.0)), 6) + F.lit(0.0)).alias("gradient"))


_WAYS = f"""ways(line_id, t, v, way) AS (SELECT line_id, -1, [CASE WHEN s = 1 THEN 0.0::DOUBLE ELSE {_NEVER} END FOR s IN range(1, len(ext) + 1)], [0 FOR s IN range(1, len(ext) + 1)] FROM lines
    UNION ALL SELECT a.line_id, a.t + 1, [f.e[ext[s] + 1] + list_max({_sources("s", "v")}) FOR s IN range(1, len(ext) + 1)], [list_position({_sources("s", "v")}, list_max({_sources("s", "v")})) - 1 FOR s IN range(1, len(ext) + 1)]
    FROM ways a JOIN lines l USING (line_id) JOIN frames f ON f.line_id = a.line_id AND f.t = a.t + 1),
    path(line_id, t, s) AS (SELECT w.line_id, w.t, CASE WHEN len(v) > 1 AND v[-2] > v[-1] THEN len(v) - 1 ELSE len(v) END FROM ways w JOIN lines USING (line_id) WHERE w.t = width - 1
    UNION ALL SELECT p.line_id, p.t - 1, p.s - w.way[p.s] FROM path p JOIN ways w ON w.line_id = p.line_id AND w.t = p.t WHERE p.t > 0)"""


@query("ctc_align", f"{_LABELS}, {_WAYS} SELECT line_id, t::INT AS t, (s - 1)::INT AS state, ext[s]::INT AS code FROM path JOIN lines USING (line_id)")
def _(s, d):
    """The likeliest path that reads as the line's best path does."""
    return alignment.align(labelled_lines(s, d), BLANK8)


@query("ctc_spans", f"""{_LABELS}, {_WAYS} SELECT line_id, ((s - 1) // 2)::INT AS idx, ext[s]::INT AS code, min(t)::INT AS start, (max(t) + 1)::INT AS "end" FROM path JOIN lines USING (line_id) WHERE s % 2 = 0 GROUP BY line_id, s, ext""")
def _(s, d):
    return alignment.spans(alignment.align(labelled_lines(s, d), BLANK8))


#: The layer whose reading is the truth, and one that mixes each code's score with its neighbour's.
TRUE_LAYER = [[20.0 * (j == i) for j in range(8)] + [0.0] for i in range(8)]
WORN_LAYER = [[9.0 * (j == i) + 11.0 * (j == (i + 1) % 8) for j in range(8)] + [0.0] for i in range(8)]


def block_features(s: SparkSession, d: str) -> DataFrame:
    """rows(line_id, t, features): the largest of each 8 scores."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.array_max(F.slice("embedding", b * 8 + 1, 8)).cast("double"))
    return A.logits(s, d).select("line_id", "t", blocks.alias("features"))


@query("ctc_finetune")
def _(s, d):
    """A worn output layer trained back towards the true one's reading; a quarter of the lines is held out."""
    rows = block_features(s, d)
    labels = greedy_labels(alignment.scored(rows, TRUE_LAYER))
    held = F.crc32(F.col("line_id").cast("string").cast("binary")) % 4 == 2
    _, report = alignment.fine_tune(rows, labels, WORN_LAYER, BLANK8, held, steps=3, rate=0.3)
    return s.createDataFrame([tuple(r.values()) for r in report], "step int, train_loss double, held_loss double, held_edits long, held_codes long")
