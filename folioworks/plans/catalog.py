"""All named queries of the engine with the SQL that checks them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ctc, lexicon, raster, tensor
from ..operators import decode, layers, lexical, pixels, scaling, spatial, wordgraph
from ..sources import images
from ..sources import model as files
from . import adapters as A
from . import recognize as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, with its SQL if it has any."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def values(rows, columns: str) -> str:
    """SQL of constant rows, the same for each model file; columns are those of Spark's schema, in DuckDB's types."""
    kinds = [c.rsplit(" ", 1) for c in columns.split(", ")]

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(literal, v)) + "]"
        return str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    each = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    names = ", ".join(f"c{i}" for i in range(len(kinds)))
    typed = ", ".join(f"CAST(c{i} AS {k}) AS {n}" for i, (n, k) in enumerate(kinds))
    return f"SELECT file, {typed} FROM (VALUES {each}) AS v({names}), (SELECT unnest({literal(A.MODEL_FILES)}) AS file)"


INK, THIN = 120, 110
PIX = f"WITH {A.PIXELS}"
INKED = f"WITH {A.PIXELS}, {A.ink(INK)}"


def inked(s: SparkSession, d: str, level: int = INK) -> DataFrame:
    return pixels.ink(A.pixels(s, d), level)


# -- imaging -----------------------------------------------------------------

OTSU = f"""{PIX}, hist AS (SELECT image_id, v, count(*) AS n FROM pixels GROUP BY ALL),
run AS (SELECT image_id, v, sum(n) OVER a AS wb, sum(n * v) OVER a AS sb, sum(n) OVER b AS n, sum(n * v) OVER b AS s FROM hist
    WINDOW a AS (PARTITION BY image_id ORDER BY v), b AS (PARTITION BY image_id)),
spread AS (SELECT image_id, v, CASE WHEN n > wb THEN wb::DOUBLE * (n - wb) * pow(sb / wb - (s - sb) / (n - wb), 2) ELSE 0 END AS d FROM run),
found AS (SELECT image_id, CASE WHEN d > 0 THEN v ELSE 0 END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d DESC, v) AS r FROM spread) WHERE r = 1)
"""


@query("img_otsu_threshold", OTSU + "SELECT image_id, threshold FROM found")
def _(s, d):
    return pixels.otsu_thresholds(A.pixels(s, d))


@query("img_otsu", OTSU + "SELECT image_id, y, x, (v <= threshold)::INT AS v FROM pixels JOIN found USING (image_id)")
def _(s, d):
    return pixels.otsu(A.pixels(s, d))


SAUVOLA = (9, 0.34375)
_HALF = (SAUVOLA[0] - 1) // 2
_AREA = (2 * _HALF + 1) ** 2


@query(
    "img_sauvola",
    f"""{PIX}, {A.SIZES}, taps AS (SELECT p.image_id, p.y, p.x, p.v, p.y + dy AS ty, p.x + dx AS tx, w, h FROM pixels p JOIN sizes USING (image_id), range({-_HALF}, {_HALF + 1}) AS a(dy), range({-_HALF}, {_HALF + 1}) AS b(dx) WHERE h > {_HALF} AND w > {_HALF}),
    mirrored AS (SELECT image_id, y, x, v, CASE WHEN ty < 0 THEN -1 - ty WHEN ty >= h THEN 2 * h - 1 - ty ELSE ty END AS ty, CASE WHEN tx < 0 THEN -1 - tx WHEN tx >= w THEN 2 * w - 1 - tx ELSE tx END AS tx FROM taps),
    sums AS (SELECT m.image_id, m.y, m.x, m.v, sum(p.v)::BIGINT AS s, sum(p.v * p.v)::BIGINT AS q FROM mirrored m JOIN pixels p ON p.image_id = m.image_id AND p.y = m.ty AND p.x = m.tx GROUP BY ALL),
    stats AS (SELECT *, floor(s::FLOAT * {float(np.float32(1 / _AREA))!r}::FLOAT)::INT AS m, floor({1 / _AREA!r}::DOUBLE * q + 0.5)::INT AS sq FROM sums),
    levels AS (SELECT *, m * (1 - {SAUVOLA[1]} * (1 - sqrt(greatest(sq - m * m, 0)::DOUBLE)::FLOAT::DOUBLE / 128)) AS t FROM stats)
    SELECT image_id, y, x, (v < trunc(t))::INT AS v FROM levels""",
)
def _(s, d):
    return pixels.sauvola(A.pixels(s, d), *SAUVOLA)


#: A rectangle that leaves both images: its destination and its source origins are outside.
RECT, SRC_AT = (-5, 10, 50, 60), (7, -3)


def _raster(op: str) -> tuple[Query, str]:
    def run(s, d):
        dst = inked(s, d)
        src = dst.withColumn("image_id", F.col("image_id") - 1)
        ids = src.select("image_id").distinct()
        return pixels.raster_op(dst.join(ids, "image_id", "left_semi"), RECT, op, None if op in ("clear", "set") else src, SRC_AT)

    x, y, w, h = RECT
    inside = f"d.x >= {x} AND d.x < {x + w} AND d.y >= {y} AND d.y < {y + h}"
    form = {"clear": "0", "set": "1", "src": "s.v", "notsrc": "1 - s.v", "and": "s.v & d.v", "or": "s.v | d.v", "xor": "xor(s.v, d.v)"}[op]
    hit = inside if op in ("clear", "set") else f"{inside} AND s.v IS NOT NULL"
    sql = f"""{INKED} SELECT d.image_id, d.y, d.x, (CASE WHEN {hit} THEN {form} ELSE d.v END)::INT AS v FROM ink d
        LEFT JOIN ink s ON s.image_id = d.image_id + 1 AND s.x = d.x - ({x}) + ({SRC_AT[0]}) AND s.y = d.y - ({y}) + ({SRC_AT[1]})
        WHERE d.image_id < (SELECT max(image_id) FROM ink)"""
    return run, sql


for _op in raster.RASTER_OPS:
    query(f"img_rasterop_{_op}", _raster(_op)[1])(_raster(_op)[0])


def _brick(name: str, ops: list[tuple[str, int, int]]) -> str:
    """Neighbour counts by a theta join over offsets, one step for each operation."""
    ctes, last = [], "ink"
    for i, (op, w, h) in enumerate(ops):
        bx, by = (w - 1 - w // 2, h - 1 - h // 2) if op == "dilate" else (w // 2, h // 2)
        test = "sum(coalesce(p.v, 0)) >= 1" if op == "dilate" else f"sum(coalesce(p.v, 0)) = {w * h}"
        ctes.append(f"s{i} AS (SELECT c.image_id, c.y, c.x, ({test})::INT AS v FROM {last} c CROSS JOIN range({-bx}, {w - bx}) AS a(dx) CROSS JOIN range({-by}, {h - by}) AS b(dy) LEFT JOIN {last} p ON p.image_id = c.image_id AND p.x = c.x + dx AND p.y = c.y + dy GROUP BY ALL)")
        last = f"s{i}"
    return f"{INKED}, {', '.join(ctes)} SELECT image_id, y, x, v FROM {last}"


query("img_dilate", _brick("img_dilate", [("dilate", 4, 2)]))(lambda s, d: pixels.dilate(inked(s, d), 4, 2))
query("img_erode", _brick("img_erode", [("erode", 5, 3)]))(lambda s, d: pixels.erode(inked(s, d), 5, 3))
query("img_open", _brick("img_open", [("erode", 4, 2), ("dilate", 4, 2)]))(lambda s, d: pixels.opening(inked(s, d), 4, 2))
query("img_close", _brick("img_close", [("dilate", 5, 3), ("erode", 5, 3)]))(lambda s, d: pixels.closing(inked(s, d), 5, 3))


@query("img_scale_area2", f"""{PIX} SELECT image_id, (y // 2)::INT AS y, (x // 2)::INT AS x, (sum(v) // 4)::INT AS v FROM pixels GROUP BY image_id, y // 2, x // 2 HAVING count(*) = 4""")
def _(s, d):
    return pixels.halve(A.pixels(s, d))


UNSHARP = (2, 0.4)


def _sharp_sql(source: str, half: int, fraction: float) -> str:
    """SQL that sharpens source (image_id, y, x, v)."""
    around, low = f"ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING", float(np.float32(1) / np.float32((2 * half + 1) ** 2))
    return f"""extent AS (SELECT image_id, max(x) + 1 AS w, max(y) + 1 AS h FROM {source} GROUP BY image_id),
    sums AS (SELECT *, sum(v) OVER (PARTITION BY image_id, y ORDER BY x {around}) AS r FROM {source}),
    boxes AS (SELECT *, sum(r) OVER (PARTITION BY image_id, x ORDER BY y {around}) AS c FROM sums),
    sharp AS (SELECT *, (v::FLOAT + {fraction}::FLOAT * (v::FLOAT - {low!r}::FLOAT * c::FLOAT))::DOUBLE + 0.5 AS f FROM boxes)
    SELECT image_id, y, x, (CASE WHEN x >= {half} AND x < w - {half} AND y >= {half} AND y < h - {half} THEN least(255, greatest(0, trunc(f))) ELSE v END)::INT AS v FROM sharp JOIN extent USING (image_id)"""


@query("img_unsharp", f"{PIX}, {_sharp_sql('pixels', *UNSHARP)}")
def _(s, d):
    return pixels.unsharp(A.pixels(s, d), *UNSHARP)


TURN = 0.05
_S, _C = (float(np.float32(f(float(np.float32(TURN))))) for f in (math.sin, math.cos))


@query(
    "img_rotate",
    f"""{INKED}, {A.SIZES}, d AS (SELECT image_id, y, x, w // 2 AS cx, h // 2 AS cy, w // 2 - x AS dx, h // 2 - y AS dy FROM ink JOIN sizes USING (image_id)),
    src AS (SELECT image_id, y, x, (cx + trunc((-dx * {_C!r}::DOUBLE - dy * {_S!r}::DOUBLE)::FLOAT))::INT AS sx, (cy + trunc((-dy * {_C!r}::DOUBLE + dx * {_S!r}::DOUBLE)::FLOAT))::INT AS sy FROM d)
    SELECT s.image_id, s.y, s.x, coalesce(i.v, 0) AS v FROM src s LEFT JOIN ink i ON i.image_id = s.image_id AND i.x = sx AND i.y = sy""",
)
def _(s, d):
    return pixels.rotate(inked(s, d), TURN)


CLOSURE = f"""WITH RECURSIVE {A.PIXELS}, {A.ink(THIN)}, dots AS (SELECT image_id, y, x, y * 64 + x AS i FROM ink WHERE v = 1),
near AS (SELECT a.image_id, a.i AS a, b.i AS b FROM dots a JOIN dots b ON a.image_id = b.image_id AND ((abs(a.x - b.x) = 1 AND a.y = b.y) OR (a.x = b.x AND abs(a.y - b.y) = 1))),
reach(image_id, i, root) AS (SELECT image_id, i, i FROM dots UNION SELECT r.image_id, n.b, r.root FROM reach r JOIN near n ON n.image_id = r.image_id AND n.a = r.i),
named AS (SELECT image_id, i, min(root) AS root FROM reach GROUP BY ALL)
"""


@query(
    "img_conncomp",
    CLOSURE
    + """SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY root) - 1)::INT AS comp, min(i % 64)::INT AS x0, min(i // 64)::INT AS y0, (max(i % 64) + 1)::INT AS x1, (max(i // 64) + 1)::INT AS y1, count(*)::INT AS pixels
    FROM named GROUP BY image_id, root""",
)
def _(s, d):
    return pixels.components(inked(s, d, THIN), 4)


@query("img_seedfill", CLOSURE + """, hit AS (SELECT DISTINCT n.image_id, n.root FROM named n WHERE (i // 64) % 8 = 0 AND (i % 64) % 8 = 0) SELECT image_id, (i // 64)::INT AS y, (i % 64)::INT AS x FROM named JOIN hit USING (image_id, root)""")
def _(s, d):
    mask = inked(s, d, THIN)
    seeds = mask.where("y % 8 = 0 and x % 8 = 0").withColumn("v", F.lit(1))
    return pixels.seed_fill(seeds, mask, 4)


@query(
    "img_distance",
    f"""{INKED}, {A.SIZES}, paper AS (SELECT image_id, x, y FROM ink WHERE v = 0 UNION ALL SELECT image_id, u.x, e.y FROM sizes, range(0, 64) AS u(x), (SELECT unnest([-1, 0]) AS k) AS f, LATERAL (SELECT CASE WHEN k = -1 THEN -1 ELSE h END AS y) AS e
        UNION ALL SELECT image_id, e.x, u.y FROM sizes, LATERAL (SELECT unnest(range(0, h)) AS y) AS u, (SELECT unnest([-1, 64]) AS x) AS e)
    SELECT i.image_id, i.y, i.x, least(255, min(abs(i.x - p.x) + abs(i.y - p.y)))::INT AS d FROM ink i JOIN paper p ON p.image_id = i.image_id AND abs(i.x - p.x) + abs(i.y - p.y) <= 64 WHERE i.v = 1 GROUP BY ALL""",
)
def _(s, d):
    return pixels.distance(inked(s, d))


def _profile_sql(source: str, angles: str) -> str:
    return f"""pts AS (SELECT i.image_id, a.ord, a.deg, i.y, (i.x - w / 2) * tan(a.deg * pi() / 180) AS shift FROM ink i JOIN sizes USING (image_id) JOIN {angles} ON {source} WHERE i.v = 1),
    bins AS (SELECT image_id, ord, deg, y + floor(shift) AS row, 1 - (shift - floor(shift)) AS m FROM pts UNION ALL SELECT image_id, ord, deg, y + floor(shift) + 1, shift - floor(shift) FROM pts),
    mass AS (SELECT image_id, ord, deg, row, sum(m) AS mass FROM bins GROUP BY ALL)"""


@query("img_profile", f"""{INKED}, {A.SIZES}, angles AS (SELECT 0 AS ord, 1.5 AS deg), {_profile_sql("true", "angles a")} SELECT image_id, row::BIGINT AS row, round(mass, 6) AS mass FROM mass""")
def _(s, d):
    return pixels.profiles(inked(s, d), 1.5).select("image_id", "row", F.round("mass", 6).alias("mass"))


_BEST = "best{n} AS (SELECT image_id, deg FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY q DESC, ord) AS r FROM (SELECT image_id, ord, deg, round(sum(mass * mass), 6) AS q FROM mass{n} GROUP BY ALL)) WHERE r = 1)"


def _skew_sql() -> str:
    first = _profile_sql("true", "coarse a").replace("pts", "pts1").replace("bins", "bins1").replace("mass AS", "mass1 AS")
    second = _profile_sql("a.image_id = i.image_id", "fine a").replace("pts", "pts2").replace("bins", "bins2").replace("mass AS", "mass2 AS")
    return f"""{INKED}, {A.SIZES}, coarse AS (SELECT k AS ord, 0.0::DOUBLE - 5.0::DOUBLE + k * 0.1::DOUBLE AS deg FROM range(0, 101) AS r(k)), {first}, {_BEST.format(n=1)},
    fine AS (SELECT image_id, 0 AS ord, deg FROM best1 UNION ALL SELECT image_id, k + 1, deg - 0.1::DOUBLE + k * 0.01::DOUBLE FROM best1, range(0, 21) AS r(k)), {second}, {_BEST.format(n=2)}
    SELECT s.image_id, round(coalesce(-deg, 0.0), 6) + 0.0 AS degrees FROM sizes s LEFT JOIN best2 USING (image_id)"""


@query("img_skew", _skew_sql())
def _(s, d):
    return pixels.skew(inked(s, d)).select("image_id", (F.round("degrees", 6) + F.lit(0.0)).alias("degrees"))


@query("img_skew_kernel")
def _(s, d):
    return pixels.by_image(inked(s, d), lambda a: {"degrees": [round(math.degrees(raster.skew_angle(a)), 6)]}, "degrees double")


def _taps_sql(taps: str) -> str:
    """CTE taps (image_id, axis, i, src, k, first, last): source positions and weights of each position of a scaled axis.

    ``taps`` makes them of axes (image_id, axis, n, m): n source positions, m scaled ones.
    """
    return f"""{A.SIZES}, axes AS (SELECT image_id, axis, n::INT AS n, m::INT AS m FROM (SELECT image_id, 'x' AS axis, w AS n, trunc(({{scale}} * w::FLOAT)::DOUBLE + 0.5) AS m FROM sizes UNION ALL SELECT image_id, 'y', h, trunc(({{scale}} * h::FLOAT)::DOUBLE + 0.5) FROM sizes)),
    places AS (SELECT *, unnest(range(m))::INT AS i FROM axes), taps AS ({taps}),
    spread AS (SELECT p.image_id, b.i AS y, a.i AS x, sum(p.v * a.k * b.k)::BIGINT AS total, sum(a.k * b.k)::BIGINT AS area, bool_or(a.far OR b.far) AS far, any_value(p.v) FILTER (a.first AND b.first) AS corner
    FROM taps a JOIN taps b ON b.image_id = a.image_id AND a.axis = 'x' AND b.axis = 'y' JOIN pixels p ON p.image_id = a.image_id AND p.x = a.src AND p.y = b.src GROUP BY ALL)"""


#: Two neighbours in sixteenths; two neighbours in parts of a whole factor; all that a scaled pixel covers, in sixteenths.
_LINEAR = """SELECT image_id, axis, i, (pos // 16)::INT AS src, (16 - pos % 16)::INT AS k, false AS first, false AS far FROM pos
    UNION ALL SELECT image_id, axis, i, least(pos // 16 + 1, n - 1)::INT, (pos % 16)::INT, false, false FROM pos"""
_WHOLE = """SELECT image_id, axis, i, i // {times} AS src, {times} - i % {times} AS k, false AS first, false AS far FROM places
    UNION ALL SELECT image_id, axis, i, least(i // {times} + 1, n - 1), i % {times}, false, false FROM places"""
_AREA = """SELECT image_id, axis, i, src, least(greatest(least(hi, src * 16 + 16) - greatest(pos, src * 16), 0), 16)::INT AS k, src = pos // 16 AS first, hi // 16 > n - 2 AS far
    FROM (SELECT *, unnest(range(n))::INT AS src FROM pos) WHERE src = pos // 16 OR (src * 16 < hi AND src * 16 + 16 > pos)"""
_POS = """SELECT *, trunc((16 * n)::FLOAT / m::FLOAT * i::FLOAT)::BIGINT AS pos, trunc(((16 * n)::FLOAT / m::FLOAT)::DOUBLE * (i + 1.0::DOUBLE))::BIGINT AS hi FROM places"""


def _scale_sql(factor: float) -> str:
    """The scaling of tiles of 64 x 64 pixels at most; factors below 0.02 find no tile as large as their box."""
    if factor < 0.02:
        return f"{PIX}, {A.SIZES} SELECT image_id, 0 AS y, 0 AS x, v FROM pixels JOIN sizes USING (image_id) WHERE y = h // 2 AND x = w // 2"
    if factor in (2.0, 4.0):
        taps, value = _WHOLE.format(times=int(factor)), f"total // {int(factor) ** 2}"
    elif factor < 0.7:
        taps, value = f"WITH pos AS ({_POS}) {_AREA}", "CASE WHEN far THEN corner ELSE (total + 128) // greatest(area, 1) END"
    else:
        taps, value = f"WITH pos AS ({_POS}) {_LINEAR}", "(total + 128) // 256"
    made = f"{PIX}, {_taps_sql(taps).format(scale=f'{float(np.float32(factor))!r}::FLOAT')}, scaled AS (SELECT image_id, y, x, ({value})::INT AS v FROM spread)"
    if 0.2 < factor < 0.7:
        return f"{made}, {_sharp_sql('scaled', 1, 0.2)}"
    return f"{made}, {_sharp_sql('scaled', 2, 0.4)}" if 0.7 <= factor < 1.4 else f"{made} SELECT image_id, y, x, v FROM scaled"


def _scales(name: str, factor: float) -> None:
    query(name, _scale_sql(factor))(lambda s, d: scaling.scale_gray(A.pixels(s, d), factor))


for _name, _factor in (("img_scale_li", 1.3), ("img_scale_2x", 2.0), ("img_scale_4x", 4.0), ("img_scale_area", 0.4), ("img_scale_smooth", 0.01), ("img_scale", 36 / 64)):
    _scales(_name, _factor)


@query("img_basic", f"""{INKED} SELECT image_id, y, x, v FROM ink""")
def _(s, d):
    """Packs rows of bits to bytes, and back."""
    return pixels.map_images(inked(s, d), lambda a: raster.unpack(raster.pack(a), a.shape[1], a.shape[0]))


GRID, PAGE = 64, (0, 0, 1000, 1400)


@query("grid_query", f"""WITH {A.BOXES}, {A.QUERY_BOXES} SELECT DISTINCT q, id FROM boxes b JOIN query_boxes k ON b.x0 < k.x1 AND k.x0 < b.x1 AND b.y0 < k.y1 AND k.y0 < b.y1 WHERE b.x0 < b.x1 AND b.y0 < b.y1""")
def _(s, d):
    return spatial.overlapping(A.query_boxes(s, d), A.boxes(s, d), GRID, PAGE)


@query(
    "grid_insert",
    f"""WITH {A.BOXES}, solid AS (SELECT *, least(15, greatest(0, x0 // 64)) AS a, least(15, greatest(0, (x1 - 1) // 64)) AS b, least(21, greatest(0, y0 // 64)) AS c, least(21, greatest(0, (y1 - 1) // 64)) AS e FROM boxes WHERE x0 < x1 AND y0 < y1),
    wide AS (SELECT id, x0, y0, x1, y1, unnest(range(a, b + 1)) AS cx, c, e FROM solid) SELECT id, x0, y0, x1, y1, cx::INT AS cx, unnest(range(c, e + 1))::INT AS cy FROM wide""",
)
def _(s, d):
    return spatial.cells(A.boxes(s, d).distinct(), GRID, PAGE)


# -- line normalisation ------------------------------------------------------

TURNS = f"""{PIX}, {A.SIZES}, mid AS (SELECT p.image_id, x, v, lag(v) OVER w AS l, lead(v) OVER w AS r FROM pixels p JOIN sizes s ON s.image_id = p.image_id WHERE y = h // 2 WINDOW w AS (PARTITION BY p.image_id ORDER BY x)),
points AS (SELECT image_id, v, true AS dark FROM mid WHERE l IS NOT NULL AND r IS NOT NULL AND ((v < l AND v <= r) OR (v <= l AND v < r))
    UNION ALL SELECT image_id, v, false FROM mid WHERE l IS NOT NULL AND r IS NOT NULL AND ((v > l AND v >= r) OR (v >= l AND v > r))),
hist AS (SELECT image_id, dark, v, count(*) AS n FROM points GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY image_id, dark ORDER BY v) AS cum, sum(n) OVER (PARTITION BY image_id, dark) AS total FROM hist),
goals AS (SELECT *, least(total, greatest(1, (CASE WHEN dark THEN 0.25 ELSE 0.75 END)::DOUBLE * total)) AS goal FROM run),
iles AS (SELECT image_id, dark, v + 1 - (cum - goal) / n AS ile FROM (SELECT *, row_number() OVER (PARTITION BY image_id, dark ORDER BY v) AS k FROM goals WHERE cum >= goal) WHERE k = 1),
bw AS (SELECT s.image_id, coalesce(a.ile, 1.0) AS black, coalesce(b.ile, 256.0) AS white FROM sizes s LEFT JOIN iles a ON a.image_id = s.image_id AND a.dark LEFT JOIN iles b ON b.image_id = s.image_id AND NOT b.dark)
"""


@query("nrm_blackwhite", TURNS + "SELECT image_id, round(black, 6) AS black, round(white, 6) AS white FROM bw")
def _(s, d):
    return pixels.black_white(A.pixels(s, d)).select("image_id", F.round("black", 6).alias("black"), F.round("white", 6).alias("white"))


@query(
    "nrm_ile",
    f"""{PIX}, hist AS (SELECT image_id, v, count(*) AS n FROM pixels GROUP BY ALL), run AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS cum, sum(n) OVER (PARTITION BY image_id) AS total FROM hist),
    goals AS (SELECT *, least(total, greatest(1, 0.3::DOUBLE * total)) AS goal FROM run)
    SELECT image_id, round(v + 1 - (cum - goal) / n, 6) AS ile FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v) AS k FROM goals WHERE cum >= goal) WHERE k = 1""",
)
def _(s, d):
    return pixels.fractiles(A.pixels(s, d), ["image_id"], F.lit(0.3)).select("image_id", F.round("ile", 6).alias("ile"))


@query("nrm_contrast", TURNS + ", f AS (SELECT image_id, black::FLOAT AS b, (CASE WHEN (white::FLOAT - black::FLOAT) / 2::FLOAT <= 0 THEN 1 ELSE (white::FLOAT - black::FLOAT) / 2::FLOAT END)::FLOAT AS c FROM bw) SELECT p.image_id, y, x, round(((p.v::FLOAT - b) / c - 1::FLOAT)::DOUBLE, 4) AS value FROM pixels p JOIN f USING (image_id)")
def _(s, d):
    return pixels.contrast(A.pixels(s, d)).withColumn("value", F.round(F.col("value").cast("double"), 4))


@query("nrm_normalize")
def _(s, d):
    def kernel(a: np.ndarray) -> dict:
        out, scale = R.normalise(a, 36, 3, tensor.Fill(1))
        y, x = np.indices(out.shape[:2])
        return {"y": y.ravel(), "x": x.ravel(), "value": out[:, :, 0].ravel().astype(float), "scale": scale}

    return pixels.by_image(A.pixels(s, d), kernel, "y int, x int, value double, scale double")


# -- layers ------------------------------------------------------------------


@query("nn_softmax", f"WITH {A.PROBS64} SELECT line_id, t, code, round(p, 6) AS p FROM score")
def _(s, d):
    return A.probs64(s, d).select("line_id", "t", F.posexplode("features").alias("code", "p")).withColumn("p", F.round("p", 6))


ACTIVATIONS = ("Linear", "Relu", "PosClip", "SymClip", "Tanh", "Logistic")
_ACT_SQL = {"Linear": "v", "Relu": "greatest(v, 0)", "PosClip": "least(1, greatest(0, v))", "SymClip": "least(1, greatest(-1, v))", "Tanh": "1 - 2 / (exp(2 * v) + 1)", "Logistic": "1 / (1 + exp(-v))"}


@query("nn_activations", f"WITH {A.PROBS64}, x AS (SELECT line_id, t, code, s / 4 AS v FROM score) SELECT line_id, t, code, " + ", ".join(f"round({_ACT_SQL[a]}, 6) + 0.0 AS {a.lower()}" for a in ACTIVATIONS) + " FROM x")
def _(s, d):
    rows = A.logits(s, d).select("line_id", "t", F.posexplode("embedding").alias("code", "e")).withColumn("v", F.col("e").cast("double") * 20 / 4)
    return rows.select("line_id", "t", "code", *((F.round(decode.activation(a, F.col("v")), 6) + F.lit(0.0)).alias(a.lower()) for a in ACTIVATIONS))


_TABLE_SQL = "CASE WHEN a >= 4095 THEN 1 ELSE {f0} + ({f1} - {f0}) * (a - floor(a)) END"
_TANH = _TABLE_SQL.format(f0="tanh(floor(a) / 256)", f1="tanh((floor(a) + 1) / 256)")
_LOGI = _TABLE_SQL.format(f0="(1 / (1 + exp(-floor(a) / 256)))", f1="(1 / (1 + exp(-(floor(a) + 1) / 256)))")


@query("nn_tanh", f"WITH {A.LOGITS}, x AS (SELECT line_id, t, (i - 1)::INT AS code, CAST(embedding[i] AS DOUBLE) * 40 AS v, abs(CAST(embedding[i] AS DOUBLE) * 40) * 256 AS a FROM logits, range(1, 65) AS r(i)), y AS (SELECT *, {_TANH} AS f, {_LOGI} AS g FROM x) SELECT line_id, t, code, round(CASE WHEN v < 0 THEN -f ELSE f END, 6) + 0.0 AS tanh, round(CASE WHEN v < 0 THEN 1 - g ELSE g END, 6) + 0.0 AS logistic FROM y")
def _(s, d):
    """Both activation tables, as an Arrow kernel."""
    rows = A.logits(s, d).select("line_id", "t", F.posexplode("embedding").alias("code", "e"))

    def run(batches):
        for pdf in batches:
            v = pdf["e"].to_numpy(float) * 40
            yield pdf[["line_id", "t", "code"]].assign(tanh=tensor.tanh(v).round(6) + 0.0, logistic=tensor.logistic(v).round(6) + 0.0)

    return rows.mapInPandas(run, "line_id int, t int, code int, tanh double, logistic double")


QUERIES["nn_logistic"], ORACLE_SQL["nn_logistic"] = QUERIES["nn_tanh"], ORACLE_SQL["nn_tanh"]

#: A matrix by rule: 3 outputs, 64 inputs and a bias.
WEIGHT = lambda r, c: ((r * 7 + c * 3) % 11 - 5) / 8
_WEIGHT_SQL = "((r * 7 + {c} * 3) % 11 - 5) / 8.0::DOUBLE"


def _weights(s: SparkSession) -> DataFrame:
    return s.createDataFrame([([[WEIGHT(r, c) for c in range(65)] for r in range(3)],)], "w array<array<double>>")


def _affine_sql(act: str) -> str:
    return f"""WITH {A.LOGITS}, x AS (SELECT line_id, t, i - 1 AS c, CAST(embedding[i] AS DOUBLE) AS v FROM logits, range(1, 65) AS q(i)),
    dot AS (SELECT line_id, t, r, sum(v * {_WEIGHT_SQL.format(c="c")}) + {_WEIGHT_SQL.format(c="64")} AS v FROM x, range(0, 3) AS o(r) GROUP BY line_id, t, r)
    SELECT line_id, t, r::INT AS r, round({act}, 5) + 0.0 AS v FROM dot"""


def _tensors(s, d):
    return A.logits(s, d).select("line_id", F.lit(0).alias("y"), F.col("t").alias("x"), F.col("embedding").alias("features"))


def _flat(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select("line_id", F.col("x").alias("t"), F.posexplode("features").alias("r", "v")).withColumn("v", F.round(F.col("v").cast("double"), digits) + F.lit(0.0))


@query("nn_matvec", _affine_sql("v"))
def _(s, d):
    rows = A.logits(s, d).join(F.broadcast(_weights(s)))
    return rows.select("line_id", "t", F.posexplode(layers.affine(F.col("embedding"), F.col("w"))).alias("r", "v")).withColumn("v", F.round("v", 5) + F.lit(0.0))


@query("nn_fullyconnected", _affine_sql("least(1, greatest(-1, v))::FLOAT::DOUBLE"))
def _(s, d):
    return _flat(layers.fully_connected(_tensors(s, d), _weights(s), lambda v: decode.activation("SymClip", v)))


def _planes(s, d):
    return A.pixels(s, d).select(F.col("image_id").alias("line_id"), "y", "x", "v")


@query("nn_maxpool", f"{PIX} SELECT image_id AS line_id, (y // 3)::INT AS y, (x // 3)::INT AS x, max(v) AS v FROM pixels GROUP BY image_id, y // 3, x // 3 HAVING count(*) = 9")
def _(s, d):
    return layers.maxpool(_planes(s, d), 3, 3)


@query("nn_reconfig", f"{PIX} SELECT image_id AS line_id, (y // 2)::INT AS y, (x // 3)::INT AS x, string_agg(v::VARCHAR, ',' ORDER BY (x % 3) * 2 + y % 2) AS features FROM pixels GROUP BY image_id, y // 2, x // 3 HAVING count(*) = 6")
def _(s, d):
    return layers.reconfig(_planes(s, d), 3, 2).withColumn("features", F.array_join(F.col("features").cast("array<string>"), ","))


@query(
    "nn_convolve_interior",
    f"""{PIX} SELECT c.image_id AS line_id, c.y, c.x, string_agg(p.v::VARCHAR, ',' ORDER BY (p.x - c.x + 1) * 3 + p.y - c.y + 1) AS features FROM pixels c JOIN pixels p ON p.image_id = c.image_id AND p.x BETWEEN c.x - 1 AND c.x + 1 AND p.y BETWEEN c.y - 1 AND c.y + 1
    GROUP BY c.image_id, c.y, c.x HAVING count(*) = 9""",
)
def _(s, d):
    return layers.convolve_interior(_planes(s, d), 1, 1).withColumn("features", F.array_join(F.col("features").cast("array<string>"), ","))


def _tensor_rows(kernel):
    """Runs kernel(gray [y, x, 1] of -1..1) -> [y, x, n] by image."""

    def run(a: np.ndarray) -> dict:
        out = kernel((a.astype(np.float32) / np.float32(127.5) - np.float32(1))[:, :, None])
        y, x, f = np.indices(out.shape)
        return {"y": y.ravel(), "x": x.ravel(), "feature": f.ravel(), "value": out.ravel().astype(float)}

    return lambda s, d: pixels.by_image(A.pixels(s, d), run, "y int, x int, feature int, value double")


def _gates(n: int, size: int) -> list[np.ndarray]:
    rnd = np.random.RandomState(3)
    return [rnd.uniform(-1, 1, (size, n + size + 1)) for _ in range(4)]


query(
    "nn_convolve",
    f"""{PIX.replace("WITH ", "WITH RECURSIVE ", 1)}, {A.SIZES}, around AS (SELECT image_id, y, x, w, h, dx, dy FROM pixels JOIN sizes USING (image_id), range(-1, 2) AS a(dx), range(-1, 2) AS b(dy)),
    beyond AS (SELECT image_id, y, x, dx, dy, row_number() OVER (PARTITION BY image_id ORDER BY y, x, dx, dy) AS draw FROM around WHERE y + dy < 0 OR y + dy >= h OR x + dx < 0 OR x + dx >= w),
    fill(draw, state) AS (SELECT 0, (1::HUGEINT * 6364136223846793005 + 1442695040888963407) % 18446744073709551616
    UNION ALL SELECT draw + 1, (state * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 FROM fill WHERE draw < (SELECT max(draw) FROM beyond))
    SELECT a.image_id, a.y, a.x, ((a.dx + 1) * 3 + a.dy + 1)::INT AS feature, (p.v::FLOAT / 127.5::FLOAT - 1::FLOAT)::DOUBLE AS value FROM around a JOIN pixels p ON p.image_id = a.image_id AND p.y = a.y + a.dy AND p.x = a.x + a.dx
    UNION ALL SELECT image_id, y, x, ((dx + 1) * 3 + dy + 1)::INT, (2.0::DOUBLE * (state // 8589934592)::DOUBLE / 2147483647.0::DOUBLE - 1)::FLOAT::DOUBLE FROM beyond JOIN fill USING (draw)""",
)(_tensor_rows(lambda x: tensor.convolve(x, 1, 1, tensor.Fill(1))))


@query("nn_series")
def _(s, d):
    root = files.runnable(A.tiny_model().network.root)
    return _tensor_rows(lambda x: root.forward(x, tensor.Fill(1)))(s, d)


@query("nn_parallel", f"WITH {A.PROBS8} SELECT line_id, t, code, round(p, 6) AS p FROM score UNION ALL SELECT line_id, t, code + 8, round(s, 6) FROM score")
def _(s, d):
    left = A.probs8(s, d).select("line_id", F.lit(0).alias("y"), F.col("t").alias("x"), "features")
    blocks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.array_max(F.slice("embedding", b * 8 + 1, 8)).cast("double") * 20)
    right = A.logits(s, d).select("line_id", F.lit(0).alias("y"), F.col("t").alias("x"), blocks.alias("features"))
    return layers.parallel(left, right).select("line_id", F.col("x").alias("t"), F.posexplode("features").alias("code", "p")).withColumn("p", F.round("p", 6))


_REV = f"{PIX}, {A.SIZES} SELECT image_id AS line_id, {{y}} AS y, {{x}} AS x, v FROM pixels JOIN sizes USING (image_id)"
query("nn_reversed_x", _REV.format(y="y", x="w - 1 - x"))(lambda s, d: layers.reversed_(_planes(s, d), "x"))
query("nn_reversed_y", _REV.format(y="h - 1 - y", x="x"))(lambda s, d: layers.reversed_(_planes(s, d), "y"))
query("nn_transpose", _REV.format(y="x", x="y"))(lambda s, d: layers.reversed_(_planes(s, d), "transpose"))
query("nn_input", f"{PIX} SELECT image_id AS line_id, y, x, v FROM pixels")(_planes)


@query("nn_stridemap", f"{PIX} SELECT image_id, (y * 64 + x)::INT AS t, ((y * 64 + x) // 64)::INT AS y, ((y * 64 + x) % 64)::INT AS x, (x * (SELECT max(p.y) + 1 FROM pixels p WHERE p.image_id = q.image_id) + y)::INT AS transposed FROM pixels q")
def _(s, d):
    p = A.pixels(s, d)
    t = layers.timestep(F.col("y"), F.col("x"), F.col("w"))
    rows = p.join(pixels.sizes(p), "image_id").select("image_id", t.alias("t"), "w", layers.timestep(F.col("x"), F.col("y"), F.col("h")).alias("transposed"))
    return rows.select("image_id", "t", F.expr("cast(t div w as int)").alias("y"), (F.col("t") % F.col("w")).alias("x"), "transposed")


@query("nn_tensor", f"WITH {A.LOGITS} SELECT line_id, t, (i - 1)::INT AS code, round(greatest(embedding[i], embedding[65 - i])::DOUBLE, 6) AS pooled, round((CAST(embedding[i] AS DOUBLE) / 3)::FLOAT::DOUBLE, 6) AS narrowed FROM logits, range(1, 65) AS r(i)")
def _(s, d):
    """Elementwise maximum with the reversed timestep, and values narrowed to single precision."""
    rows = A.logits(s, d)
    both = F.zip_with(F.zip_with("embedding", F.reverse("embedding"), lambda a, b: F.greatest(a, b)), F.transform("embedding", lambda v: (v.cast("double") / 3).cast("float")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return rows.select("line_id", "t", F.posexplode(both).alias("code", "e")).select("line_id", "t", "code", F.round(F.col("e.a").cast("double"), 6).alias("pooled"), F.round(F.col("e.b").cast("double"), 6).alias("narrowed"))


@query("nn_weight_check", f"""WITH {A.LAYERS} SELECT a.layer_id, a.num_weights::BIGINT AS declared, (a.own_weights + coalesce((SELECT sum(b.num_weights) FROM layers b WHERE b.parent_id = a.layer_id), 0))::BIGINT AS actual, a.num_weights = a.own_weights + coalesce((SELECT sum(b.num_weights) FROM layers b WHERE b.parent_id = a.layer_id), 0) AS ok FROM layers a""")
def _(s, d):
    return layers.weight_check(A.layers(s))


@query(
    "snk_tree",
    f"""WITH RECURSIVE {A.LAYERS}, t(layer_id, depth, path) AS (SELECT layer_id, 0, lpad(ord::VARCHAR, 3, '0') FROM layers WHERE parent_id IS NULL UNION ALL SELECT l.layer_id, t.depth + 1, t.path || '.' || lpad(l.ord::VARCHAR, 3, '0') FROM layers l JOIN t ON l.parent_id = t.layer_id)
    SELECT a.layer_id, a.depth, a.path, any_value(repeat('  ', a.depth) || l.type || ' ' || l.name || ' ni=' || l.ni || ' no=' || l.no || ' weights=' || l.num_weights) AS line, sum(m.own_weights)::BIGINT AS total
    FROM t a JOIN t b ON b.path = a.path OR starts_with(b.path, a.path || '.') JOIN layers l ON l.layer_id = a.layer_id JOIN layers m ON m.layer_id = b.layer_id GROUP BY a.layer_id, a.depth, a.path""",
)
def _(s, d):
    return layers.tree(A.layers(s))


@query("nn_matrix_stats", "WITH m AS (SELECT r, c, ((r * 7 + c * 3) % 11 - 5) / 8.0::DOUBLE AS v FROM range(0, 3) AS a(r), range(0, 65) AS b(c)) SELECT 0 AS layer_id, 0 AS gate, min(v) AS low, max(v) AS high, round(avg(v), 9) AS mean FROM m")
def _(s, d):
    w = _weights(s).select(F.posexplode("w").alias("row", "values")).select(F.lit(0).alias("layer_id"), F.lit(0).alias("gate"), "row", "values")
    return layers.matrix_stats(w).withColumn("mean", F.round("mean", 9))


@query(
    "nn_rand",
    """WITH RECURSIVE g(seed, i, state) AS (SELECT s_suppkey, -1, (s_suppkey::HUGEINT * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 FROM supplier
    UNION ALL SELECT seed, i + 1, (state * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 FROM g WHERE i < 7)
    SELECT seed::BIGINT AS seed, i::INT AS i, (2.0::DOUBLE * (state // 8589934592)::DOUBLE / 2147483647.0::DOUBLE - 1)::FLOAT::DOUBLE AS value FROM g WHERE i >= 0""",
)
def _(s, d):
    """The generator's first draws for each supplier's key as seed."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(k, i, float(v)) for k in pdf["s_suppkey"] for i, v in enumerate(tensor.Fill(int(k)).signed(8))], columns=["seed", "i", "value"])

    return A.table(s, d, "supplier").select("s_suppkey").mapInPandas(run, "seed long, i int, value double")


def model_table(name: str, table: str, sql: str | None) -> None:
    """Registers a table of the model files, read where the files are read."""
    query(name, sql)(lambda s, d: files.read_table(s, A.model_files(s), table))


#: What each layer of the tiny model becomes, as its description says.
BUILT = [
    ("root", "Series", 1, 8, 3), ("0", "Input", 1, 1, 1), ("1", "Series", 1, 4, 1), ("1.0", "Convolve", 1, 9, 1), ("1.1", "FullyConnected", 9, 4, 1), ("2", "Maxpool", 4, 4, 3),
    ("3", "XYTranspose", 4, 6, 1), ("3.0", "LSTM", 4, 6, 1), ("4", "LSTM", 6, 6, 1), ("5", "XReversed", 6, 6, 1), ("5.0", "LSTM", 6, 6, 1), ("6", "FullyConnected", 6, 8, 1),
]
model_table("nn_build", "built", values(BUILT, "path VARCHAR, kind VARCHAR, inputs INT, outputs INT, x_scale INT"))


# -- charset, recoder, word graphs -------------------------------------------


@query("lex_props", f"WITH {A.CHARSET} SELECT id, properties & 1 <> 0 AS alpha, properties & 2 <> 0 AS lower, properties & 4 <> 0 AS upper, properties & 8 <> 0 AS digit, properties & 16 <> 0 AS punct FROM charset")
def _(s, d):
    return lexical.properties(A.charset(s, d))


@query("lex_spacedelim", f"WITH {A.CHARSET} SELECT id, script NOT IN ('Han', 'Thai', 'Hangul', 'Hiragana', 'Katakana') AS space_delimited FROM charset")
def _(s, d):
    return lexical.spaced(A.charset(s, d))


def _looked_up(s, d) -> DataFrame:
    """Ids from 0: at least 150, all of the charset and one beyond it."""
    last = A.charset(s, d).agg(F.greatest(F.lit(149), F.coalesce(F.max("id"), F.lit(2)) + 1).alias("last"))
    return last.select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("id"))


_IDS = "SELECT unnest(range(0, (SELECT greatest(150, coalesce(max(id), 2) + 2) FROM charset))) AS i"


@query("lex_charset", f"WITH {A.CHARSET} SELECT i::INT AS id, coalesce(c.text, '') AS text, coalesce(c.text, '') AS normed FROM ({_IDS}) LEFT JOIN charset c ON c.id = i")
def _(s, d):
    return lexical.characters(_looked_up(s, d), A.charset(s, d))


@query("lex_encode", f"WITH {A.RECODER} SELECT i::INT AS id, r.code::VARCHAR AS code FROM ({_IDS}) LEFT JOIN recoder r ON r.unichar_id = i")
def _(s, d):
    return lexical.encode(_looked_up(s, d), A.recoder(s, d)).select("id", F.array_join(F.col("code").cast("array<string>"), ",").alias("code"))


@query("lex_decode", f"WITH {A.RECODER} SELECT code::VARCHAR AS code, max(unichar_id)::INT AS unichar_id FROM recoder GROUP BY code")
def _(s, d):
    return lexical.decoder(A.recoder(s, d)).select(F.array_join(F.col("code").cast("array<string>"), ",").alias("code"), "unichar_id")


@query("lex_coderange", f"WITH {A.RECODER} SELECT (max(code) + 1)::INT AS code_range, 1 AS max_code_len, count(*) AS size, count(DISTINCT code) AS first_codes FROM recoder")
def _(s, d):
    return lexical.code_range(A.recoder(s, d))


#: The prefix tree of the tiny model's words, node by node: (letter's id, next node, word end, last of its node).
TINY_EDGES = lexicon.build_edges([[ord(c) - ord("a") + 3 for c in w] for w in A.TINY_WORDS])


@query("lex_edge", values([(i, c, last, end, after) for i, (c, after, end, last) in enumerate(TINY_EDGES)], "edge BIGINT, unichar_id INT, last BOOLEAN, eow BOOLEAN, next BIGINT"))
def _(s, d):
    """Packed records of the model files' word graph, taken apart."""
    records = files.read_table(s, A.model_files(s), "records").where(F.col("dawg") == files.type_name(files.WORD_GRAPH))
    return lexical.edge_fields(records.select("file", "edge", "record"), A.TINY_SIZE)


@query("lex_edgechar", f"""WITH {A.EDGES}, {A.WORDS}, wanted AS (SELECT DISTINCT substring(word, 1, 2) AS node, substring(word, 3, 1) AS letter FROM words WHERE length(word) >= 3) SELECT node, letter, CASE WHEN eow IS NULL THEN NULL ELSE node || letter END AS next, eow FROM wanted LEFT JOIN edges USING (node, letter)""")
def _(s, d):
    words = A.document_words(s, d).where("length(word) >= 3")
    wanted = words.select(F.expr("left(word, 2)").alias("node"), F.expr("substring(word, 3, 1)").alias("letter")).distinct()
    return lexical.edge_char(wanted, lexical.prefix_edges(A.lexicon_words(s, d)))


LETTERS = [chr(c) for c in (*range(65, 91), *range(97, 123))]
_LOOKUP = f"""WITH {A.LEXICON}, {A.WORDS}, prefixes AS (SELECT DISTINCT substring(word, 1, n) AS word FROM (SELECT word, unnest(range(1, length(word) + 1)) AS n FROM lexicon))
SELECT word, word IN (SELECT word FROM lexicon) AS contains, word IN (SELECT word FROM prefixes) AS prefix FROM words"""


@query("lex_contains", _LOOKUP)
def _(s, d):
    return lexical.lookup(A.document_words(s, d), lexical.prefix_edges(A.lexicon_words(s, d)))


QUERIES["lex_prefix"], ORACLE_SQL["lex_prefix"] = QUERIES["lex_contains"], ORACLE_SQL["lex_contains"]


@query(
    "lex_minimal",
    f"""WITH {A.LEXICON}, parts AS (SELECT substring(word, 1, n - 1) AS prefix, substring(word, n, 1) AS letter, substring(word, n) AS rest, n = length(word) AS eow FROM (SELECT word, unnest(range(1, length(word) + 1)) AS n FROM lexicon)),
    nodes AS (SELECT prefix, string_agg(rest, ' ' ORDER BY rest) AS endings FROM parts GROUP BY prefix),
    named AS (SELECT prefix, first_value(prefix) OVER (PARTITION BY endings ORDER BY length(prefix), prefix) AS name FROM nodes),
    edges AS (SELECT prefix, letter, bool_or(eow) AS eow FROM parts GROUP BY prefix, letter)
    SELECT e.prefix AS node, e.letter, b.name AS next, e.eow, e.letter = max(e.letter) OVER (PARTITION BY e.prefix) AS last
    FROM edges e JOIN named a ON a.prefix = e.prefix AND a.name = a.prefix LEFT JOIN named b ON b.prefix = e.prefix || e.letter""",
)
def _(s, d):
    """The minimal word graph of the lexicon; the SQL compares whole lists of endings."""
    return wordgraph.minimal_graph(A.lexicon_words(s, d))


@query("lex_walk", _LOOKUP)
def _(s, d):
    """The documents' words, stepped along the minimal graph."""
    return wordgraph.walk(A.document_words(s, d), wordgraph.minimal_graph(A.lexicon_words(s, d)))


@query("lex_classify", _LOOKUP.replace("SELECT word, word IN (SELECT word FROM lexicon) AS contains, word IN (SELECT word FROM prefixes) AS prefix FROM words", "SELECT word, CASE WHEN word IN (SELECT word FROM prefixes) THEN 8 ELSE 0 END::INT AS permuter, word IN (SELECT word FROM lexicon) AS valid_end FROM words"))
def _(s, d):
    """The automaton's answer over the lexicon, without punctuation: 8 is its rank."""
    return lexical.classify(A.document_words(s, d), A.lexicon_words(s, d), LETTERS)


@query(
    "lex_letter",
    _LOOKUP[: _LOOKUP.rindex("SELECT word,")]
    + """, digits AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+')) AS word FROM documents),
    bare AS (SELECT word, word IN (SELECT word FROM prefixes) AS prefix, word IN (SELECT word FROM lexicon) AS known FROM words)
    SELECT word, CASE WHEN prefix THEN 8 ELSE 0 END::INT AS permuter, known AS valid_end FROM bare
    UNION ALL SELECT unnest(['(' || word || ')', word || '.']), CASE WHEN known THEN 8 ELSE 0 END::INT, known FROM bare
    UNION ALL SELECT unnest([word, '(' || word || ')']), CASE WHEN length(word) <= 4 THEN 6 ELSE 0 END::INT, length(word) <= 4 FROM digits""",
)
def _(s, d):
    """Words in punctuation: the documents' words, bare, in brackets or before a stop; and numbers of one to four digits."""
    words, numbers = A.document_words(s, d), A.document_numbers(s, d)
    around = lambda *forms: F.explode(F.array(*forms)).alias("word")
    bracketed = F.concat(F.lit("("), "word", F.lit(")"))
    words = words.select(around("word", bracketed, F.concat("word", F.lit(".")))).unionByName(numbers.select(around("word", bracketed)))
    wild = "\0"  # no letter: the wildcard of the punctuation patterns
    letters = LETTERS + list("().,0123456789")
    return lexical.classify(words, A.lexicon_words(s, d), letters, [wild, f"({wild})", f"{wild}.", f"{wild},"], ["0", "00", "000", "0000"])


# before its first letter a hypothesis is in the punctuation, which lets a bare word through
model_table("lex_start", "start", values([(lexicon.LEAD, -1, lexicon.NO_EDGE, lexicon.NO_EDGE)], "kind INT, core INT, at INT, wrap INT"))


# -- decoding ----------------------------------------------------------------

BLANK64, BLANK8, SPACE = 63, 7, 0


@query("dec_argmax", f"WITH {A.PROBS64}, {A.BEST} SELECT line_id, t, code FROM best")
def _(s, d):
    return decode.best_codes(A.probs64(s, d)).select("line_id", "t", "code")


@query("dec_topn", f"WITH {A.PROBS64}, ranked AS (SELECT *, row_number() OVER (PARTITION BY line_id, t ORDER BY p DESC, code) AS r FROM score) SELECT line_id, t, code, (CASE WHEN r <= 2 OR code = {BLANK64} THEN 0 WHEN r <= 5 THEN 1 ELSE 2 END)::INT AS tier FROM ranked")
def _(s, d):
    return decode.tiers(A.probs64(s, d), BLANK64)


@query("dec_greedy", f'WITH {A.PROBS64}, {A.greedy_sql(BLANK64)} SELECT line_id, idx, code, start, "end" FROM symbols')
def _(s, d):
    return decode.greedy(A.probs64(s, d), BLANK64)


@query("dec_cert", f"WITH {A.PROBS64}, {A.BEST} SELECT line_id, t, round(CASE WHEN p > exp(-20) THEN ln(p) ELSE -20 END, 6) AS certainty FROM best")
def _(s, d):
    return decode.best_codes(A.probs64(s, d)).select("line_id", "t", F.round(decode.certainty(F.col("p")), 6).alias("certainty"))


@query("dec_score", f'WITH {A.PROBS8}, {A.scored_sql(BLANK8)} SELECT line_id, idx, code, start, "end", round(certainty, 6) AS certainty, round(rating, 6) AS rating FROM scored')
def _(s, d):
    return decode.scores(A.probs8(s, d), BLANK8).select("line_id", "idx", "code", "start", "end", F.round("certainty", 6).alias("certainty"), F.round("rating", 6).alias("rating"))


BOUNDS = """bounds AS (SELECT line_id, idx + 1 AS k, "end" + (nxt - "end") // 2 AS bound FROM (SELECT *, lead(start) OVER (PARTITION BY line_id ORDER BY idx) AS nxt FROM scored) WHERE nxt IS NOT NULL
    UNION ALL SELECT DISTINCT line_id, 0, 0 FROM scored UNION ALL SELECT w.line_id, count(s.idx), any_value(width) FROM widths w LEFT JOIN scored s USING (line_id) GROUP BY w.line_id)"""


@query("dec_bounds", f"WITH {A.PROBS8}, {A.scored_sql(BLANK8)}, {BOUNDS} SELECT line_id, k::INT AS k, bound::INT AS bound FROM bounds")
def _(s, d):
    p = A.probs8(s, d)
    return decode.boundaries(decode.greedy(p, BLANK8), decode.widths(p))


@query("dec_text", f"WITH {A.PROBS8}, {A.greedy_sql(BLANK8)}, lines AS (SELECT DISTINCT line_id FROM logits) SELECT line_id, coalesce(string_agg(substr('{A.TEXTS8}', code + 1, 1), '' ORDER BY idx), '') AS text, NULL::VARCHAR AS error FROM lines LEFT JOIN symbols USING (line_id) GROUP BY line_id")
def _(s, d):
    p = A.probs8(s, d)
    return decode.texts(decode.greedy(p, BLANK8), A.chars8(s), decode.widths(p))


def _symbols(run) -> Query:
    """A decoder as kernel on whole lines of 8 codes: (line_id, idx, char, start, end, certainty, rating)."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        rows = [(pdf["line_id"].iloc[0], i, *x) for i, x in enumerate(run(np.stack(pdf["features"])))]
        return pd.DataFrame(rows, columns=["line_id", "idx", "char", "start", "end", "certainty", "rating"])

    return lambda s, d: A.probs8(s, d).groupBy("line_id").applyInPandas(kernel, "line_id long, idx int, char int, start int, end int, certainty double, rating double")


def _plain_beam(probs: np.ndarray) -> list[ctc.Symbol]:
    return ctc.Beam(BLANK8, range(8), {i: i for i in range(7)}).decode(probs)


def _word_beam(probs: np.ndarray) -> list[ctc.Symbol]:
    r = R.Recognizer.of(A.tiny_model())
    return r.beam(probs)


#: Characters of one to three codes, over the 7 codes beside the blank.
SEVERAL = {(0,): 0, (1,): 1, (2, 3): 2, (2, 4): 3, (3, 2): 4, (4, 5, 6): 5, (5, 1): 6, (6,): 7}


def _several_beam(probs: np.ndarray) -> list[ctc.Symbol]:
    return ctc.Beam(BLANK8, range(8), SEVERAL).decode(probs)


query("dec_beam")(_symbols(_word_beam))
query("dec_multicode")(_symbols(_several_beam))
query("dec_bestpath")(_symbols(_plain_beam))


@query("dec_pathscore", f'WITH {A.PROBS8}, {A.scored_sql(BLANK8)} SELECT line_id, idx, code AS char, start, "end", round(certainty, 6) AS certainty, round(rating, 6) AS rating FROM scored')
def _(s, d):
    scored = _symbols(lambda p: ctc.score(p, ctc.greedy(p, BLANK8, {i: i for i in range(7)})))(s, d)
    return scored.withColumns({c: F.round(c, 6) for c in ("certainty", "rating")})


# -- words and lines ---------------------------------------------------------

WORDS = f"""marked AS (SELECT *, sum((code = {SPACE})::INT) OVER w AS gap, last_value(CASE WHEN code = {SPACE} THEN certainty END IGNORE NULLS) OVER w AS before,
    first_value(CASE WHEN code = {SPACE} THEN certainty END IGNORE NULLS) OVER (PARTITION BY line_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS beyond FROM scored WINDOW w AS (PARTITION BY line_id ORDER BY idx)),
    runs AS (SELECT line_id, gap, min(idx) AS first, max(idx) + 1 AS after, least(coalesce(any_value(before), 0.0), coalesce(any_value(beyond), any_value(before), 0.0)) AS space_certainty,
    string_agg(substr('{A.TEXTS8}', code + 1, 1), '' ORDER BY idx) AS text, min(certainty) AS c FROM marked WHERE code <> {SPACE} GROUP BY line_id, gap),
    found AS (SELECT *, (row_number() OVER (PARTITION BY line_id ORDER BY gap) - 1)::INT AS word FROM runs)"""
SCALE, BOX = 6.0, (100, 50, 400, 90)


@query("out_split", f"WITH {A.PROBS8}, {A.scored_sql(BLANK8)}, {WORDS} SELECT line_id, word, first::INT AS first, after::INT AS after, round(space_certainty, 6) AS space_certainty FROM found")
def _(s, d):
    return decode.words(decode.scores(A.probs8(s, d), BLANK8), SPACE).drop("gap").withColumn("space_certainty", F.round("space_certainty", 6))


_BOXED = f"""{BOUNDS}, boxed AS (SELECT f.*, ({BOX[0]} + floor(a.bound * {SCALE}))::INT AS x0, greatest({BOX[0]} + floor(a.bound * {SCALE}) + 1, {BOX[0]} + ceil(b.bound * {SCALE}))::INT AS x1
    FROM found f JOIN bounds a ON a.line_id = f.line_id AND a.k = f.first JOIN bounds b ON b.line_id = f.line_id AND b.k = f.after)"""


@query("out_wordbounds", f"WITH {A.PROBS8}, {A.scored_sql(BLANK8)}, {WORDS}, {_BOXED} SELECT line_id, word, x0, {BOX[1]} AS y0, x1, {BOX[3]} AS y1 FROM boxed")
def _(s, d):
    p = A.probs8(s, d)
    scored = decode.scores(p, BLANK8)
    return decode.word_boxes(decode.words(scored, SPACE), decode.boundaries(scored, decode.widths(p)), SCALE, BOX).select("line_id", "word", "x0", "y0", "x1", "y1")


@query("out_conf", f"WITH {A.PROBS8}, {A.scored_sql(BLANK8)} SELECT line_id, idx, round(greatest(0, least(100, 100 + 35 * certainty)), 5) AS confidence FROM scored")
def _(s, d):
    return decode.scores(A.probs8(s, d), BLANK8).select("line_id", "idx", F.round(decode.confidence(F.col("certainty")), 5).alias("confidence"))


@query(
    "out_recognize",
    f"""WITH {A.PROBS8}, {A.scored_sql(BLANK8)}, {WORDS}, {_BOXED}, conf AS (SELECT *, greatest(0, least(100, 100 + 35 * least(0, c, space_certainty))) AS k FROM boxed)
    SELECT line_id, word, text, x0, {BOX[1]} AS y0, x1, {BOX[3]} AS y1, round(k, 5) AS confidence, round(min(k) OVER (PARTITION BY line_id), 5) AS line_confidence FROM conf""",
)
def _(s, d):
    out = decode.recognize(A.probs8(s, d), A.chars8(s), BLANK8, SPACE, SCALE, BOX)
    return out.withColumns({c: F.round(c, 5) for c in ("confidence", "line_confidence")})


@query(
    "out_lines",
    f"""WITH {A.PROBS8}, {A.scored_sql(BLANK8)}, {WORDS}, worst AS (SELECT line_id, count(*) AS n_words, min(greatest(0, least(100, 100 + 35 * least(0, c, space_certainty)))) AS confidence FROM found GROUP BY line_id),
    texts AS (SELECT line_id, coalesce(string_agg(substr('{A.TEXTS8}', code + 1, 1), '' ORDER BY idx), '') AS text FROM widths LEFT JOIN scored USING (line_id) GROUP BY line_id)
    SELECT line_id, text, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(confidence, 0.0), 5) AS confidence, NULL::VARCHAR AS error FROM texts LEFT JOIN worst USING (line_id)""",
)
def _(s, d):
    return decode.lines(A.probs8(s, d), A.chars8(s), BLANK8, SPACE).withColumn("confidence", F.round("confidence", 5))


@query("out_cer", f"WITH {A.PAIRS} SELECT conv_id, turn, round(CASE WHEN length(want) > 0 THEN levenshtein(got, want) / length(want) ELSE (length(got) > 0)::INT::DOUBLE END, 6) AS cer FROM pairs")
def _(s, d):
    return A.text_pairs(s, d).select("conv_id", "turn", F.round(decode.error_rate(F.col("got"), F.col("want")), 6).alias("cer"))


@query("ext_conf_grid", f"""WITH {A.PROBS8}, {A.scored_sql(BLANK8)}, {WORDS}, {_BOXED}, conf AS (SELECT line_id % 2 AS page, greatest(0, least(100, 100 + 35 * least(0, c, space_certainty))) AS k, least(2, greatest(0, floor((x0 + x1) / 2 * 3 / 1000))) + 3 * least(2, greatest(0, floor({(BOX[1] + BOX[3]) / 2} * 3 / 200))) AS cell FROM boxed)
    SELECT page::INT AS page, cell::INT AS cell, round(quantile_cont(k, 0.1), 5) AS p10 FROM conf GROUP BY ALL HAVING count(*) >= 5""")
def _(s, d):
    words = decode.recognize(A.probs8(s, d), A.chars8(s), BLANK8, SPACE, SCALE, BOX).withColumn("page", (F.col("line_id") % 2).cast("int"))
    return R.confidence_grid(words, 1000, 200).withColumn("p10", F.round("p10", 5))


# -- model files, whole recognition -------------------------------------------


def _entries() -> list[tuple]:
    """(type, name, size, digest) of the tiny model's components, before they are packed into one file."""
    made = [A.model_entries(A.tiny_model(), swap) for swap in (False, True)]
    return [[(t, files.type_name(t), len(v), hashlib.sha256(v).hexdigest()) for t, v in sorted(m.items())] for m in made]


_META = " UNION ALL ".join(f"({values(rows, 'type INT, name VARCHAR, size BIGINT, sha256 VARCHAR')} WHERE file = '{f}')" for f, rows in zip(A.MODEL_FILES, _entries()))


@query("src_container", _META)
def _(s, d):
    """The components of every file."""
    found = files.read_components(s, A.model_files(s))
    return found.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "type", "name", "size", F.sha2("bytes", 256).alias("sha256"))


@query("src_container_meta", "WITH c AS (" + _META + ") SELECT file, count(*)::BIGINT AS components, sum(size)::BIGINT AS bytes, string_agg(name, ',' ORDER BY type) AS names, file = 'tiny.swapped' AS swapped, 'tiny:1' AS version FROM c GROUP BY file")
def _(s, d):
    """What the header of every file says."""
    return files.rows_of_files(s, A.model_files(s), "components long, bytes long, names string, swapped boolean, version string", files.header_rows)


@query(
    "src_reader",
    """SELECT s_suppkey AS key, swapped, (s_suppkey % 256 - 128)::INT AS i8, (s_suppkey % 256)::INT AS u8, (s_suppkey % 65536 - 32768)::INT AS i16, (-s_suppkey)::INT AS i32, (4294967295 - s_suppkey)::BIGINT AS u32,
    (-s_suppkey * 1000000007)::BIGINT AS i64, (18446744073709551615::HUGEINT - s_suppkey)::VARCHAR AS u64, (s_suppkey / 4)::DOUBLE AS f32, (s_suppkey / 8)::DOUBLE AS f64, 'supplier ' || s_suppkey AS text, s_suppkey % 3 AS n_reals,
    CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey / 2 END::DOUBLE AS first_real, 0 AS "left" FROM supplier, (SELECT unnest([false, true]) AS swapped)""",
)
def _(s, d):
    """Items of every type, packed from each supplier's key in both byte orders, and read back."""

    def pack(batches):
        for pdf in batches:
            rows = []
            for k in pdf["s_suppkey"].tolist():
                v = dict(i8=k % 256 - 128, u8=k % 256, i16=k % 65536 - 32768, i32=-k, u32=2**32 - 1 - k, i64=-k * 1000000007, u64=2**64 - 1 - k, f32=k / 4, f64=k / 8, text=f"supplier {k}", reals=[k / 2] * (k % 3))
                rows += [(k * 2 + swap, files.write_values(v, swap), swap) for swap in (False, True)]
            yield pd.DataFrame(rows, columns=["row", "bytes", "swapped"])

    packed = A.table(s, d, "supplier").select("s_suppkey").mapInPandas(pack, "row long, bytes binary, swapped boolean")
    out = files.read_values(packed, "row", "bytes", "swapped")
    numbers = out.withColumns({"swapped": F.col("key") % 2 == 1, "key": F.expr("key div 2"), "n_reals": F.size("reals").cast("long"), "first_real": F.get("reals", F.lit(0))})
    return numbers.select("key", "swapped", *files.VALUE_CODES, "u64", "text", "n_reals", "first_real", "left")


@query("src_bitreverse", "SELECT s_suppkey, (((s_suppkey & 255) << 24) | (((s_suppkey >> 8) & 255) << 16) | (((s_suppkey >> 16) & 255) << 8) | ((s_suppkey >> 24) & 255))::BIGINT AS reversed FROM supplier")
def _(s, d):
    at = lambda b: F.shiftright("s_suppkey", b).bitwiseAND(F.lit(255))
    out = F.shiftleft(at(0), 24).bitwiseOR(F.shiftleft(at(8), 16)).bitwiseOR(F.shiftleft(at(16), 8)).bitwiseOR(at(24))
    return A.table(s, d, "supplier").select("s_suppkey", out.cast("long").alias("reversed"))


_TINY_CHARS = [(0, " ", " ", "Common", 0), (1, "Joined", "Joined", "Common", 0), (2, "|Broken|0|1", "Broken", "Common", 0), *((i + 3, c, c, "Latin", 3) for i, c in enumerate(A.TEXTS8[1:]))]


@query("src_unicharset", values(_TINY_CHARS, "id INT, text VARCHAR, normed VARCHAR, script VARCHAR, properties INT"))
def _(s, d):
    """The charset component of every file, line by line."""
    found = files.read_components(s, A.model_files(s)).where(F.col("type") == files.CHARSET)
    lines = found.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.posexplode(F.split(F.decode("bytes", "utf-8"), "\n")).alias("line_no", "value"))
    return lexical.parse_charset(lines)


@query("src_recoder", values([(i, str(c)) for i, c in enumerate([0, 7, 7, 1, 2, 3, 4, 5, 6])], "unichar_id INT, code VARCHAR"))
def _(s, d):
    codes = files.read_table(s, A.model_files(s), "recoder")
    return codes.withColumn("code", F.array_join(F.col("code").cast("array<string>"), ","))


def _tiny_graph_rows() -> list[tuple]:
    rows = [("lstm-punc-dawg", 0, 0, 0, 0, True, True)]
    node = 0
    for e, (letter, after, end, last) in enumerate(TINY_EDGES):
        rows.append(("lstm-word-dawg", node, e, letter, after, end, last))
        node = e + 1 if last else node
    return rows


model_table("src_dawg", "dawg_edges", values(_tiny_graph_rows(), "dawg VARCHAR, node BIGINT, edge BIGINT, unichar_id INT, next BIGINT, eow BOOLEAN, last BOOLEAN"))
_TINY_LAYERS = files.layer_rows(A.tiny_model().network.root)


@query("src_network", values([(i, -1 if p is None else p, *more) for i, p, *more in _TINY_LAYERS], "layer_id INT, parent_id INT, ord INT, type VARCHAR, name VARCHAR, ni INT, no INT, num_weights BIGINT, own_weights BIGINT"))
def _(s, d):
    """The layers of every file; the root's parent is -1."""
    return files.read_table(s, A.model_files(s), "layers").fillna(-1, ["parent_id"])


@query("src_matrix", values([(i, k, r, len(row), round(float(row.sum()), 6), round(float(row[-1]), 6)) for i, (_, x) in enumerate(A.tiny_model().network.root.walk()) for k, m in enumerate(x.matrices) for r, row in enumerate(m)], "layer_id INT, gate INT, row INT, n INT, total DOUBLE, bias DOUBLE"))
def _(s, d):
    w = files.read_table(s, A.model_files(s), "weights")
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return w.select("file", "layer_id", "gate", "row", F.size("values").alias("n"), F.round(total, 6).alias("total"), F.round(F.element_at("values", -1), 6).alias("bias"))


model_table("src_model", "model_check", values([(k, True) for k in ("recoder size", "one softmax", "softmax outputs", "root outputs", "blank is last", "graph sizes")], "invariant VARCHAR, ok BOOLEAN"))


@query("src_tables", "SELECT i::INT AS i, round(tanh(i / 256), 9) AS tanh, round(1 / (1 + exp(-i / 256)), 9) AS logistic FROM range(0, 4096) AS r(i)")
def _(s, d):
    return s.createDataFrame(pd.DataFrame({"i": np.arange(4096, dtype="int32"), "tanh": tensor.TANH.round(9), "logistic": tensor.LOGISTIC.round(9)}), "i int, tanh double, logistic double")


@query("src_image", f"{PIX} SELECT image_id, y, x, v FROM pixels")
def _(s, d):
    """Pixels to dense images and back."""
    return images.explode_pixels(images.dense_images(A.pixels(s, d)), "line_id")


@query("snk_dump")
def _(s, d):
    return files.rows_of_files(s, A.model_files(s), "line int, text string", lambda data: enumerate(files.describe(data)))


def _line_images(s, d) -> DataFrame:
    return images.dense_images(A.pixels(s, d))


query("snk_activations")(lambda s, d: R.activation_report(R.activations(_line_images(s, d), R.Recognizer.of(A.tiny_model()))))
query("nn_tap")(lambda s, d: R.activations(_line_images(s, d), R.Recognizer.of(A.tiny_model())))


@query("dec_recognizer")
def _(s, d):
    out = R.recognize_lines(_line_images(s, d), R.Recognizer.of(A.tiny_model()))
    return out.select("line_id", "text", F.round("confidence", 4).alias("confidence"), F.size("words").alias("n_words"), "error")
