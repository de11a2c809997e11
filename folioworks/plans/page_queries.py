"""Queries of page layout: lines, columns, baselines. Registered in the catalog's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns, decode, page, runs
from . import adapters as A
from . import catalog
from .catalog import PIX, query

#: Ink of the tiles, and gaps that fit them.
PAGE_INK, PAGE_GAPS, PAGE_CORE = 104, (4, 4, 2), 2


def _smear(source: str, out: str, axis: str, gap: int, v: str = "v") -> str:
    across = "y" if axis == "x" else "x"
    return f"""{out} AS (SELECT *, coalesce((min(CASE WHEN {v} = 1 THEN {axis} END) OVER (PARTITION BY image_id, {across} ORDER BY {axis} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        - max(CASE WHEN {v} = 1 THEN {axis} END) OVER (PARTITION BY image_id, {across} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= {gap + 1})::INT, 0) AS {out}_v FROM {source})"""


SMEARED = f"""{A.PIXELS}, {A.ink(PAGE_INK)}, {_smear("ink", "along", "x", PAGE_GAPS[0])}, {_smear("along", "down", "y", PAGE_GAPS[1])},
    met AS (SELECT image_id, y, x, v, along_v * down_v AS b FROM down), {_smear("met", "again", "x", PAGE_GAPS[2], "b")}, full_ AS (SELECT image_id, y, x, v, again_v AS s FROM again)"""

#: Lines by closure over touching runs, then row by row.
LINES = f"""{SMEARED}, spans AS (SELECT image_id, y, min(x) AS x0, max(x) + 1 AS x1, y * 4294967296 + min(x) AS run FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS island FROM full_ WHERE s = 1) GROUP BY image_id, y, island),
    near AS MATERIALIZED (SELECT a.image_id, a.run AS a, b.run AS b FROM spans a JOIN spans b ON a.image_id = b.image_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
    reach(image_id, run, root) AS (SELECT image_id, run, run FROM spans UNION SELECT r.image_id, n.b, r.root FROM reach r JOIN near n ON n.image_id = r.image_id AND n.a = r.run),
    named AS (SELECT image_id, run, min(root) AS block FROM reach GROUP BY ALL),
    dots AS MATERIALIZED (SELECT f.image_id, f.y, f.x, n.block FROM full_ f JOIN spans s ON s.image_id = f.image_id AND s.y = f.y AND f.x >= s.x0 AND f.x < s.x1 JOIN named n ON n.image_id = s.image_id AND n.run = s.run WHERE f.v = 1),
    extent AS (SELECT image_id, block, min(y) AS lo, max(y) AS hi, count(*) AS total FROM dots GROUP BY ALL),
    prof AS (SELECT e.image_id, e.block, e.y, (SELECT count(*) FROM dots d WHERE d.image_id = e.image_id AND d.block = e.block AND d.y = e.y) AS n, total, hi - lo + 1 AS h FROM (SELECT *, unnest(range(lo, hi + 1)) AS y FROM extent) e),
    marked AS (SELECT *, n * h >= total AS core, y - row_number() OVER (PARTITION BY image_id, block, n * h >= total ORDER BY y) AS island FROM prof),
    cores AS (SELECT image_id, block, min(y) AS a, max(y) AS b, row_number() OVER (PARTITION BY image_id, block ORDER BY min(y)) AS k FROM marked WHERE core GROUP BY image_id, block, island HAVING count(*) >= {PAGE_CORE}),
    cuts AS (SELECT c.image_id, c.block, arg_min(p.y, (p.n, p.y)) AS cut FROM cores c JOIN cores e ON e.image_id = c.image_id AND e.block = c.block AND e.k = c.k + 1 JOIN prof p ON p.image_id = c.image_id AND p.block = c.block AND p.y > c.b AND p.y < e.a GROUP BY c.image_id, c.block, c.k),
    assigned AS (SELECT d.*, (SELECT count(*) FROM cuts c WHERE c.image_id = d.image_id AND c.block = d.block AND c.cut <= d.y) AS line FROM dots d),
    lines AS MATERIALIZED (SELECT image_id, block::BIGINT AS block, line::INT AS line, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS ink FROM assigned GROUP BY ALL),
    ids AS (SELECT *, image_id * 1048576 + row_number() OVER (PARTITION BY image_id ORDER BY block, line) - 1 AS line_id FROM lines)"""


def page_bits(s, d):
    return A.pixels(s, d).select("image_id", "y", "x", (F.col("v") <= PAGE_INK).cast("int").alias("v"))


@query("page_smear", f"WITH {SMEARED} SELECT image_id, y, x, s AS v FROM full_")
def _(s, d):
    return page.smeared(page_bits(s, d), PAGE_GAPS)


@query("page_lines", f"WITH RECURSIVE {LINES} SELECT * FROM lines")
def _(s, d):
    return page.text_lines(page_bits(s, d), PAGE_GAPS, PAGE_CORE)


@query(
    "page_crops",
    f"""WITH RECURSIVE {LINES} SELECT line_id, max(p.x) - any_value(x0) + 1 AS width, max(p.y) - any_value(y0) + 1 AS height, string_agg(printf('%02X', p.v), '' ORDER BY p.y, p.x) AS pix
    FROM ids JOIN pixels p ON p.image_id = ids.image_id AND p.x >= x0 - 1 AND p.x <= x1 AND p.y >= y0 - 1 AND p.y <= y1 GROUP BY line_id""".replace("any_value(x0)", "greatest(0, any_value(x0) - 1)").replace("any_value(y0)", "greatest(0, any_value(y0) - 1)"),
)
def _(s, d):
    lines = page.numbered(page.text_lines(page_bits(s, d), PAGE_GAPS, PAGE_CORE))
    return page.line_images(A.pixels(s, d), lines, 1).withColumn("pix", F.hex("pix"))


#: Components of ink by closure over runs that touch, each in the line that has its middle row.
COMPONENTS = f"""{LINES}, strokes AS (SELECT image_id, y, min(x) AS x0, max(x) + 1 AS x1, y * 4294967296 + min(x) AS run FROM (SELECT *, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS island FROM ink WHERE v = 1) GROUP BY image_id, y, island),
    touch AS MATERIALIZED (SELECT a.image_id, a.run AS a, b.run AS b FROM strokes a JOIN strokes b ON a.image_id = b.image_id AND abs(a.y - b.y) = 1 AND a.x0 <= b.x1 AND b.x0 <= a.x1),
    spread(image_id, run, root) AS (SELECT image_id, run, run FROM strokes UNION SELECT r.image_id, n.b, r.root FROM spread r JOIN touch n ON n.image_id = r.image_id AND n.a = r.run),
    parts AS (SELECT image_id, run, min(root) AS root FROM spread GROUP BY ALL),
    comps AS (SELECT s.image_id, p.root, min(s.x0) AS x0, min(s.y) AS y0, max(s.x1) AS x1, max(s.y) + 1 AS y1 FROM strokes s JOIN parts p USING (image_id, run) GROUP BY s.image_id, p.root),
    boxes AS MATERIALIZED (SELECT c.image_id, d.block, (SELECT count(*) FROM cuts k WHERE k.image_id = c.image_id AND k.block = d.block AND k.cut <= (c.y0 + c.y1 - 1) // 2) AS line, c.root, c.x0, c.y0, c.x1, c.y1
        FROM comps c JOIN dots d ON d.image_id = c.image_id AND d.y * 4294967296 + d.x = c.root)"""

_FITS = """feet AS (SELECT image_id, block, line, (x0 + x1) / 2 AS x, y1::DOUBLE AS y, row_number() OVER (PARTITION BY image_id, block, line ORDER BY x0 + x1, y1, root) AS k, count(*) OVER (PARTITION BY image_id, block, line) AS n FROM boxes),
    pairs AS (SELECT a.image_id, a.block, a.line, a.k AS ka, b.k AS kb, (b.y - a.y) / (b.x - a.x) AS slope, a.y - (b.y - a.y) / (b.x - a.x) * a.x AS off FROM feet a JOIN feet b USING (image_id, block, line) WHERE a.k <= 3 AND b.k > b.n - 3 AND a.x < b.x),
    tried AS (SELECT * FROM pairs UNION ALL SELECT image_id, block, line, 0, 0, 0.0, y FROM feet f WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.image_id = f.image_id AND p.block = f.block AND p.line = f.line)),
    errors AS (SELECT t.*, f.n, round(pow(f.y - t.off - t.slope * f.x, 2), 6) AS r FROM tried t JOIN feet f USING (image_id, block, line)),
    medians AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, block, line, ka, kb ORDER BY r) AS rank FROM errors) WHERE rank = n // 2 + 1),
    fits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, block, line ORDER BY r, ka, kb) AS place FROM medians) WHERE place = 1)"""


@query("page_baselines", f"WITH RECURSIVE {COMPONENTS}, {_FITS} SELECT image_id, block::BIGINT AS block, line::INT AS line, round(slope, 6) + 0.0 AS slope, round(off, 6) + 0.0 AS off, r AS error, n FROM fits")
def _(s, d):
    found = page.baselines(page.line_components(page_bits(s, d), PAGE_GAPS, PAGE_CORE))
    return found.select("image_id", "block", "line", (F.round("slope", 6) + F.lit(0.0)).alias("slope"), (F.round("offset", 6) + F.lit(0.0)).alias("off"), "error", "n")


_WORDS = """spaced AS (SELECT *, greatest(x0 - max(x1) OVER (PARTITION BY image_id, block, line ORDER BY x0, y0, root ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap, x0 > min(x0) OVER (PARTITION BY image_id, block, line) AS later FROM boxes),
    marked_ AS (SELECT *, row_number() OVER (PARTITION BY image_id, block, line ORDER BY x0, y0, root) AS k FROM spaced),
    gaps AS (SELECT image_id, block, line, gap FROM marked_ WHERE k > 1),
    levels AS (SELECT DISTINCT image_id, block, line, gap AS level FROM gaps),
    splits AS (SELECT l.image_id, l.block, l.line, l.level, count(*) FILTER (WHERE gap <= level) AS a, count(*) FILTER (WHERE gap > level) AS b, avg(gap) FILTER (WHERE gap <= level) AS ma, avg(gap) FILTER (WHERE gap > level) AS mb FROM levels l JOIN gaps g USING (image_id, block, line) GROUP BY ALL),
    chosen AS (SELECT image_id, block, line, CASE WHEN count(*) = 1 THEN min(level) ELSE arg_min(level, (-coalesce(round(a::DOUBLE * b * (ma - mb) * (ma - mb), 9), 0), level)) END AS space FROM splits GROUP BY ALL),
    worded AS (SELECT m.*, sum(CASE WHEN k > 1 AND gap > space THEN 1 ELSE 0 END) OVER (PARTITION BY m.image_id, m.block, m.line ORDER BY k) AS word FROM marked_ m LEFT JOIN chosen c USING (image_id, block, line))"""


@query("page_words", f"WITH RECURSIVE {COMPONENTS}, {_WORDS} SELECT image_id, block::BIGINT AS block, line::INT AS line, word::INT AS word, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM worded GROUP BY image_id, block, line, word")
def _(s, d):
    return page.word_boxes(page.line_components(page_bits(s, d), PAGE_GAPS, PAGE_CORE))


# -- columns -------------------------------------------------------------------


def column_boxes(s, d):
    """Order lines as boxes in three columns of a supplier's page; seventh lines span them all."""
    li = A.table(s, d, "lineitem")
    span, at = F.col("l_linenumber") == 7, (F.col("l_linenumber") % 3) * 330 + F.col("l_partkey") % 3
    x0 = F.when(span, F.lit(0)).otherwise(at)
    y0 = F.col("l_orderkey") * 37 % 4000
    rows = li.select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), x0.alias("x0"), y0.alias("y0"), F.when(span, 980).otherwise(x0 + 20 + F.floor(F.col("l_quantity") * 5)).alias("x1"), (y0 + 9).alias("y1"))
    return rows.distinct()


COLUMN_BOXES = """boxes AS (SELECT DISTINCT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 7 THEN 0 ELSE l_linenumber % 3 * 330 + l_partkey % 3 END AS x0, l_orderkey * 37 % 4000 AS y0,
    CASE WHEN l_linenumber = 7 THEN 980 ELSE l_linenumber % 3 * 330 + l_partkey % 3 + 20 + floor(l_quantity * 5)::BIGINT END AS x1, l_orderkey * 37 % 4000 + 9 AS y1 FROM lineitem)"""
STOPS = f"""{COLUMN_BOXES}, edges AS (SELECT page, 'left' AS side, x0 AS x FROM boxes UNION ALL SELECT page, 'right', x1 FROM boxes), hist AS (SELECT page, side, x, count(*) AS n FROM edges GROUP BY ALL),
    held AS (SELECT a.page, a.side, a.x, sum(b.n)::BIGINT AS support, (SELECT sum(n) FROM hist h WHERE h.page = a.page AND h.side = a.side) AS total FROM hist a JOIN hist b ON b.page = a.page AND b.side = a.side AND abs(a.x - b.x) <= 4 GROUP BY a.page, a.side, a.x),
    stops AS (SELECT page, side, x, support FROM held a WHERE support >= 0.1 * total AND NOT EXISTS (SELECT 1 FROM held b WHERE b.page = a.page AND b.side = a.side AND abs(a.x - b.x) <= 40 AND (b.support > a.support OR (b.support = a.support AND b.x < a.x))))"""
ORDERED = f"""{STOPS}, placed AS (SELECT b.*, greatest((SELECT count(*) FROM stops s WHERE s.page = b.page AND side = 'left' AND s.x <= b.x0 + 4) - 1, 0) AS col, EXISTS (SELECT 1 FROM stops s WHERE s.page = b.page AND side = 'left' AND s.x > b.x0 + 4 AND s.x < b.x1 - 4) AS spans FROM boxes b),
    banded AS (SELECT *, sum(spans::INT) OVER (PARTITION BY page ORDER BY y0, spans DESC, x0, id, x1, y1) AS band, CASE WHEN spans THEN -1 ELSE col END AS c FROM placed),
    begun AS (SELECT *, coalesce((y0 - max(y1) OVER (PARTITION BY page, band, c ORDER BY y0, x0, id, x1, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 24)::INT, 1) AS starts FROM banded),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY band, c, y0, x0, id, x1, y1) - 1 AS ord, sum(starts) OVER (PARTITION BY page ORDER BY band, c, y0, x0, id, x1, y1) - 1 AS block FROM begun)"""


@query("page_tabs", f"WITH {STOPS} SELECT page, side, x, support FROM stops")
def _(s, d):
    return columns.tab_stops(column_boxes(s, d))


@query("page_order", f"WITH {ORDERED} SELECT page, id, x0, y0, x1, y1, col::INT AS col, spans, band::INT AS band, block::INT AS block, ord::INT AS ord FROM ordered")
def _(s, d):
    return columns.reading_order(column_boxes(s, d))


@query("page_blocks", f"WITH {ORDERED} SELECT page, block::INT AS block, band::INT AS band, col::INT AS col, spans, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM ordered GROUP BY page, block, band, col, spans")
def _(s, d):
    return columns.blocks(columns.reading_order(column_boxes(s, d)))


# -- tight boxes of recognised words -------------------------------------------


@query(
    "out_tightbounds",
    f"""{catalog.CLOSURE}, tiles AS (SELECT image_id, root, min(i % 64) AS x0, min(i // 64) AS y0, max(i % 64) + 1 AS x1, max(i // 64) + 1 AS y1 FROM named GROUP BY image_id, root),
    strips AS (SELECT * FROM (WITH {A.PROBS8}, {A.scored_sql(catalog.BLANK8)}, {catalog.WORDS}, {catalog._BOXED} SELECT line_id * 1000 + word AS strip, line_id // 1000 * 200 // 64 AS image_id, (x0 - {catalog.BOX[0]}) % 64 AS x0, (x0 - {catalog.BOX[0]}) % 64 + x1 - x0 AS x1 FROM boxed))
    SELECT s.image_id, s.strip, min(t.x0)::INT AS x0, min(t.y0)::INT AS y0, max(t.x1)::INT AS x1, max(t.y1)::INT AS y1, count(*) AS n FROM strips s JOIN tiles t ON t.image_id = s.image_id AND (t.x0 + t.x1 - 1) // 2 >= s.x0 AND (t.x0 + t.x1 - 1) // 2 < s.x1 GROUP BY s.image_id, s.strip""",
)
def _(s, d):
    """The words of out_wordbounds as strips of the tile their line begins in (columns taken modulo its width), tightened to its components."""
    p = A.probs8(s, d)
    scored = decode.scores(p, catalog.BLANK8)
    words = decode.word_boxes(decode.words(scored, catalog.SPACE), decode.boundaries(scored, decode.widths(p)), catalog.SCALE, catalog.BOX)
    x0 = (F.col("x0") - catalog.BOX[0]) % 64
    strips = words.select(F.expr("line_id div 1000 * 200 div 64").alias("image_id"), (F.col("line_id") * 1000 + F.col("word")).alias("strip"), x0.alias("x0"), (x0 + F.col("x1") - F.col("x0")).alias("x1"))
    return page.tight_boxes(strips, runs.components(catalog.inked(s, d, catalog.THIN), 4))
