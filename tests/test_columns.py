"""Columns, reading order, baselines and words on drawn pages."""

import itertools
import random

import numpy as np
import pytest

from folioworks.operators import columns, page

BOX = "page long, id long, x0 long, y0 long, x1 long, y1 long"


def drawn(rnd, page_id):
    """Two or three columns of boxes with jittered left edges, headings across them at times."""
    n, rows, y = rnd.choice([2, 3]), [], 0
    number = itertools.count()
    for _ in range(rnd.randint(1, 3)):
        if rnd.random() < 0.7:
            rows.append((page_id, next(number), 0, y, n * 300 - 20, y + 12))
            y += 20
        depth = []
        for c in range(n):
            at = y
            for _ in range(rnd.randint(4, 9)):
                x = c * 300 + rnd.randint(0, 3)
                rows.append((page_id, next(number), x, at, x + rnd.randint(40, 270), at + 10))
                at += 14 if rnd.random() < 0.8 else 60
            depth.append(at)
        y = max(depth) + 10
    return rows


def test_reading_order_is_a_topological_order(spark):
    rnd = random.Random(1)
    pages = [drawn(rnd, i) for i in range(6)]
    rows = [r for p in pages for r in p]
    rnd.shuffle(rows)
    got = columns.reading_order(spark.createDataFrame(rows, BOX).repartition(5)).collect()
    at = {(r.page, r.id): r for r in got}
    assert len(at) == len(rows)
    for p in pages:
        assert sorted(at[r[0], r[1]].ord for r in p) == list(range(len(p)))
        for a, b in itertools.permutations(p, 2):
            apart = a[4] <= b[2] or b[4] <= a[2]
            above = a[5] <= b[3]
            # nothing lies between two boxes side by side and spans both
            walls = [c for c in p if c not in (a, b) and c[2] < min(a[4], b[4]) and c[4] > max(a[2], b[2]) and min(a[3], b[3]) <= c[3] <= max(a[3], b[3])]
            if above and not apart or apart and a[4] <= b[2] and not walls:
                assert at[a[0], a[1]].ord < at[b[0], b[1]].ord, (a, b)
    for r in got:
        assert r.spans == (r.x1 - r.x0 > 300) and (r.spans or r.col == r.x0 // 300)
    blocks = columns.blocks(spark.createDataFrame(got)).collect()
    assert sum(b.n for b in blocks) == len(rows) and all(len({(r.band, r.col) for r in got if (r.page, r.block) == (b.page, b.block)}) == 1 for b in blocks)


def test_stops_of_scattered_boxes(spark):
    one = spark.createDataFrame([(1, 1, 5, 5, 9, 9)], BOX)
    assert sorted((r.side, r.x, r.support) for r in columns.tab_stops(one).collect()) == [("left", 5, 1), ("right", 9, 1)]
    assert columns.reading_order(one.where("false")).count() == 0
    # of stops with equal support near each other the leftmost stays
    two = spark.createDataFrame([(1, i, x, i, x + 500, i + 1) for i, x in enumerate((10, 10, 30, 30, 200))], BOX)
    assert sorted(r.x for r in columns.tab_stops(two, share=0.3).collect() if r.side == "left") == [10]


def feet(spark, lines):
    rows = [(0, 1, i, k, int(x), int(y) - 10, int(x) + 6, int(y)) for i, pts in enumerate(lines) for k, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "image_id long, block long, line int, root long, x0 int, y0 int, x1 int, y1 int")


def test_baselines_ignore_outliers(spark):
    x = np.arange(21) * 10
    true = 100 + 0.1 * (x + 3)
    y = true.copy()
    y[[2, 5, 9, 11, 14, 18]] += 25
    y[[0, 20]] -= 40
    level = [(i * 9, 50) for i in range(6)]
    got = {r.line: r for r in page.baselines(feet(spark, [list(zip(x, y)), level, [(5, 7), (5, 30)], [(4, 9)]])).collect()}
    assert got[0].slope == pytest.approx(0.1, abs=0.012) and got[0].offset == pytest.approx(100, abs=1.5)
    assert (got[1].slope, got[1].offset, got[1].error, got[1].n) == (0.0, 50.0, 0.0, 6)
    assert (got[2].slope, got[2].offset) == (0.0, 7.0) and (got[3].slope, got[3].offset, got[3].n) == (0.0, 9.0, 1)


def brute_baseline(points):
    points = sorted(points)
    n, best = len(points), None
    for a in range(min(3, n)):
        for b in range(max(0, n - 3), n):
            (xa, ya), (xb, yb) = points[a], points[b]
            if xa < xb:
                s = (yb - ya) / (xb - xa)
                r = sorted(round((y - ya - s * (x - xa)) ** 2, 6) for x, y in points)[n // 2]
                best = min(best or (r, a, b, s), (r, a, b, s))
    return best


def test_baselines_by_brute_force(spark):
    rnd = random.Random(3)
    lines = [[(x, rnd.randint(20, 40)) for x in rnd.sample(range(0, 300, 3), rnd.randint(2, 12))] for _ in range(12)]
    got = {r.line: r for r in page.baselines(feet(spark, lines)).collect()}
    for i, pts in enumerate(lines):
        r, _, _, s = brute_baseline([(x + 3, y) for x, y in pts])
        assert got[i].error == pytest.approx(r, abs=1e-5) and got[i].slope == pytest.approx(s, abs=1e-9)


def test_words_by_gaps(spark):
    """Gaps of 2 within words, 9 between them; a line of even gaps is one word; boxes that overlap have none."""
    x, line = 0, []
    for word in (4, 2, 5):
        for _ in range(word):
            line.append((x, 20))
            x += 8
        x += 7
    even = [(i * 9, 20) for i in range(5)]
    overlapping = [(0, 20), (3, 20), (4, 20), (30, 20)]
    got = page.word_boxes(feet(spark, [line, even, overlapping, [(3, 20)]])).orderBy("line", "word").collect()
    assert [(r.line, r.word, r.n) for r in got] == [(0, 0, 4), (0, 1, 2), (0, 2, 5), (1, 0, 5), (2, 0, 3), (2, 1, 1), (3, 0, 1)]
    assert (got[0].x0, got[0].x1, got[0].y0, got[0].y1) == (0, 30, 10, 20)


def test_words_of_equal_splits(spark):
    """Gaps 1, 2, 0, 1 split as well behind 0 as behind 1 (16/3 both): the smaller counts, though a last place may differ."""
    line = [(0, 20), (7, 20), (15, 20), (21, 20), (28, 20)]
    rows = page.word_gaps(feet(spark, [line])).orderBy("x0").collect()
    assert [r.gap for r in rows] == [None, 1, 2, 0, 1] and {r.space for r in rows} == {0}
    assert [r.n for r in page.word_boxes(feet(spark, [line])).orderBy("word").collect()] == [1, 1, 2, 1]


def test_tight_boxes_of_strips(spark):
    """Components by their middle column, strips that lie over each other, without ink, or empty."""
    rnd = random.Random(5)
    comps = [(i % 2, x, rnd.randint(0, 30), x + rnd.randint(1, 20), 40) for i, x in enumerate(rnd.sample(range(400), 60))]
    strips = [(i % 3, i, a, a + rnd.randint(-1, 90)) for i, a in enumerate(rnd.sample(range(-40, 420), 40))]
    got = page.tight_boxes(spark.createDataFrame(strips, "image_id long, strip long, x0 int, x1 int"), spark.createDataFrame(comps, "image_id long, x0 int, y0 int, x1 int, y1 int"))
    want = {}
    for image, strip, lo, hi in strips:
        mine = [c for c in comps if c[0] == image and lo <= (c[1] + c[3] - 1) // 2 < hi]
        if mine:
            want[image, strip] = (min(c[1] for c in mine), min(c[2] for c in mine), max(c[3] for c in mine), max(c[4] for c in mine), len(mine))
    assert {(r.image_id, r.strip): (r.x0, r.y0, r.x1, r.y1, r.n) for r in got.collect()} == want and want
