"""Components, lines and crops of drawn pages; large images split over tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioworks.functions import raster
from folioworks.operators import page, pixels, runs
from folioworks.plans import adapters as A
from folioworks.plans import recognize as R


def image_rows(spark, a, image=0):
    return spark.createDataFrame([(image, y, x, int(v)) for (y, x), v in np.ndenumerate(a)], "image_id long, y int, x int, v int")


def spiral(n):
    a = np.zeros((n, n), np.uint8)
    x, y, dx, dy, step = 0, 0, 1, 0, n
    while step > 1:
        for _ in range(2):
            for _ in range(step - 1):
                a[y, x] = 1
                x, y = x + dx, y + dy
            dx, dy = -dy, dx
            step -= 1 if (dx, dy) in ((0, 1), (0, -1)) else 0
        step -= 1
    return a


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_the_kernel(spark, connectivity, seed):
    rnd = np.random.RandomState(seed)
    a = (rnd.rand(70, 90) < (0.55 if connectivity == 4 else 0.4)).astype(np.uint8) if seed == 1 else spiral(41)
    got = pixels.components(image_rows(spark, a).unionByName(image_rows(spark, a[:9, :9], 5)), connectivity).orderBy("image_id", "comp").collect()
    for i, b in ((0, a), (5, a[:9, :9])):
        assert [(r.x0, r.y0, r.x1, r.y1, r.pixels) for r in got if r.image_id == i] == raster.components(b, connectivity)
    seeds = np.zeros_like(a)
    seeds[::13, ::7] = 1
    filled = runs.seed_fill(image_rows(spark, seeds), image_rows(spark, a), connectivity).collect()
    want = raster.seed_fill(seeds & a, a, connectivity)
    assert {(r.y, r.x) for r in filled} == set(zip(*map(lambda v: v.tolist(), np.nonzero(want))))
    far = {(r.y, r.x): r.d for r in runs.distance(image_rows(spark, a)).collect()}
    assert far == {(y, x): int(d) for (y, x), d in np.ndenumerate(raster.city_block(a)) if a[y, x]}


def test_labels_do_not_go_through_the_driver(spark):
    """However small the files of labels are, no join of them is a broadcast."""
    rnd = np.random.RandomState(3)
    a = (rnd.rand(30, 40) < 0.4).astype(np.uint8)
    bits = image_rows(spark, a).cache()
    boxes = page.line_components(bits, (4, 4, 2), 2)
    for df in (runs.components(bits, 4), runs.seed_fill(bits.where("x % 5 = 0"), bits, 4), boxes, page.baselines(boxes), page.word_boxes(boxes)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan


def test_components_without_ink_or_images(spark):
    paper = image_rows(spark, np.zeros((3, 4), np.uint8))
    assert pixels.components(paper, 8).count() == 0 and runs.distance(paper).count() == 0
    assert page.text_lines(paper.where("false")).count() == 0 and page.text_lines(paper).count() == 0
    with pytest.raises(ValueError):
        pixels.components(paper, 6)


def test_a_large_image_splits(spark):
    """A comb of 1500 teeth: one component of 2,249,250 pixels, in no task's hands alone."""
    n = 1500
    bits = spark.range(0, n * n, numPartitions=8).select(F.lit(1).cast("long").alias("image_id"), F.expr(f"int(id div {n})").alias("y"), (F.col("id") % n).cast("int").alias("x"))
    bits = bits.withColumn("v", ((F.col("y") == 0) | (F.col("x") % 3 == 0)).cast("int"))
    found = pixels.components(bits, 4)
    assert "Pandas" not in found._jdf.queryExecution().toString()
    r = found.collect()
    assert [(x.x0, x.y0, x.x1, x.y1, x.pixels) for x in r] == [(0, 0, n, n, n + (n - 1) * 500)]


def drawn():
    """Two columns of three lines each; letters are bars, some with stems above and below."""
    a = np.zeros((120, 260), np.uint8)
    boxes = []
    for x0 in (10, 150):
        for y0 in (12, 42, 72):
            for k in range(14):
                x = x0 + 7 * k
                a[y0 : y0 + 10, x : x + 5] = 1
            a[y0 - 5 : y0, x0 : x0 + 2] = 1
            a[y0 + 10 : y0 + 14, x0 + 14 : x0 + 16] = 1
            boxes.append((x0, y0 - 5, x0 + 96, y0 + 14))
    return a, boxes


def test_lines_of_two_columns(spark):
    a, boxes = drawn()
    got = page.text_lines(image_rows(spark, a), gaps=(30, 20, 10)).collect()
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in got) == sorted(boxes) and {r.line for r in got} == {0}
    assert sum(r.ink for r in got) == a.sum()


def test_lines_that_touch_are_cut_in_the_valley(spark):
    a, boxes = drawn()
    for x0 in (10, 150):
        for y0 in (12, 42):
            a[y0 + 10 : y0 + 30, x0 + 14 : x0 + 16] = 1
    got = page.text_lines(image_rows(spark, a), gaps=(30, 20, 10)).orderBy("block", "line").collect()
    assert [(r.x0, r.y0, r.x1, r.y1, r.line) for r in got] == [(x, y, x + 96, z, i) for x in (10, 150) for i, (y, z) in enumerate(((7, 22), (22, 52), (52, 86)))]
    assert len({r.block for r in got}) == 2 and sum(r.ink for r in got) == a.sum()


def test_tilted_page_to_recognition(spark):
    a, boxes = drawn()
    tilted = raster.rotate(a, np.deg2rad(1.5))
    gray = image_rows(spark, np.where(tilted, 30, 220).astype(np.uint8), 3)
    lines = page.find_lines(gray, gaps=(30, 20, 10))
    got = lines.orderBy("line_id").collect()
    assert len(got) == 6 and all(r.line_id >> 20 == 3 for r in got)
    assert sorted(r.x1 - r.x0 for r in got) == pytest.approx([96] * 6, abs=6) and all(14 <= r.y1 - r.y0 <= 24 for r in got)
    crops = page.line_images(gray, lines, 2).collect()
    for r in crops:
        assert len(r.pix) == r.width * r.height
    read = R.recognize_lines(page.line_images(gray, lines, 2), R.Recognizer.of(A.tiny_model())).collect()
    assert len(read) == 6 and all(r.error is None for r in read)


def test_smears_and_valleys(spark):
    a = np.array([[1, 0, 0, 1, 0, 0, 0, 1], [0] * 8, [1] + [0] * 7], np.uint8)
    along = pixels.dense(page.smear(image_rows(spark, a), "x", 2).toPandas())
    assert along.tolist() == [[1, 1, 1, 1, 0, 0, 0, 1], [0] * 8, [1] + [0] * 7]
    down = pixels.dense(page.smear(image_rows(spark, a), "y", 1).toPandas())
    assert down[:, 0].tolist() == [1, 1, 1]
    rows = [5, 6, 1, 0, 0, 2, 7, 7, 1, 6, 1, 5, 5]
    prof = spark.createDataFrame([(0, 1, y, n) for y, n in enumerate(rows)], "image_id long, block long, y int, n long")
    assert [r.cut for r in page.valley_cuts(prof).orderBy("cut").collect()] == [3, 8]
    assert [r.cut for r in page.valley_cuts(prof, 1).orderBy("cut").collect()] == [3, 8, 10]
