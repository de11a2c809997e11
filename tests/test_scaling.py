"""Scaling by grouped sums against the kernel."""

import numpy as np
import pytest

from folioworks.functions import raster
from folioworks.operators import pixels, scaling


@pytest.mark.parametrize("factor", [0.015, 0.1, 0.0625, 0.5, 0.33, 0.64, 0.7, 0.93, 1.0, 1.37, 1.5, 2.0, 3.3, 4.0])
def test_scales_equal_the_kernel(spark, factor):
    rnd = np.random.RandomState(int(factor * 1000))
    images = [rnd.randint(0, 256, s).astype(np.uint8) for s in (((140, 97), (60, 201)) if factor < 0.02 else ((33, 21), (40, 47)))]
    rows = [(i, y, x, int(v)) for i, a in enumerate(images) for (y, x), v in np.ndenumerate(a)]
    out = scaling.scale_gray(spark.createDataFrame(rows, "image_id long, y int, x int, v int"), factor).toPandas()
    for i, a in enumerate(images):
        got, want = pixels.dense(out[out["image_id"] == i]), raster.scale_gray(a, factor)
        assert got.shape == want.shape and np.array_equal(got, want)


def test_scales_of_nothing(spark):
    none = spark.createDataFrame([], "image_id long, y int, x int, v int")
    assert all(scaling.scale_gray(none, f).count() == 0 for f in (0.01, 0.4, 2.0, 1.3))
    with pytest.raises(ValueError):
        scaling.scale_gray(none, 0.0)


def test_sums_and_pages_are_dealt_to_all_tasks(spark, sf):
    """What reads few bytes but makes many rows, or sorts pages, keeps a stated number of tasks."""
    from folioworks.plans import catalog, page_queries  # noqa: F401

    for name in ("img_scale_4x", "page_blocks"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan
