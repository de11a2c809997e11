"""Every query runs; those with SQL give the rows that SQL gives; kernels give what joins give."""

import math

import duckdb
import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioworks.functions import ctc, raster
from folioworks.operators import decode, pixels, spatial
from folioworks.plans import adapters, catalog, page_queries, recurrent_queries, training_queries  # noqa: F401
from folioworks.sources import images

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    key = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v)
    fix = lambda v: None if pd.isna(v) else v.item() if hasattr(v, "item") else v
    return cols, sorted(tuple(key(fix(v)) for v in r) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name not in catalog.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    (a, x), (b, y) = rows(got), rows(want)
    assert a == b and len(x) == len(y)
    assert x == y


def image_rows(spark, a):
    return spark.createDataFrame([(0, y, x, int(v)) for (y, x), v in np.ndenumerate(a)], "image_id long, y int, x int, v int")


def array(df):
    return pixels.dense(df.toPandas())


@pytest.mark.parametrize("seed", [1, 2])
def test_kernels_equal_relational_forms(spark, seed):
    rnd = np.random.RandomState(seed)
    gray, bits = rnd.randint(0, 256, (15, 19)).astype(np.uint8), (rnd.rand(15, 19) < 0.4).astype(np.uint8)
    g, b = image_rows(spark, gray), image_rows(spark, bits)
    for got, want in (
        (pixels.otsu(g), raster.otsu(gray)),
        (pixels.sauvola(g, 7, 0.3), raster.sauvola(gray, 7, 0.3)),
        (pixels.unsharp(g, 2, 0.4), raster.unsharp(gray, 2, 0.4)),
        (pixels.halve(g), raster.halve(gray)),
        (pixels.dilate(b, 4, 3), raster.dilate(bits, 4, 3)),
        (pixels.erode(b, 2, 3), raster.erode(bits, 2, 3)),
        (pixels.rotate(b, 0.3), raster.rotate(bits, 0.3)),
    ):
        assert np.array_equal(array(got), want)
    black, white = raster.black_white(gray)
    row = pixels.black_white(g).first()
    assert (row.black, row.white) == pytest.approx((black, white))
    assert pixels.skew(b).first().degrees == pytest.approx(math.degrees(raster.skew_angle(bits)), abs=1e-6)


def test_boxes(spark):
    box = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 5, 5, 30, 30), (3, 90, 90, 120, 140), (4, 7, 7, 7, 9)], "id long, x0 long, y0 long, x1 long, y1 long")
    ask = spark.createDataFrame([(1, 0, 0, 5, 5), (2, 6, 6, 7, 7), (3, 200, 95, 300, 300), (4, 0, 0, 100, 100), (5, 10, 0, 12, 5)], "q long, x0 long, y0 long, x1 long, y1 long")
    got = {}
    for r in spatial.overlapping(ask, box, 16, (0, 0, 100, 100)).collect():
        got.setdefault(r.q, set()).add(r.id)
    assert got == {1: {1}, 2: {1, 2}, 4: {1, 2, 3}}
    with pytest.raises(ValueError):
        spatial.cells(box, 0, (0, 0, 1, 1))


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_equal_query_boxes_are_joined_once(spark, few, monkeypatch):
    """Pairs by brute force: queries that share a box, have several or no number, ids of several boxes; the plan sorts out no pair after queries took theirs."""
    monkeypatch.setattr(spatial, "FEW", few)
    rnd = np.random.RandomState(7)
    rows = lambda n, ids: [(int(rnd.randint(ids)), int(x), int(y), int(x + rnd.randint(-2, 40)), int(y + rnd.randint(1, 40))) for x, y in rnd.randint(-20, 130, (n, 2))]
    boxes, asked = rows(150, 90), rows(40, 60)
    asked += [(100 + i, *r[1:]) for i, r in enumerate(asked[:25])] + [(None, *asked[0][1:]), (None, *asked[3][1:])]
    box = spark.createDataFrame(boxes, "id long, x0 long, y0 long, x1 long, y1 long")
    out = spatial.overlapping(spark.createDataFrame(asked, "q long, x0 long, y0 long, x1 long, y1 long"), box, 16, (0, 0, 100, 100))
    got = [(r.q, r.id) for r in out.collect()]
    want = {(q, i) for q, a0, b0, a1, b1 in asked for i, x0, y0, x1, y1 in boxes if a0 < a1 and b0 < b1 and x0 < x1 and y0 < y1 and x0 < a1 and a0 < x1 and y0 < b1 and b0 < y1}
    assert len(got) == len(want) and set(got) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Project [q#") and "Join" in plan.splitlines()[1]


def test_pairs_of_boxes_take_little_disk(spark, tmp_path, monkeypatch):
    """Tasks get a bounded number of boxes, and pairs lie so that files of them are small; pairs are right where ids have one, few or many boxes."""
    monkeypatch.setattr(spatial, "DEALT", 2000)
    rnd = np.random.RandomState(3)
    places = lambda n, w, h: [(int(x), int(y)) for x, y in zip(rnd.randint(0, w, n), rnd.randint(0, h, n), strict=True)]
    boxes = [(int(rnd.randint(1 << 40)), x, y, x + int(rnd.randint(1, 50)), y + int(rnd.randint(1, 8)) * 5) for x, y in places(10_000, 1000, 1400)]
    for k in range(2, 9):  # ids of k boxes, near each other
        boxes += [(k, x + 15 * i, y, x + 15 * i + 30, y + 20) for x, y in [places(1, 800, 1300)[0]] for i in range(k)]
    shapes = [(x, y, x + 300, y + 300) for x, y in places(60, 900, 1300)]
    asked = [(60 * k + i, *b) for k in range(4) for i, b in enumerate(shapes)]
    box, ask = (spark.createDataFrame(r, f"{k} long, x0 long, y0 long, x1 long, y1 long") for k, r in (("id", boxes), ("q", asked)))
    out = spatial.overlapping(ask, box, 64, (0, 0, 1000, 1400))
    out.write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    met = {(i, id_) for i, (a0, b0, a1, b1) in enumerate(shapes) for id_, x0, y0, x1, y1 in boxes if x0 < a1 and a0 < x1 and y0 < b1 and b0 < y1}
    got = pairs.toPandas()
    assert len(got) == 4 * len(met) and set(zip(got.q, got.id, strict=True)) == {(60 * k + i, id_) for i, id_ in met for k in range(4)}
    tasks = out.rdd.getNumPartitions()
    assert tasks >= len(boxes) / 2000
    pairs.repartition(tasks, "id").sortWithinPartitions("id").write.parquet(f"{tmp_path}/by_id")
    of_q = lambda name: sum(pq.read_metadata(p).row_group(0).column(0).total_compressed_size for p in (tmp_path / name).glob("*.parquet") if pq.read_metadata(p).num_rows)
    assert of_q("pairs") < 0.8 * of_q("by_id")


def test_decoding_equals_kernel(spark, sf):
    probs = adapters.probs8(spark, sf)
    got = {(r.line_id, r.idx): (r.start, r.end, r.certainty) for r in decode.scores(probs, 7).collect()}
    want = {}
    for line, part in probs.toPandas().sort_values("t").groupby("line_id"):
        p = np.stack(part["features"])
        for i, s in enumerate(ctc.score(p, ctc.greedy(p, 7, {c: c for c in range(7)}))):
            want[line, i] = (s.start, s.end, s.certainty)
    assert got.keys() == want.keys()
    assert all(got[k][:2] == want[k][:2] and abs(got[k][2] - want[k][2]) < 1e-9 for k in want)


def test_charset_lookups_hold_all_ids(spark, tmp_path):
    text = "".join(chr(0x4E00 + i) for i in range(200))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.text for r in catalog.QUERIES["lex_charset"](spark, str(tmp_path)).collect()}
    assert got == {i: text[i - 3] if 3 <= i < 203 else "" for i in range(204)}
    got = {r.id: r.code for r in catalog.QUERIES["lex_encode"](spark, str(tmp_path)).collect()}
    assert got == {0: "0", 1: "201", 2: "201", 203: None} | {i: str(i - 2) for i in range(3, 203)}


def test_lines_without_words_and_codes_without_characters(spark):
    """Line 1 is all blank, line 2 has a code that stands for nothing, line 3 a word, a space and a word."""
    one = lambda *codes: [[0.97 if c == k else 0.01 for k in range(4)] for c in codes]
    rows = [(line, t, p) for line, codes in ((1, (3, 3)), (2, (2, 3, 1)), (3, (1, 0, 1))) for t, p in enumerate(one(*codes))]
    probs = spark.createDataFrame(rows, "line_id long, t int, features array<double>")
    chars = spark.createDataFrame([(0, " "), (1, "a")], "code int, text string")
    got = {r.line_id: (r.text, r.n_words, r.confidence > 0, r.error) for r in decode.lines(probs, chars, 3, 0).collect()}
    assert got == {1: ("", 0, False, None), 2: (None, 1, True, "code 2 stands for no character"), 3: ("a a", 2, True, None)}
    words = {(r.line_id, r.word): r.text for r in decode.recognize(probs, chars, 3, 0, 1.0, (0, 0, 9, 9)).collect()}
    assert words == {(2, 0): None, (3, 0): "a", (3, 1): "a"}


def test_error_rate_of_whole_texts(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    texts = ["", "a", "é", "naïve Zoë", "naive Zoe", "x" * 300 + "y", "y" + "x" * 300]
    pairs = [(a, b) for a in texts for b in texts]
    got = spark.createDataFrame(pairs, "got string, want string").select("got", "want", decode.error_rate(F.col("got"), F.col("want")).alias("e")).collect()
    assert all(r.e == (distance(r.got, r.want) / len(r.want) if r.want else float(bool(r.got))) for r in got)


def test_pages_become_pixels(spark):
    """A page of 1000 x 1400 in seconds, null and empty images without rows."""
    page = np.random.RandomState(3).randint(0, 256, (1400, 1000)).astype(np.uint8)
    rows = [(1, 1000, 1400, bytearray(page.tobytes())), (2, 0, 0, bytearray()), (3, 5, 5, None)]
    out = images.explode_pixels(spark.createDataFrame(rows, "image_id long, width int, height int, pix binary"))
    got = out.groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("v") * (F.col("x") + 1000 * F.col("y"))).alias("s")).collect()
    assert [(r.image_id, r.n, r.s) for r in got] == [(1, page.size, int((page.ravel().astype(np.int64) * np.arange(page.size)).sum()))]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
