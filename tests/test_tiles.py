import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.operators import layout, tiles


def boxes(rng, n, pages):
    """Boxes of very different sizes, on and off tile edges, some without extent, null or not finite."""
    out = []
    for i in range(n):
        size = 2.0 ** rng.choice([-3, 0, 1, 3, 5, 8, 11])
        x, y = (rng.choice([rng.randrange(-64, 64) * 8.0, rng.uniform(-300, 300)]) for _ in "xy")
        w, h = (rng.choice([size, rng.uniform(0, size), 0.0]) for _ in "wh")
        out.append((rng.randrange(pages) if rng.random() < 0.95 else None, i, x, y, x + w, y + h))
    return out + [(0, n, None, 0.0, 1.0, 1.0), (0, n + 1, float("nan"), 0.0, 9.0, 9.0), (0, n + 2, 0.0, 0.0, float("inf"), 9.0), (0, n + 3, -1e9, -1e9, 1e9, 1e9), (0, n + 4, 5.0, 5.0, 1.0, 9.0)]


def meets(a, b):
    finite = lambda v: all(x is not None and abs(x) < 2.0**52 for x in v[2:])
    return a[0] is not None and a[0] == b[0] and finite(a) and finite(b) and max(a[2], b[2]) < min(a[4], b[4]) and max(a[3], b[3]) < min(a[5], b[5])


@pytest.mark.parametrize(("seed", "few"), [(0, 0), (1, 16), (2, 50)])
def test_like_all_pairs(spark, seed, few):
    rng = random.Random(seed)
    left, right = boxes(rng, 150, 3), boxes(rng, 200, 3)
    frame = lambda rows, name, box: spark.createDataFrame(rows, "page int, pos int, x0 double, y0 double, x1 double, y1 double").select("page", F.col("pos").alias(name), G.box("x0", "y0", "x1", "y1").alias(box))
    found = [(r.i, r.j) for r in tiles.meeting(frame(left, "i", "a"), frame(right, "j", "b"), ["page"], few=few).collect()]
    want = {(a[1], b[1]) for a in left for b in right if meets(a, b)}
    assert len(found) == len(set(found)) and set(found) == want and want


def test_hot_page_meets_few_pairs(spark):
    """10**5 boxes on one page: pairs met within a small factor of pairs kept, over many tasks, and no nested loop."""
    n = 100_000
    grid = spark.range(n).select((F.col("id") % 1).alias("page"), F.col("id").alias("pos"), (F.col("id") % 400 * 10.0).alias("x0"), (F.floor(F.col("id") / 400) * 10.0).alias("y0"))
    box = G.box("x0", "y0", F.col("x0") + 9, F.col("y0") + 9)
    a, b = grid.select("page", F.col("pos").alias("i"), box.alias("a")), grid.select("page", F.col("pos").alias("j"), G.box(F.col("x0") + 1, F.col("y0") + 1, F.col("x0") + 6, F.col("y0") + 6).alias("b"))
    found = tiles.meeting(a, b, ["page"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "__tile" in plan
    assert found.count() == n
    laid = lambda df, c: df.withColumn("t", F.explode(tiles._tiles(F.col(c), F.lit(4)))).select("page", "t")
    met = laid(a, "a").groupBy("page", "t").count().withColumnRenamed("count", "n").join(laid(b, "b").groupBy("page", "t").count(), ["page", "t"])
    assert met.agg(F.sum(F.col("n") * F.col("count"))).first()[0] < 16 * n


def test_cells_without_lines(spark):
    cells = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 50.0, 50.0, 50.0, 50.0)], "page int, cell_pos int, x0 double, y0 double, x1 double, y1 double")
    lines = spark.createDataFrame([(1, 5, "in", 1.0, 1.0, 3.0, 3.0), (1, 6, "half", 8.0, 2.0, 12.0, 4.0), (1, 7, "out", 10.0, 0.0, 20.0, 9.0), (2, 8, "x", 0.0, 0.0, 5.0, 5.0)], "page int, pos int, text string, x0 double, y0 double, x1 double, y1 double")
    assert {r.cell_pos: r.cell_text for r in layout.lines_in_cells(cells, lines, ["page"]).collect()} == {0: "in half", 1: ""}
    assert {r.cell_text for r in layout.lines_in_cells(cells, lines.limit(0), ["page"]).collect()} == {""}


def test_a_row_for_each_small_box(spark, monkeypatch):
    """Few large boxes among many small ones are laid out in more tiles, so that the small ones are one row each."""
    rows = {}
    of = tiles._grids
    monkeypatch.setattr(tiles, "_grids", lambda left, right: rows.setdefault("grids", of(left, right)))
    small = spark.range(5000).select(F.lit(0).alias("page"), F.col("id").alias("j"), G.box((F.col("id") % 70 * 9).cast("double"), F.col("id") / 9, F.col("id") % 70 * 9 + 5.0, F.col("id") / 9 + 4).alias("b"))
    large = spark.range(40).select(F.lit(0).alias("page"), F.col("id").alias("i"), G.box(F.col("id") * 1.0, F.col("id") * 9.0, F.when(F.col("id") == 3, 600.0).otherwise(F.col("id") + 7.0), F.col("id") * 9.0 + 5).alias("a"))
    got = {(r.i, r.j) for r in tiles.meeting(large, small, ["page"]).collect()}
    want = {(r.i, r.j) for r in large.crossJoin(small.drop("page")).where(G.intersection("a", "b").isNotNull()).collect()}
    assert got == want and want and set(rows["grids"].values()) == {3} and len(rows["grids"]) == 2
