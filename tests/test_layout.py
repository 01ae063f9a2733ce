import json
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.functions import constants as K
from folioflow.functions import geometry as G
from folioflow.functions import text as X
from folioflow.operators import layout, quality
from folioflow.sources import pages


def glyph(text, x0, y0=700.0, size=10.0, region=2, formula=False, w=6.0):
    return SimpleNamespace(kind="char", text=text, font="F", x0=x0, x1=x0 + w, y0=y0, y1=y0 + size, size=size, region=region, formula=formula, m0=1.0, m3=1.0)


def read(items, width=600.0):
    page = layout.Segmenter(width)
    for g in items:
        (page.line if g.kind == "line" else page.glyph)(g)
    return page.end()


def word(text, x=50.0, **more):
    return [glyph(c, x + 6 * i, **more) for i, c in enumerate(text)]


def test_plain_and_wrapped_lines():
    page = read(word("one two") + word("next", y0=688.0))
    assert [p.text for p in page.paragraphs] == ["one two next"] and page.paragraphs[0].brk
    assert page.paragraphs[0].x0 == 50 and page.paragraphs[0].x1 == 92 and page.paragraphs[0].y0 == 688


def test_gap_makes_a_space_and_region_a_paragraph():
    page = read([glyph("a", 50), glyph("b", 60)] + word("new", 50, region=3))
    assert [p.text for p in page.paragraphs] == ["a b", "new"]


def test_subscript_greek_and_brackets():
    page = read(word("the x") + [glyph("2", 80, y0=698, size=7)] + word(" is", 86))
    assert page.paragraphs[0].text == "the x{v0} is" and page.formulas[0].fix == pytest.approx(698 - 700)
    # Text to the right of the formula sets the offset.
    page = read([glyph("f", 50, formula=True), glyph("(", 56), glyph("a", 62, formula=True), glyph(")", 68), glyph("t", 74, y0=701)])
    assert [p.text for p in page.paragraphs] == ["{v0}", "t"] and len(page.formulas[0].glyphs) == 4
    assert page.formulas[0].width == 24 and page.formulas[0].fix == pytest.approx(-1)


def test_drop_cap_and_reserved_region():
    page = read([glyph("A", 50, size=30)] + word("bc", 56))
    assert page.paragraphs[0].size == 10 and page.paragraphs[0].text == "Abc" and page.paragraphs[0].y == 700 + 20
    page = read([glyph("x", 50, region=0), glyph("y", 56, region=0), glyph("t", 62)])
    assert [p.text for p in page.paragraphs] == ["{v0}", "t"]


def test_lines_of_formulas():
    line = lambda r: SimpleNamespace(kind="line", region=r, x0=1, y0=2, x1=3, y1=2, line_width=1.0)
    page = read([line(2), glyph("a", 50), glyph("=", 58, formula=True), line(2), line(3)])
    assert len(page.lines) == 2 and len(page.formulas[0].lines) == 1


def test_pages_at_once_like_glyph_by_glyph():
    """Pages of one size are cut by columns; reading each glyph after the other gives the same."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        counts = rng.integers(0, 20, 3)
        n, texts = int(counts.sum()), ["a", " ", "(", ")", "="]
        code, x0, y0 = rng.integers(0, 5, n), np.cumsum(rng.choice([6.0, 6.0, 9.0, 200.0, -250.0], n)), rng.choice([700.0, 701.0], n)
        page = layout.Glyphs(texts, code, (code == 4) & (rng.random(n) < 0.8), rng.choice([2, 2, 2, 3, 0], n), np.full(n, 10.0), x0, y0, x0 + 6, y0 + 10, np.full(3, 600.0), counts)
        got, want = layout.cut_runs(page), layout.Cuts(*(np.zeros(n, bool) for _ in range(4)), np.zeros(n))
        for a, z in zip(page.ends[:-1].tolist(), page.ends[1:].tolist(), strict=True):
            if a < z:
                layout._fold(page, a, z, want)
        for name in ("math", "run", "paragraph", "spaced", "size"):
            assert (getattr(got, name) == getattr(want, name)).all(), name


PAR = {"x": 50.0, "y": 700.0, "x0": 50.0, "x1": 80.0, "y0": 690.0, "y1": 710.0, "size": 10.0, "text": "", "brk": True}


def test_reflow_breaks_and_overflows():
    flow = layout.Reflow(PAR, [], layout.FixedMetrics()).run("abcdefgh")
    assert flow.lines == 1 and [o["codes"] for o in flow.ops] == ["616263646566", "6768"]
    assert layout.Reflow(PAR | {"brk": False}, [], layout.FixedMetrics()).run("abcdefgh").lines == 0
    flow = layout.Reflow(PAR, [], layout.FixedMetrics()).run("abcdef gh")
    assert flow.ops[1]["codes"] == "6768" and flow.ops[1]["x"] == 50.0  # the space at a line's start is dropped
    assert [o["font"] for o in layout.Reflow(PAR, [], layout.FixedMetrics()).run("a日").ops] == ["tiro", "noto"]


def test_reflow_measures_each_character_once():
    """Characters are measured once a paragraph, and those of one width are placed line by line; the places are the same."""
    seen, rng = [], np.random.default_rng(6)

    class Counted(layout.FixedMetrics):
        def advance(self, ch):
            seen.append(ch)
            return super().advance(ch)

    par = PAR | {"x1": 450.0}
    for text in ("abc " * 5_000, "abc " * 5_000 + "\u65e5", "ab{v0}c " * 5_000):
        seen.clear()
        layout.draw_page({"paragraphs": [par], "formulas": [], "lines": []}, [text], "en", Counted())
        assert len(seen) <= 4 * len(set(text))
    for _ in range(500):
        text, par = "".join(rng.choice(list("ab  "), rng.integers(1, 40))), PAR | {"x": float(rng.choice([50.0, 55.0, 90.0])), "x1": 50.0 + float(rng.integers(4, 90)), "brk": bool(rng.random() < 0.6)}
        parts, last = layout.place_even(text, 3.7, par)
        places = layout.place(layout.measure(text, [], SimpleNamespace(advance=lambda c: ("f", 0.37)), 10.0), par)
        drawn = [(i, x, line) for i, (x, line, _) in enumerate(places) if not (text[i] == " " and x == par["x0"])]
        assert last == places[-1][1] and [i for a, z, _, _ in parts for i in range(a, z)] == [i for i, _, _ in drawn]
        at = {i: (x, line) for i, x, line in drawn}
        assert all(at[a] == (x, line) for a, _, x, line in parts)


def test_reflow_formulas():
    formula = {"width": 12.0, "fix": 2.0, "glyphs": [{"text": "x", "font": "F", "size": 10.0, "x0": 5.0, "y0": 700.0, "x1": 11.0, "y1": 710.0, "cid": 120}], "lines": [{"x0": 5.0, "y0": 699.0, "x1": 9.0, "y1": 699.0, "line_width": 1.0}, {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 0.0, "line_width": 9.0}]}
    flow = layout.Reflow(PAR, [formula], layout.FixedMetrics()).run("a{v0}{v7}b{ V 0 }")
    assert [(o["kind"], o["x"]) for o in flow.ops] == [("TEXT", 50.0), ("TEXT", 55.0), ("LINE", 55.0), ("TEXT", 67.0), ("TEXT", 50.0), ("LINE", 50.0)]
    assert flow.ops[1]["dy"] == 2.0
    assert layout.Reflow(PAR, [formula], layout.FixedMetrics()).run("{v0}").ops[0]["dy"] == 0.0  # nothing before it
    page = {"paragraphs": [PAR], "formulas": [], "lines": [{"x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 2.0, "line_width": 1.0}]}
    assert layout.draw_page(page, ["a"], "en") == "BT /tiro 10.000000 Tf 1 0 0 1 50.000000 700.000000 Tm [<61>] TJ ET q 1 0 0 1 1.000000 2.000000 cm [] 0 d 0 J 1.000000 w 0 0 m 2.000000 0.000000 l S Q BT ET "


def test_line_height(spark):
    cases = [(1.4, 3, 10.0, 30.0), (1.4, 3, 10.0, 100.0), (0.8, 9, 10.0, 1.0), (1.1, 2, 10.0, 21.5)]
    rows = spark.createDataFrame(cases, "s double, n int, z double, h double").select(X.shrunk_line_height("s", "n", "z", "h").alias("v")).collect()
    for (s, n, z, h), r in zip(cases, rows, strict=True):
        assert r.v == layout.fitted_line_height(s, n - 1, z, h)


def test_regions_like_painting(spark):
    rng, w, h = np.random.default_rng(5), 60, 40
    boxes = [(1, i, bool(rng.random() < 0.3), float(rng.random()), *map(float, sorted(rng.uniform(-5, 65, 2))), *map(float, sorted(rng.uniform(-5, 45, 2)))) for i in range(8)]
    points = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3, 66, (200, 2)))]
    df = spark.createDataFrame([(p, i, "figure" if r else "text", c, x0, y0, x1, y1) for p, i, r, c, x0, x1, y0, y1 in boxes], "page long, pos int, name string, conf double, x0 double, y0 double, x1 double, y1 double")
    raster = np.ones((h, w), int)
    ranked = sorted(boxes, key=lambda b: (-b[3], b[1]))
    for reserved in (False, True):
        for i, (_, _, r, _, x0, x1, y0, y1) in enumerate(ranked):
            if r == reserved:
                a, b, c, d = (int(np.clip(int(v), 0, m - 1)) for v, m in ((x0 - 1, w), (h - y1 - 1, h), (x1 + 1, w), (h - y0 + 1, h)))
                raster[b:d, a:c] = 0 if r else i + 2
    glyphs = spark.createDataFrame(points, "page long, i int, x0 double, y0 double").withColumns({"text": F.lit("x"), "page_width": F.lit(w), "page_height": F.lit(h)})
    got = {r.i: r.region for r in layout.glyph_regions(glyphs, layout.ranked_boxes(df, ["page"], None), ["page"]).collect()}
    for _, i, x, y in points:
        assert got[i] == raster[np.clip(int(y), 0, h - 1), np.clip(int(x), 0, w - 1)]
    assert layout.glyph_regions(glyphs.limit(1), layout.ranked_boxes(df.limit(0), ["page"]), ["page"]).first().region == 1


def test_pages_through_spark(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one line\nand more\fsecond page")
    spark.dataSource.register(pages.PageSource)
    items = spark.read.format("pages").option("pagesPerPartition", "1").load(str(tmp_path / "a.txt"))
    found = layout.segment_pages(items, ["path", "page"])
    assert {r.page: [p.text for p in r.paragraphs] for r in found.collect()} == {0: ["one line and more"], 1: ["second page"]}
    drawn = layout.draw_pages(found.withColumn("translations", F.transform("paragraphs", lambda p: p.text)), ["path", "page"], "en")
    assert all(r.ops.startswith("BT /tiro 10.000000 Tf") for r in drawn.collect())


def test_page_matrix_and_models(spark):
    row = spark.createDataFrame([(0,), (90,), (180,), (270,)], "r int").select(pages.page_matrix("r", F.lit(0), F.lit(0), F.lit(6), F.lit(8)).alias("m")).collect()
    assert [r.m for r in row] == [[1, 0, 0, 1, 0, 0], [0, -1, 1, 0, 0, 6], [-1, 0, 0, -1, 6, 8], [0, 1, -1, 0, 8, 0]]
    images = spark.createDataFrame([(1, b"ab"), (2, b"")], "page int, image binary")
    got = pages.predict(images, lambda: lambda batch: [[{"n": len(i)}] for i in batch], ["page"], "page int, n int")
    assert sorted(map(tuple, got.collect())) == [(1, 2), (2, 0)]


def test_geometry(spark):
    a, b = G.box(0, 0, 10, 10), G.box(5, 5, 20, 10)
    row = spark.range(1).select(G.iou(a, b).alias("iou"), G.intersection(a, G.box(10, 0, 20, 10)).alias("touch"), G.is_degenerate(G.box(0, 0, 0.05, 9)).alias("thin"), G.crop_window(G.box(0, 0, 0.1, 0.1), 100.0, 100.0, 100, 100).alias("crop"), G.unletterbox(G.box(512, 512, 1024, 1024), 1024, 1024, 300, 500).alias("u")).first()
    assert row.iou == pytest.approx(25 / (100 + 75 - 25)) and row.touch is None and row.thin and row.crop is None
    gain = min(1024 / 300, 1024 / 500)
    assert row.u.x0 == pytest.approx((512 - round((1024 - 500 * gain) / 2 - 0.1)) / gain)
    with pytest.raises(Exception, match="positive"):
        spark.range(1).select(G.scale(a, F.col("id"), 5, 1, 1)).collect()


def test_document_type(spark):
    rows = [(d, "scanned" if i < s else "digital") for d, (n, s) in enumerate([(5, 5), (5, 0), (5, 4), (5, 1), (4, 2), (10, 8), (10, 2)]) for i in range(n)]
    got = {r.d: r.doc_type for r in quality.document_type(spark.createDataFrame(rows, "d int, page_type string"), ["d"]).collect()}
    assert got == {0: "scanned", 1: "digital", 2: "scanned", 3: "digital", 4: "mixed", 5: "scanned", 6: "digital"}


CELL = {"bbox_pdf": [1.0, 1.0, 5.0, 5.0], "row_id": 0, "col_id": 0, "source_text": "", "translated_text": ""}
ELEMENT = {"label": "Text", "category": "FLOWING_TEXT", "bbox_pdf": [0.0, 0.0, 10.0, 10.0], "source_text": "t", "translated_text": "", "latex": "", "cells": []}
TABLE = ELEMENT | {"category": "TABLE", "cells": [CELL]}


@pytest.mark.parametrize(
    ("change", "codes"),
    [
        ({}, []),
        ({"bbox_pdf": [0.0, 0.0, 10.0]}, ["BBOX_FORMAT"]),
        ({"bbox_pdf": [0.0, float("inf"), 10.0, 1.0]}, ["BBOX_INVALID_NUMBER"]),
        ({"bbox_pdf": [10.0, 9.0, 0.0, 1.0]}, ["BBOX_X_ORDER"]),
        ({"bbox_pdf": [0.0, 9.0, 10.0, 1.0]}, ["BBOX_Y_ORDER"]),
        ({"bbox_pdf": [-1.0, 0.0, 700.0, 900.0]}, ["BBOX_NEGATIVE", "BBOX_EXCEEDS_WIDTH", "BBOX_EXCEEDS_HEIGHT"]),
        ({"bbox_pdf": [-0.005, 0.0, 600.005, 10.0]}, []),
        ({"category": "BYPASS"}, ["BYPASS_TEXT"]),
        ({"category": "EQUATION"}, ["EQUATION_LATEX"]),
        ({"category": "EQUATION", "latex": K.EQUATION_LATEX}, []),
        ({"category": "TABLE"}, ["TABLE_NO_CELLS"]),
        (TABLE, []),
        (TABLE | {"category": "IN_PLACE"}, ["NON_TABLE_HAS_CELLS"]),
        (TABLE | {"cells": [CELL | {"bbox_pdf": [-1.0, 0.0, 11.0, 5.0]}]}, ["CELL_OUTSIDE_TABLE", "CELL_OUTSIDE_TABLE"]),
        (TABLE | {"cells": [CELL | {"bbox_pdf": None}]}, ["BBOX_FORMAT"]),
    ],
)
def test_validation(spark, change, codes):
    page = {"page_index": 0, "page_width": 600.0, "page_height": 800.0, "elements": [ELEMENT | change], "raw_text": "", "chapter_id": ""}
    docs = spark.read.schema(schemas.DOCUMENT).option("allowNonNumericNumbers", "true").json(spark.sparkContext.parallelize([json.dumps({"pdf_path": "a", "pages": [page], "chapters": []})]))
    row = quality.validate(docs).first()
    assert [e.code for e in row.errors] == codes and row.valid == (not codes)
