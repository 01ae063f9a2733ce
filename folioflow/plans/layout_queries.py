"""Queries of boxes, regions, tables, document types and validation.

The driver's tables hold no boxes, so parts stand for detected boxes (ten to a page), and line
items for points and OCR lines on those pages; the numbers are contrived, the operators real.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.functions import constants as K
from folioflow.functions import geometry as G
from folioflow.functions import text as X
from folioflow.operators import layout, quality, segments
from folioflow.plans.register import Register, table
from folioflow.sources import pages as page_source

REGISTER = Register()

BOXES = """b AS (SELECT p_partkey // 10 AS page, p_partkey AS pos, CASE WHEN p_partkey % 5 = 0 THEN 'figure' ELSE 'text' END AS name,
  (p_partkey * 37 % 1000) / 1000.0::DOUBLE AS conf, CAST((p_size * 7) % 300 AS DOUBLE) AS x0, CAST((p_partkey * 13) % 400 AS DOUBLE) AS y0,
  CAST((p_size * 7) % 300 + 20 + p_size * 3 AS DOUBLE) AS x1, CAST((p_partkey * 13) % 400 + 30 + p_partkey % 90 AS DOUBLE) AS y1 FROM part)"""


def _boxes(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    x0, y0 = (s * 7) % 300, (k * 13) % 400
    return table(spark, sf_dir, "part").select(
        F.floor(k / 10).alias("page"), k.cast("int").alias("pos"), F.when(k % 5 == 0, "figure").otherwise("text").alias("name"), ((k * 37 % 1000) / F.lit(1000.0)).alias("conf"),
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 20 + s * 3).cast("double").alias("x1"), (y0 + 30 + k % 90).cast("double").alias("y1"),
    )


POINTS = "p AS (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, l_partkey // 10 AS page, l_quantity * 9.5 AS x, CAST(floor(l_extendedprice) AS BIGINT) % 500 + 0.25 AS y FROM lineitem)"


def _points(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem")
    return own.select("l_orderkey", "l_linenumber", F.floor(F.col("l_partkey") / 10).alias("page"), (F.col("l_quantity") * 9.5).alias("x0"), (F.floor("l_extendedprice") % 500 + F.lit(0.25)).alias("y0"))


REGIONS = f"""WITH {BOXES}, {POINTS},
r AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY conf DESC, pos) - 1 AS i, name,
  greatest(0, least(trunc(x0 - 1), 611)) AS x0, greatest(0, least(trunc(792 - y1 - 1), 791)) AS y0, greatest(0, least(trunc(x1 + 1), 611)) AS x1, greatest(0, least(trunc(792 - y0 + 1), 791)) AS y1 FROM b WHERE conf > {K.MIN_CONFIDENCE}),
q AS (SELECT *, greatest(0, least(trunc(x), 611)) AS px, greatest(0, least(trunc(y), 791)) AS py FROM p),
m AS (SELECT id, l_orderkey, l_linenumber, max(i + 2) AS top, bool_or(name = 'figure') AS reserved FROM q LEFT JOIN r ON r.page = q.page AND px >= r.x0 AND px < r.x1 AND py >= r.y0 AND py < r.y1 GROUP BY ALL)
"""


@REGISTER(REGIONS + "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN reserved THEN 0 ELSE coalesce(top, 1) END AS INTEGER) AS region FROM m")
def region_of_point(spark, sf_dir):
    """The region under each glyph."""
    boxes = layout.ranked_boxes(_boxes(spark, sf_dir), ["page"])
    glyphs = _points(spark, sf_dir).withColumns({"text": F.lit("x"), "page_width": F.lit(612), "page_height": F.lit(792)})
    return layout.glyph_regions(glyphs, boxes, ["page"], (612, 792)).select("l_orderkey", "l_linenumber", "region")


@REGISTER(REGIONS + "SELECT CAST(CASE WHEN reserved THEN 0 ELSE coalesce(top, 1) END AS INTEGER) AS region, count(*) AS n FROM m GROUP BY 1")
def line_regions(spark, sf_dir):
    """Rule lines by region, through the start of each."""
    return region_of_point(spark, sf_dir).groupBy("region").agg(F.count("*").alias("n"))


@REGISTER(f"WITH {BOXES} SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY conf DESC, pos) - 1 AS INTEGER) AS i, pos FROM b WHERE conf > {K.MIN_CONFIDENCE}")
def boxes_by_confidence(spark, sf_dir):
    """Boxes of a page, surest first."""
    found = layout.ranked_boxes(_boxes(spark, sf_dir), ["page"]).select("page", F.posexplode("boxes").alias("i", "b"))
    return found.select("page", "i", F.col("b.pos").cast("long").alias("pos"))


@REGISTER(f"WITH {BOXES} SELECT page, list(pos ORDER BY y0, pos) AS order_by_y FROM b GROUP BY page")
def elements_by_y(spark, sf_dir):
    """O2, O3: elements of a page from top to bottom, ties by position."""
    own = _boxes(spark, sf_dir).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("y0", "pos"))).alias("e"))
    return own.select("page", F.transform("e", lambda e: e.pos.cast("long")).alias("order_by_y"))


@REGISTER(f"""WITH {BOXES}, {POINTS}, l AS (SELECT page, l_orderkey * 10 + l_linenumber AS pos, x AS x0, y AS y0, x + 30 AS x1, y + 8 AS y1 FROM p),
m AS (SELECT b.page, b.pos AS cell_pos, string_agg('w' || l.pos, ' ' ORDER BY l.y0, l.pos) AS t FROM b JOIN l ON l.page = b.page
  AND greatest(b.x0, l.x0) < least(b.x1, l.x1) AND greatest(b.y0, l.y0) < least(b.y1, l.y1)
  AND (least(b.x1, l.x1) - greatest(b.x0, l.x0)) * (least(b.y1, l.y1) - greatest(b.y0, l.y0)) / greatest(1.0, (l.x1 - l.x0) * (l.y1 - l.y0)) >= {K.OVERLAP} GROUP BY ALL)
SELECT b.page, b.pos AS cell_pos, coalesce(m.t, '') AS cell_text FROM b LEFT JOIN m ON m.page = b.page AND m.cell_pos = b.pos""")
def text_of_cells(spark, sf_dir):
    """OCR lines of each cell by overlap, in order."""
    lines = _points(spark, sf_dir).select("page", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "x0", "y0", (F.col("x0") + 30).alias("x1"), (F.col("y0") + 8).alias("y1"))
    cells = _boxes(spark, sf_dir).select("page", F.col("pos").cast("long").alias("cell_pos"), "x0", "y0", "x1", "y1")
    found = layout.lines_in_cells(cells, lines.withColumn("text", F.concat(F.lit("w"), "pos")), ["page"])
    return found.select("page", "cell_pos", "cell_text")


HOT_PAGE = """k AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey * 37 % 9973 AS DOUBLE) AS x0, CAST(l_suppkey * 101 + l_orderkey * 13 % 8999 AS DOUBLE) AS y0, CAST(2 + l_quantity AS DOUBLE) AS w FROM lineitem),
b AS (SELECT l_orderkey * 10 + l_linenumber AS pos, x0, y0, x0 + w AS x1, y0 + w / 2 AS y1, l_linenumber FROM k),
c AS (SELECT pos, x0 - 5 AS x0, y0 - 5 AS y0, CASE WHEN pos % 50021 = 11 THEN x0 + 5000 ELSE x1 + 9 END AS x1, y1 + 9 AS y1 FROM b WHERE l_linenumber = 1)"""


def _hot_page(spark, sf_dir):
    """Line items as boxes of one page, and cells around every order's first, of which a few are very wide."""
    own = table(spark, sf_dir, "lineitem")
    x0, y0 = (F.col("l_partkey") * 37 % 9973).cast("double"), (F.col("l_suppkey") * 101 + F.col("l_orderkey") * 13 % 8999).cast("double")
    w = (F.lit(2) + F.col("l_quantity")).cast("double")
    boxes = own.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), (y0 + w / 2).alias("y1"), "l_linenumber", F.lit(0).alias("page"))
    wide = F.when(F.col("pos") % 50021 == 11, F.col("x0") + 5000).otherwise(F.col("x1") + 9)
    cells = boxes.where("l_linenumber = 1").select("page", F.col("pos").alias("cell_pos"), (F.col("x0") - 5).alias("x0"), (F.col("y0") - 5).alias("y0"), wide.alias("x1"), (F.col("y1") + 9).alias("y1"))
    return cells, boxes.select("page", "pos", "x0", "y0", "x1", "y1", F.concat(F.lit("w"), "pos").alias("text"))


@REGISTER(f"""WITH {HOT_PAGE}, m AS (SELECT c.pos AS cell_pos, string_agg('w' || l.pos, ' ' ORDER BY l.y0, l.pos) AS t FROM c JOIN b l
  ON c.x0 < l.x1 AND l.x0 < c.x1 AND c.y0 < l.y1 AND l.y0 < c.y1
  AND (least(c.x1, l.x1) - greatest(c.x0, l.x0)) * (least(c.y1, l.y1) - greatest(c.y0, l.y0)) / greatest(1.0, (l.x1 - l.x0) * (l.y1 - l.y0)) >= {K.OVERLAP} GROUP BY ALL)
SELECT c.pos AS cell_pos, coalesce(m.t, '') AS cell_text FROM c LEFT JOIN m ON m.cell_pos = c.pos""")
def text_of_cells_on_one_page(spark, sf_dir):
    """J6 where all boxes lie on one page."""
    return layout.lines_in_cells(*_hot_page(spark, sf_dir), ["page"]).select("cell_pos", "cell_text")


@REGISTER(f"""WITH {BOXES}, j AS (SELECT a.page, a.pos, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, c.x0, c.y0, c.x1, c.y1 FROM b a JOIN b c ON c.page = a.page AND c.pos = a.pos + 1),
k AS (SELECT *, CASE WHEN greatest(ax0, x0) < least(ax1, x1) AND greatest(ay0, y0) < least(ay1, y1) THEN (least(ax1, x1) - greatest(ax0, x0)) * (least(ay1, y1) - greatest(ay0, y0)) ELSE 0.0::DOUBLE END AS common, (ax1 - ax0) * (ay1 - ay0) AS area FROM j)
SELECT pos, area, common, round(common / (area + (x1 - x0) * (y1 - y0) - common), 9) AS iou, ax1 - ax0 < 25 OR ay1 - ay0 < 25 AS small FROM k""")
def box_pairs(spark, sf_dir):
    """Areas, intersections and IoU of neighbouring boxes."""
    own = _boxes(spark, sf_dir).select("page", F.col("pos").cast("long").alias("pos"), G.box("x0", "y0", "x1", "y1").alias("a"))
    other = own.select("page", (F.col("pos") - 1).alias("pos"), F.col("a").alias("b"))
    both = own.join(other, ["page", "pos"])
    return both.select("pos", G.area("a").alias("area"), F.coalesce(G.area(G.intersection("a", "b")), F.lit(0.0)).alias("common"), F.round(G.iou("a", "b"), 9).alias("iou"), G.is_degenerate("a", 25).alias("small"))


@REGISTER(f"""WITH {BOXES} SELECT pos, round(x0 * (612.0 / 1000), 6) AS sx0, round(y1 * (792.0 / 1200), 6) AS sy1, least(x1, 300.0) AS cx1, greatest(0.0, y0 - 50) AS cy0, least(x1, x0) AS nx0, greatest(y1, y0) AS ny1,
CAST(greatest(0, least(trunc(x0 * (1000 / 612.0::DOUBLE)), 1000)) AS INTEGER) AS px0, CAST(greatest(0, least(trunc(y1 * (1200 / 792.0::DOUBLE)), 1200)) AS INTEGER) AS py1 FROM b""")
def box_arithmetic(spark, sf_dir):
    """scaling, clamping, offset, order of corners, crop windows."""
    own = _boxes(spark, sf_dir).select(F.col("pos").cast("long").alias("pos"), G.box("x0", "y0", "x1", "y1").alias("b"), G.box("x1", "y1", "x0", "y0").alias("r"))
    scaled, clamped, moved, normal = G.scale("b", 1000.0, 1200.0, 612.0, 792.0), G.clamp("b", 300, 300), G.clamp(G.offset("b", 0, -50), 10_000, 10_000), G.normalize("r")
    crop = G.crop_window("b", 612.0, 792.0, 1000, 1200)
    return own.select("pos", F.round(scaled.x0, 6).alias("sx0"), F.round(scaled.y1, 6).alias("sy1"), clamped.x1.alias("cx1"), moved.y0.alias("cy0"), normal.x0.alias("nx0"), normal.y1.alias("ny1"), crop.x0.alias("px0"), crop.y1.alias("py1"))


@REGISTER(f"WITH {BOXES} SELECT pos, least(x0, x1, x0 + 5) AS ex0, greatest(y0, y1, y1 + 2) AS ey1 FROM b")
def polygon_envelopes(spark, sf_dir):
    """Envelopes of skewed polygons."""
    points = F.array(F.array("x0", "y0"), F.array("x1", F.col("y0") + 1), F.array("x1", F.col("y1") + 2), F.array(F.col("x0") + 5, "y1"))
    b = G.polygon_box(points)
    return _boxes(spark, sf_dir).select(F.col("pos").cast("long").alias("pos"), b.x0.alias("ex0"), b.y1.alias("ey1"))


@REGISTER(f"""WITH {BOXES}, g AS (SELECT pos, x0, y1, 300.0::DOUBLE + pos % 400 AS h, 500.0::DOUBLE + pos % 300 AS w FROM b), s AS (SELECT *, least(1024 / h, 1024 / w) AS gain FROM g)
SELECT pos, round((x0 - round_even((1024 - w * gain) / 2 - 0.1, 0)) / gain, 6) AS ux0, round((y1 - round_even((1024 - h * gain) / 2 - 0.1, 0)) / gain, 6) AS uy1,
CAST(round_even(h * gain, 0) AS INTEGER) AS rh, CAST(round_even(w * gain, 0) AS INTEGER) AS rw FROM s""")
def letterbox_boxes(spark, sf_dir):
    """boxes from a padded model image back to the page image, and the resized size."""
    own = _boxes(spark, sf_dir).select(F.col("pos").cast("long").alias("pos"), G.box("x0", "y0", "x1", "y1").alias("b"))
    h, w = F.col("pos") % 400 + 300.0, F.col("pos") % 300 + 500.0
    u, r = G.unletterbox("b", 1024, 1024, h, w), G.letterbox(h, w, 1024, 1024)
    return own.select("pos", F.round(u.x0, 6).alias("ux0"), F.round(u.y1, 6).alias("uy1"), r.height.alias("rh"), r.width.alias("rw"))


@REGISTER("""WITH c AS (SELECT l_orderkey, l_suppkey AS xref, sum(l_quantity) AS c, min(l_linenumber) AS p FROM lineitem GROUP BY ALL)
SELECT l_orderkey, list(xref ORDER BY c DESC, p, xref)[1] AS xref, max(c) AS coverage FROM c GROUP BY l_orderkey""")
def best_image(spark, sf_dir):
    """The image that covers most of a page, the first of equals."""
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("xref"), F.col("l_quantity").alias("coverage"), F.col("l_linenumber").alias("pos"))
    return layout.best_image(own, ["l_orderkey"])


@REGISTER("""WITH v AS (SELECT source, count(*) AS n_pages, count(*) FILTER (WHERE quality = 0) AS n_scanned FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT *, CASE WHEN n_scanned * 10 >= n_pages * 8 THEN 'scanned' WHEN n_scanned * 10 <= n_pages * 2 THEN 'digital' ELSE 'mixed' END AS doc_type FROM v""")
def source_vote(spark, sf_dir):
    """A1: the type of a source by the votes of its pages."""
    own = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return quality.document_type(own.withColumn("page_type", F.when(F.col("quality") == 0, "scanned").otherwise("digital")), ["source"])


@REGISTER("""WITH p AS (SELECT doc_id, n_chars % 130 AS t, doc_id % 5 AS k, (doc_id % 3) * 100.0 AS area, (n_chars % 110) * 1.0 AS image FROM documents)
SELECT doc_id, CASE WHEN t >= 100 OR k >= 3 THEN 'digital' WHEN t = 0 AND k = 0 THEN 'scanned' WHEN area <> 0 AND image / nullif(area, 0) >= 0.5 THEN 'scanned' ELSE 'digital' END AS page_type FROM p""")
def page_types(spark, sf_dir):
    """A2: the tiers of a page's type."""
    own = table(spark, sf_dir, "documents")
    found = quality.page_type(F.col("n_chars") % 130, F.col("doc_id") % 5, (F.col("doc_id") % 3) * 100.0, (F.col("n_chars") % 110) * 1.0)
    return own.select("doc_id", found.alias("page_type"))


def _stage_documents(spark, sf_dir):
    """One document of one page per ten parts, with faults of all kinds strewn in."""
    own = _boxes(spark, sf_dir)
    i = F.col("pos") % 10
    bbox = (
        F.when(F.col("pos") % 7 == 0, F.array("x1", "y0", "x0", "y1"))
        .when(F.col("pos") % 11 == 0, F.array("x0", "y1", "x1", "y0"))
        .when(F.col("pos") % 13 == 0, F.array("x0", "y0", F.lit(float("nan")), "y1"))
        .when(F.col("pos") % 17 == 0, F.array("x0", "y0", "x1"))
        .when(F.col("pos") % 19 == 0, F.array(F.col("x0") - 400, "y0", "x1", "y1"))
        .otherwise(F.array("x0", "y0", "x1", "y1"))
    )
    category = F.get(F.array(*[F.lit(c) for c in K.CATEGORIES]), (F.col("pos") % 5).cast("int"))
    cell = F.struct(F.transform(bbox, lambda v: v + (F.col("pos") % 3 - 1)).alias("bbox_pdf"), F.lit(0).alias("row_id"), F.lit(0).alias("col_id"), F.lit("").alias("source_text"), F.lit("").alias("translated_text"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("value"))
    cells = F.when(F.col("pos") % 4 == 0, F.array(cell)).otherwise(F.array().cast(f"array<{schemas.CELL}>"))
    element = F.struct(F.lit("Text").alias("label"), category.alias("category"), bbox.alias("bbox_pdf"), F.when(F.col("pos") % 3 == 0, "t").otherwise("").alias("source_text"), F.lit("").alias("translated_text"), F.when(F.col("pos") % 2 == 0, K.EQUATION_LATEX).otherwise("").alias("latex"), F.lit(None).cast("string").alias("translated_latex"), cells.alias("cells"))
    elements = F.transform(F.sort_array(F.collect_list(F.struct(i.alias("i"), element.alias("e")))), lambda s: s.e)
    page = F.struct(F.lit(0).alias("page_index"), F.when(F.col("page") % 23 == 0, float("inf")).otherwise(300.0).alias("page_width"), F.lit(450.0).alias("page_height"), elements.alias("elements"), F.lit("").alias("raw_text"), F.when(F.col("page") % 29 == 0, "c1").otherwise("").alias("chapter_id"))
    chapter = F.struct(F.lit("c1").alias("chapter_id"), F.lit("").alias("title"), F.lit(5).alias("start_page"), F.lit(2).alias("end_page"), F.lit("").alias("summary"), F.create_map().cast("map<string,string>").alias("glossary"))
    return own.groupBy("page").agg(page.alias("p")).select("page", F.when(F.col("page") % 31 != 0, "f.pdf").alias("pdf_path"), F.array("p").cast(f"array<{schemas.PAGE}>").alias("pages"), F.when(F.col("page") % 37 == 0, F.array(chapter)).otherwise(F.array().cast(f"array<{schemas.CHAPTER}>")).alias("chapters"))


_ERRORS = f"""WITH {BOXES},
e AS (SELECT page, pos, row_number() OVER (PARTITION BY page ORDER BY pos % 10) - 1 AS i, (['BYPASS', 'FLOWING_TEXT', 'IN_PLACE', 'TABLE', 'EQUATION'])[1 + pos % 5] AS category,
  CASE WHEN pos % 7 = 0 THEN [x1, y0, x0, y1] WHEN pos % 11 = 0 THEN [x0, y1, x1, y0] WHEN pos % 13 = 0 THEN [x0, y0, 'nan'::DOUBLE, y1] WHEN pos % 17 = 0 THEN [x0, y0, x1] WHEN pos % 19 = 0 THEN [x0 - 400, y0, x1, y1] ELSE [x0, y0, x1, y1] END AS v,
  CASE WHEN page % 23 = 0 THEN 'inf'::DOUBLE ELSE 300.0::DOUBLE END AS w FROM b WHERE page % 31 <> 0),
f AS (SELECT *, 'pages[0].elements[' || i || ']' AS spot, CASE WHEN len(v) <> 4 THEN 'BBOX_FORMAT' WHEN isnan(v[3]) THEN 'BBOX_INVALID_NUMBER' WHEN v[1] >= v[3] THEN 'BBOX_X_ORDER' WHEN v[2] >= v[4] THEN 'BBOX_Y_ORDER' END AS fault, pos % 3 - 1 AS d FROM e)
SELECT page, spot || '.bbox_pdf' AS path, fault AS code FROM f WHERE fault IS NOT NULL
UNION ALL SELECT page, spot || '.bbox_pdf', 'BBOX_NEGATIVE' FROM f WHERE fault IS NULL AND (v[1] < -0.01 OR v[2] < -0.01)
UNION ALL SELECT page, spot || '.bbox_pdf', 'BBOX_EXCEEDS_WIDTH' FROM f WHERE fault IS NULL AND v[3] > w + 0.01
UNION ALL SELECT page, spot || '.bbox_pdf', 'BBOX_EXCEEDS_HEIGHT' FROM f WHERE fault IS NULL AND v[4] > 450.01
UNION ALL SELECT page, spot || '.source_text', 'BYPASS_TEXT' FROM f WHERE category = 'BYPASS' AND pos % 3 = 0
UNION ALL SELECT page, spot || '.latex', 'EQUATION_LATEX' FROM f WHERE category = 'EQUATION' AND pos % 2 <> 0
UNION ALL SELECT page, spot || '.cells', 'TABLE_NO_CELLS' FROM f WHERE category = 'TABLE' AND pos % 4 <> 0
UNION ALL SELECT page, spot || '.cells', 'NON_TABLE_HAS_CELLS' FROM f WHERE category <> 'TABLE' AND pos % 4 = 0
UNION ALL SELECT page, spot || '.cells[0].bbox_pdf', fault FROM f WHERE pos % 4 = 0 AND fault IS NOT NULL
UNION ALL SELECT page, spot || '.cells[0]', 'CELL_OUTSIDE_TABLE' FROM f WHERE pos % 4 = 0 AND fault IS NULL AND d <> 0
UNION ALL SELECT DISTINCT page, 'pages[0].page_width', 'INVALID_NUMBER' FROM f WHERE page % 23 = 0
UNION ALL SELECT DISTINCT page, 'pages[0].chapter_id', 'STAGE_A_CHAPTER_ID' FROM f WHERE page % 29 = 0
UNION ALL SELECT DISTINCT page, 'chapters', 'STAGE_A_CHAPTERS' FROM f WHERE page % 37 = 0
UNION ALL SELECT DISTINCT page, 'chapters[0]', 'CHAPTER_PAGE_ORDER' FROM f WHERE page % 37 = 0
UNION ALL SELECT DISTINCT page, 'pdf_path', 'MISSING_FIELD' FROM b WHERE page % 31 = 0"""


@REGISTER(_ERRORS)
def validation_errors(spark, sf_dir):
    """Every error of every document."""
    found = quality.validate(_stage_documents(spark, sf_dir))
    return found.select("page", F.explode("errors").alias("e")).select("page", "e.path", "e.code")


@REGISTER(f"SELECT count(DISTINCT p_partkey // 10) AS n_documents, count(DISTINCT p_partkey // 10) - (SELECT count(DISTINCT page) FROM ({_ERRORS})) AS n_valid, (SELECT count(*) FROM ({_ERRORS})) AS n_errors FROM part")
def validation_summary(spark, sf_dir):
    """A document is valid without errors."""
    found = quality.validate(_stage_documents(spark, sf_dir))
    return found.agg(F.count("*").alias("n_documents"), F.count_if("valid").alias("n_valid"), F.sum(F.size("errors")).alias("n_errors"))


@REGISTER("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber % 2 = 0 AND l_discount = 0")
def rule_lines(spark, sf_dir):
    """P10: black horizontal strokes; other line items are fills, slanted or coloured."""
    point = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    q = F.col("l_quantity")
    paths = table(spark, sf_dir, "lineitem").withColumns({
        "op": F.when(F.col("l_returnflag") == "N", "S").otherwise("f"),
        "points": F.array(point("m", F.lit(0), q), point("l", q, q + F.col("l_linenumber") % 2)),
        "color": F.array("l_discount", F.lit(0.0)),
        "matrix": F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 2.0, 5.0, 7.0)]),
    })
    return layout.rule_lines(paths).select("l_orderkey", "l_linenumber", "l_quantity")


@REGISTER(f"""WITH {BOXES}, r AS (SELECT DISTINCT ON (l_partkey) l_partkey AS crop_id, 'w' || l_orderkey AS text FROM lineitem WHERE l_partkey % 3 <> 0 ORDER BY l_partkey, l_orderkey)
SELECT b.pos AS crop_id, coalesce(text, '') AS source_text, CASE WHEN b.pos % 7 = 0 THEN '{K.EQUATION_LATEX}' ELSE '' END AS latex FROM b LEFT JOIN r ON r.crop_id = b.pos""")
def crop_texts(spark, sf_dir):
    """Results of crops by their id; crops without one are empty."""
    results = table(spark, sf_dir, "lineitem").where("l_partkey % 3 <> 0").groupBy(F.col("l_partkey").alias("crop_id")).agg(F.concat(F.lit("w"), F.min("l_orderkey")).alias("text"))
    blocks = _boxes(spark, sf_dir).select(F.col("pos").cast("long").alias("crop_id"), F.when(F.col("pos") % 7 == 0, "EQUATION").otherwise("FLOWING_TEXT").alias("category"))
    return layout.texts_of_crops(blocks, results).select("crop_id", "source_text", "latex")


def _dealt(own):
    """Texts dealt out, as a small file of them holds very many glyphs."""
    return own.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


@REGISTER()
def paragraphs(spark, sf_dir):
    """Every document as a page of glyphs, read into paragraphs and formulas."""
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.replace("text", F.lit("\f"), F.lit(" ")), "UTF-8").alias("content"))
    found = layout.segment_whole_pages(page_source.read_whole_pages(_dealt(own)), ["path", "page"])
    return found.select(F.col("path").cast("long").alias("doc_id"), F.size("paragraphs").alias("n_paragraphs"), F.size("formulas").alias("n_formulas"), F.md5(F.array_join(F.transform("paragraphs", lambda p: p.text), "\n")).alias("text_md5"))


@REGISTER()
def drawn_turns(spark, sf_dir):
    """Conversation turns set as pages, translated and drawn again."""
    own = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("path"), F.encode(F.replace("text", F.lit("\f"), F.lit(" ")), "UTF-8").alias("content"))
    found = layout.segment_whole_pages(page_source.read_whole_pages(_dealt(own)), ["path", "page"])
    new = F.transform("paragraphs", lambda p: F.when(X.is_passthrough(p.text), p.text).otherwise(F.concat(F.lit("<"), p.text, F.lit(">"))))
    drawn = layout.draw_pages(found.withColumn("translations", new), ["path", "page"], "en")
    return drawn.select("path", F.length("ops").alias("n_chars"), F.md5("ops").alias("ops_md5"))


@REGISTER("SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_elements, md5(array_to_string(ls, chr(10))) AS text_md5 FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)")
def json_round_trip(spark, sf_dir):
    """Nested records as JSON and back."""
    docs = segments.lines_as_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = docs.select("doc_id", F.from_json(F.to_json(F.struct("pages")), f"pages array<{schemas.PAGE}>").alias("r"))
    elements = F.col("r.pages")[0]["elements"]
    return back.select("doc_id", F.size(elements).cast("long").alias("n_elements"), F.md5(F.array_join(F.transform(elements, lambda e: e.source_text), "\n")).alias("text_md5"))
