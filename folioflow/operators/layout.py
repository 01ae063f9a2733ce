"""Pages of glyphs: regions, paragraphs with formulas, reflow; and text of regions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from folioflow.functions import constants as K
from folioflow.functions import geometry as G
from folioflow.functions import text as X
from folioflow.functions.packed import PACKED, SIDES, unpacked
from folioflow.operators import tiles

# ---------------------------------------------------------------- regions and text of regions


def ranked_boxes(boxes: DataFrame, by: list[str], min_conf: float | None = K.MIN_CONFIDENCE) -> DataFrame:
    """boxes(by..., pos, conf, name, x0..y1) above the confidence, as one array per page, surest first."""
    own = boxes if min_conf is None else boxes.where(F.col("conf") > min_conf)
    box = F.struct((-F.col("conf")).alias("order"), "pos", "name", "conf", "x0", "y0", "x1", "y1")
    return own.groupBy(*by).agg(F.sort_array(F.collect_list(box)).alias("boxes"))


def detected_boxes(found: DataFrame, model_height: int, model_width: int, min_conf: float = K.MIN_CONFIDENCE) -> DataFrame:
    """Boxes on their pages of found(..., conf, x0..y1, height, width): what a layout model gave for a padded
    image of a page of that size. Unsure ones go, the others are clamped to the page and those without
    an extent left go too."""
    on_page = G.clamp(G.unletterbox(G.box("x0", "y0", "x1", "y1"), model_height, model_width, "height", "width"), F.col("width"), F.col("height"))
    sure = found.where(F.col("conf") > min_conf).withColumn("__b", on_page).where(~G.is_degenerate("__b"))
    return sure.withColumns({c: F.col(f"__b.{c}") for c in ("x0", "y0", "x1", "y1")}).drop("__b")


def page_marks(boxes: DataFrame, width: Column | str, height: Column | str) -> DataFrame:
    """ranked_boxes with a column marks instead: for each box the pixels that it covers on a raster of the
    page, and its region: 0 where it is reserved, else 2 plus its index. One row a page, so the corners are
    computed once a box and not once a glyph."""
    w, h = (F.col(v) if isinstance(v, str) else v for v in (width, height))
    mark = lambda b, i: F.struct(F.when(b["name"].isin(*K.RESERVED_REGIONS), F.lit(1 << 30)).otherwise(i + 2).alias("region"), G.pixel_region(b, w, h).alias("px"))
    return boxes.withColumn("marks", F.transform("boxes", mark)).drop("boxes")


def region_of(marks: Column | str, x: Column | str, y: Column | str, width: Column | str, height: Column | str) -> Column:
    """The region at a point of a page: 0 if a reserved box covers it, else 2 plus the index of the
    least sure covering box, else 1. Boxes cover whole pixels of the page's raster, the last row
    and column never; x and y are truncated and clipped to it. marks: from page_marks.
    """
    marks, x, y, w, h = (F.col(v) if isinstance(v, str) else v for v in (marks, x, y, width, height))
    px = F.greatest(F.lit(0), F.least(x.cast("int"), (w - 1).cast("int")))
    py = F.greatest(F.lit(0), F.least(y.cast("int"), (h - 1).cast("int")))
    covers = lambda m: (px >= m.px.x0) & (px < m.px.x1) & (py >= m.px.y0) & (py < m.px.y1)
    top = F.coalesce(F.array_max(F.transform(F.filter(marks, covers), lambda m: m.region)), F.lit(1))
    return F.when(top == 1 << 30, 0).otherwise(top)


def glyph_regions(glyphs: DataFrame, boxes: DataFrame, by: list[str], size: tuple[float, float] | None = None) -> DataFrame:
    """glyphs with their region; a page's boxes travel as one array, so glyphs are not multiplied.

    glyphs has page_width and page_height, the same for all of a page; boxes comes from
    ranked_boxes. Bullets have region 0. size: width and height, where all pages have the same.
    """
    if size:
        sized = boxes.withColumn("__w", F.lit(size[0])).withColumn("__h", F.lit(size[1]))
    else:
        sized = boxes.join(glyphs.groupBy(*by).agg(F.max("page_width").alias("__w"), F.max("page_height").alias("__h")), by)
    marks = page_marks(sized, "__w", "__h").drop("__w", "__h")
    found = region_of("marks", "x0", "y0", "page_width", "page_height")
    return glyphs.join(marks, by, "left").withColumn("region", F.when(F.col("text") == "•", 0).otherwise(found)).drop("marks")


def lines_in_cells(cells: DataFrame, lines: DataFrame, by: list[str], overlap: float = K.OVERLAP) -> DataFrame:
    """cells(by..., cell_pos, x0..y1) with the cleaned text of the OCR lines(by..., pos, text, x0..y1)
    that lie in them by at least the overlap share of the line; a line may be in several cells. They meet by
    tiles, so that a page with very many of them is no single task and pairs far apart are not made."""
    box = G.box("x0", "y0", "x1", "y1")
    met = tiles.meeting(cells.select(*by, "cell_pos", box.alias("__a")), lines.select(*by, F.col("pos").alias("l_pos"), F.col("text").alias("l_text"), box.alias("__b")), by, "__a", "__b")
    met = met.where(G.area(G.intersection("__a", "__b")) / F.greatest(F.lit(1.0), G.area("__b")) >= overlap).withColumn("l_y0", F.col("__b.y0"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_y0", "l_pos", "l_text"))), lambda s: s.l_text), " ")
    found = met.groupBy(*by, "cell_pos").agg(text.alias("t"))
    return cells.join(found, [*by, "cell_pos"], "left").withColumn("cell_text", X.clean_ocr_text(F.coalesce("t", F.lit("")))).drop("t")


def texts_of_crops(blocks: DataFrame, results: DataFrame, crop: str = "crop_id") -> DataFrame:
    """blocks(crop, category, ...) with source_text from results(crop, text), by the crop's id and never by
    order. A crop without a result, as of a failed call, has an empty text; equations get their
    placeholder as latex."""
    text = F.coalesce(results["text"], F.lit(""))
    found = blocks.join(results.select(crop, text.alias("source_text")), crop, "left")
    latex = F.when(F.col("category") == "EQUATION", K.EQUATION_LATEX)
    return found.withColumn("source_text", F.coalesce("source_text", F.lit(""))).withColumn("latex", F.coalesce(latex, F.lit("")))


def ordered_text(df: DataFrame, by: list[str], order: list[str], text: str, sep: str, alias: str) -> DataFrame:
    """Texts of each group in order, joined; empty ones are skipped."""
    own = F.when(F.col(text) != "", F.struct(*order, F.col(text).alias("__t")))
    return df.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(own)), lambda s: s["__t"]), sep).alias(alias))


def page_raw_text(elements: DataFrame, by: list[str]) -> DataFrame:
    """Flowing and in-place texts of a page, from top to bottom, one per line."""
    own = elements.withColumn("__s", F.when(F.col("category").isin(*K.RAW_TEXT_CATEGORIES), F.col("source_text")).otherwise(""))
    return ordered_text(own, by, ["y0", "pos"], "__s", "\n", "raw_text")


def best_image(placements: DataFrame, by: list[str]) -> DataFrame:
    """The image (xref) that covers most of a page; of equals the first, then the smallest xref. Pages without cover have none."""
    covered = placements.groupBy(*by, "xref").agg(F.sum("coverage").alias("c"), F.min("pos").alias("p")).where("c > 0")
    return covered.groupBy(*by).agg(F.max_by("xref", F.struct("c", -F.col("p"), -F.col("xref"))).alias("xref"), F.max("c").alias("coverage"))


def rule_lines(paths: DataFrame) -> DataFrame:
    """The painted paths that are rules: stroked, never filled, black, one horizontal line of two points.

    paths has op (the painting operator), points (array of structs kind, x, y), color (array of
    components) and matrix (six numbers); equal heights are judged after the matrix.
    """
    point = lambda i: F.get("points", F.lit(i))
    height = lambda p: F.col("matrix")[1] * p.x + F.col("matrix")[3] * p.y + F.col("matrix")[5]
    straight = (F.size("points") == 2) & (point(0)["kind"] == "m") & (point(1)["kind"] == "l")
    return paths.where((F.col("op") == "S") & straight & (height(point(0)) == height(point(1))) & X.is_black("color"))


# ---------------------------------------------------------------- paragraphs and formulas


@dataclass
class Paragraph:
    x: float
    y: float
    x0: float
    x1: float
    y0: float
    y1: float
    size: float
    text: str
    brk: bool


@dataclass
class Formula:
    glyphs: list
    lines: list
    fix: float

    @property
    def width(self) -> float:
        return max(g.x1 for g in self.glyphs) - self.glyphs[0].x0


class Glyphs:
    """The glyphs of pages in order as columns, and what each is to the one before it on its page.

    code: each glyph's place in texts; counts: how many glyphs each page has.
    """

    def __init__(self, texts: list[str], code: np.ndarray, marked: np.ndarray, region: np.ndarray, size: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, page_width: np.ndarray, counts: np.ndarray):
        self.texts, self.code, self.region, self.size, self.x0, self.y0, self.x1, self.y1 = texts, code, region, size, x0, y0, x1, y1
        self.marked = marked | (region == 0)
        self.ends = np.concatenate([[0], np.cumsum(counts)])
        self.begins = self.ends[:-1][counts > 0]
        self.first = np.zeros(len(code), bool)
        self.first[self.begins] = True
        before = lambda v: np.concatenate([v[:1], v[:-1]])
        self.same = (region == before(region)) & ~self.first
        self.far = np.abs(x0 - before(x0)) > np.repeat(page_width / 4, counts)
        gap = x0 > before(x1) + 1
        self.back = ~gap & (x1 < before(x0))
        self.apart = gap | self.back
        self.right = x0 > before(x0)

    @classmethod
    def of(cls, glyphs: list, page_width: float) -> Glyphs:
        """The glyphs of one page."""
        column = lambda name, kind: np.array([getattr(g, name) for g in glyphs], kind)
        sides = (column(c, float) for c in ("size", "x0", "y0", "x1", "y1"))
        return cls([g.text for g in glyphs], np.arange(len(glyphs)), column("formula", bool), column("region", int), *sides, np.array([page_width]), np.array([len(glyphs)]))

    def each(self, of_text: Callable[[str], object], kind: type) -> np.ndarray:
        """A property of each glyph's text."""
        return np.array([of_text(t) for t in self.texts], kind)[self.code]

    def __len__(self) -> int:
        return len(self.code)


@dataclass
class Cuts:
    """For each glyph: whether it is of a formula, begins a run of its kind or a paragraph, and whether a
    space comes before it; the size of its paragraph so far; and each run's placeholder by its begin."""

    math: np.ndarray
    run: np.ndarray
    paragraph: np.ndarray
    spaced: np.ndarray
    size: np.ndarray


def _turn(text: str) -> int:
    """1 for a bracket that opens, -1 for one that closes, else 0."""
    return (text == "(") - (text == ")")


def cut_runs(page: Glyphs) -> Cuts:
    """What each glyph of the pages belongs to.

    Small glyphs after two visible characters and brackets that open within a formula belong to
    formulas. A formula ends at text, at another region and at a jump across the page, unless
    nothing stands before it in its paragraph; one by itself is a paragraph.

    On a page of one size no glyph is small, so only brackets depend on what was read so far, and the rest
    is known for all glyphs at once. Other pages are read glyph by glyph.
    """
    n = len(page)
    if not n:
        return Cuts(*(np.zeros(0, bool) for _ in range(4)), np.zeros(0))
    math = page.marked.copy()
    at = np.flatnonzero(~math & (page.each(_turn, int) != 0))
    depth, last = 0, -1
    for i, turn, own in zip(at.tolist(), page.each(_turn, int)[at].tolist(), np.searchsorted(page.begins, at, "right").tolist(), strict=True):
        depth, last = (depth, last) if own == last else (0, own)
        math[i] = depth > 0 if turn < 0 else math[i - 1] and not page.first[i]
        depth += turn * int(math[i])
    inside = np.concatenate([[False], math[:-1]]) & ~page.first
    # A chain is a formula but for jumps. One that begins its paragraph has nothing before it, so jumps do not end it.
    chained = inside & math & page.same
    chain = np.cumsum(math & ~chained)
    alone = np.concatenate([[False], ~page.same[math & ~chained]])[chain]
    follows = chained & (alone | ~page.far)
    paragraph = ~page.same | (inside & ~chained & alone)
    run = ~follows & (paragraph | math | inside)
    out = Cuts(math, run, paragraph, ~follows & ~paragraph & page.apart, page.size.copy())
    low, high = np.minimum.reduceat(page.size, page.begins), np.maximum.reduceat(page.size, page.begins)
    uneven = ~((low == high) & (low >= 0)) | np.logical_or.reduceat(page.each(lambda t: t == "", bool), page.begins)
    for a, z in zip(page.begins[uneven].tolist(), np.append(page.begins[1:], n)[uneven].tolist(), strict=True):
        _fold(page, a, z, out)
    return out


def _fold(page: Glyphs, a: int, z: int, out: Cuts) -> None:
    """cut_runs of the page of glyphs a to z, one after the other. Of the text so far only counts matter: whether
    there is any, and its visible characters."""
    texts = [page.texts[i] for i in page.code[a:z].tolist()]
    columns = (c[a:z].tolist() for c in (page.size, page.marked, page.same, page.far, page.apart))
    size, shown, visible, depth, inside = 0.0, False, 0, 0, False
    rows = []
    for text, own, marked, same, far, apart in zip(texts, *columns, strict=True):
        math, run, paragraph, spaced = marked or (same and own < size * K.SUBSCRIPT and visible > 1), False, False, False
        turn = 0 if math else _turn(text)
        if turn:
            math = inside if turn > 0 else depth > 0
            depth += turn * math
        if not (inside and math and same and not (shown and far)):
            paragraph = not same or (inside and not shown)
            if inside:
                shown, visible = True, visible + 4
            run = paragraph or math or inside
            if paragraph:
                size, shown, visible = own, False, 0
            elif apart:
                spaced = shown = True
        if not math:
            if text != " " and (own > size or visible == 1):
                size = own
            shown, visible = shown or text != "", visible + len("".join(text.split()))
        rows.append((math, run, paragraph, spaced, size))
        inside = math
    for kept, values in zip((out.math, out.run, out.paragraph, out.spaced, out.size), zip(*rows, strict=True), strict=True):
        kept[a:z] = values


def _ranges(begins: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of the parts that begin where begins holds."""
    at = np.flatnonzero(begins).tolist()
    return list(zip(at, [*at[1:], len(begins)], strict=False))


def _offsets(page: Glyphs, cuts: Cuts, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """How far the formulas of glyphs a to z stand above the text: by the text right of one, if the
    formula ends there and it is of the same region, else by the glyph left of it."""
    if not len(a):
        return np.zeros(0)
    right = np.minimum(z, len(page) - 1)
    inner = np.maximum.reduceat(page.x0, np.flatnonzero(cuts.run))[cuts.math[cuts.run]]
    by_right = (z < len(page)) & ~cuts.math[right] & page.same[right] & (page.x0[right] > inner)
    by_left = np.where(page.right[a] & ~cuts.paragraph[a], page.y0[a] - page.y0[a - 1], 0.0)
    return np.where(by_right, page.y0[a] - page.y0[right], by_left)


class Segmenter:
    """Reads a page's glyphs and lines in order; gives paragraphs, formulas and lines of no formula.

    A glyph needs text, size, x0, y0, x1, y1, region and formula (font, character or direction
    already mark it). end() reads what was given.
    """

    def __init__(self, page_width: float):
        self.page_width = page_width
        self._glyphs: list = []
        self._lines: list[tuple[int, object]] = []

    def line(self, item) -> None:
        self._lines.append((len(self._glyphs) - 1, item))

    def glyph(self, g) -> None:
        self._glyphs.append(g)

    def end(self) -> Segmenter:
        page = Glyphs.of(self._glyphs, self.page_width)
        cuts = cut_runs(page)
        runs = _ranges(cuts.run)
        formulas = [(a, z) for a, z in runs if cuts.math[a]]
        # A line belongs to the formula that the glyph before it is of.
        owner = np.cumsum(cuts.run & cuts.math) - 1
        held = [i >= 0 and cuts.math[i] and page.region[i] == item.region for i, item in self._lines]
        self.lines = [item for (_, item), h in zip(self._lines, held, strict=True) if not h]
        own: list[list] = [[] for _ in formulas]
        for (i, item), h in zip(self._lines, held, strict=True):
            if h:
                own[owner[i]].append(item)
        fixes = _offsets(page, cuts, *np.array(formulas, int).reshape(-1, 2).T).tolist()
        self.formulas = [Formula(self._glyphs[a:z], lines, fix) for (a, z), lines, fix in zip(formulas, own, fixes, strict=True)]
        pieces = np.where(cuts.spaced, " ", "").astype(object) + np.where(cuts.math, "", np.array(page.texts, object))
        for number, (_, z) in enumerate(formulas):
            pieces[z - 1] += f"{{v{number}}}"
        self.paragraphs = []
        for a, z in _ranges(cuts.paragraph):
            box = page.x0[a:z].min(), max(page.x0[a], page.x1[a:z].max()), page.y0[a:z].min(), page.y1[a:z].max()
            size = cuts.size[z - 1]
            self.paragraphs.append(Paragraph(*map(float, (page.x0[a], page.y0[a] - (size - page.size[a]), *box, size)), "".join(pieces[a:z]), bool((cuts.spaced & page.back)[a:z].any())))
        return self


_G = "struct<text: string, font: string, size: double, x0: double, y0: double, x1: double, y1: double, cid: int>"
_L = "struct<x0: double, y0: double, x1: double, y1: double, line_width: double>"
PAGE_ROW = f"paragraphs array<struct<x: double, y: double, x0: double, x1: double, y0: double, y1: double, size: double, text: string, brk: boolean>>, formulas array<struct<width: double, fix: double, glyphs: array<{_G}>, lines: array<{_L}>>>, lines array<{_L}>"


def _page_row(pdf: pd.DataFrame) -> dict:
    """PAGE_ROW of the items of one page, in order; formula tells what font, character or direction mark."""
    page = Segmenter(float(pdf["page_width"].iloc[0]))
    for item in pdf.itertuples(index=False):
        (page.line if item.kind == "line" else page.glyph)(item)
    page.end()
    glyph = lambda g: {"text": g.text, "font": g.font, "size": g.size, "x0": g.x0, "y0": g.y0, "x1": g.x1, "y1": g.y1, "cid": ord(g.text[0]) if g.text else 0}
    line = lambda g: {"x0": g.x0, "y0": g.y0, "x1": g.x1, "y1": g.y1, "line_width": g.line_width}
    formulas = [{"width": f.width, "fix": f.fix, "glyphs": [glyph(g) for g in f.glyphs], "lines": [line(x) for x in f.lines]} for f in page.formulas]
    return {"paragraphs": [vars(p) for p in page.paragraphs], "formulas": formulas, "lines": [line(x) for x in page.lines]}


def segment_pages(items: DataFrame, by: list[str]) -> DataFrame:
    """One row per page of items: glyphs and lines with by..., seq, kind (char or line), page_width.

    A page is a group; a document's pages are independent, so they run in parallel. For items that still lie
    page by page see segment_whole_pages, which moves none.
    """
    marked = items.withColumn("formula", F.coalesce(X.is_formula_glyph("font", "text") | X.is_vertical("m0", "m3"), F.lit(False)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.select(*by).schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        return pd.DataFrame([{c: pdf[c].iloc[0] for c in by} | _page_row(pdf)])

    return marked.groupBy(*by).applyInPandas(run, f"{schema}, {PAGE_ROW}")


def _spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of ranges of these begins and lengths, one range after the other."""
    return np.arange(lengths.sum()) + np.repeat(begins - (np.cumsum(lengths) - lengths), lengths)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and how many each has."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.array([len(t) for t in texts], int)


def _strings(points: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts that end at these places among the code points."""
    sizes = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)])
    data = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return pa.Array.from_buffers(pa.string(), len(ends), [None, pa.py_buffer(np.concatenate([[0], sizes[ends]]).astype(np.int32)), pa.py_buffer(data)])


def _texts(page: Glyphs, cuts: Cuts, begins: np.ndarray, last: np.ndarray, numbers: np.ndarray) -> pa.Array:
    """The texts of the paragraphs that begin there: glyphs of no formula, spaces, and a placeholder with its number
    after each formula's last glyph."""
    own, lengths = _points(page.texts)
    shown = lengths[page.code] * ~cuts.math
    marks, marked = _points([f"{{v{i}}}" for i in numbers.tolist()])
    total = shown + cuts.spaced
    total[last] += marked
    ends = np.cumsum(total)
    out = np.empty(ends[-1] if len(ends) else 0, "<u4")
    out[(ends - total)[cuts.spaced]] = 32
    kept = np.flatnonzero(~cuts.math)
    code = page.code[kept]
    if (lengths == 1).all():
        out[ends[kept] - 1] = own[code]
    else:
        out[_spread(ends[kept] - lengths[code], lengths[code])] = own[_spread((np.cumsum(lengths) - lengths)[code], lengths[code])]
    out[_spread(ends[last] - marked, marked)] = marks
    return _strings(out, ends[np.append(begins[1:], len(page)) - 1] if len(begins) else ends)


def _listed(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _line_arrays(lines: pa.Array, rows: np.ndarray) -> pa.Array:
    names = ["x0", "y0", "x1", "y1", "line_width"]
    return pa.StructArray.from_arrays([lines.field(c).take(pa.array(rows)) for c in names], names)


def _page_arrays(page: Glyphs, fonts: pa.Array, kind: np.ndarray, lines: pa.Array, of_page: np.ndarray) -> list[pa.Array]:
    """PAGE_ROW of pages, as arrays. kind: each glyph's place in fonts; of_page: each line's page."""
    cuts = cut_runs(page)
    a = np.flatnonzero(cuts.run)
    z = np.append(a[1:], len(page))
    a, z = a[cuts.math[a]], z[cuts.math[a]]
    firsts = np.searchsorted(a, page.ends)
    numbers = np.arange(len(a)) - np.repeat(firsts[:-1], np.diff(firsts))
    # A line belongs to the formula that the glyph before it is of.
    after = lines.field("after").to_numpy()
    at, held = page.ends[of_page] + after - 1, after > 0
    held[held] = cuts.math[at[held]] & (page.region[at[held]] == lines.field("region").to_numpy()[held])
    owned, free = np.flatnonzero(held), np.flatnonzero(~held)
    owner = np.searchsorted(a, at[owned], "right") - 1
    inner = np.flatnonzero(cuts.math)
    code = pa.array(page.code[inner])
    texts, points = pa.array(page.texts, pa.string()), pa.array([ord(t[0]) if t else 0 for t in page.texts], pa.int32())
    glyphs = pa.StructArray.from_arrays([texts.take(code), fonts.take(pa.array(kind[inner])), *(pa.array(getattr(page, c)[inner]) for c in SIDES), points.take(code)], ["text", "font", *SIDES, "cid"])
    widths = np.maximum.reduceat(page.x1, np.flatnonzero(cuts.run))[cuts.math[cuts.run]] - page.x0[a] if len(a) else np.zeros(0)
    formulas = pa.StructArray.from_arrays([pa.array(widths), pa.array(_offsets(page, cuts, a, z)), _listed(np.append(np.searchsorted(inner, a), len(inner)), glyphs), _listed(np.searchsorted(owner, np.arange(len(a) + 1)), _line_arrays(lines, owned))], ["width", "fix", "glyphs", "lines"])
    p = np.flatnonzero(cuts.paragraph)
    size = cuts.size[np.append(p[1:], len(page)) - 1] if len(p) else np.zeros(0)
    least = lambda v: np.minimum.reduceat(v, p) if len(p) else v
    most = lambda v: np.maximum.reduceat(v, p) if len(p) else v
    broken = np.logical_or.reduceat(cuts.spaced & page.back, p) if len(p) else np.zeros(0, bool)
    columns = [page.x0[p], page.y0[p] - (size - page.size[p]), least(page.x0), np.maximum(page.x0[p], most(page.x1)), least(page.y0), most(page.y1), size]
    paragraphs = pa.StructArray.from_arrays([*map(pa.array, columns), _texts(page, cuts, p, z - 1, numbers), pa.array(broken)], ["x", "y", "x0", "x1", "y0", "y1", "size", "text", "brk"])
    return [_listed(np.searchsorted(p, page.ends), paragraphs), _listed(firsts, formulas), _listed(np.searchsorted(of_page[free], np.arange(len(page.ends))), _line_arrays(lines, free))]


def segment_whole_pages(pages: DataFrame, by: list[str]) -> DataFrame:
    """segment_pages of pages(by..., page_width, glyphs, kinds, lines) as read_whole_pages gives them: a row a page with its glyphs in
    order as packed columns. Only kinds are judged by themselves, glyphs are read by columns over many pages, and none is shuffled or sorted."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select(*by).schema)
    mark = lambda k: F.coalesce(X.is_formula_glyph(k.font, k.text) | X.is_vertical(k.m0, k.m3), F.lit(False))
    marked = F.transform("kinds", lambda k: F.struct(k.font.alias("font"), F.coalesce(k.text, F.lit("")).alias("text"), mark(k).alias("marked")))
    names, types = [*by, *(f.name for f in to_arrow_schema(T._parse_datatype_string(PAGE_ROW)))], [f.type for f in to_arrow_schema(T._parse_datatype_string(PAGE_ROW))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n, *cells = b.column("glyphs").flatten()
            counts = n.to_numpy().astype(int)
            found = {c: unpacked(c, v, counts) for c, v in zip(PACKED, cells, strict=True)}
            kinds, lines = b.column("kinds"), b.column("lines")
            sizes = np.diff(kinds.offsets.to_numpy())
            fonts, texts, marks = kinds.flatten().flatten()
            own = texts.dictionary_encode()
            kind = found["code"] + np.repeat(np.cumsum(sizes) - sizes, counts)
            page = Glyphs(own.dictionary.to_pylist(), own.indices.to_numpy()[kind], marks.to_numpy(zero_copy_only=False)[kind], found["region"], *(found[c] for c in SIDES), b.column("page_width").to_numpy(), counts)
            of_page = np.repeat(np.arange(b.num_rows), np.diff(lines.offsets.to_numpy()))
            lines = lines.flatten()
            arrays = _page_arrays(page, fonts, kind, lines, of_page)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by), *(v.cast(t) for v, t in zip(arrays, types, strict=True))], names)

    return pages.select(*by, "page_width", "glyphs", marked.alias("kinds"), "lines").mapInArrow(run, f"{schema}, {PAGE_ROW}")


# ---------------------------------------------------------------- reflow


@dataclass
class FixedMetrics:
    """Stand-in font metrics: Latin-1 half an em wide in font tiro, all else an em in font noto."""

    latin: str = "tiro"
    other: str = "noto"

    def advance(self, ch: str) -> tuple[str, float]:
        return (self.latin, 0.5) if ord(ch) < 256 else (self.other, 1.0)

    def codes(self, font: str, text: str) -> str:
        top, latin = max(text, default=""), font == self.latin
        if top <= ("\xff" if latin else "\uffff"):
            return text.encode("latin-1" if latin else "utf-16-be", "surrogatepass").hex()
        return "".join(f"{ord(c):0{2 if latin else 4}x}" for c in text)


_PLACEHOLDER = re.compile(r"\{\s*v([\d\s]+)\}", re.I)
_MODIFIERS = ("Lm", "Mn", "Sk")


@dataclass
class Token:
    """A character or a formula: what it takes up, and how far it moves on what follows."""

    char: str
    formula: dict | None
    font: str | None
    width: float
    advance: float


def measure(text: str, formulas: list, metrics: FixedMetrics, size: float) -> list[Token]:
    """The characters and known formulas of a text with their sizes; unknown placeholders are left out.
    A formula that ends in a modifier moves on by that much less."""

    def formula(m: re.Match) -> list[Token]:
        digits = m[1].replace(" ", "")
        f = formulas[int(digits)] if digits.isdigit() and int(digits) < len(formulas) else None
        if f is None:
            return []
        last = f["glyphs"][-1]
        modifier = bool(last["text"]) and unicodedata.category(last["text"][0]) in _MODIFIERS
        return [Token("", f, None, f["width"], f["width"] - (last["x1"] - last["x0"]) * modifier)]

    sized = {c: Token(c, None, font, em * size, em * size) for c in set(text) for font, em in [metrics.advance(c)]}
    chars = lambda part: [sized[c] for c in part]

    out, at = [], 0
    for m in _PLACEHOLDER.finditer(text):
        out += chars(text[at : m.start()]) + formula(m)
        at = m.end()
    return out + chars(text[at:])


def _dropped(t: Token, x: float, par: dict) -> bool:
    """Whether a token is a space at the begin of a line, which takes up nothing."""
    return t.char == " " and x == par["x0"]


def place(tokens: list[Token], par: dict) -> list[tuple[float, int, bool]]:
    """Where each token stands: x, line, and whether it is beyond the right edge of the line before.

    Beyond the edge a paragraph that had several lines goes on in the next one, another runs on.
    """
    out, x, line = [], par["x"], 0
    for t in tokens:
        beyond = x + t.width > par["x1"] + 0.1 * par["size"]
        if beyond and par["brk"]:
            x, line = par["x0"], line + 1
        out.append((x, line, beyond))
        x += 0 if _dropped(t, x, par) else t.advance
    return out


def _text_op(font, size, x, dy, codes, line) -> dict:
    return {"kind": "TEXT", "font": font, "size": size, "x": x, "dy": dy, "codes": codes, "line": line, "dx": None, "dy2": None, "width": None}


def _formula_ops(f: dict, x: float, line: int, fix: float, metrics: FixedMetrics) -> list[dict]:
    """The glyphs of a formula and its thin lines, each as far from x as it was from the first glyph."""
    left, base = f["glyphs"][0]["x0"], f["glyphs"][0]["y0"]
    glyphs = [_text_op(g["font"], g["size"], x + g["x0"] - left, fix + g["y0"] - base, metrics.codes(g["font"], chr(g["cid"])), line) for g in f["glyphs"]]
    thin = [s for s in f["lines"] if s["line_width"] < K.MAX_LINE_WIDTH]
    return glyphs + [{"kind": "LINE", "font": None, "size": None, "x": s["x0"] + x - left, "dy": s["y0"] + fix - base, "codes": None, "line": line, "dx": s["x1"] - s["x0"], "dy2": s["y1"] - s["y0"], "width": s["line_width"]} for s in thin]


def place_even(text: str, width: float, par: dict) -> tuple[list[tuple[int, int, float, int]], int]:
    """place for characters of one width: the stretches (first, last + 1, x, line) to be drawn, and the last character's line.
    Even the first character of a line must fit."""
    edge, left, n = par["x1"] + 0.1 * par["size"], par["x0"], len(text)
    out, x, line, i, full = [], par["x"], 0, 0, 0
    while True:
        if x == left:
            while i < n and text[i] == " ":
                i += 1
        z = min(i + full, n) if line else i
        if not full or not line:
            while z < n and x + width <= edge:
                x, z = x + width, z + 1
            full = z - i if line else 0
        if z > i:
            out.append((i, z, par["x"] if not line else left, line))
        if z == n:
            return out, line
        if not par["brk"]:
            for k in range(z, n):
                out.append((k, k + 1, x, line))
                x += width
            return out, line
        i, x, line = z, left, line + 1


class Reflow:
    """The drawing operators of one paragraph with a new text: tokens are measured, placed, then drawn
    in stretches of one font and line."""

    def __init__(self, par: dict, formulas: list, metrics: FixedMetrics):
        self.par, self.formulas, self.metrics = par, formulas, metrics
        self.ops: list[dict] = []
        self.lines = 0

    def run(self, text: str) -> Reflow:
        kinds = {self.metrics.advance(c) for c in set(text)}
        if len(kinds) == 1 and not ("{" in text and _PLACEHOLDER.search(text)):
            ((font, em),) = kinds
            size = self.par["size"]
            if self.par["x0"] <= self.par["x"] and self.par["x0"] < self.par["x0"] + em * size <= self.par["x1"] + 0.1 * size:
                parts, self.lines = place_even(text, em * size, self.par)
                self.ops = [_text_op(font, size, x, 0.0, self.metrics.codes(font, text[a:z]), line) for a, z, x, line in parts]
                return self
        tokens = measure(text, self.formulas, self.metrics, self.par["size"])
        places = place(tokens, self.par)
        self.lines = places[-1][1] if places else 0
        first_text = next((i for i, t in enumerate(tokens) if t.formula is None), len(tokens))
        stretch: list[int] = []

        def draw() -> None:
            if stretch:
                x, line, _ = places[stretch[0]]
                font = tokens[stretch[0]].font
                self.ops.append(_text_op(font, self.par["size"], x, 0.0, self.metrics.codes(font, "".join(tokens[i].char for i in stretch)), line))
                stretch.clear()

        for i, (t, (x, line, beyond)) in enumerate(zip(tokens, places, strict=True)):
            if t.formula is not None or beyond or (stretch and tokens[stretch[-1]].font != t.font):
                draw()
            if t.formula is not None:
                self.ops += _formula_ops(t.formula, x, line, t.formula["fix"] if first_text < i else 0.0, self.metrics)
            elif not _dropped(t, x, self.par):
                stretch.append(i)
        draw()
        return self


def fitted_line_height(start: float, lines: int, size: float, height: float) -> float:
    while (lines + 1) * size * start > height and start >= 1:
        start -= K.LINE_STEP
    return start


def draw_page(page: dict, texts: list[str], lang: str, metrics: FixedMetrics | None = None) -> str:
    """The drawing operators of a page whose paragraphs have new texts, then its own lines."""
    metrics, out = metrics or FixedMetrics(), []
    height = K.LINE_HEIGHTS.get(lang.lower(), K.DEFAULT_LINE_HEIGHT)
    for par, text in zip(page["paragraphs"], texts, strict=True):
        flow = Reflow(par, page["formulas"], metrics).run(text)
        leading = par["size"] * fitted_line_height(height, flow.lines, par["size"], par["y1"] - par["y0"])
        for op in flow.ops:
            y = op["dy"] + par["y"] - op["line"] * leading
            values = (op["font"], op["size"], op["x"], y, op["codes"]) if op["kind"] == "TEXT" else (op["x"], y, op["width"], op["dx"], op["dy2"])
            out.append((K.TEXT_OP if op["kind"] == "TEXT" else K.LINE_OP) % values)
    out += [K.LINE_OP % (s["x0"], s["y0"], s["line_width"], s["x1"] - s["x0"], s["y1"] - s["y0"]) for s in page["lines"] if s["line_width"] < K.MAX_LINE_WIDTH]
    return f"BT {''.join(out)}ET "


def draw_pages(pages: DataFrame, by: list[str], lang: str, make_metrics: Callable[[], FixedMetrics] = FixedMetrics) -> DataFrame:
    """(by..., ops) of segment_pages rows with an array translations, one text per paragraph."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select(*by).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metrics = make_metrics()
        for b in batches:
            ops = []
            for paragraphs, formulas, lines, texts in zip(*(b.column(c) for c in ("paragraphs", "formulas", "lines", "translations")), strict=True):
                texts = texts.as_py()
                page = {"paragraphs": paragraphs.as_py(), "formulas": formulas.as_py() if any("{" in t for t in texts) else [], "lines": lines.as_py()}
                ops.append(draw_page(page, texts, lang, metrics))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by), pa.array(ops, pa.string())], [*by, "ops"])

    sizes = F.transform("paragraphs", lambda p: p.dropFields("text")).alias("paragraphs")
    return pages.select(*by, sizes, "formulas", "lines", "translations").mapInArrow(run, f"{schema}, ops string")
