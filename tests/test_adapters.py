"""Adapters with stand-ins: page content, images, services, downloads, JSON as text."""

import json
import math
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.functions import text as X
from folioflow.functions.packed import PACKED
from folioflow.operators import calls, layout, quality
from folioflow.sources import files, interpreter, pages, render

INNER = {"matrix": [1, 0, 0, 1, 5, 0], "content": [["text", "b", 10, 0, 0, "x"], ["Do", "outer"]]}
PAGE = {
    "resources": {"fonts": {"a": {"default": 0.5, "W": 1.0}}, "forms": {"outer": {"matrix": [2, 0, 0, 2, 0, 100], "resources": {"fonts": {"b": {"default": 0.25}}, "forms": {"inner": INNER}}, "content": [["text", "a", 5, 10, 0, "Wi"], ["Do", "inner"], ["Do", "unknown"]]}}},
    "content": [["q"], ["cm", 1, 0, 0, 1, 50, 0], ["Do", "outer"], ["line", 0, 0, 10, 0, 1], ["Q"], ["Q"], ["text", "a", 10, 0, 0, "ab"], ["odd"]],
}


def test_interpreter_follows_forms():
    drawn = interpreter.interpret(PAGE["content"], interpreter.Resources.of(PAGE["resources"]))
    spots = [(i["kind"], i["text"], i["x0"], i["y0"], i["x1"], i["y1"]) for i in drawn.items]
    assert spots[:2] == [("char", "W", 70, 100, 80, 110), ("char", "i", 80, 100, 85, 110)]  # 50 + 2 * 10, sizes doubled
    assert spots[2] == ("char", "x", 60, 100, 65, 120)  # the inner form's font and matrix, within the outer one's
    assert spots[3:] == [("line", "", 50, 0, 60, 0), ("char", "a", 0, 0, 5, 10), ("char", "b", 5, 0, 10, 10)]
    assert [(f["name"], f["depth"]) for f in drawn.forms] == [("outer", 1), ("inner", 2)]  # and no form within itself
    for f in drawn.forms:
        assert interpreter.times(f["matrix"], f["inverse"]) == pytest.approx(interpreter.IDENTITY)
    assert interpreter.inverse((1, 1, 1, 1, 0, 0)) is None
    turned = interpreter.interpret([["cm", 0, 1, -1, 0, 0, 0], ["text", "f", 10, 0, 0, "v"]], interpreter.Resources())
    assert (turned.items[0]["m0"], turned.items[0]["m3"]) == (0, 0) and turned.items[0]["size"] == 10


def test_forms_through_spark(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"pages": [PAGE, {"content": [["text", "f", 10, 50, 700, "alone"]]}, {}]}))
    spark.dataSource.register(pages.PageSource)
    read = lambda parts: spark.read.format("pages").option("backend", "forms").option("partsPerFile", parts).load(str(path))
    assert sorted(map(repr, read(1).collect())) == sorted(map(repr, read(2).collect())) and read(1).where("kind = 'line'").count() == 1
    binaries = spark.createDataFrame([("d", bytearray(path.read_bytes()))], "path string, content binary")
    found = layout.segment_pages(pages.read_pages(binaries, "forms"), ["path", "page"])
    assert {r.page: [p.text for p in r.paragraphs][0] for r in found.collect()}[1] == "alone"


def test_page_reader_opens_nothing_on_the_driver():
    reader = pages.PageReader({"path": "/no/such/file,/nor/this", "partsPerFile": "3"})
    assert [(p.path, p.part) for p in reader.partitions()] == [(f, i) for f in ("/no/such/file", "/nor/this") for i in range(3)]


def test_dominant_image():
    gray, color = np.full((4, 4), 7, np.uint8), np.full((4, 4, 4), 255, np.uint8)
    assert render.dominant_image([(1, 0.5, gray), (2, 0.3, color), (1, 0.4, gray)]) is gray
    assert (render.dominant_image([(2, 0.8, color)]) == 255).all() and render.dominant_image([(2, 0.8, color)]).shape == (4, 4)
    assert render.dominant_image([(1, 0.79, gray)]) is None and render.dominant_image([]) is None

    class Scans(render.GridRenderer):
        def images(self, content, page):
            return [(1, 0.9 if page == 0 else 0.1, gray)]

    own = Scans(pages.PlainBackend())
    assert render.render_for_ocr(own, b"a\fb", 0, 72).shape == (4, 4) and render.render_for_ocr(own, b"a\fb", 1, 72).shape == (800, 600)


def test_overlay(spark):
    white = bytearray(np.full((20, 30), 255, np.uint8).tobytes())
    images = spark.createDataFrame([(0, 20, 30, white), (1, 20, 30, white)], "page int, height int, width int, pixels binary")
    boxes = spark.createDataFrame([(0, 1, "Text", 10.0, 10.0, 40.0, 30.0), (0, 0, "Table", 50.0, 0.0, 99.0, 5.0)], "page int, pos int, label string, x0 double, y0 double, x1 double, y1 double")
    got = {r.page: r for r in render.overlay(images, boxes, ["page"], 60.0, 40.0).collect()}
    drawn = np.frombuffer(got[0].pixels, np.uint8).reshape(20, 30)
    assert (drawn[5, 5:21] == 0).all() and (drawn[15, 5:21] == 0).all() and (drawn[5:16, [5, 20]] == 0).all() and (drawn[6:15, 6:20] == 255).all()
    assert (drawn[0:3, 29] == 0).all() and [m["label"] for m in json.loads(got[0].marks)] == ["Table", "Text"]
    assert got[1].pixels == bytes(white) and got[1].marks == "[]"


def test_failed_images_have_no_rows(spark):
    def make():
        def model(batch):
            if any(i == b"bad" for i in batch):
                raise ValueError
            return [[{"text": i.decode()}] for i in batch]

        return model

    images = spark.createDataFrame([(1, bytearray(b"one")), (2, bytearray(b"bad")), (3, bytearray(b"two"))], "crop_id int, image binary").coalesce(1)
    found = pages.predict(images, make, ["crop_id"], "crop_id int, text string")
    blocks = spark.createDataFrame([(3, "FLOWING_TEXT"), (2, "EQUATION"), (1, "EQUATION")], "crop_id int, category string")
    got = {r.crop_id: (r.source_text, r.latex) for r in layout.texts_of_crops(blocks, found).collect()}
    assert got == {1: ("one", "[EQUATION_PLACEHOLDER]"), 2: ("", "[EQUATION_PLACEHOLDER]"), 3: ("two", "")}


def test_boxes_of_a_layout_model(spark):
    """A page of 300 by 500 on an image of 1024: the middle of the image is that of the page."""
    rows = [(1, 0.9, 0.0, 0.0, 1024.0, 1024.0), (2, 0.2, 0.0, 0.0, 9.0, 9.0), (3, 0.9, 512.0, 512.0, 512.01, 900.0), (4, 0.9, 512.0, 512.0, 1024.0, 1024.0)]
    found = spark.createDataFrame([(*r, 300, 500) for r in rows], "i int, conf double, x0 double, y0 double, x1 double, y1 double, height int, width int")
    got = {r.i: (round(r.x0), round(r.y0), round(r.x1), round(r.y1)) for r in layout.detected_boxes(found, 1024, 1024).collect()}
    assert got == {1: (0, 0, 500, 300), 4: (250, 150, 500, 300)}


def test_services():
    own = calls.provider_for("ollama:m", send=lambda texts: [t.upper() for t in texts], lang_in="en", lang_out="de", temperature=0, prompt="p")
    assert own.params == {"lang_in": "en", "lang_out": "de", "model": "m", "temperature": 0} and own.translate(["a"]) == ["A"]
    assert calls.cache_params("openai", "en", "de", "m", temperature=0, prompt="p", think="t", other=1) == {"lang_in": "en", "lang_out": "de", "model": "m", "temperature": 0, "prompt": "p", "think": "t"}
    assert calls.provider_for("bing", send=lambda texts: texts).translate(["x" * 3000]) == ["x" * 1000]
    with pytest.raises(ValueError, match="needs"):
        calls.provider_for("google")


def test_uncached_service(spark, tmp_path):
    cache, texts = spark.createDataFrame([], schemas.CACHE), spark.createDataFrame([("hello",)], "text string")
    done, new = calls.translate_texts(texts, cache, calls.provider_for("argos", send=lambda t: [x + "!" for x in t]), 1, str(tmp_path / "s"))
    assert done.first().translation == "hello!" and new.count() == 0


def test_downloads_stop_at_the_limit(spark):
    def parts():
        yield b"abc"
        yield b"def"
        raise AssertionError("read on")

    answers = {"http://x/a": (200, [b"ab", b"cd"], None), "http://x/b": (200, parts, None)}
    urls = spark.createDataFrame([(u,) for u in answers], "url string")
    make = lambda u: (answers[u][0], answers[u][1]() if callable(answers[u][1]) else answers[u][1], None)
    got = {r.url: (r.content and bytes(r.content), r.error) for r in files.fetch(urls, make, 5).collect()}
    assert got == {"http://x/a": (b"abcd", None), "http://x/b": (None, "over 5 bytes")}


def test_translated_path(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, pdf_path string")
    files.write_documents(docs, source=str(tmp_path / "in.json"))
    assert (tmp_path / "in.translated.json").is_dir() and files.translated_path("x") == "x.translated.json"
    with pytest.raises(ValueError):
        files.write_documents(docs)


def test_json_that_the_schema_cannot_read(spark):
    texts = ['{"pdf_path": "a", "pages": []}', "no json", '{"pdf_path": "a", "pages": {"x": 1}}', '{"pages": []}', None, '{"pdf_path": "a", "pages": [{"page_width": "wide"}]}']
    rows = quality.validate_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")).collect()
    assert {r.i: [e.code for e in r.errors] for r in rows} == {0: [], 1: ["JSON_SCHEMA"], 2: ["JSON_SCHEMA"], 3: ["MISSING_FIELD"], 4: ["JSON_SCHEMA"], 5: ["JSON_SCHEMA"]}


def test_result_of_page(spark):
    found = spark.createDataFrame([('<div class="result-container">a &amp; b\n</div><p class="t0">c</p>',), ('<p class="t0">d</p>',), ("none",)], "h string").select(X.result_of_page("h").alias("r")).collect()
    assert [r.r for r in found] == ["a & b", "d", None]


# ---------------------------------------------------------------- paragraphs and drawings of plain pages, plainly


def plain_paragraphs(text):
    """Paragraphs and number of formulas of a page of plain text in a grid: as the page source sets it, all of
    one region and size, so only characters, brackets and jumps decide."""
    cells = [(c, row, col) for row, line in enumerate(text.split("\n")) for col, c in enumerate(line)]
    odd = lambda c: c != " " and (unicodedata.category(c) in ("Lm", "Mn", "Sk", "Sm", "Zl", "Zp", "Zs") or "\u0370" <= c <= "\u03ff")
    out, formulas, depth, inside = [], 0, 0, False
    for i, (c, row, col) in enumerate(cells):
        before = cells[i - 1] if i else None
        math = odd(c)
        if not math and c == "(" and inside:
            math, depth = True, depth + 1
        elif not math and c == ")" and depth:
            math, depth = True, depth - 1
        jump = bool(before and out and out[-1] and abs(6 * (col - before[2])) > 150)
        if inside and (not math or jump):
            new = not out[-1]
            out[-1] += f"{{v{formulas}}}"
            formulas, inside = formulas + 1, False
        else:
            new = False
        if not inside:
            if not i or new:
                out.append("")
            elif col > before[2] + 1 or col + 1 < before[2]:
                out[-1] += " "
        if math:
            inside = True
        else:
            out[-1] += c
    if inside:
        out[-1] += f"{{v{formulas}}}"
        formulas += 1
    return out, formulas


TEXTS = ["plain words", "two\nlines of it", "a = b + (c) and so on", "=\ntext", "αβγ (x) end", "f(x) = (y", "long " * 30 + "=\n+ more", "x\n\ny", "= = =", "", "  lead", "e = m(c)(d) ok", "日本 = 語"]


def test_paragraphs_like_a_plain_version(spark, sf_dir):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    own = spark.createDataFrame([(str(i), bytearray(t.replace("\f", " ").encode())) for i, t in enumerate(texts)], "path string, content binary")
    got = {int(r.path): ([p.text for p in r.paragraphs], len(r.formulas)) for r in layout.segment_pages(pages.read_pages(own), ["path", "page"]).collect()}
    for i, t in enumerate(texts):
        if t.replace("\n", ""):
            assert got[i] == plain_paragraphs(t.replace("\f", " ")), t


def test_whole_pages_like_rows_of_glyphs(spark):
    """Pages that stay whole give what grouped glyphs give, without moving any of them."""
    rows = [(str(i), bytearray(("\f".join(TEXTS[i:] + ["(cid:3) ∑"])).encode())) for i in range(len(TEXTS))] + [("empty", bytearray(b""))]
    own = spark.createDataFrame(rows, "path string, content binary")
    want = sorted(layout.segment_pages(pages.read_pages(own), ["path", "page"]).collect(), key=str)
    whole = layout.segment_whole_pages(pages.read_whole_pages(own), ["path", "page"])
    assert sorted(whole.collect(), key=str) == want and any(r.formulas for r in want)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()


def test_whole_pages_with_lines_and_sizes(spark):
    """Other backends' pages are packed from their rows: fonts, sizes, lines, pages without glyphs."""
    draw = [["text", "F", 10, 50, 700, "area x"], ["text", "F", 7, 80, 698, "2"], ["line", 80, 697, 86, 697, 0.5], ["text", "CMMI", 10, 90, 700, "y"], ["line", 90, 699, 95, 699, 1], ["text", "F", 10, 96, 700, " is"]]
    contents = [[draw, [["line", 1, 2, 3, 2, 1.0]], []], [draw[::-1]], [[["text", "F", 1 / 3, 50, 700, "thirds"]]]]
    rows = [(str(i), bytearray(json.dumps({"pages": [{"content": c} for c in p]}).encode())) for i, p in enumerate(contents)]
    own = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    want = sorted(layout.segment_pages(pages.read_pages(own, "forms"), ["path", "page"]).collect(), key=str)
    got = layout.segment_whole_pages(pages.read_whole_pages(own, "forms"), ["path", "page"]).collect()
    assert sorted(got, key=str) == want and len(want) == 4
    assert any(f.lines for r in want for f in r.formulas) and any(r.lines for r in want)


def test_glyphs_are_packed_and_long_pages_take_their_share(spark):
    """Glyphs are a few cells a page for the engine, and a page of one very long paragraph is read in time in proportion."""
    text = " so long a line" * 60_000
    own = spark.createDataFrame([("a", bytearray(text.encode())), ("none", None)], "path string, content binary")
    start = time.time()
    (row,) = layout.segment_whole_pages(pages.read_whole_pages(own), ["path", "page"]).collect()
    assert [p.text for p in row.paragraphs] == [text] and row.formulas == []
    assert time.time() - start < 20
    glyphs = pages.read_whole_pages(own).schema["glyphs"].dataType
    assert {f.name: f.dataType.simpleString() for f in glyphs} == {"n": "int"} | dict.fromkeys(PACKED, "binary")


def plain_drawing(text, width, left=50.0, top=740.0, size=10.0):
    """Drawing operators of one paragraph without formulas: broken greedily at the width, if it had lines."""
    rows, x = [[]], left
    for c in text:
        wide = size * (0.5 if ord(c) < 256 else 1.0)
        if x + wide > left + width + 0.1 * size:
            rows, x = [*rows, []], left
        if c == " " and x == left:
            continue
        rows[-1].append((x, c))
        x += wide
    return rows


def test_drawings_like_a_plain_version(spark):
    rng = np.random.default_rng(4)
    for _ in range(200):
        text = "".join(rng.choice(list("ab \u65e5c  d"), rng.integers(0, 60)))
        par = {"x": 50.0, "y": 740.0, "x0": 50.0, "x1": 50.0 + float(rng.integers(20, 90)), "y0": 700.0, "y1": 750.0, "size": 10.0, "text": "", "brk": True}
        flow = layout.Reflow(par, [], layout.FixedMetrics()).run(text)
        rows = plain_drawing(text, par["x1"] - 50.0)
        assert flow.lines == len(rows) - 1
        for n, row in enumerate(rows):
            ops = [o for o in flow.ops if o["line"] == n]
            codes = "".join(o["codes"] for o in ops)
            assert codes == "".join(f"{ord(c):0{2 if ord(c) < 256 else 4}x}" for _, c in row)
            assert not row or math.isclose(ops[0]["x"], row[0][0])
