import numpy as np

from folioflow.sources import render
from folioflow.sources.pages import PlainBackend


def test_pages_become_rasters(spark):
    files = spark.createDataFrame([("a", bytearray(b"x y\fz"))], "path string, content binary")
    pages = render.render_pages(files, lambda: render.GridRenderer(PlainBackend()))
    rows = {r.page: np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width) for r in pages.collect()}
    assert rows[0].shape == (800, 600) and (rows[0] == 0).sum() == 2 * 60 and (rows[1] == 0).sum() == 60
    padded = render.map_images(pages, lambda: lambda i: render.resize_and_pad(i, 256, 256), ["path", "page"]).first()
    assert (padded.height, padded.width) == (256, 192)
    doubled = render.render_pages(files, lambda: render.GridRenderer(PlainBackend()), 144).first()
    assert (doubled.height, doubled.width) == (1600, 1200)


def test_images():
    image = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert render.crop(image, (1, 0, 3, 2)).tolist() == [[1, 2], [5, 6]] and render.crop(image, None).tolist() == [[255]]
    same = render.resize_and_pad(image, 3, 4, 1)
    assert same.tolist() == image.tolist()
    assert render.resize_and_pad(np.full((100, 50), 7, np.uint8), 64, 70).shape == (64, 38)
    assert set(np.unique(render.resize_and_pad(np.full((10, 10), 7, np.uint8), 10, 20))) == {7, render.PADDING}


def test_conversion(spark):
    files = spark.createDataFrame([("a", bytearray(b"ab")), ("b", bytearray(b""))], "path string, content binary")
    got = {r.path: (r.content, r.error) for r in render.convert(files, lambda: lambda c: bytes(reversed(c)) if c else 1 / 0).collect()}
    assert got == {"a": (bytearray(b"ba"), None), "b": (None, "ZeroDivisionError: division by zero")}
