"""Page rasters and document conversions, over pluggable backends.

A raster is a struct (height, width, pixels): grey bytes in rows. GridRenderer is a deterministic
stand-in that draws glyph boxes; a real renderer has the same two methods.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions import constants as K
from folioflow.sources.pages import PlainBackend

RASTER = "height int, width int, pixels binary"
#: Grey of the padding around a resized image, and white.
PADDING, WHITE = 114, 255


@dataclass
class GridRenderer:
    """White pages with a black box for each visible character."""

    backend: PlainBackend

    def n_pages(self, content: bytes) -> int:
        return self.backend.n_pages(content)

    def render(self, content: bytes, page: int, dpi: int) -> np.ndarray:
        k, own = dpi / 72, self.backend
        out = np.full((round(own.page_height * k), round(own.page_width * k)), WHITE, np.uint8)
        for g in own.page(content, page).itertuples(index=False):
            if not g.text.isspace():
                out[max(0, int((own.page_height - g.y1) * k)) : int((own.page_height - g.y0) * k), max(0, int(g.x0 * k)) : int(g.x1 * k)] = 0
        return out


def dominant_image(placements: list[tuple[int, float, np.ndarray]], least: float = K.DOMINANT_IMAGE) -> np.ndarray | None:
    """The embedded image that covers most of a page, if its shares of the page add up to least: of
    placements (number, share, raster); the first of equals. Colours become grey."""
    shares: dict[int, float] = {}
    for number, share, _ in placements:
        shares[number] = shares.get(number, 0.0) + share
    best = max(shares, key=shares.get, default=None)
    if best is None or shares[best] < least:
        return None
    image = next(raster for number, _, raster in placements if number == best)
    return image if image.ndim == 2 else np.round(image[..., :3] @ [0.299, 0.587, 0.114]).astype(np.uint8)


def render_for_ocr(renderer, content: bytes, page: int, dpi: int) -> np.ndarray:
    """A page as text recognition reads it best: its dominant image as it was embedded, else drawn."""
    images = getattr(renderer, "images", None)
    found = dominant_image(images(content, page)) if images else None
    return renderer.render(content, page, dpi) if found is None else found


def render_pages(binaries: DataFrame, make_renderer: Callable[[], GridRenderer], dpi: int = 72, for_ocr: bool = False) -> DataFrame:
    """(path, page, height, width, pixels) of binaries(path, content), one page at a time. for_ocr takes
    dominant embedded images instead of drawing; a layout model needs pages drawn."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer = make_renderer()
        for df in frames:
            for path, content in zip(df["path"], df["content"], strict=True):
                for page in range(renderer.n_pages(content)):
                    image = render_for_ocr(renderer, content, page, dpi) if for_ocr else renderer.render(content, page, dpi)
                    yield pd.DataFrame([(path, page, *image.shape, image.tobytes())], columns=["path", "page", "height", "width", "pixels"])

    return binaries.select("path", "content").mapInPandas(run, f"path string, page int, {RASTER}")


def crop(image: np.ndarray, window: tuple[int, int, int, int] | None) -> np.ndarray:
    """The pixels of a window (x0, y0, x1, y1); one white pixel where there is none."""
    return np.full((1, 1), WHITE, np.uint8) if window is None else image[window[1] : window[3], window[0] : window[2]]


def resize_and_pad(image: np.ndarray, height: int, width: int, stride: int = 32) -> np.ndarray:
    """The image scaled to fit, bilinear, then padded to multiples of the stride past its own size."""
    h, w = image.shape
    r = min(height / h, width / w)
    rh, rw = round(h * r), round(w * r)
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((rh, h), (rw, w)))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    rows = lambda i: image[i][:, x0] * (1 - fx) + image[i][:, x1] * fx
    scaled = np.round(rows(y0) * (1 - fy) + rows(y1) * fy).astype(np.uint8)
    ph, pw = (height - rh) % stride, (width - rw) % stride
    return np.pad(scaled, ((ph // 2, ph - ph // 2), (pw // 2, pw - pw // 2)), constant_values=PADDING)


def map_images(images: DataFrame, make: Callable[[], Callable[[np.ndarray], np.ndarray]], by: list[str]) -> DataFrame:
    """images(by..., height, width, pixels) with each raster changed by a function that make() gives per task."""
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.select(*by).schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        change = make()
        for df in frames:
            out = [change(np.frombuffer(p, np.uint8).reshape(h, w)) for h, w, p in zip(df["height"], df["width"], df["pixels"], strict=True)]
            yield df[by].assign(height=[i.shape[0] for i in out], width=[i.shape[1] for i in out], pixels=[np.ascontiguousarray(i).tobytes() for i in out])

    return images.select(*by, "height", "width", "pixels").mapInPandas(run, f"{keys}, {RASTER}")


def overlay(images: DataFrame, boxes: DataFrame, by: list[str], page_width: float, page_height: float) -> DataFrame:
    """images(by..., height, width, pixels) with the borders of each page's boxes drawn in black, and marks:
    the same boxes as JSON. boxes(by..., pos, label, x0..y1) are in points, origin at the top left; a page
    without boxes stays as it is."""
    box = F.struct("pos", "label", "x0", "y0", "x1", "y1")
    held = images.join(boxes.groupBy(*by).agg(F.sort_array(F.collect_list(box)).alias("boxes")), by, "left")
    held = held.withColumn("marks", F.coalesce(F.to_json("boxes"), F.lit("[]")))
    keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in images.select(*by).schema)

    def draw(image: np.ndarray, found: list) -> np.ndarray:
        out, (h, w) = image.copy(), image.shape
        for b in found:
            x0, x1 = (int(np.clip(v * w / page_width, 0, w - 1)) for v in (b["x0"], b["x1"]))
            y0, y1 = (int(np.clip(v * h / page_height, 0, h - 1)) for v in (b["y0"], b["y1"]))
            out[[y0, y1], x0 : x1 + 1] = 0
            out[y0 : y1 + 1, [x0, x1]] = 0
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rasters = [np.frombuffer(p, np.uint8).reshape(h, w) for h, w, p in zip(df["height"], df["width"], df["pixels"], strict=True)]
            yield df[[*by, "height", "width"]].assign(pixels=[draw(r, [] if b is None else list(b)).tobytes() for r, b in zip(rasters, df["boxes"], strict=True)], marks=df["marks"])

    return held.select(*by, "height", "width", "pixels", "boxes", "marks").mapInPandas(run, f"{keys}, {RASTER}, marks string")


def convert(binaries: DataFrame, make: Callable[[], Callable[[bytes], bytes]]) -> DataFrame:
    """binaries(path, content) with contents converted (archival form, subset fonts, overlays) by a
    backend; a failure becomes an error and leaves the content null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        change = make()
        for df in frames:
            rows = []
            for path, content in zip(df["path"], df["content"], strict=True):
                try:
                    rows.append((path, change(content), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return binaries.select("path", "content").mapInPandas(run, "path string, content binary, error string")
