"""Page readers: a Python data source over a pluggable backend, and model adapters.

The engine has no PDF, layout or OCR library. A backend turns one document into pages of glyphs
and lines; PlainBackend is a deterministic one that sets plain text in a fixed-width grid, so
everything after the reader can be tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from folioflow import schemas
from folioflow.functions.packed import PACKED, SIDES, packed


#: What tells whether a glyph is marked as of a formula; a page holds each kind once.
KIND = "font: string, text: string, m0: double, m3: double"
#: A line, after so many glyphs of its page.
LINE = "after: int, region: int, x0: double, y0: double, x1: double, y1: double, line_width: double"


@dataclass
class PageColumns:
    """A page: its kinds of glyphs as four lists, its glyphs in order as arrays, code being the number
    of a glyph's kind, and its lines as in LINE."""

    font: list
    text: list
    m0: list
    m3: list
    code: np.ndarray
    size: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    region: np.ndarray
    lines: list[dict]

    @classmethod
    def of(cls, rows: pd.DataFrame) -> PageColumns:
        """The page whose items are rows."""
        rows = rows.sort_values("seq", kind="stable")
        is_line = (rows["kind"] == "line").to_numpy()
        glyphs, lines = rows[~is_line], rows[is_line].assign(after=np.cumsum(~is_line)[is_line])
        plain = (pa.array(glyphs[c], t, from_pandas=True).to_pylist() for c, t in (("font", pa.string()), ("text", pa.string()), ("m0", pa.float64()), ("m3", pa.float64())))
        numbers: dict[tuple, int] = {}
        code = np.array([numbers.setdefault(k, len(numbers)) for k in zip(*plain, strict=True)], np.int32)
        kinds = [list(c) for c in zip(*numbers, strict=True)] or [[], [], [], []]
        held = pa.RecordBatch.from_pandas(lines[["after", "region", "x0", "y0", "x1", "y1", "line_width"]], preserve_index=False).to_pylist()
        return cls(*kinds, code, *(glyphs[c].to_numpy(float) for c in SIDES), glyphs["region"].to_numpy(int), held)


@dataclass
class PlainBackend:
    """Pages of plain text, split at form feeds; characters are 6 by 10 points."""

    page_width: float = 600.0
    page_height: float = 800.0

    def n_pages(self, content: bytes) -> int:
        return content.count(b"\f") + 1

    def page(self, content: bytes, n: int) -> pd.DataFrame:
        own = self._columns(content.split(b"\f")[n])
        text = pd.Series([own.text[i] for i in own.code.tolist()], dtype=object)
        out = pd.DataFrame({"seq": np.arange(len(own.code)), "kind": "char", "text": text, "font": "Plain", "size": own.size, "x0": own.x0, "y0": own.y0, "x1": own.x1, "y1": own.y1, "m0": 1.0, "m3": 1.0, "region": 2})
        return out.assign(line_width=pd.Series([None] * len(out), dtype="float64"))

    def pages(self, content: bytes) -> Iterator[PageColumns]:
        """All pages as columns; content is split once."""
        for part in content.split(b"\f"):
            yield self._columns(part)

    def _columns(self, part: bytes) -> PageColumns:
        text = part.decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        ends = points == 10
        row = np.cumsum(ends)
        begins = np.concatenate([[0], np.flatnonzero(ends) + 1])
        kept = np.flatnonzero(~ends)
        row = row[kept]
        x, y = 50.0 + 6 * (kept - begins[row]), self.page_height - 60 - 12.0 * row
        chars = sorted(set(text) - {"\n"})
        number = _numbers()
        number[[ord(c) for c in chars]] = np.arange(len(chars))
        k, n = len(chars), len(kept)
        return PageColumns(["Plain"] * k, chars, [1.0] * k, [1.0] * k, number[points[kept]], np.full(n, 10.0), x, y, x + 6, y + 10, np.full(n, 2), [])


@cache
def _numbers() -> np.ndarray:
    """A number for each code point, which a page sets for its own characters before it reads them."""
    return np.zeros(0x110000, np.int32)


def form_backend():
    """interpreter.FormBackend, imported where it is used."""
    from folioflow.sources.interpreter import FormBackend

    return FormBackend()


BACKENDS: dict[str, Callable] = {"plain": PlainBackend, "forms": form_backend}


class _Pages(InputPartition):
    def __init__(self, path: str, part: int, parts: int):
        self.path, self.part, self.parts = path, part, parts


class PageReader(DataSourceReader):
    """partsPerFile partitions for each file, each with every so manieth page. Files are opened by the
    tasks alone, from a folder that all machines mount; for other stores see read_pages."""

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.backend = BACKENDS[options.get("backend", "plain")]()
        self.parts = int(options.get("partsPerFile", "1"))

    def partitions(self) -> list[InputPartition]:
        return [_Pages(path, i, self.parts) for path in self.paths for i in range(self.parts)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            content = f.read()
        for n in range(partition.part, self.backend.n_pages(content), partition.parts):
            for g in self.backend.page(content, n).itertuples(index=False):
                width = None if g.line_width != g.line_width else g.line_width
                yield (partition.path, n, g.seq, g.kind, g.text, g.font, g.size, g.x0, g.y0, g.x1, g.y1, g.m0, g.m3, g.region, width, self.backend.page_width, self.backend.page_height)


class PageSource(DataSource):
    """spark.dataSource.register(PageSource); spark.read.format("pages").option("backend", ...).load(path)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return f"path string, {schemas.GLYPH}, page_width double, page_height double"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


def read_pages(binaries: DataFrame, backend: str = "plain") -> DataFrame:
    """Glyph rows of binaries(path, content), for stores that only Spark reads."""
    make = BACKENDS[backend]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = make()
        for df in frames:
            for path, content in zip(df["path"], df["content"], strict=True):
                for n in range(own.n_pages(content)):
                    rows = own.page(content, n)
                    if len(rows):
                        yield rows.assign(path=path, page=n, page_width=own.page_width, page_height=own.page_height)[columns]

    columns = ["path", *[c.strip().split(" ")[0] for c in schemas.GLYPH.split(",")], "page_width", "page_height"]
    return binaries.select("path", "content").mapInPandas(run, f"path string, {schemas.GLYPH}, page_width double, page_height double")


#: Pages are packed together until they hold so many glyphs, which bounds a worker's memory.
PACKED_GLYPHS = 1 << 18


def _arrow(fields: str) -> pa.StructType:
    types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    return pa.struct([(name, types[kind]) for name, kind in (f.split(": ") for f in fields.split(", "))])


def read_whole_pages(binaries: DataFrame, backend: str = "plain") -> DataFrame:
    """read_pages with a row a page: (path, page, page_width, page_height, glyphs, kinds, lines), for layout.segment_whole_pages.

    Glyphs are a struct of packed columns, so a page's glyphs are a few cells for the engine and not a value each: code is the
    glyph's place among the page's kinds. A backend gives all pages of a content as PageColumns (pages) or each as rows (page).
    Null contents have no pages.
    """
    make = BACKENDS[backend]

    def columns(own, content: bytes) -> Iterator[PageColumns]:
        if hasattr(own, "pages"):
            return own.pages(content)
        return (PageColumns.of(own.page(content, n)) for n in range(own.n_pages(content)))

    def lists(parts: list[list], kind: pa.DataType, values: list) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.StructArray.from_arrays(values, fields=list(kind)) if values else pa.array([x for p in parts for x in p], kind))

    def batch(own, held: list[tuple[str, int, PageColumns]]) -> pa.RecordBatch:
        paths, numbers, found = zip(*held, strict=True)
        ends = np.cumsum([0, *(len(p.code) for p in found)])
        joined = lambda c: np.concatenate([getattr(p, c) for p in found])
        cells = [packed(c, joined(c), ends) for c in PACKED]
        kinds = [pa.array([x for p in found for x in getattr(p, f.name)], f.type) for f in _arrow(KIND)]
        glyphs = pa.StructArray.from_arrays([pa.array(np.diff(ends), pa.int32()), *cells], ["n", *PACKED])
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(numbers, pa.int64()), pa.array([own.page_width] * n, pa.float64()), pa.array([own.page_height] * n, pa.float64()), glyphs, lists([p.text for p in found], _arrow(KIND), kinds), lists([p.lines for p in found], _arrow(LINE), [])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        held, size = [], 0
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                content = content.as_py()
                if content is None:
                    continue
                for n, page in enumerate(columns(own, content)):
                    if len(page.code) or page.lines:
                        held.append((path, n, page))
                        size += len(page.code)
                        if size >= PACKED_GLYPHS:
                            yield batch(own, held)
                            held, size = [], 0
        if held:
            yield batch(own, held)

    names = ["path", "page", "page_width", "page_height", "glyphs", "kinds", "lines"]
    cells = ", ".join(f"{c}: binary" for c in PACKED)
    return binaries.select("path", "content").mapInArrow(run, f"path string, page long, page_width double, page_height double, glyphs struct<n: int, {cells}>, kinds array<struct<{KIND}>>, lines array<struct<{LINE}>>")


def page_matrix(rotate: Column | str, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The matrix of a page by its rotation, as an array of six numbers."""
    r = F.pmod(F.col(rotate) if isinstance(rotate, str) else rotate, F.lit(360))
    m = lambda *v: F.array(*[F.lit(x).cast("double") for x in v])
    return F.when(r == 90, m(0, -1, 1, 0, -y0, x1)).when(r == 180, m(-1, 0, 0, -1, x1, y1)).when(r == 270, m(0, 1, -1, 0, y1, -x0)).otherwise(m(1, 0, 0, 1, -x0, -y0))


def predict(images: DataFrame, make_model: Callable[[], Callable[[list], list]], by: list[str], schema: str) -> DataFrame:
    """Model results of images(by..., image): make_model() runs once per task and gives a function
    from a list of images to a list of lists of dicts, which become rows. Of a batch that fails each
    image is tried by itself; one that still fails has no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, names = make_model(), [c.strip().split(" ")[0] for c in schema.split(",")]

        def tried(batch: list) -> list:
            try:
                return model(batch)
            except Exception:  # noqa: BLE001
                return [[]] if len(batch) == 1 else [x for image in batch for x in tried([image])]

        for df in frames:
            rows = [{**{c: key[i] for i, c in enumerate(by)}, **r} for key, found in zip(df[by].itertuples(index=False, name=None), tried(df["image"].tolist()), strict=True) for r in found]
            yield pd.DataFrame(rows, columns=names)

    return images.select(*by, "image").mapInPandas(run, schema)
