"""An interpreter of page content: drawing operators, resources and nested forms.

FormBackend reads documents whose pages are JSON: a content is a list of operators, each a list
of a name and operands; resources hold fonts (advance widths) and forms (content, matrix and
resources of their own). A reader of a real format has to deliver just this.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: Forms within forms; a form that holds itself is drawn no deeper.
MOST_NESTED = 16


def times(m: tuple, n: tuple) -> tuple:
    """The matrix that first does m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def inverse(m: tuple) -> tuple | None:
    """The matrix that undoes m, or None if none does."""
    a, b, c, d, e, f = m
    size = a * d - b * c
    return None if size == 0 else (d / size, -b / size, -c / size, a / size, (c * f - d * e) / size, (b * e - a * f) / size)


def apply(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


@dataclass
class Resources:
    """What a content may name. Names that a form lacks are those of the page."""

    fonts: dict = field(default_factory=dict)
    forms: dict = field(default_factory=dict)
    outer: Resources | None = None

    @classmethod
    def of(cls, raw: dict | None, outer: Resources | None = None) -> Resources:
        raw = raw or {}
        return cls(raw.get("fonts", {}), raw.get("forms", {}), outer)

    def font(self, name: str) -> dict:
        return self.fonts[name] if name in self.fonts else self.outer.font(name) if self.outer else {}

    def form(self, name: str) -> dict | None:
        return self.forms[name] if name in self.forms else self.outer.form(name) if self.outer else None


@dataclass
class Drawn:
    """Glyph and line rows in paint order, and the forms drawn: name, depth, matrix and its inverse, which
    brings what is drawn on the page back into the form."""

    items: list = field(default_factory=list)
    forms: list = field(default_factory=list)


def interpret(content: list, resources: Resources, matrix: tuple = IDENTITY, out: Drawn | None = None, depth: int = 0, above: tuple = ()) -> Drawn:
    """Runs a content. Operators: q and Q keep and restore the matrix, cm changes it, text (font, size,
    x, y, string), line (x0, y0, x1, y1, width) and Do (form). Unknown ones are passed over."""
    out, kept = out or Drawn(), []
    for name, *args in content:
        if name == "q":
            kept.append(matrix)
        elif name == "Q" and kept:
            matrix = kept.pop()
        elif name == "cm":
            matrix = times(tuple(map(float, args)), matrix)
        elif name == "text":
            out.items += _glyphs(*args, matrix, resources)
        elif name == "line":
            (x0, y0), (x1, y1) = apply(matrix, *args[:2]), apply(matrix, *args[2:4])
            out.items.append({"kind": "line", "text": "", "font": "", "size": 0.0, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "m0": matrix[0], "m3": matrix[3], "line_width": float(args[4])})
        elif name == "Do":
            form = resources.form(args[0])
            if form is not None and args[0] not in above and depth < MOST_NESTED:
                own = times(tuple(map(float, form.get("matrix", IDENTITY))), matrix)
                out.forms.append({"name": args[0], "depth": depth + 1, "matrix": own, "inverse": inverse(own)})
                interpret(form.get("content", []), Resources.of(form.get("resources"), resources), own, out, depth + 1, (*above, args[0]))
    return out


def _glyphs(font: str, size: float, x: float, y: float, string: str, matrix: tuple, resources: Resources) -> Iterator[dict]:
    """One row a character, upright boxes around the corners of its cell."""
    widths, own = resources.font(font), times((size, 0.0, 0.0, size, x, y), matrix)
    at = 0.0
    for c in string:
        wide = float(widths.get(c, widths.get("default", 0.5)))
        corners = [apply(own, u, v) for u in (at, at + wide) for v in (0.0, 1.0)]
        xs, ys = zip(*corners, strict=True)
        yield {"kind": "char", "text": c, "font": font, "size": float(size * abs(matrix[3] or matrix[1])), "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "m0": own[0], "m3": own[3], "line_width": None}
        at += wide


@dataclass
class FormBackend:
    """Documents as JSON: pages with content and resources; see the module."""

    page_width: float = 600.0
    page_height: float = 800.0

    def n_pages(self, content: bytes) -> int:
        return len(json.loads(content)["pages"])

    def page(self, content: bytes, n: int) -> pd.DataFrame:
        raw = json.loads(content)["pages"][n]
        items = interpret(raw.get("content", []), Resources.of(raw.get("resources"))).items
        columns = ["kind", "text", "font", "size", "x0", "y0", "x1", "y1", "m0", "m3", "line_width"]
        out = pd.DataFrame(items, columns=columns).assign(region=2)
        return out.assign(seq=range(len(out)), line_width=out["line_width"].astype("float64"))
