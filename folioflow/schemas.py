"""Record types of the dataflow."""

from __future__ import annotations

CELL = "struct<bbox_pdf: array<double>, row_id: int, col_id: int, source_text: string, translated_text: string, text: string, value: string>"
ELEMENT = f"struct<label: string, category: string, bbox_pdf: array<double>, source_text: string, translated_text: string, latex: string, translated_latex: string, cells: array<{CELL}>>"
PAGE = f"struct<page_index: int, page_width: double, page_height: double, elements: array<{ELEMENT}>, raw_text: string, chapter_id: string>"
CHAPTER = "struct<chapter_id: string, title: string, start_page: int, end_page: int, summary: string, glossary: map<string, string>>"
#: A parsed document; translation input and Stage-A output both fit. Absent fields read as null.
DOCUMENT = f"pdf_path string, source_language string, target_language string, pages array<{PAGE}>, chapters array<{CHAPTER}>, glossary map<string, string>"

SEGMENT = "doc_id long, seg_id string, page_pos int, elem_pos int, slot int, cell_pos int, write_key string, text string"
CACHE = "translate_engine string, translate_engine_params string, original_text string, translation string, write_seq long"
GLYPH = "page long, seq long, kind string, text string, font string, size double, x0 double, y0 double, x1 double, y1 double, m0 double, m3 double, region int, line_width double"


def _record(fields: dict, **more) -> dict:
    """An object that has all of these fields and no others."""
    return {"type": "object", "required": list(fields), "additionalProperties": False, "properties": fields, **more}


# The fields of a document after the layout stage, all required, and what each may hold.
_TEXT, _SOME_TEXT, _COUNT, _POSITIVE = {"type": "string"}, {"type": "string", "minLength": 1}, {"type": "integer", "minimum": 0}, {"type": "number", "exclusiveMinimum": 0}
_BOX = {"type": "array", "items": {"type": "number"}, "minItems": 4, "maxItems": 4}
_CATEGORY = {"type": "string", "enum": ["BYPASS", "FLOWING_TEXT", "IN_PLACE", "TABLE", "EQUATION"]}
_TERMS = {"type": "object", "additionalProperties": _TEXT}
_CELL = _record({"bbox_pdf": _BOX, "row_id": _COUNT, "col_id": _COUNT, "source_text": _TEXT, "translated_text": _TEXT})
_ELEMENT = _record({"label": _SOME_TEXT, "category": _CATEGORY, "bbox_pdf": _BOX, "source_text": _TEXT, "translated_text": _TEXT, "latex": _TEXT, "cells": {"type": "array", "items": _CELL}})
_PAGE = _record({"page_index": _COUNT, "page_width": _POSITIVE, "page_height": _POSITIVE, "elements": {"type": "array", "items": _ELEMENT}, "raw_text": _TEXT, "chapter_id": _TEXT})
_CHAPTER = _record({"chapter_id": _SOME_TEXT, "title": _TEXT, "start_page": _COUNT, "end_page": _COUNT, "summary": _TEXT, "glossary": _TERMS})
#: The closed form of a document, as JSON Schema.
DOCUMENT_SCHEMA = _record({"pdf_path": _SOME_TEXT, "pages": {"type": "array", "items": _PAGE}, "chapters": {"type": "array", "items": _CHAPTER}, "glossary": _TERMS})
