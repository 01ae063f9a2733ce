"""Document type votes, validation of stage output, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.functions import constants as K
from folioflow.functions import jsonschema
from folioflow.functions import text as X


def page_type(text_chars: Column, text_blocks: Column, page_area: Column, image_area: Column) -> Column:
    """scanned or digital, by text, then text blocks, then the share of images. Overlapping images count twice."""
    share = F.when(page_area != 0, image_area / page_area)
    return (
        F.when((text_chars >= K.TEXT_CHARS) | (text_blocks >= K.TEXT_BLOCKS), "digital")
        .when((text_chars == 0) & (text_blocks == 0), "scanned")
        .when(share >= K.IMAGE_COVERAGE, "scanned")
        .otherwise("digital")
    )


def document_type(pages: DataFrame, by: list[str], kind: str = "page_type") -> DataFrame:
    """scanned, digital or mixed by the share of scanned pages; at least 0.8 and at most 0.2 settle it."""
    scanned, n = F.count_if(F.col(kind) == "scanned"), F.count("*")
    vote = F.when(scanned * 10 >= n * 8, "scanned").when(scanned * 10 <= n * 2, "digital").otherwise("mixed")
    return pages.groupBy(*by).agg(n.alias("n_pages"), scanned.alias("n_scanned"), vote.alias("doc_type"))


def route_of(category: Column | str) -> Column:
    """The step that an element of a category goes to: none, structure (tables) or ocr."""
    c = F.col(category) if isinstance(category, str) else category
    return F.when(c == "BYPASS", "none").when(c == "TABLE", "structure").otherwise("ocr")


_ERROR = "array<struct<path: string, message: string, code: string>>"


def _error(path: Column, message: str, code: str) -> Column:
    return F.struct(path.alias("path"), F.lit(message).alias("message"), F.lit(code).alias("code"))


def _finite(v: Column) -> Column:
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(True))


def _box_fault(box: Column, path: Column) -> Column:
    """The first fault of a box, or null."""
    broken = box.isNull() | (F.size(F.coalesce(box, F.array().cast("array<double>"))) != 4) | F.coalesce(F.exists(box, lambda v: v.isNull()), F.lit(False))
    at = lambda i: F.get(box, F.lit(i))
    return (
        F.when(broken, _error(path, "a box has four numbers", "BBOX_FORMAT"))
        .when(F.exists(box, lambda v: ~_finite(v)), _error(path, "a box holds finite numbers", "BBOX_INVALID_NUMBER"))
        .when(at(0) >= at(2), _error(path, "x0 must be less than x1", "BBOX_X_ORDER"))
        .when(at(1) >= at(3), _error(path, "y0 must be less than y1", "BBOX_Y_ORDER"))
    )


def _some(*errors: tuple[Column, Column]) -> Column:
    """The errors whose conditions hold."""
    return F.array_compact(F.array(*[F.when(cond, err) for cond, err in errors])).cast(_ERROR)


def validation_errors(stage: str = "A") -> Column:
    """Errors (path, message, code) of a document row with the columns of schemas.DOCUMENT, in order.

    Works within the row. Without a pdf_path there is that one error only.
    """
    at = lambda b, i: F.get(b, F.lit(i))
    tol, none = K.EDGE_TOLERANCE, F.array().cast(_ERROR)
    name = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def cell(c: Column, table: Column, path: Column) -> Column:
        box, spot = c.bbox_pdf, name(path, ".bbox_pdf")
        fault = _box_fault(box, spot)
        both = fault.isNull() & _box_fault(table, spot).isNull()
        return F.concat(
            F.array_compact(F.array(fault)).cast(_ERROR),
            _some(
                (both & ((at(box, 0) < at(table, 0) - tol) | (at(box, 1) < at(table, 1) - tol)), _error(path, "a cell starts before its table", "CELL_OUTSIDE_TABLE")),
                (both & ((at(box, 2) > at(table, 2) + tol) | (at(box, 3) > at(table, 3) + tol)), _error(path, "a cell ends after its table", "CELL_OUTSIDE_TABLE")),
            ),
        )

    def element(e: Column, path: Column, w: Column, h: Column) -> Column:
        box, spot = e.bbox_pdf, name(path, ".bbox_pdf")
        fault = _box_fault(box, spot)
        cells = F.coalesce(e.cells, F.array().cast(f"array<{schemas.CELL}>"))
        category = F.coalesce(e.category, F.lit(""))
        sized = fault.isNull() & ~F.isnan(w) & ~F.isnan(h) & (w > 0) & (h > 0)
        return F.concat(
            F.array_compact(F.array(fault)).cast(_ERROR),
            _some(
                (sized & ((at(box, 0) < -tol) | (at(box, 1) < -tol)), _error(spot, "a box has no negative corner", "BBOX_NEGATIVE")),
                (sized & (at(box, 2) > w + tol), _error(spot, "a box ends within the page's width", "BBOX_EXCEEDS_WIDTH")),
                (sized & (at(box, 3) > h + tol), _error(spot, "a box ends within the page's height", "BBOX_EXCEEDS_HEIGHT")),
                ((category == "BYPASS") & (F.coalesce(e.source_text, F.lit("")) != ""), _error(name(path, ".source_text"), "BYPASS has no text", "BYPASS_TEXT")),
                ((category == "EQUATION") & (F.coalesce(e.latex, F.lit("")) != K.EQUATION_LATEX), _error(name(path, ".latex"), "EQUATION holds the placeholder", "EQUATION_LATEX")),
                ((category == "TABLE") & (F.size(cells) == 0), _error(name(path, ".cells"), "TABLE has cells", "TABLE_NO_CELLS")),
                ((category != "TABLE") & (F.size(cells) > 0), _error(name(path, ".cells"), "only TABLE has cells", "NON_TABLE_HAS_CELLS")),
            ),
            F.flatten(F.transform(cells, lambda c, k: cell(c, box, name(path, ".cells[", k, "]")))),
        )

    def page(p: Column, i: Column) -> Column:
        path = name("pages[", i, "]")
        w, h = F.coalesce(p.page_width, F.lit(0.0)), F.coalesce(p.page_height, F.lit(0.0))
        own = _some(
            (~_finite(w), _error(name(path, ".page_width"), "not a finite number", "INVALID_NUMBER")),
            (~_finite(h), _error(name(path, ".page_height"), "not a finite number", "INVALID_NUMBER")),
            (F.lit(stage == "A") & (F.coalesce(p.chapter_id, F.lit("")) != ""), _error(name(path, ".chapter_id"), "no chapter after stage A", "STAGE_A_CHAPTER_ID")),
        )
        elements = F.coalesce(p.elements, F.array().cast(f"array<{schemas.ELEMENT}>"))
        return F.concat(own, F.flatten(F.transform(elements, lambda e, j: element(e, name(path, ".elements[", j, "]"), w, h))))

    pages = F.coalesce("pages", F.array().cast(f"array<{schemas.PAGE}>"))
    chapters = F.coalesce("chapters", F.array().cast(f"array<{schemas.CHAPTER}>"))
    order = lambda c, i: F.when(F.coalesce(c.end_page, F.lit(0)) < F.coalesce(c.start_page, F.lit(0)), _error(name("chapters[", i, "]"), "a chapter ends at or after its start", "CHAPTER_PAGE_ORDER"))
    found = F.concat(
        _some((F.lit(stage == "A") & (F.size(chapters) > 0), _error(F.lit("chapters"), "no chapters after stage A", "STAGE_A_CHAPTERS"))),
        F.flatten(F.transform(pages, page)),
        F.array_compact(F.transform(chapters, order)).cast(_ERROR),
    )
    missing = F.array(_error(F.lit("pdf_path"), "pdf_path is required", "MISSING_FIELD")).cast(_ERROR)
    return F.when(F.col("pdf_path").isNull(), missing).otherwise(F.coalesce(found, none))


def schema_errors(raw: Column | str) -> Column:
    """Errors of one document as JSON text that the schema cannot read: no JSON, or a value of another
    type than its field's. Absent fields are not errors here."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    read = F.from_json(raw, f"{schemas.DOCUMENT}, __broken string", {"columnNameOfCorruptRecord": "__broken", "mode": "PERMISSIVE", "allowNonNumericNumbers": "true"})
    broken = raw.isNull() | read["__broken"].isNotNull()
    return F.when(broken, F.array(_error(F.lit(""), "the text is no document of the schema", "JSON_SCHEMA")).cast(_ERROR)).otherwise(F.array().cast(_ERROR))


def validate_json(texts: DataFrame, column: str = "value", stage: str = "A", schema: dict | None = None) -> DataFrame:
    """texts with errors and valid, for documents as JSON text. What the record type cannot read has that one
    error; the rest is judged as by validate. With a JSON schema, such as schemas.DOCUMENT_SCHEMA, its errors
    come first: missing and unknown fields, types, enums, ranges, each with its path."""
    found = texts.withColumn("__schema", schema_errors(column))
    read = F.from_json(F.col(column), schemas.DOCUMENT, {"allowNonNumericNumbers": "true"})
    judged = found.withColumn("__d", read).select(*texts.columns, "__schema", "__d.*").withColumn("errors", F.when(F.size("__schema") > 0, F.col("__schema")).otherwise(validation_errors(stage)))
    if schema is not None:
        judged = judged.withColumn("errors", F.when(F.size("__schema") == 0, F.concat(jsonschema.violations(column, schema), "errors")).otherwise(F.col("errors")))
    return judged.select(*texts.columns, "errors", (F.size("errors") == 0).alias("valid"))


def validate(docs: DataFrame, stage: str = "A") -> DataFrame:
    """docs with errors and valid."""
    return docs.withColumn("errors", validation_errors(stage)).withColumn("valid", F.size("errors") == 0)


def toc_hints(elements: DataFrame) -> DataFrame:
    """Headings and table-of-contents entries with text, cut to 80 code points."""
    cut = F.when(F.length("source_text") > 80, F.concat(F.left("source_text", F.lit(80)), F.lit("..."))).otherwise(F.col("source_text"))
    return elements.where(F.col("label").isin(*K.TOC_LABELS) & (F.coalesce("source_text", F.lit("")) != "")).withColumn("hint", F.concat(F.lit("["), "label", F.lit("] "), cut))


def category_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("category").agg(F.count("*").alias("n")).orderBy("category")


def translation_report(segments: DataFrame, tolerance: float = K.LENGTH_TOLERANCE) -> DataFrame:
    """One row: segments, translated, violations of length, untranslated; segments(text, translation)."""
    done = F.coalesce("translation", F.lit("")) != ""
    return segments.agg(
        F.count("*").alias("n_segments"),
        F.count_if(done).alias("n_translated"),
        F.count_if(done & X.length_violation("translation", "text", tolerance)).alias("n_violations"),
        F.count_if(~done).alias("n_untranslated"),
    )


def report_lines(segments: DataFrame, tolerance: float = K.LENGTH_TOLERANCE) -> DataFrame:
    """The segments that a report names: kind, ratio of lengths, and the text cut to 60 code points."""
    done = F.coalesce("translation", F.lit("")) != ""
    kind = F.when(~done, "untranslated").when(X.length_violation("translation", "text", tolerance), "length")
    ratio = F.when(done, F.round(F.length("translation") / F.greatest(F.length("text"), F.lit(1)), 4))
    return segments.withColumn("kind", kind).where("kind is not null").withColumn("ratio", ratio).withColumn("excerpt", F.left("text", F.lit(60)))
