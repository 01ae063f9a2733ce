"""Column functions on text. All but three run inside the JVM; those three say so."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions import constants as K
from folioflow.functions import jsonschema


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(s: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(s), K.BLANK_EDGES, "")


def is_plain_text(s: Column | str) -> Column:
    """Whether two letters in a row remain without <math> spans."""
    return F.regexp_replace(_c(s), K.MATH_TAG, "").rlike(K.LETTER_RUN)


def is_equation_only(s: Column | str) -> Column:
    """Whether nothing remains without <math> spans and equation labels; true for empty text."""
    return strip(F.regexp_replace(F.regexp_replace(_c(s), K.MATH_TAG, ""), K.EQUATION_LABEL, "")) == ""


def is_passthrough(s: Column | str) -> Column:
    """Whether a segment is blank or a single formula placeholder, and so not worth a call."""
    return (strip(s) == "") | _c(s).rlike(r"(?U)^\{v\d+\}\n?\z")


def length_violation(translation: Column | str, source: Column | str, tolerance: float = K.LENGTH_TOLERANCE) -> Column:
    """Whether lengths differ by more than the tolerance; never for sources under 20 code points."""
    n, m = F.length(_c(source)), F.length(_c(translation))
    return (n >= K.LENGTH_MIN_CHARS) & (F.abs(m - n) / F.greatest(n, F.lit(1)) > tolerance)


@F.pandas_udf(T.StringType())
def _normal_form(s: pd.Series) -> pd.Series:
    # Java has neither this normal form as a function nor the same table of categories.
    keep = lambda t: "".join(c for c in unicodedata.normalize("NFC", t) if c in "\n\t" or unicodedata.category(c)[0] != "C")
    return s.map(lambda t: t if t is None else keep(t))


@F.pandas_udf(T.StringType())
def _drop_controls(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in t if unicodedata.category(c)[0] != "C"))


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t))


def clean_ocr_text(s: Column | str) -> Column:
    """Normal form (a pandas UDF), then ligatures, quotes, dashes, spaces, and blank edges.

    Blank lines within stay. A null text becomes empty.
    """
    # ASCII is in normal form; its control characters go in the JVM. Only other texts go to Python: the
    # column that does is null for the rest, and a plain regular expression decides.
    plain = ~_c(s).rlike(r"[^\x00-\x7F]")
    ascii_ = F.when(_c(s).rlike(r"[\x00-\x08\x0B-\x1F\x7F]"), F.regexp_replace(_c(s), r"[\x00-\x08\x0B-\x1F\x7F]+", "")).otherwise(_c(s))
    t = F.when(plain, ascii_).otherwise(_normal_form(F.when(~plain, _c(s))))
    t = F.coalesce(t, F.lit(""))
    for old, new in K.OCR_REPLACEMENTS:
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(F.translate(t, "\t", " "), " +", " ")
    lines = F.transform(F.split(t, "\n", -1), strip)
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+\z", "")


def remove_control_characters(s: Column | str) -> Column:
    """Without characters of category C, line ends included (a pandas UDF)."""
    return _drop_controls(_c(s))


def html_unescape(s: Column | str) -> Column:
    """With HTML entities resolved (a pandas UDF)."""
    return _unescape(_c(s))


def result_of_page(s: Column | str) -> Column:
    """The first result on a service's answer page: unescaped, without control characters; null without one."""
    found = F.regexp_extract_all(_c(s), F.lit(K.RESULT_MARK), F.lit(1))
    return remove_control_characters(html_unescape(F.get(found, F.lit(0))))


def strip_think(s: Column | str, form: str = "gateway") -> Column:
    """Without one leading <think> block. form: plain, lines (also the line ends after it) or gateway (white space before and an empty block allowed)."""
    return F.regexp_replace(_c(s), K.THINK[form], "")


def placeholder_ids(s: Column | str) -> Column:
    """Numbers of the formula placeholders in a text, in order; null where there are too many digits."""
    found = F.regexp_extract_all(_c(s), F.lit(r"(?i)\{\s*v([\d\s]+)\}"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(" "), F.lit("")).try_cast("int"))


def placeholder(n: Column | str) -> Column:
    return F.concat(F.lit("{v"), _c(n).cast("string"), F.lit("}"))


def hex_codes(s: Column | str, width: int) -> Column:
    """Code points in lower-case hexadecimal, each of at least width digits."""
    code = lambda ch: F.lower(F.hex(F.ascii(ch)))
    padded = lambda h: F.when(F.length(h) < width, F.lpad(h, width, "0")).otherwise(h)
    return F.array_join(F.transform(F.filter(F.split(_c(s), ""), lambda ch: ch != ""), lambda ch: padded(code(ch))), "")


def text_op(font: Column | str, size: Column | str, x: Column | str, y: Column | str, codes: Column | str) -> Column:
    """The drawing operator of a run of encoded text."""
    return F.format_string(K.TEXT_OP, _c(font), _c(size), _c(x), _c(y), _c(codes))


def line_op(x: Column | str, y: Column | str, dx: Column | str, dy: Column | str, width: Column | str) -> Column:
    """The drawing operator of a line."""
    return F.format_string(K.LINE_OP, _c(x), _c(y), _c(width), _c(dx), _c(dy))


def is_formula_glyph(font: Column | str, char: Column | str, font_pattern: str | None = None, char_pattern: str | None = None) -> Column:
    """Whether font or character mark a glyph as part of a formula; own patterns replace the fixed ones."""
    f, ch = F.element_at(F.split(_c(font), r"\+"), -1), _c(char)
    by_font = f.rlike(f"^(?:{font_pattern})") if font_pattern else f.rlike(K.FORMULA_FONT)
    by_char = ch.rlike(f"^(?:{char_pattern})") if char_pattern else (ch != "") & (ch != " ") & ch.rlike(K.FORMULA_CHAR)
    return ch.rlike(r"^\(cid:") | by_font | by_char


def is_vertical(m0: Column | str, m3: Column | str) -> Column:
    return (_c(m0) == 0) & (_c(m3) == 0)


def split_service(s: Column | str) -> Column:
    """Struct (service, model) of service:model; model is null without a colon."""
    parts = F.split(_c(s), ":", 2)
    return F.struct(parts[0].alias("service"), F.get(parts, F.lit(1)).alias("model"))


def file_stem(path: Column | str) -> Column:
    """The file name without its last suffix; leading dots are no suffix."""
    name = F.regexp_extract(_c(path), r"[^/]*\z", 0)
    return F.regexp_replace(name, r"(?s)^(\.*[^.].*)\.[^.]*\z", "$1")


def is_black(color: Column | str) -> Column:
    """Whether all components of a colour add up to zero."""
    return F.aggregate(_c(color), F.lit(0.0), lambda a, x: a + x) == 0


def safe_float(s: Column | str) -> Column:
    return _c(s).try_cast("double")


def token_limit(text: Column | str, option: Column | int) -> Column:
    """The larger of the option and five tokens per code point."""
    return F.greatest(F.length(_c(text)) * 5, F.lit(option) if isinstance(option, int) else option)


def cap(s: Column | str, provider: str) -> Column:
    """The text as far as a provider takes it, in code points."""
    n = K.TEXT_CAPS.get(provider)
    return F.left(_c(s), F.lit(n)) if n else _c(s)


def json_bytes(s: Column | str) -> Column:
    """UTF-8 bytes of a text as a JSON string, quotes included."""
    return F.octet_length(F.to_json(F.struct(_c(s).alias("t")))) - 6


def lookup(table: dict, key: Column, default: Column) -> Column:
    """A small fixed table as an expression."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, key), default)


def category_of(label: Column | str) -> Column:
    return lookup(K.LABEL_CATEGORIES, _c(label), F.lit(K.DEFAULT_CATEGORY))


def line_height(lang: Column | str) -> Column:
    return lookup(K.LINE_HEIGHTS, F.lower(_c(lang)), F.lit(K.DEFAULT_LINE_HEIGHT))


def font_of(lang: Column | str) -> Column:
    return lookup(K.FONTS, F.lower(_c(lang)), F.lit(K.DEFAULT_FONT))


def language_name(lang: Column | str) -> Column:
    """The English name of a language; fails for one without."""
    return lookup(K.LANGUAGE_NAMES, _c(lang), F.raise_error(F.concat(F.lit("no name for language "), _c(lang))))


def provider_code(lang: Column | str, provider: str) -> Column:
    table = K.PROVIDER_CODES.get(provider)
    return lookup(table, F.lower(_c(lang)), _c(lang)) if table else _c(lang)


def shrunk_line_height(start: Column | str, lines: Column | str, size: Column | str, height: Column | str, steps: int = 64) -> Column:
    """The line height after steps of 0.05 down while the lines overflow and it is at least 1.

    Repeated subtraction on purpose: the result keeps its rounding.
    """
    over = lambda h: (_c(lines) * _c(size) * h > _c(height)) & (h >= 1)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), _c(start).cast("double"), lambda h, _: F.when(over(h), h - K.LINE_STEP).otherwise(h))


def page_numbers(ranges: Column | str) -> Column:
    """Zero-based pages of ranges like 1-3,5; order and repeats stay."""
    one = lambda r: F.split(r, "-")
    each = lambda r: F.when(F.contains(r, F.lit("-")), F.sequence(one(r)[0].cast("int") - 1, one(r)[1].cast("int") - 1)).otherwise(F.array(r.try_cast("int") - 1))
    return F.flatten(F.transform(F.split(_c(ranges), ","), each))


def canonical_params(params: dict | None) -> str:
    """Cache parameters as JSON with sorted keys and ASCII only; equal dicts give equal text."""
    return json.dumps(params or {}, sort_keys=True)


def with_params(params: Column | str, more: dict[str, str]) -> Column:
    """A map of parameters with some put in or replaced, last wins whatever the session says."""
    keys = list(more)
    kept = F.map_filter(_c(params), lambda k, _: ~k.isin(*keys)) if keys else _c(params)
    return F.map_concat(kept, F.create_map(*[F.lit(x) for kv in more.items() for x in kv])) if keys else kept


def translation_prompt(payload: Column | str, source: str, target: str, glossary: Column | None = None) -> Column:
    """The request for one chunk; payload is its JSON."""
    head = f"Translate each value from {source} to {target}. Answer with a JSON list of objects with the keys id and t, one per input id. Keep placeholders such as {{v0}} and markup unchanged. Keep lengths close to the source.\n"
    block = F.when(F.coalesce(glossary, F.lit("")) != "", F.concat(F.lit("Use these terms:\n"), glossary, F.lit("\n"))).otherwise("") if glossary is not None else F.lit("")
    return F.concat(F.lit(head), block, _c(payload))


def translation_request(payload: Column | str, ids: Column | str, source: Column | str, target: Column | str, glossary: Column | str) -> Column:
    """Struct (system, user) that asks for the translation of one chunk. payload is its JSON, ids its ids in
    order, of which the first two serve as the example; glossary its lines, or empty."""
    terms = F.when(F.coalesce(_c(glossary), F.lit("")) != "", F.concat(F.lit("\nGlossary, to be used as it stands:\n"), _c(glossary))).otherwise("")
    rules = " Leave markup, formulas between <math> and </math>, addresses and placeholders such as {v0} as they are. Keep each length within 15 percent of its source. Neither merge nor split entries. Answer with JSON and nothing else."
    system = F.concat(F.lit("You translate documents from "), _c(source), F.lit(" to "), _c(target), F.lit("."), F.lit(rules), terms)
    shape = F.array_join(F.transform(F.slice(_c(ids), 1, 2), lambda i: F.concat(F.lit('{"id": "'), i, F.lit('", "t": "translation of '), i, F.lit('"}'))), ", ")
    user = F.concat(F.lit(f"{INPUT}\n"), _c(payload), F.lit(f"\n{ANSWER}\n["), shape, F.lit("]"))
    return F.struct(system.alias("system"), user.alias("user"))


def glossary_request(payload: Column | str, source: Column | str, target: Column | str) -> Column:
    """Struct (system, user) that asks for the proper names and technical terms of one chunk."""
    system = F.concat(F.lit("You collect the terms of documents for translators from "), _c(source), F.lit(" to "), _c(target), F.lit("."))
    wanted = "Take names of people, places, organisations and products, and technical terms, each once. Leave common words, formulas and placeholders out."
    user = F.concat(F.lit(f"{wanted}\n{INPUT}\n"), _c(payload), F.lit(f'\n{ANSWER}\n[{{"src": "term", "dst": "its translation"}}]'))
    return F.struct(system.alias("system"), user.alias("user"))


#: Marks around the payload of a request, and what is said when an answer is asked for again.
INPUT, ANSWER = "Input:", "Answer in this form:"
EVERY_ID = "\nEvery id of the input must be answered, each exactly once."
OTHER_LENGTHS = "\nThe lengths of the last answer were off by more than 15 percent. It was:\n"


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """A template with $name or ${name} filled in; unknown names stay as they are and $$ is a dollar sign."""
    parts, at = [], 0
    for m in re.finditer(r"\$(?:(\$)|([A-Za-z_]\w*)|\{([A-Za-z_]\w*)\})", template):
        name = m[2] or m[3]
        parts += [F.lit(template[at : m.start()]), F.lit("$") if m[1] else values.get(name, F.lit(m[0]))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def canonical_json(value: Column | str) -> Column:
    """JSON text in one form for equal values: keys sorted in all depths, no spaces, all but ASCII escaped as in UTF-16.
    Of a text that is no JSON, or has a key twice, null. Numbers keep how they are written, but for zeros at the end."""
    value = F.col(value) if isinstance(value, str) else value
    flat = F.to_json(jsonschema.whole_json(value))
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    escaped = lambda c: F.when(c.rlike(r"[\x00-\x7F]"), c).otherwise(units(c))
    return F.when(flat.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.regexp_extract_all(flat, F.lit("(?s)(.)")), escaped), "")).otherwise(flat)
