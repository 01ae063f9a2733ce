"""JSON Schema as column expressions: a schema is compiled once, and each text is judged within its row, in the JVM.

Keywords: type (also a list of types), enum, const, required, properties, additionalProperties (false or a schema),
items, minItems, maxItems, minLength, maxLength, pattern, minimum, maximum, exclusiveMinimum, exclusiveMaximum, anyOf,
and $ref to #/$defs or #/definitions. Others are refused when the schema is compiled, but for those that
say nothing about a value. As everywhere in JSON Schema a keyword judges values of its own type only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR = "struct<path: string, message: string, code: string>"
_SILENT = {"$schema", "$id", "$defs", "definitions", "title", "description", "default", "examples", "$comment"}
_NUMBERS = "BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT"
#: What schema_of_variant begins with for each type.
_KINDS = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "object": "OBJECT", "array": "ARRAY", "number": f"({_NUMBERS})"}


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _error(path: Column, message: str | Column) -> Column:
    return F.struct(path.alias("path"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit("JSON_SCHEMA").alias("code"))


def _when(*faults: tuple[Column, Column]) -> Column:
    """The errors whose conditions hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), err) for cond, err in faults])).cast(f"array<{ERROR}>") if faults else F.array().cast(f"array<{ERROR}>")


class _Compiler:
    def __init__(self, root: dict):
        self.root, self.open = root, []

    def resolved(self, schema: dict) -> dict:
        while "$ref" in schema:
            at = self.root
            for part in schema["$ref"].removeprefix("#/").split("/"):
                at = at[part]
            schema = at
        return schema

    def judge(self, schema: dict, v: Column, path: Column) -> Column:
        """The errors of a variant that is there, at a path."""
        ref = schema.get("$ref")
        if ref in self.open:
            raise ValueError(f"{ref} holds itself; an expression cannot recur")
        schema = self.resolved(schema)
        unknown = set(schema) - _SILENT - set(_KEYWORDS)
        if unknown:
            raise ValueError(f"keywords without a meaning here: {', '.join(sorted(unknown))}")
        self.open.append(ref) if ref else None
        out = _bound(F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind")), lambda x: self._judged(schema, x.v, x.kind, path))
        self.open.pop() if ref else None
        return out

    def _judged(self, schema: dict, v: Column, kind: Column, path: Column) -> Column:
        faults, parts = [], []
        if "type" in schema:
            kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            fits = F.lit(False)
            for k in kinds:
                fits = fits | (self._whole(v, kind) if k == "integer" else kind.rlike(f"^{_KINDS[k]}"))
            faults.append((~fits, _error(path, f"is no {' or '.join(kinds)}")))
        if "enum" in schema or "const" in schema:
            allowed = schema["enum"] if "enum" in schema else [schema["const"]]
            written = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in allowed]
            faults.append((~F.to_json(v).isin(*written), _error(path, f"is none of {', '.join(written)}")))
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        is_text, is_number = kind == "STRING", kind.rlike(f"^({_NUMBERS})")
        for key, wrong, what in (("minLength", lambda n: F.length(text) < n, "shorter than"), ("maxLength", lambda n: F.length(text) > n, "longer than"), ("pattern", lambda p: ~text.rlike(p), "does not match")):
            if key in schema:
                faults.append((is_text & wrong(schema[key]), _error(path, f"{what} {schema[key]}")))
        for key, wrong, what in (("minimum", lambda n: number < n, "below"), ("maximum", lambda n: number > n, "above"), ("exclusiveMinimum", lambda n: number <= n, "not above"), ("exclusiveMaximum", lambda n: number >= n, "not below")):
            if key in schema:
                faults.append((is_number & wrong(schema[key]), _error(path, f"{what} {schema[key]}")))
        if {"items", "minItems", "maxItems"} & set(schema):
            parts.append(F.when(kind.startswith("ARRAY"), _bound(F.try_variant_get(v, "$", "array<variant>"), lambda a: self._array(schema, a, path))))
        if {"properties", "required", "additionalProperties"} & set(schema):
            parts.append(F.when(kind.startswith("OBJECT"), _bound(F.try_variant_get(v, "$", "map<string, variant>"), lambda m: self._object(schema, m, path))))
        if "anyOf" in schema:
            each = [F.size(self.judge(s, v, path)) > 0 for s in schema["anyOf"]]
            none = each[0]
            for x in each[1:]:
                none = none & x
            faults.append((none, _error(path, "fits none of the forms")))
        nothing = F.array().cast(f"array<{ERROR}>")
        return F.concat(_when(*faults), *[F.coalesce(p, nothing) for p in parts])

    def _whole(self, v: Column, kind: Column) -> Column:
        number = F.try_variant_get(v, "$", "double")
        return kind.rlike(f"^({_NUMBERS})") & (number % 1 == 0)

    def _array(self, schema: dict, a: Column, path: Column) -> Column:
        n = F.size(a)
        faults = [(wrong, _error(path, f"{what} {schema[key]} items")) for key, wrong, what in (("minItems", n < schema.get("minItems", 0), "fewer than"), ("maxItems", n > schema.get("maxItems", 0), "more than")) if key in schema]
        if "items" not in schema:
            return _when(*faults)
        each = F.transform(a, lambda x, i: self.judge(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.concat(_when(*faults), F.flatten(each))

    def _object(self, schema: dict, m: Column, path: Column) -> Column:
        known = schema.get("properties", {})
        at = lambda key: F.concat(path, F.lit("."), key if isinstance(key, Column) else F.lit(key))
        has = lambda key: F.map_contains_key(m, key)
        parts = [_when(*[(~has(k), _error(at(k), "is required")) for k in schema.get("required", [])])]
        nothing = F.array().cast(f"array<{ERROR}>")
        for key, sub in known.items():
            parts.append(F.when(has(key), self.judge(sub, F.element_at(m, key), at(key))).otherwise(nothing))
        more = schema.get("additionalProperties", True)
        if more is not True:
            others = F.array_sort(F.filter(F.map_keys(m), lambda k: ~k.isin(*known) if known else F.lit(True)))
            judged = (lambda k: F.array(_error(at(k), "is no field here")).cast(f"array<{ERROR}>")) if more is False else (lambda k: self.judge(more, F.element_at(m, k), at(k)))
            parts.append(F.flatten(F.transform(others, judged)))
        return F.concat(*parts)


_KEYWORDS = ("$ref", "type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minLength", "maxLength", "pattern", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "anyOf")


def whole_json(raw: Column) -> Column:
    """A JSON text as a variant, null if it is none. The parser stops at the end of the first value, so the text is read as the
    only item of a list and as the only field of an object: what follows a value cannot close both."""
    listed, named = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    one = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    return F.when(one & named.isNotNull(), F.try_variant_get(listed, "$[0]", "variant"))


def violations(raw: Column | str, schema: dict) -> Column:
    """Errors (path, message, code JSON_SCHEMA) of JSON texts against a schema. Paths begin with $; a null or a text
    that is no JSON, among them objects with repeated keys, has one error at $. Errors of a value come before
    those of its parts, parts in the order of the schema, unknown fields by name."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    broken = F.array(_error(F.lit("$"), "is no JSON")).cast(f"array<{ERROR}>")
    parsed = whole_json(raw)
    found = _Compiler(schema).judge(schema, parsed, F.lit("$"))
    return F.when(parsed.isNull(), broken).otherwise(found)
