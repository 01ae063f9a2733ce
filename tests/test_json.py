import json

import pytest

from folioflow import schemas
from folioflow.functions import jsonschema
from folioflow.operators import calls, quality

ANSWERS = [
    '[{"id": "0", "t": "a"}, {"id": 1, "t": "b"}]', '{"1": "x", "0": "y"}', '```json\n[{"id": "0", "t": "a"}]\n```', '[{"id": "0", "t": "a"}, {"id": "1", "t": "b', "[]", "{}", "", None, "null", "7", '"x"',
    '[{"id": "0", "t": 5}]', '[{"id": 1.5, "t": "a"}]', '[{"id": true, "t": null}]', '[{"t": "no id"}, {"id": "0", "t": "a"}]', '[["x"]]', '[{"id": "0", "t": "a"}, {"id": "0", "t": "z"}]', '{"a": 1, "b": "x"}', '{"a": {"id": "x"}}',
    '{"0": "a", "0": "b"}', '[{"id": "\\ud83d\\ude00", "t": "\\ud800"}]', ' \n[{"id": " a ", "t": "\\u00e9\\n"}] ', '[{"id": 123456789012345678901234567890, "t": "big"}]', '[{"id": -7, "t": ""}, {"id": "", "t": "x", "more": [1, {"id": 2}]}]', "[NaN]", '{"id": "x", "t": "y"}', '[{"id": {"id": "x"}, "t": "y"}]',
]


def test_both_readers_agree(spark):
    raw = spark.createDataFrame(list(enumerate(ANSWERS)), "i int, answer string")
    got = {}
    for r in calls.parse_answers(raw, ["i"]).collect():
        got.setdefault(r.i, {})[r.pos] = (r.seg_id, r.t)
    want = {i: dict(enumerate(calls.parse_answer(a))) for i, a in enumerate(ANSWERS)}
    assert got == {i: x for i, x in want.items() if x}


def test_only_broken_answers_go_to_python(spark):
    raw = spark.createDataFrame(list(enumerate(ANSWERS)), "i int, answer string")
    plain = raw.select("i", calls._plain_answer(raw.answer).alias("x"))
    assert "Python" not in plain._jdf.queryExecution().toString()
    assert {0, 1, 4, 5, 16, 21, 23, 25} <= {r.i for r in plain.where("x is not null").collect()}
    plan = calls.parse_answers(raw, ["i"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Filter" in plan.split("ArrowEvalPython")[1]


CASES = [
    ({"type": "integer"}, [("1", 0), ("1.0", 0), ("1.5", 1), ('"1"', 1), ("true", 1), ("null", 1), ("1e3", 0), ("12345678901234567890", 0)]),
    ({"type": ["string", "null"]}, [('"x"', 0), ("null", 0), ("1", 1), ("[]", 1)]),
    ({"enum": ["a", 1, None, [1]]}, [('"a"', 0), ("1", 0), ("null", 0), ("[1]", 0), ('"b"', 1), ("2", 1)]),
    ({"minLength": 2, "maxLength": 3, "pattern": "^.é?"}, [('"ab"', 0), ('"a"', 1), ('"abcd"', 1), ("1", 0), ('"\\ud83d\\ude00"', 1)]),
    ({"minimum": 0, "exclusiveMaximum": 5}, [("0", 0), ("-0.1", 1), ("5", 1), ("4.999", 0), ('"9"', 0)]),
    ({"items": {"type": "number"}, "minItems": 1, "maxItems": 2}, [("[]", 1), ("[1]", 0), ("[1, 2, 3]", 1), ('["a", "b"]', 2), ("{}", 0)]),
    ({"required": ["a"], "properties": {"a": {"type": "string"}, "b": {"properties": {"c": {"const": 1}}, "additionalProperties": False}}}, [("{}", 1), ('{"a": 1}', 1), ('{"a": "x", "z": 1}', 0), ('{"a": "x", "b": {"c": 2, "d": 1}}', 2), ("[]", 0)]),
    ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, [('"x"', 0), ("7", 0), ("1", 1)]),
    ({"$ref": "#/$defs/x", "$defs": {"x": {"additionalProperties": {"$ref": "#/definitions/y"}}}, "definitions": {"y": {"type": "boolean"}}}, [('{"k": true}', 0), ('{"k": 1, "l": 2}', 2)]),
    ({}, [("{", 1), ("", 1), (None, 1), ('{"a": 1, "a": 2}', 1), ("[1, [2]]", 0), ("1 x", 1), ("[1]]", 1), ("null", 0)]),
]


def test_keywords(spark):
    for schema, texts in CASES:
        df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
        found = [len(r[0]) for r in df.select(jsonschema.violations("t", schema)).collect()]
        assert found == [n for _, n in texts], (schema, found)
    with pytest.raises(ValueError, match="without a meaning"):
        jsonschema.violations("t", {"oneOf": []})
    with pytest.raises(ValueError, match="holds itself"):
        jsonschema.violations("t", {"$ref": "#/$defs/x", "$defs": {"x": {"items": {"$ref": "#/$defs/x"}}}})


def test_documents_of_the_closed_form(spark):
    cell = {"bbox_pdf": [0, 0, 1, 1], "row_id": 0, "col_id": 0, "source_text": "", "translated_text": ""}
    element = {"label": "Table", "category": "TABLE", "bbox_pdf": [0, 0, 1, 1], "source_text": "", "translated_text": "", "latex": "", "cells": [cell]}
    page = {"page_index": 0, "page_width": 10, "page_height": 10.5, "elements": [element], "raw_text": "", "chapter_id": ""}
    good = {"pdf_path": "a.pdf", "pages": [page], "chapters": [], "glossary": {"k": "v"}}
    put = lambda **x: json.loads(json.dumps({**good, **x}))
    bad = put()
    bad["pages"][0]["elements"][0]["cells"][0]["row_id"] = -1
    bad["pages"][0]["elements"][0]["category"] = "TEXT"
    del bad["pages"][0]["raw_text"]
    rows = [good, bad, put(glossary={"k": 1}), put(source_language="en")]
    texts = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, value string")
    found = {r.i: [(e.path, e.message) for e in r.errors if e.code == "JSON_SCHEMA"] for r in quality.validate_json(texts, schema=schemas.DOCUMENT_SCHEMA).collect()}
    assert found[0] == []
    assert found[1] == [("$.pages[0].raw_text", "is required"), ("$.pages[0].elements[0].category", 'is none of "BYPASS", "FLOWING_TEXT", "IN_PLACE", "TABLE", "EQUATION"'), ("$.pages[0].elements[0].cells[0].row_id", "below 0")]
    assert [p for p, _ in found[3]] == ["$.source_language"]


def test_canonical_json(spark):
    import random

    from folioflow.functions import text as X

    rng = random.Random(1)
    word = lambda: "".join(rng.choices('ab"\\/\n\té😀\x7f ', k=rng.randint(0, 4)))

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        return [lambda: rng.randint(-9, 9), lambda: rng.random() < 0.5, lambda: None, word, lambda: [value(depth - 1) for _ in range(rng.randint(0, 3))], lambda: {word(): value(depth - 1) for _ in range(rng.randint(0, 4))}][kind]()

    values = [value(3) for _ in range(200)]
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2), indent=i % 3 or None)) for i, v in enumerate(values)]
    found = {r.i: r.c for r in spark.createDataFrame(rows, "i int, t string").select("i", X.canonical_json("t").alias("c")).collect()}
    want = {i: json.dumps(v, sort_keys=True, separators=(",", ":")) for i, v in enumerate(values)}
    assert {i: c and c.replace("\x7f", "\\u007f") for i, c in found.items()} == {i: c.replace("\x7f", "\\u007f") for i, c in want.items()}
    broken = spark.createDataFrame([(t,) for t in ("", "{", None, '{"a":1,"a":2}', "1 2", "1, 2", "1] x", "1} x", "{}x", '1], "v": [2', "//")], "t string")
    assert [r[0] for r in broken.select(X.canonical_json("t")).collect()] == [None] * 11
