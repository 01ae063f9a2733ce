import json

import pytest
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.functions import text as X
from folioflow.operators import segments
from folioflow.operators.calls import EchoProvider, ScriptedProvider, call_provider
from folioflow.plans.translate import Settings, translate_documents
from folioflow.sources import files

DOC = {
    "pdf_path": "a.pdf", "source_language": "en", "target_language": "fr",
    "pages": [
        {"page_index": 0, "page_width": 600.0, "page_height": 800.0, "elements": [
            {"label": "Section-header", "category": "TEXT", "bbox_pdf": [0, 0, 10, 10], "source_text": "A heading here", "latex": ""},
            {"label": "Text", "category": "TEXT", "bbox_pdf": [0, 0, 10, 10], "source_text": "Some paragraph", "latex": ""},
            {"label": "Picture", "category": "BYPASS", "bbox_pdf": [0, 0, 10, 10], "source_text": "", "latex": ""},
            {"label": "Formula", "category": "TEXT", "bbox_pdf": [0, 0, 10, 10], "source_text": "<math>e</math> (1.2)", "latex": ""},
            {"label": "Table", "category": "TEXT", "bbox_pdf": [0, 0, 10, 10], "source_text": "Its caption", "latex": "where words are", "cells": [{"text": "word"}, {"text": "12"}, {"text": ""}]},
        ]},
        {"page_index": 1, "page_width": 600.0, "page_height": 800.0, "elements": [{"label": "Text", "category": "TEXT", "bbox_pdf": [0, 0, 10, 10], "source_text": "Last one", "latex": ""}]},
    ],
}


@pytest.fixture()
def docs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(DOC))
    return files.read_documents(spark, str(tmp_path / "in"))


def test_collects_in_depth_first_order(docs):
    got = sorted(segments.collect_segments(docs).collect(), key=lambda r: int(r.seg_id))
    assert [r.seg_id for r in got] == ["0", "1", "2", "3", "4", "5"]
    assert [r.text for r in got] == ["A heading here", "Some paragraph", "Its caption", "where words are", "word", "Last one"]
    assert [r.write_key for r in got] == ["translated_text", "translated_text", "translated_text", "translated_latex", "translated_text", "translated_text"]


@pytest.mark.parametrize("limit", [10, 60, 200, 3000])
def test_chunks_respect_bytes(docs, limit):
    rows = sorted(segments.chunked_segments(docs, limit).collect(), key=lambda r: int(r.seg_id))
    size = lambda part: len(json.dumps({r.seg_id: r.text for r in part}, ensure_ascii=False).encode())
    parts = [[r for r in rows if r.chunk_no == n] for n in range(rows[-1].chunk_no + 1)]
    assert sum(parts, []) == rows and all(parts)
    # Every chunk fits or is one entry, and the next entry would not have fitted.
    assert all(len(p) == 1 or size(p) <= limit for p in parts)
    assert all(size([*p, following[0]]) > limit for p, following in zip(parts, parts[1:], strict=False))


def test_json_bytes_like_python(spark):
    texts = ["", "a", '"quoted" \\ /', "\n\t\r\x08\x0c", "".join(map(chr, range(1, 32))), "日本 😀  \x7f"]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(X.json_bytes("s").alias("n")).collect()
    assert [r.n for r in got] == [len(json.dumps(t, ensure_ascii=False).encode()) for t in texts]


def test_write_back_leaves_siblings(docs):
    found = segments.collect_segments(docs)
    some = found.where("seg_id in ('3', '4')").select("doc_id", "seg_id", F.upper("text").alias("translation"))
    back = json.loads(segments.write_back(docs, some).select(F.to_json(F.struct("pages")).alias("j")).first().j)
    table = back["pages"][0]["elements"][4]
    assert table["translated_latex"] == "WHERE WORDS ARE" and "translated_text" not in table
    assert [c.get("translated_text") for c in table["cells"]] == ["WORD", None, None]
    assert "translated_text" not in table["cells"][1]
    assert back["pages"][1]["elements"][0] == {k: v for k, v in DOC["pages"][1]["elements"][0].items()} | {"bbox_pdf": [0.0, 0.0, 10.0, 10.0]}
    assert len(back["pages"][0]["elements"]) == 5


def test_whole_flow(spark, docs, tmp_path):
    cache = spark.createDataFrame([("echo", "{}", "word", "cached", 0)], schemas.CACHE)
    result = translate_documents(docs, cache, EchoProvider(), Settings(), str(tmp_path / "staging"))
    got = {r.seg_id: r.translation for r in result.segments.collect()}
    assert got["0"] == "echo(A heading here)" and got["4"] == "cached" and len(got) == 6
    assert spark.read.parquet(str(tmp_path / "staging")).count() == 5  # only misses were called for
    assert result.cache.count() == 6
    assert result.report.first().n_translated == 6
    files.write_documents(result.documents, str(tmp_path / "out"))
    assert "echo(Last one)" in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))


def test_languages_must_be_known(spark, docs, tmp_path):
    bare = docs.withColumn("source_language", F.lit(""))
    with pytest.raises(Exception, match="source_language is not set"):
        translate_documents(bare, spark.createDataFrame([], schemas.CACHE), EchoProvider(), Settings(), str(tmp_path / "s")).documents.collect()
    assert translate_documents(bare, spark.createDataFrame([], schemas.CACHE), EchoProvider(), Settings(source_language="en"), str(tmp_path / "s")).segments.count() == 6


def test_failed_calls_become_rows(spark):
    class Broken(ScriptedProvider):
        def translate(self, texts):
            raise OSError("down")

    got = call_provider(spark.createDataFrame([("a",)], "original_text string"), Broken({})).first()
    assert got.translation is None and got.error == "OSError: down"


def test_pages(spark):
    ranges = spark.range(1).select(X.page_numbers(F.lit("1-3,5")).alias("p")).first().p
    assert ranges == [0, 1, 2, 4]
    for n, want in [(0, []), (3, [0, 1, 2]), (5, [0, 1, 2, 3, 4]), (12, [int(i * 12 / 5) for i in range(5)]), (101, [int(i * 101 / 5) for i in range(5)])]:
        assert spark.range(1).select(segments.sampled_positions(F.lit(n)).alias("p")).first().p == want


def test_columns_of_empty_documents(spark):
    empty = spark.createDataFrame([], f"doc_id long, {schemas.DOCUMENT}")
    assert segments.chunked_segments(empty).count() == 0
    null = spark.createDataFrame([(1, None)], f"doc_id long, pages array<{schemas.PAGE}>")
    assert segments.collect_segments(null).count() == 0
