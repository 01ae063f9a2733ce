"""The flow with a chat model: chunks, glossary, rounds of calls, and the gateway."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from folioflow import schemas
from folioflow.functions import lenient
from folioflow.functions import text as X
from folioflow.operators import calls, gateway, segments
from folioflow.plans import translate
from folioflow.plans.flow_queries import payload_of
from folioflow.plans.translate import Settings, translate_documents

ELEMENT = {"label": "Text", "category": "FLOWING_TEXT", "bbox_pdf": [0.0, 0.0, 9.0, 9.0], "source_text": "", "translated_text": "", "latex": "", "cells": []}
PAGES = [
    [ELEMENT | {"source_text": "On the growth of rye"}, ELEMENT | {"category": "BYPASS"}, ELEMENT | {"source_text": "<math>a=b</math>"}, ELEMENT | {"source_text": "Yields by year", "latex": "Yield table", "cells": [{"text": "Harvest"}, {"text": "17.25"}]}],
    [ELEMENT | {"source_text": "Rye from Kuopio was sown in every field of the station."}],
]


def documents(spark, pages):
    doc = {"doc_id": 1, "pdf_path": "r.pdf", "source_language": "English", "target_language": "Finnish", "pages": [{"page_index": i, "elements": p} for i, p in enumerate(pages)]}
    return spark.read.schema(f"doc_id long, {schemas.DOCUMENT}").json(spark.sparkContext.parallelize([json.dumps(doc)]))


def run(spark, pages, answer, tmp_path, **settings):
    cache = spark.createDataFrame([], schemas.CACHE)
    return translate_documents(documents(spark, pages), cache, gateway.ScriptedModel(answer), Settings(**settings), str(tmp_path / "flow"))


def calls_of(spark, tmp_path, *rounds):
    return [spark.read.parquet(str(tmp_path / "flow" / r)).count() for r in rounds]


ROUNDS = ("first", "missing", "unchanged", "length")


def marked(system, user):
    return json.dumps([{"id": k, "t": f"[{v}]"} for k, v in payload_of(user).items()])


def test_end_to_end(spark, tmp_path):
    result = run(spark, PAGES, marked, tmp_path, tolerance=0.9)
    back = json.loads(result.documents.select(F.to_json(F.struct("pdf_path", "pages")).alias("j")).first().j)
    first, second = back["pages"]
    assert [e["translated_text"] for e in first["elements"]] == ["[On the growth of rye]", "", "", "[Yields by year]"]
    table = first["elements"][3]
    assert table["translated_latex"] == "[Yield table]" and table["latex"] == "Yield table"
    assert table["cells"] == [{"text": "Harvest", "translated_text": "[Harvest]"}, {"text": "17.25"}]
    assert second["elements"][0]["translated_text"] == "[Rye from Kuopio was sown in every field of the station.]"
    assert back["pdf_path"] == "r.pdf" and first["elements"][0]["bbox_pdf"] == [0.0, 0.0, 9.0, 9.0]
    assert calls_of(spark, tmp_path, *ROUNDS) == [1, 0, 0, 0] and result.report.first().n_translated == 5 and result.errors.count() == 0


def test_a_length_that_is_off_takes_two_calls(spark, tmp_path):
    source, right = "A sentence that is long enough for its length to count.", "Lause joka on kyllin pitka jotta sen mitta myos lasketaan"

    def answer(system, user):
        return json.dumps([{"id": k, "t": right if X.OTHER_LENGTHS in user else f"{v} and more and more and more"} for k, v in payload_of(user).items()])

    result = run(spark, [[ELEMENT | {"source_text": source}]], answer, tmp_path)
    row = result.segments.first()
    assert row.translation == right and row.source_of == "length" and not row.off
    assert calls_of(spark, tmp_path, *ROUNDS) == [1, 0, 0, 1]
    never = run(spark, [[ELEMENT | {"source_text": source}]], lambda s, u: json.dumps({k: v * 2 for k, v in payload_of(u).items()}), tmp_path).segments.first()
    assert never.off and never.translation == source * 2


def test_missing_unknown_unchanged_and_failed(spark, tmp_path):
    pages = [[ELEMENT | {"source_text": f"text number {w}"} for w in ("one", "two", "six")]]

    def answer(system, user):
        keep = [k for k in payload_of(user) if k != "1"] if X.EVERY_ID not in user else ["1"]
        return json.dumps([{"id": k, "t": payload_of(user)[k].upper()} for k in keep] + [{"id": "77", "t": "x"}])

    got = {r.seg_id: (r.translation, r.source_of) for r in run(spark, pages, answer, tmp_path).segments.collect()}
    assert got == {"0": ("TEXT NUMBER ONE", "first"), "1": ("TEXT NUMBER TWO", "retry"), "2": ("TEXT NUMBER SIX", "first")}
    same = run(spark, pages, lambda s, u: json.dumps(payload_of(u)), tmp_path)
    assert {r.translation for r in same.segments.collect()} == {e["source_text"] for e in pages[0]}
    assert calls_of(spark, tmp_path, *ROUNDS) == [1, 0, 1, 0]

    def broken(system, user):
        raise OSError("down")

    gone = run(spark, pages, broken, tmp_path, limits=gateway.Limits(attempts=1))
    assert {(r.translation, r.source_of) for r in gone.segments.collect()} == {(e["source_text"], "source") for e in pages[0]}
    assert sorted((r["round"], r.error) for r in gone.errors.collect()) == [(r, "OSError: down") for r in ("first", "missing", "unchanged")]


def test_glossary_reaches_the_chunks_that_hold_it(spark, tmp_path):
    pages = [[ELEMENT | {"source_text": "Kuopio lies on a lake."}, ELEMENT | {"source_text": "Nothing of the kind here."}, ELEMENT | {"source_text": "To KUOPIO by train."}]]

    def answer(system, user):
        texts = payload_of(user)
        if system.startswith("You collect"):
            if "2" in texts:
                raise OSError("no terms today")  # goes without
            return json.dumps([{"src": "Kuopio ", "dst": "KPO"}, {"src": "kuopio", "dst": "other"}, {"dst": "bare"}])
        return json.dumps([{"id": k, "t": "with" if "kuopio = KPO" in system else "none"} for k in texts])

    result = run(spark, pages, answer, tmp_path, glossary=True, chunk_bytes=10, tolerance=9.0, limits=gateway.Limits(attempts=1))
    assert {r.seg_id: r.translation for r in result.segments.collect()} == {"0": "with", "1": "none", "2": "with"}
    assert [r.error for r in result.errors.collect()] == ["OSError: no terms today"]


def test_gateway_limits():
    waits, now = [], [0.0]

    def sleep(s):
        waits.append(s)
        now[0] += s

    class Model:
        name, params, tries = "m", {}, 0

        def complete(self, system, user, force_json=False):
            self.tries += 1
            if self.tries == 1:
                raise gateway.RateLimited
            if self.tries == 2:
                raise OSError
            return gateway.Reply("<think>x</think>ok")

    own = gateway.Gateway(Model(), gateway.Limits(calls=2), lambda: now[0], sleep)
    assert own.call("s", "u") == "ok"
    assert waits == [5.5, 1.0, 53.5]  # after too many calls; after an error; for the third call within a minute
    parts = iter([gateway.Reply('[{"id": 1, "t": "a"}]', True), gateway.Reply('[{"id": 1, "t": "b"}, {"id": 2, "t": "c"}]')])
    own = gateway.Gateway(type("P", (), {"complete": lambda self, *a: next(parts)})())
    assert json.loads(own.call("s", "u")) == [{"id": 1, "t": "a"}, {"id": 2, "t": "c"}]


def test_gateway_width():
    here, most, lock, gate = [0], [0], threading.Lock(), threading.Event()

    class Model:
        def complete(self, system, user, force_json=False):
            with lock:
                here[0] += 1
                most[0] = max(most[0], here[0])
            gate.wait(0.05)
            with lock:
                here[0] -= 1
            return gateway.Reply("ok")

    own = gateway.Gateway(Model(), gateway.Limits(width=2))
    threads = [threading.Thread(target=own.call, args=("s", "u")) for _ in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert most[0] == 2


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Sure:\n```json\n[{\"id\": \"0\", \"t\": \"a\"} {\"id\": \"1\", \"t\": \"b\"},]\n```\nDone.", [{"id": "0", "t": "a"}, {"id": "1", "t": "b"}]),
        ("{'0': 'it is', \"1\": 'so',}", {"0": "it is", "1": "so"}),
        ("[{id: 0, t: plain words}, {id: 1", [{"id": 0, "t": "plain words"}]),
        ('{a: True, b: none, c: [1 2.5 -3e2], "d": "say \\"x\\" or "y" too"}', {"a": True, "b": None, "c": [1, 2.5, -300.0], "d": 'say "x" or "y" too'}),
        ('[{"id": "0", "t": "caf\\u00e9 \\ud83d\\ude00"},]', [{"id": "0", "t": "caf\u00e9 \U0001f600"}]),
        ("nothing here", None), (None, None), ("[", []), ("[}]", []), ("[" * 5000, []), ('{"a": {"b": "c"', {}),
    ],
)
def test_lenient_json(raw, want):
    assert lenient.loads(raw) == want


def test_lenient_json_is_linear():
    import time

    long = "[" + ", ".join('{"id": "%d", "t": "some text here"}' % i for i in range(20_000)) + ', {"id'
    began = time.perf_counter()
    assert len(lenient.loads(long)) == 20_000 and time.perf_counter() - began < 10


def test_glossary_plans(spark):
    """No text in the rows of grams; one pass over each text for a small glossary; nothing lost by either."""
    chunks = spark.createDataFrame([(1, "The cat SAT on the catalogue"), (2, "dog"), (2, "dog"), (3, None), (4, "")], "doc_id long, chunk_text string")
    terms = spark.createDataFrame([("cat", "c"), ("cat", "d"), ("catalogue", "e"), ("o", "f"), ("at", "g"), ("zzz", "h")], "src_key string, dst string")
    want = sorted([(1, k, d) for k, d in (("cat", "c"), ("cat", "d"), ("catalogue", "e"), ("o", "f"), ("at", "g"))] + [(2, "o", "f")] * 2)
    for most in (0, 10):
        found = calls.glossary_matches(chunks, terms, broadcast_terms=most)
        assert sorted((r.doc_id, r.src_key, r.dst) for r in found.collect()) == want
    plan = calls.glossary_matches(chunks, terms, broadcast_terms=0)._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.splitlines() if "Generate explode" in line and "__g" in line]
    assert generated and all("chunk_text" not in line.split("],")[-1] for line in generated)
    assert calls.glossary_matches(chunks, terms.limit(0)).count() == 0


def test_rounds_do_not_deal_texts_out(spark, tmp_path):
    """All that is known of a chunk stays in its row: no round joins or groups texts, and answers that name an id twice
    settle by the last."""
    docs = segments.lines_as_documents(spark.createDataFrame([(1, "one\ntwo"), (2, "three"), (None, "four")], "doc_id long, text string"))
    docs = docs.withColumn("source_language", F.lit("a")).withColumn("target_language", F.lit("b"))

    def twice(system, user):
        return json.dumps([{"id": i, "t": f"{n} {t}"} for n in "xy" for i, t in payload_of(user).items()])

    found = translate.translate_chunks(docs, gateway.ScriptedModel(twice), translate.Settings(), str(tmp_path)).segments
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.seg_id, r.translation, r.source_of) for r in found.collect()} == {(1, "0", "y one", "first"), (1, "1", "y two", "first"), (2, "0", "y three", "first"), (None, "0", "y four", "first")}
