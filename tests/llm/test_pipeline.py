"""The pipeline against a plain version, stage by stage."""

import random
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from folioflow.llm.common import materialize
from tests.llm.test_linededup import brute as brute_lines
from tests.llm.test_simhash import brute_print, components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "which of these seven rivers flows through the largest number of capital cities in the whole world today"


def corpus():
    rng = random.Random(4)
    words = {"en": "the of and house tree river walking talking stone green".split(), "de": "der und haus baum fluss gehend redend stein von stark".split()}
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        lines = [" ".join(rng.choices(words[lang], k=rng.randint(4, 20))) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.append("This footer stands on many pages of the site")
        rows.append((i, "\n".join(lines), lang, f"s{i % 3}", 0))
    rows += [(70, rows[5][1], "en", "s0", 0), (71, rows[5][1], "en", "s0", 0), (72, rows[9][1], None, "s0", 0), (72, rows[9][1], None, "s0", 0)]
    rows += [(80, "12 34 !!", "en", "s0", 0), (81, None, "en", "s0", 0), (82, "", "en", "s0", 0), (83, f"the house {ITEM} and the tree", "en", "s0", 0), (84, f"und der baum\n{ITEM}", "de", "s1", 0)]
    return rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage made of its predecessor's rows."""
    sf = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame([(1, ITEM), (2, "not in any document at all I should think")], "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
    docs, out = spark.read.parquet(str(sf / "documents.parquet")), {}
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        docs = materialize(stage(spark, docs, str(sf)), name)
        out[name] = before, docs.collect(), docs.columns
    return out, sf


def test_language_id_drops_what_has_no_letters(stages):
    before, after, columns = stages[0]["language_id"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {80, 81, 82}
    assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_id_keeps_short_texts_of_shared_words(spark):
    langs = ["da", "de", "en"]
    rows = [(i, f"common words only{lang} shown{lang}", lang, "s0", 0) for i, lang in enumerate(langs * 20)]
    rows += [(100, "common words", "en", "s0", 0), (101, "common words " * 10, "en", "s0", 0), (102, "1 2", "en", "s0", 0)]
    kept = {r.doc_id for r in pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert 100 in kept and 102 not in kept


def test_line_dedup(stages):
    before, after, columns = stages[0]["line_dedup"]
    want = Counter((d, t) for d, _, _, t in brute_lines([(r.doc_id, r.text) for r in before]))
    assert Counter((r.doc_id, r.text) for r in after) == want and all(r.n_chars == len(r.text) for r in after)
    assert sum("This footer" in r.text for r in after) == 1
    assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_dedup_keeps_one_of_each_group(stages):
    before, after, _ = stages[0]["near_dedup"]
    prints = [brute_print(r.text) for r in before]
    link = components(range(len(before)), [(i, j) for i in range(len(before)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    least = {}
    for i, r in enumerate(before):
        least[link[i]] = min(r.doc_id, least.get(link[i], r.doc_id))
    assert sorted(r.doc_id for r in after) == sorted(least.values())


def test_decontamination(stages):
    before, after, _ = stages[0]["decontamination"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {83, 84} and len(before) - len(after) == 2


def test_packing(stages, spark):
    before, after, _ = stages[0]["packing"]
    assert {r.doc_id for r in after} == {r.doc_id for r in before}
    assert all(len(r.ids) == r.length for r in after)
    whole = pipeline.run(spark, str(stages[1]))
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in after)


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    """Null and repeated ids, null texts, repeated rows, and columns with the names that operators use."""
    schema = SCHEMA + ", id long, k1 string, score string, n_lines string, `a.b` string, text_md5 string, fp long, row string"
    extra = (7, "k", "mine", "own", "dot", "m", 3, "r")
    words = [f"{a}{b}" for a in "bcdfghjklmnp" for b in ("arden", "ouse", "iver", "ree")]
    text = lambda seed, n=30: " ".join(random.Random(seed).choices(words, k=n))
    rows = [(i, text(i), "en", "s0", 0) for i in range(40)]
    copy = text(3)
    rows += [(None, copy, "en", "s0", 0), (None, text(90), None, None, None), (None, f"so {ITEM} it", "en", "s0", 0), (3, text(91), "en", "s0", 0), (3, f"and {ITEM}", "en", "s0", 0), (50, None, "en", "s0", 0), (51, text(92), "en", "s0", 0), (51, text(92), "en", "s0", 0)]
    spark.createDataFrame([(*r, *extra) for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
    left = docs.collect()
    assert all((r.score, r.n_lines, r["a.b"], r.k1, r.row) == ("mine", "own", "dot", "k", "r") for r in left)
    got = sorted(((r.doc_id, r.text) for r in left), key=repr)
    want = [(i, text(i)) for i in range(40)] + [(None, text(90)), (3, text(91)), (51, text(92))]
    assert got == sorted(want, key=repr)  # the copy without an id, both that hold the item and the repeated row are gone
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 42


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
