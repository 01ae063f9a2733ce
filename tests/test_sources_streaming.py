import json

from folioflow.operators.calls import EchoProvider
from folioflow.plans.registry import QUERIES
from folioflow.sources import files
from folioflow.streaming import incremental


def test_listing(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "sub/c.Pdf", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 5)
    assert files.list_documents(spark, str(tmp_path)).count() == 3
    assert files.read_binaries(spark, str(tmp_path), max_bytes=4).count() == 0
    assert files.missing_files([str(tmp_path / "a.pdf"), str(tmp_path / "no.pdf"), "http://x/y.pdf"]) == [str(tmp_path / "no.pdf")]
    wanted = spark.createDataFrame([("https://x/a.pdf",), ("nowhere",)], "path string")
    assert [r.path for r in files.missing_from(wanted, files.list_documents(spark, str(tmp_path))).collect()] == ["nowhere"]


def test_fetch_and_save(spark, tmp_path):
    answers = {"http://x/a.pdf": (200, b"abc", None), "http://x/b": (404, b"", None), "http://x/c": (200, b"abcdef", "n.html")}
    got = files.fetch(spark.createDataFrame([(u,) for u in [*answers, "http://x/none"]], "url string"), lambda u: answers[u], 5).collect()
    assert {r.url[-1]: (r.name, r.error) for r in got} == {"f": ("a.pdf", None), "b": ("b.pdf", "status 404"), "c": ("n.pdf", "over 5 bytes"), "e": ("none.pdf", "KeyError: 'http://x/none'")}
    named = files.result_names(spark.createDataFrame([("/in/paper.v2.pdf",), (".hidden",)], "path string")).collect()
    assert [r.mono for r in named] == ["paper.v2-mono.pdf", ".hidden-mono.pdf"]
    files.save_files(spark.createDataFrame([("r.bin", bytearray(b"ab"))], "name string, content binary"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "r.bin").read_bytes() == b"ab"
    assert files.font_for("JA", "/f") == "/f/SourceHanSerifJP-Regular.ttf"


def test_stream_translates_each_text_once(spark, tmp_path):
    doc = lambda i, text: json.dumps({"doc_id": i, "pages": [{"elements": [{"category": "FLOWING_TEXT", "source_text": text}]}]})
    (tmp_path / "in").mkdir()
    run = lambda: incremental.translate_stream(incremental.read_stream(spark, str(tmp_path / "in")), EchoProvider(), str(tmp_path / "cache"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    (tmp_path / "in" / "1.json").write_text(doc(1, "hello there") + "\n" + doc(2, "other text"))
    run()
    (tmp_path / "in" / "2.json").write_text(doc(3, "hello there") + "\n" + doc(4, "third text"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert files.read_cache(spark, str(tmp_path / "cache/v=2")).count() == 3
    assert spark.read.parquet(str(tmp_path / "cache/staging/1")).count() == 1  # the known text was not called for again
    assert files.read_cache(spark, str(tmp_path / "nowhere")).count() == 0


def test_windows_of_calls(spark, sf_dir):
    got = incremental.call_rates(spark.read.parquet(f"{sf_dir}/events.parquet"), ["user_id"])
    assert got.agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert QUERIES
