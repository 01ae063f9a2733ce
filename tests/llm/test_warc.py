import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from folioflow.llm import warc

LONG, UMLAUT = "x" * 1000, "ü" * 500
PAGES = [(1, "http://a/ ü\r\nX: y", LONG), (2, None, LONG), (7, "http://b", LONG), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (8, "u", UMLAUT), (9, "u", UMLAUT), (None, "n", LONG), (10, "u", "WARC/1.1\r\n\r\n" * 9), (11, "u", "y" * 3_000_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, owner string, digest int")


def test_round_trip(spark, pages, tmp_path):
    archives = warc.write_archives(pages.repartition(3))
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert len(got) == len(PAGES) and all(r.digest_ok for r in got.values())
    kinds = {i: (r.record_type, r.refers_to) for i, r in got.items()}
    assert kinds[1] == kinds[2] == kinds[None] == ("revisit", 7) and kinds[8] == ("revisit", 9)
    assert all(kinds[i] == ("response", None) for i in (3, 4, 5, 6, 7, 9, 10, 11))
    for i, _, html in PAGES:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha1(data).hexdigest()
        assert got[i].html == (None if kinds[i][0] == "revisit" else html or "")
    assert got[1].url == "http://a/%20ü%0D%0AX:%20y"
    warc.save_archives(archives, str(tmp_path / "w"))
    again = warc.read_archives(warc.load_archives(spark, str(tmp_path / "w")))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.values()))


def test_files_are_read_as_streams(spark, pages, tmp_path):
    archives = warc.write_archives(pages.repartition(2))
    warc.save_archives(archives, str(tmp_path / "w"))
    paths = spark.createDataFrame([(str(p),) for p in (tmp_path / "w").glob("*.warc.gz")], "path string")
    got = warc.read_files(paths, lambda path: open(path, "rb"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, warc.read_archives(archives).collect()))


def test_members_and_framing():
    data = warc.write_record(1, "u", b"one") + warc.write_record(2, "u", b"two", 1)
    assert gzip.decompress(data).count(b"WARC/1.1") == 2
    for n in (1, 7, 100_000):  # pieces of any size
        records = list(warc.read_records(data[i : i + n] for i in range(0, len(data), n)))
        assert [r["warc-type"] for r in records] == ["response", "revisit"] and all(r["block_ok"] for r in records)
    assert list(warc.read_records([])) == []
    for broken in (data[:-9], gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"), gzip.compress(b"HTTP\r\n\r\n"), gzip.compress(b"WARC/1.1")):
        with pytest.raises(ValueError):
            list(warc.read_records([broken]))
    bad = gzip.compress(gzip.decompress(warc.write_record(1, "u", b"one")).replace(b"\r\n\r\none", b"\r\n\r\ntwo"))
    assert not warc.parse_page(next(warc.read_records([bad])))["digest_ok"]


def test_ties_and_empty(spark, pages):
    twice = spark.createDataFrame([(1, "u", LONG), (5, "u", LONG), (5, "u", LONG)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type) for r in warc.read_archives(warc.write_archives(twice)).collect())
    assert got == [(1, "revisit"), (5, "response"), (5, "response")]
    null = twice.withColumn("page_id", F.lit(None).cast("long"))
    assert {r.record_type for r in warc.read_archives(warc.write_archives(null)).collect()} == {"response"}
    assert warc.write_archives(pages.limit(0)).count() == 0
