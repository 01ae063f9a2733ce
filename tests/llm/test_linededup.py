import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import linededup, mph

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    least = -(2**63)
    held = defaultdict(set)
    for d, t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held[k].add(least if d is None else d)
    out = []
    for d, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 3 or (least if d is None else d) == max(held[key(x)])]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_like_brute_force(docs, texts, monkeypatch):
    found = linededup.dedup_lines(docs)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()), key=repr) == brute(texts)
    assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
    # Many shards, each copied for many probes, give the same.
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 7)
    monkeypatch.setattr(linededup, "PROBES_PER_COPY", 5)
    found = linededup.dedup_lines(docs.repartition(5))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()), key=repr) == brute(texts)


def test_clashing_and_empty(spark, docs):
    found = linededup.dedup_lines(docs.withColumn("n_lines", F.lit("old")))
    assert found.columns.count("n_lines") == 1 and dict(found.dtypes)["n_lines"] == "bigint"
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    one = linededup.dedup_lines(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert [(r.text, r.n_lines, r.n_dropped) for r in one] == [("", 1, 0)] * 2


def test_rows_without_an_id_are_documents(spark):
    line = "a line that is long enough to count"
    rows = [(None, f"{line}\none"), (None, f"{line}\ntwo"), (None, f"three\n{line}"), (4, line), (9, "other")]
    found = lambda r: sorted(((x.doc_id, x.text) for x in linededup.dedup_lines(spark.createDataFrame(r, "doc_id long, text string")).collect()), key=repr)
    assert found(rows) == sorted([(None, "one"), (None, "two"), (None, "three"), (4, line), (9, "other")], key=repr)
    # Equal rows count each, and all stay where nobody else holds the line.
    assert found([(None, line)] * 3) == [(None, line)] * 3
    assert found([(None, line)] * 2 + [(4, line)]) == sorted([(None, "")] * 2 + [(4, line)], key=repr)
    # Of different texts without an id one keeps the line.
    assert sum(line in t for _, t in found(rows[:3])) == 1


def test_query_hash(spark, tmp_path, docs, texts):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.op1_line_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(texts)), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    data = mph.build(keys)
    index = mph.Function(data)(keys)
    assert sorted(index.tolist()) == list(range(len(keys)))
    if n >= 1000:
        assert len(data) < len(keys)  # under eight bits a key
    other = mph.Function(data)(np.arange(5, dtype=np.uint64))
    assert ((other >= -1) & (other < max(1, len(keys)))).all()


def test_colliding_hashes_stay_apart():
    import pyarrow as pa

    t = pa.table({"h": pa.array([5, 5, 9], pa.int64()), "f": pa.array([1, 2, 3], pa.int32()), "n": pa.array([7, 1, 300], pa.int64()), "owner": pa.array([10, 11, 12], pa.int64())})
    shard = linededup.Shard(linededup._build_shard(t, 3), 3)
    hit, owner = shard.probe(np.array([5, 5, 9, 5], np.int64), np.array([1, 2, 3, 8], np.int32))
    assert hit.tolist() == [True, False, True, False] and owner[0] == 10 and owner[2] == 12
