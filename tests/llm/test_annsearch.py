import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import annsearch


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        score = {}
        for i, x in rows:
            if i != q:
                score[i] = max(score.get(i, -np.inf), float((np.array(x, np.float32).astype(float) * np.array(v, np.float32).astype(float)).sum()))
        out[q] = sorted(score.items(), key=lambda s: (-s[1], s[0]))[:k]
    return out


@pytest.mark.parametrize("dim", [1, 3, 16])
def test_small_tables_are_exact(spark, dim, monkeypatch):
    monkeypatch.setattr(annsearch, "CANDIDATES_PER_BLOCK", 100)
    monkeypatch.setattr(annsearch, "QUERIES_PER_BLOCK", 4)
    rng = np.random.default_rng(dim)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(60)] + [rows[3], rows[3]]
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id long, embedding array<float>, id string, rank double")
    odd = [(900, None), (901, [0.0] * dim), (902, [float("nan")] * dim), (903, [float("inf")] * dim), (904, [None] * dim), (None, rows[0][1]), (905, []), (906, [1.0] * (dim + 1))]
    df = df.unionByName(spark.createDataFrame([(*r, "x", 1.5) for r in odd], df.schema))
    got = {}
    for r in sorted(annsearch.search(df, F.col("id") % 20 == 0, k=10).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 10)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-9 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_recall_on_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = annsearch.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0, rerank=60).collect()
    hits = sum((r.query_id, r.vec_id) in {(q, i) for q, v in want.items() for i, _ in v} for r in got)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert annsearch.search(one, F.col("id") % 20 == 0).count() == 0
    assert annsearch.search(one.limit(0), F.col("id") % 20 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in annsearch.search(two, F.col("id") % 20 == 0).collect()] == [(0, 1, 1, 11.0)]


def test_double_vectors_keep_their_precision(spark):
    rows = [(0, [0.1, 0.2]), (1, [0.4, 0.4]), (2, [1e39, -1e39]), (3, [1e39, 1e39]), (20, [1e200, 1.0])]
    got = [tuple(r) for r in annsearch.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1]
    vectors = dict(rows)
    for q in (0, 20):
        want = sorted(((dot(vectors[q], v), i) for i, v in rows if i != q), key=lambda x: (-x[0], x[1]))
        assert [(i, s) for query, _, i, s in sorted(got) if query == q] == [(i, s) for s, i in want]


def test_every_length_is_searched(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (20, [1.0]), (21, [5.0]), (22, [7.0]), (40, [1.0, 1.0, 1.0])]
    found = annsearch.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 20 == 0)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == [(0, 1, 1), (20, 1, 22), (20, 2, 21)]


def test_cells_of_clustered_vectors(spark, monkeypatch):
    """Few cells are searched where vectors lie in clusters, nearly all where they do not; recall holds, and exact is exact."""
    monkeypatch.setattr(annsearch, "CELL_ROWS", 100)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 16))
    for spread, probes in ((0.05, range(1, 9)), (50.0, range(12, 31))):
        x = (centres[rng.integers(0, 25, 3000)] + spread * rng.normal(size=(3000, 16))).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert annsearch.partition(x, 30, 20).probes in probes
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        want = {(q, i) for q, v in brute(rows, [r for r in rows if r[0] % 100 == 0], 20).items() for i, _ in v}
        got = {(r.query_id, r.vec_id) for r in annsearch.search(df, F.col("id") % 100 == 0).collect()}
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
        assert {(r.query_id, r.vec_id) for r in annsearch.search(df, F.col("id") % 100 == 0, exact=True).collect()} == want


def test_a_vector_that_many_rows_share(spark, monkeypatch):
    monkeypatch.setattr(annsearch, "CANDIDATES_PER_BLOCK", 64)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 0.0, 0.0, 0.0] if i % 3 else rng.normal(size=4).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = {}
    for r in sorted(annsearch.search(df, F.col("id") % 20 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len(set(v) & {i for i, _ in want[q]}) for q, v in got.items())
    assert hits >= 0.98 * sum(map(len, want.values()))


@pytest.mark.parametrize("kind", ["clusters", "lengths", "directions", "queries", "huge"])
def test_no_kind_of_rows_loses_neighbours(spark, kind, monkeypatch):
    """Close clusters, uneven lengths, few directions that count, queries unlike the rows and lengths beyond what is
    quantised: the 200 best codes of a block held half of the neighbours or fewer there."""
    monkeypatch.setattr(annsearch, "CELL_ROWS", 1500)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 16))
    if kind == "clusters":
        x = rng.normal(size=(5, 16))[rng.integers(0, 5, 6000)] + 0.002 * x
    elif kind == "lengths":
        x *= np.exp(3 * rng.normal(size=(6000, 1)))
    elif kind == "directions":
        x *= np.where(np.arange(16) == 0, 1000, 1)
    elif kind == "queries":
        x[::100] = 3 * x[::100] + 20
    else:
        x *= np.where(rng.random((6000, 1)) < 0.1, 1e9, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {(q, i) for q, v in brute(rows, [r for r in rows if r[0] % 100 == 0], 20).items() for i, _ in v}
    got = {(r.query_id, r.vec_id) for r in annsearch.search(df, F.col("id") % 100 == 0, rerank=40).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_anisotropic_loss_beats_plain_assignment():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = annsearch.fit(x)
    assert q.eta > 1

    def parallel(rounds):
        codes = q.assign(x, rounds)
        back = q.books[np.arange(q.subspaces)[None], codes].reshape(len(x), -1)[:, :32]
        return float(np.mean(((x - back) * x).sum(1) ** 2))

    assert parallel(2) < parallel(0)
    codes = np.ascontiguousarray(q.encode(x).T)
    back = q.books[np.arange(q.subspaces)[None], q.assign(x)].reshape(len(x), -1)[:, :32]
    assert np.allclose(annsearch.scan(q, x[0], codes), back @ x[0], atol=1e-4)
    assert annsearch.best(np.array([1, 3, 3, 2, 3], np.float32), 2).tolist() == [1, 2]
