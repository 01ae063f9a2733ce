import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import suffixes


def brute(texts, length=200):
    """(doc_id, bytes, removed, spans, kept) of rows (doc_id, text)."""
    raw = [(d, (t or "").encode()) for d, t in texts]
    seen = Counter(t[i : i + length] for _, t in raw for i in range(len(t) - length + 1))
    out = []
    for d, t in raw:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, g in zip(t, gone.tolist(), strict=True) if not g)
        out.append((d, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return sorted(out, key=repr)


def found(df, **more):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.without_repeats(df, **more).collect()), key=repr)


def test_awkward_rows(spark, docs, texts, tmp_path):
    want = brute(texts)
    assert found(docs) == want
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in suffixes.op13_suffix_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((d, n, k, s, hashlib.sha256(t).hexdigest()) for d, n, k, s, t in want), key=repr)


@pytest.mark.parametrize("most", [4096, 2])
def test_common_phrase_in_many_surroundings(spark, monkeypatch, most):
    """Near copies, phrases shorter and longer than a string, cut at every place; also where hot grams are dealt again."""
    monkeypatch.setattr(suffixes, "GROUP_CONTEXTS", most)
    rng = random.Random(most)
    noise = lambda n: "".join(rng.choices("abcdé ", k=n))
    phrase, long = noise(25), noise(140)
    texts = []
    for i in range(60):
        base = noise(rng.randint(0, 60)) + phrase + noise(rng.randint(0, 50))
        texts.append((i, base + long[rng.randint(0, 60) : rng.randint(70, 140)] + noise(rng.randint(0, 30))))
        if i % 3 == 0:
            cut = rng.randrange(len(base))
            texts.append((i, base[:cut] + "#" + base[cut:]))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    assert found(df, length=30) == brute(texts, 30)


def test_one_letter_and_chunks(spark, monkeypatch):
    texts = [(1, "x" * 3000), (2, "y" * 199), (3, "y" * 200), (4, "z" * 201), (5, "xy" * 400)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert found(df) == brute(texts)
    # A text in several chunks of windows has the same repeats.
    rng = random.Random(3)
    text = bytes(rng.choices(b"ab", k=900)) * 2
    for chunk in (64, 1 << 20):
        monkeypatch.setattr(suffixes, "CHUNK", chunk)
        held = Counter()
        for _, _, at in suffixes.contexts(text, 40, 12):
            for a in at.tolist():
                first, offset, windows = suffixes.unpacked(a)
                held.update(range(first, first + windows))
                assert 0 <= offset <= 28
        assert held == Counter(range(len(text) - 39))


def test_other_columns_and_empty(spark, docs):
    out = suffixes.without_repeats(docs.withColumn("n_bytes", F.lit("old")))
    assert out.columns == [*[c for c in docs.columns], "n_bytes", "n_removed", "n_spans", "kept"] and dict(out.dtypes)["n_bytes"] == "bigint"
    assert suffixes.without_repeats(docs.limit(0)).count() == 0


def test_merge_sort_orders_suffixes():
    rng = np.random.default_rng(5)
    blob = rng.integers(97, 99, 5000).astype(np.uint8)
    at, sizes = rng.permutation(4900)[:1000], [1, 2, 3, 94, 900]
    run = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    got = suffixes.merge_sort(suffixes.prefix_hashes(blob), blob, at, run, 100)
    begin = 0
    for n in sizes:
        assert [blob[i : i + 100].tobytes() for i in got[begin : begin + n]] == sorted(blob[i : i + 100].tobytes() for i in at[begin : begin + n])
        begin += n


def test_a_collision_is_found(monkeypatch):
    """With hashes that all agree, bytes decide."""
    texts = [b"a" * 10 + b"b" * 20, b"a" * 10 + b"c" * 20, b"a" * 10 + b"b" * 20, b"x" * 30]
    monkeypatch.setattr(suffixes, "prefix_hashes", lambda a: np.zeros(len(a) + 1, np.uint64))
    one = np.ones(4, np.int64)
    assert suffixes.repeated(one, 0 * one, one, texts, 30).tolist() == [True, False, True, False]


def test_prefix_hashes_beyond_a_block():
    a = np.random.default_rng(1).integers(0, 256, 3 * suffixes.BLOCK + 5).astype(np.uint8)
    a[-700:] = a[100:800]
    h = suffixes.prefix_hashes(a)
    want = 0
    for i, x in enumerate(a.tolist()):
        want = (want * suffixes.BASE + int(suffixes.VALUES[x])) % 2**64
        assert i % 1000 or int(h[i + 1]) == want
    assert suffixes.span_hash(h, np.array([100]), 600) == suffixes.span_hash(h, np.array([len(a) - 700]), 600)
