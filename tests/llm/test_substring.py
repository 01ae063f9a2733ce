import hashlib
import random
import re

import numpy as np
import pytest

from folioflow.llm import substring


def brute(texts, window=20):
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in texts]
    least = lambda d: -(2**63) if d is None else d
    first = {}
    for d, w in docs:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (2**63, 0)), (least(d), i))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (least(d), i):
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def found(df, **more):
    return sorted(((r.id, r.n_words, r.n_removed, r.text) for r in substring.dedup_substrings(df, **more).collect()), key=repr)


def test_like_brute_force(docs, texts):
    assert found(docs) == brute(texts)
    assert found(docs.repartition(7)) == brute(texts)


@pytest.mark.parametrize("seed", range(4))
def test_random_repeats(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(substring, "_CHUNK_BYTES", rng.choice([100, 2000, 1 << 20]))
    words = [f"w{i}" for i in range(rng.choice([2, 5, 30]))]
    passages = [rng.choices(words, k=rng.randint(6, 60)) for _ in range(5)]
    rows = [(i, " ".join(sum([rng.choice(passages)[rng.randint(0, 5) :] + rng.choices(words, k=rng.randint(0, 4)) for _ in range(rng.randint(0, 6))], []))) for i in rng.sample(range(1000), 60)]
    window = rng.choice([6, 8, 20])
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=window) == brute(rows, window)


def test_spans_and_empty(spark, docs):
    text = " ".join(f"a{i}" for i in range(30))
    rows = substring.dedup_substrings(spark.createDataFrame([(1, text), (2, f"x {text} y")], "doc_id long, text string")).collect()
    assert {r.id: [(s.start, s.end) for s in r.removed] for r in rows} == {1: [], 2: [(1, 31)]}
    assert substring.dedup_substrings(docs.limit(0)).count() == 0


def test_very_long_text_takes_the_other_way(monkeypatch):
    rng = np.random.default_rng(2)
    words, lens = rng.integers(0, 9, 3000).astype(np.uint64), np.array([1500, 0, 10, 1490])
    plain = substring.paths(words, lens, 20)
    roll = substring.Rolling(words, substring._C1, 1)
    at = np.arange(len(words) - substring.MINIMIZER + 1)
    other = substring._long_paths(words, lens, 20, roll, roll(at, at + substring.MINIMIZER))
    assert all((a == b).all() for a, b in zip(plain, other, strict=True))


def texts_of(df):
    return sorted(((r.id, r.text) for r in substring.dedup_substrings(df).collect()), key=repr)


def test_rows_without_or_with_repeated_ids_keep_their_own_words(spark, monkeypatch):
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    twice = f"{words('p', 30)} {words('p', 30)}"
    rows = [(None, twice), (None, words("u", 70)), (7, twice), (7, words("v", 70)), (9, words("v", 70)), (9, words("v", 70))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(None, words("p", 30)), (None, words("u", 70)), (7, ""), (7, words("v", 70)), (9, ""), (9, "")], key=repr)
    assert texts_of(df) == want
    # Tags that do not tell rows apart: the checksums do.
    monkeypatch.setattr(substring, "_tag", lambda id_, text: id_ * 0)
    assert texts_of(df) == want
    null = spark.createDataFrame([(None, f"x {words('p', 30)}"), (None, f"{words('p', 30)} y"), (3, words("p", 30))], "doc_id long, text string")
    found = [t for _, t in texts_of(null)]
    assert sum("p0 p1" in t for t in found) == 1 and "" in found


def test_circles_and_long_paths(spark):
    """Texts that go round in circles, and passages whose first occurrences lie in different texts."""
    line = " ".join(f"l{i}" for i in range(25))
    long = [f"x{i}" for i in range(600)]
    rows = [(i, " ".join([line] * (i + 2))) for i in range(4)] + [(10, "same " * 100), (11, "same " * 60)]
    rows += [(20 + i, " ".join(long[40 * i : 40 * i + 70])) for i in range(14)] + [(50, " ".join(long)), (51, " ".join(long))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_unbranched_paths(spark):
    """Edges with their nodes by number: two chains that meet, a circle, and links between rows."""
    place = lambda start, n: start << substring.START | n
    rows = [(1, 1, place(0, 3), 100, 101), (2, 1, place(3, 2), 101, 102), (3, 2, place(7, 4), 102, 103), (4, 3, place(0, 1), 200, 103), (5, 3, place(1, 1), 103, 104), (6, 4, place(0, 1), 300, 301), (7, 5, place(0, 1), 301, 300)]
    graph = spark.createDataFrame([(*r, r[0]) for r in rows], "k long, id long, place long, head long, tail long, d1 long")
    got = {r.k: (r.path, r.offset) for r in substring.unbranched_paths(graph).collect()}
    assert got == {1: (1, 0), 2: (1, 3), 3: (1, 5), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (7, 0)}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_resolver_over_batches_of_any_size(size):
    rng = random.Random(size)
    rows = sorted((rng.randrange(4), rng.randrange(3), rng.randrange(5), rng.randrange(3) << substring.START | 5 | rng.choice([0, 0, substring.COPIED])) for _ in range(60))
    state, got = substring.Resolver(), set()
    for i in range(0, len(rows), size):
        out = state.step(*(np.array(x, np.int64) for x in zip(*rows[i : i + size], strict=True)))
        got |= {tuple(int(v) for v in r) for r in zip(*out, strict=True)}
    want, plain = set(), [(*r[:3], r[3] & substring.PLACE) for r in rows]
    for h, p in {r[:2] for r in rows}:
        own = sorted({r[2:] for r in plain if r[:2] == (h, p)})
        want |= {(h, p, *r, substring.LATER) for r in own[1:]}
        again = len(own) > 1 or any(r[3] & substring.COPIED for r in rows if r[:2] == (h, p))
        branched = len({r[1] for r in rows if r[0] == h}) > 1
        want |= {(h, p, *own[0], kind) for kind, on in ((substring.EDGE, again), (substring.BRANCH, branched)) if on}
    split = {(*r[:4], k) for r in got for k in ((0,) if r[4] == 0 else [k for k in (1, 2) if r[4] & k])}
    assert split == want


def test_query(spark, docs, texts, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.op4_substring_dedup(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(texts)), key=repr)
