import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioflow.llm import simhash
from folioflow.llm.graph import connected_components


def brute_print(t, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", "A", "a B", "a b c", "x y z x y z x y z", "É é", " \x0b lead", "w " * 70_000])
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode() if text else None, 3) == brute_print(text)


def cluster(seed):
    """Fingerprints in chains, dense balls and at random, two of them equal."""
    rng = random.Random(seed)
    out = [0, 2**64 - 1, 1, 3, 7, 15]
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            out.append(x)
            y = x if rng.random() < 0.5 else out[-1]
            for b in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << b
            out.append(y)
            x = y if rng.random() < 0.4 else x
    centre = rng.getrandbits(64)
    out += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)]
    return sorted(set(out))


@pytest.mark.parametrize("seed", range(3))
def test_links_keep_components(spark, seed):
    fps = cluster(seed)
    x = np.array(fps, np.uint64)
    want = components(fps, [(fps[i], fps[i + 1 + j]) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 3)])
    signed = lambda v: v - 2**64 if v >> 63 else v
    found = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()]
    back = lambda v: v % 2**64
    assert all(bin(back(u) ^ back(v)).count("1") <= 3 for u, v in found)
    assert components(fps, [(back(u), back(v)) for u, v in found]) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1000 + i: 1000 for i in range(1, 200)}, 5001: 5000}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_like_brute_force(docs, texts):
    prints = [brute_print(t) for _, t in texts]
    link = components(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    least = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            least[link[i]] = min(d, least.get(link[i], d))
    want = sorted(((d, prints[i], least.get(link[i])) for i, (d, _) in enumerate(texts)), key=repr)
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.id, r.fp % 2**64, r.component) for r in got), key=repr) == want


def test_query_and_empty(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = simhash.op10_simhash(spark, str(tmp_path))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.where(F.length("fingerprint") != 16).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
