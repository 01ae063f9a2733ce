import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import jaccard
from tests.llm.test_simhash import components


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def corpus():
    """Copies with more and more words changed, chains of them, and texts of few or no words."""
    rng = random.Random(3)
    out = [None, "", " ", "one", "ONE", "one two", "a b c d e", "a b c d e a b c d e", None]
    for _ in range(6):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        for n in range(40):
            out.append(" ".join(words))
            if n % 8 == 7:
                words = words[: rng.randint(40, len(words))] + ["more"] * rng.randint(0, 30)
            words = [*words]
            words[rng.randrange(len(words))] = f"x{n}"
    return list(enumerate(out))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    alike = lambda a, b: len(a & b) >= jaccard.SIMILARITY * len(a | b)
    return components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])])


def test_like_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component for r in jaccard.near_copies(docs).collect()} == brute(rows)
    assert jaccard.near_copies(docs.limit(0)).count() == 0


def test_open_bands_in_blocks(spark, monkeypatch):
    """Many sets that share half of their shingles and few links: blocks of any size give the same."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(90):
        own = [f"o{i}x{j}" for j in range(rng.randint(10, 40))]
        rows.append((i, " ".join(common + own)))
        if i % 9 == 0:
            rows.append((200 + i, " ".join(common + own[:-1])))
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), None
    for sets, hashes in ((512, 1 << 20), (7, 1 << 20), (512, 300)):
        monkeypatch.setattr(jaccard, "BLOCK_SETS", sets)
        monkeypatch.setattr(jaccard, "BLOCK_HASHES", hashes)
        got = {r.id: r.component for r in jaccard.near_copies(docs).collect()}
        want = want or {rows[i][0]: rows[c][0] for i, c in brute(rows).items()}
        assert got == want and len(set(want.values())) < len(rows)


def test_rows_without_or_with_repeated_ids(spark):
    words = lambda p: " ".join(f"{p}{i}" for i in range(50))
    rows = [(5, words("t"), "a"), (7, words("t"), "b"), (7, words("o"), "c"), (None, words("t"), "d"), (None, words("n"), "e"), (None, words("n") + " end", "f"), (9, words("q"), "g"), (9, words("q"), "h"), (None, None, "i"), (3, "", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string")
    kept = jaccard.without_near_copies(docs)
    assert kept.columns == docs.columns
    got = sorted((tuple(r)[:2] for r in kept.collect()), key=repr)
    null = [x for x in got if x[0] is None]
    assert [x for x in got if x[0] is not None] == sorted([(3, ""), (5, words("t")), (7, words("o")), (9, words("q"))], key=repr)
    assert len(null) == 1 and null[0][1].startswith("n0")


def test_near_dedup_finds_copies_of_similarity_08(spark):
    """The stage linked three-word fingerprints at three bits before, which such copies rarely reach."""
    rng = random.Random(5)
    rows = []
    for i in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        near = [*words]
        near[40], near[80] = "changed", "too"  # 106 of 126 shingles
        rows += [(2 * i, " ".join(words), "en", "s0", 0), (2 * i + 1, " ".join(near), "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(range(0, 60, 2))


def test_ball_hashing_links_without_bands(spark, monkeypatch):
    """Where no band is shared, the balls of the fingerprints bring close copies together, and only true ones stay."""
    rng, rows = random.Random(6), []
    for i in range(12):
        words = [f"w{rng.randrange(9000)}" for _ in range(1500)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:700], "changed", *words[701:]]))]
    sketches = jaccard._sketches
    alone = lambda docs, shingle, whole: sketches(docs, shingle, whole) if whole else sketches(docs, shingle, whole).withColumn("values", F.array("node"))
    monkeypatch.setattr(jaccard, "_sketches", alone)
    prints = [jaccard.majority(np.unique(jaccard.shingle_hashes(t.encode(), 5))) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= jaccard.RADIUS]
    got = {r.id: r.component for r in jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(range(len(rows)), near) and len(set(got.values())) < len(rows)


def test_ball_pairs_like_brute_force(spark):
    rng = random.Random(7)
    prints = [rng.getrandbits(64) for _ in range(20)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for p in prints for _ in range(4)]
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    pairs = jaccard._ball_pairs(spark.createDataFrame([(i, p, 9) for i, p in enumerate(signed)], "node long, fp long, size int")).collect()
    near = [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    assert components(range(len(prints)), [(r.u, r.v) for r in pairs]) == components(range(len(prints)), near)
