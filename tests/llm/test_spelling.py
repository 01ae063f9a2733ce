import random
import re
import zlib
from collections import Counter

import pytest

from folioflow.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(texts, every=199):
    counts = Counter()
    for d, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    near = {w: [x for x in words if distance_one(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], [ord(c) for c in x]), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    words = {"a", "b", "ab", "aaaa", "aaaaa", "aaaaaa", "ééééé", "éééééé", "×÷×÷×÷"}
    for _ in range(n):
        w = "".join(rng.choices("abcé", k=rng.randint(1, 9)))
        words.add(w)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            words.add(rng.choice([w[:i] + rng.choice("abcé") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("xyz") + w[i + 1 :]]))
    words.discard("")
    return {w: rng.choice([1, 5, 6, 25, 30, 130, 700]) for w in words}


@pytest.mark.parametrize("block_words", [20_000, 3, 1])
def test_like_brute_force(spark, block_words, monkeypatch):
    """Also with blocks that are dealt again and again, down to single code points."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", block_words)
    words = vocabulary(block_words)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted((tuple(r) for r in spelling.variants(df).collect()), key=repr) == brute(words)


def test_each_pair_once(spark):
    words = vocabulary(9)
    found = [(r.word, r.near) for r in spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), 5).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if distance_one(a, b)}


def test_words_of_awkward_rows(spark, docs, texts, tmp_path):
    for every, least in ((199, 5), (2, 1)):
        found = {r.word: r.n for r in spelling.count_words(docs, least_n=least, every=every).collect()}
        assert found == {w: n for w, n in brute_words(texts, every).items()} if least == 5 else found
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((tuple(r) for r in spelling.op12_spelling(spark, str(tmp_path)).collect()), key=repr) == brute(brute_words(texts))
    assert spelling.variants(spelling.count_words(docs.limit(0))).count() == 0


def test_letters_lost(spark, tmp_path):
    """Many runs, of which many lose a letter, also the last; words of just enough code points."""
    rng = random.Random(4)
    base = ["résumé", "resume", "spelling", "spellings", "Straße", "ÀÉÎÕÜß", "naïveté", "words", "seven77seven", "don't_stopping"]
    texts = [(i if i % 9 else None, " ".join(rng.choices(base, k=40))) for i in range(300)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = brute(brute_words(texts))
    assert any(r[1] for r in want)
    assert sorted((tuple(r) for r in spelling.op12_spelling(spark, str(tmp_path)).collect()), key=repr) == want
