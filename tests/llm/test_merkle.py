import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from folioflow.llm import merkle

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
FRAME = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"


def fold_up(digests):
    """Levels of digests, three at a time."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        run = range(i - i % 3, min(i - i % 3 + 3, len(level)))
        yield [level[j] for j in run if j < i], [level[j] for j in run if j > i]
        i //= 3


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars). Equal ids go by leaf."""
    leaf = lambda r, t: H(*map(FRAME, (r[0], r[3], r[2], r[4], t)))
    groups = {}
    for r in rows:
        later = r[1]
        if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
            later = r[1].replace("\n", "")
        groups.setdefault(r[3], []).append((-(2**70) if r[0] is None else r[0], leaf(r, r[1]), r[0], leaf(r, later)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    towers = {s: fold_up([x[1] for x in sorted(groups[s])]) for s in names}
    top = fold_up([towers[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, own, doc, other) in enumerate(sorted(groups[s])):
            steps = [*siblings(towers[s], i), *siblings(top, k)]
            node = other
            for left, right in steps:
                node = H(*left, node, *right)
            root = top[-1][0]
            out.append((doc, own, towers[s][-1][0], root, H(*(x for a, b in steps for x in a + b)), node, node == root))
    return sorted(out, key=repr)


def got(docs, span):
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return sorted((tuple(r) for r in merkle.manifest(docs, found=changed, span=span).collect()), key=repr)


def test_awkward_rows(spark, docs, tmp_path):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted((tuple(r) for r in merkle.op11_merkle(spark, str(tmp_path)).collect()), key=repr)
    assert found == brute(rows)
    assert {r[6] for r in found} == {True, False}


@pytest.mark.parametrize("n", [1, 10, 300])
def test_sizes(spark, n):
    """Lone leaves, last runs of one, several steps, many groups, ids of all sizes, equal rows."""
    rng = random.Random(n)
    ids = [rng.choice([rng.randrange(-5, 5), rng.randrange(-(2**63), 2**63), rng.randrange(2**20), None]) for _ in range(n)]
    rows = [(d, rng.choice([None, "", "a\nb", f"x{d}\ny"]), None, rng.choice([None, "", "a", "aé", "b", "z" * 9, f"s{rng.randrange(40)}"]), rng.choice([None, 3])) for d in ids]
    rows += rows[: n // 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got(docs, 2) == brute(rows)


def test_ranks_at_the_edges_of_digits(spark):
    ids = sorted([-(2**63), -1, 0, 1, 65535, 65536, 65537, 2**32 - 1, 2**32, 2**48, 2**63 - 1, -65536, -65537])
    rows = [("g", i, 1 + i % 3) for i in ids] + [("h", 5, 7)]
    df = spark.createDataFrame(rows, "grp string, id long, n long")
    names = ["a", "b", "c", "d"]
    keyed = df.select("*", *[c.alias(x) for x, c in zip(names, merkle.id_digits(F.col("id")), strict=True)])
    found = {(r.grp, r.id): r.before for r in merkle.radix_ranks(keyed.drop("id"), ["grp"], names).join(keyed.drop("n"), ["grp", *names]).collect()}
    want, seen = {("h", 5): 0}, 0
    for i in ids:
        want["g", i] = seen
        seen += 1 + i % 3
    assert found == want


def test_general_use(spark):
    docs = spark.createDataFrame([("k1", 7, "x"), ("k1", 8, "y"), ("k2", 9, "z")], "shelf string, number long, body string")
    found = merkle.manifest(docs, ("number", "body"), "number", "shelf", "body", fanout=2).collect()
    leaves = {i: H(FRAME(i), FRAME(t)) for _, i, t in [tuple(r) for r in docs.collect()]}
    assert {r.root for r in found} == {H(H(leaves[7], leaves[8]), leaves[9])} and all(r.verified for r in found)
    assert {r.id: r.proof for r in found}[7] == H(leaves[8], leaves[9])
    assert merkle.manifest(docs.limit(0), ("number", "body"), "number", "shelf", "body").count() == 0
