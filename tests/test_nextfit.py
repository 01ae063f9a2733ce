import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators.nextfit import next_fit


def walked(sizes, most):
    """The rule, entry by entry."""
    out, used = [], None
    for n in sizes:
        fits = used is not None and used + n + 2 <= most
        out.append(out[-1] + (not fits) if out else 0)
        used = used + n + 2 if fits else n + 2
    return out


@pytest.mark.parametrize("block", [22, None])
def test_like_the_walk(spark, block):
    """Documents of all lengths, large entries, exact fits, null ids; blocks so small that chains pass many."""
    rng = random.Random(block or 0)
    docs = {None: [5, 5], 1: [1], 2: [38, 38, 38], 3: [100], 4: [0] * 300, 5: [18] * 60, 6: [100] * 50}
    for d in range(10, 22):
        docs[d] = [rng.choice([0, 1, 3, 18, 38, 39, 90, rng.randrange(60)]) for _ in range(rng.randrange(1, 400))]
    rows = [(d, i, n) for d, sizes in docs.items() for i, n in enumerate(sizes)]
    rng.shuffle(rows)
    found = next_fit(spark.createDataFrame(rows, "doc long, i int, n int"), ["doc"], "i", "n", 40, block).collect()
    got = {(r.doc, r.i): r.chunk_no for r in found}
    assert len(found) == len(rows)
    assert got == {(d, i): c for d, sizes in docs.items() for i, c in enumerate(walked(sizes, 40))}


def test_one_long_document_in_the_jvm(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("d").alias("doc"), F.col("id").alias("pos"), (F.xxhash64("id") % 200 + 200).alias("size"))
    found = next_fit(rows, ["doc"], "pos", "size", 3000)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = [r.chunk_no for r in found.orderBy("pos").collect()]
    assert got == walked([r[0] for r in rows.orderBy("pos").select("size").collect()], 3000)


def test_no_entries(spark):
    assert next_fit(spark.createDataFrame([], "doc long, pos long, size long"), ["doc"], "pos", "size", 100).count() == 0
