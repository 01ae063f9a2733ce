from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from folioflow.llm import common
from folioflow.staging import shared_dir


def test_no_private_folder_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, default: None)
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a")))
    named = SimpleNamespace(get=lambda key, default: "hdfs://x/shared/")
    assert shared_dir(SimpleNamespace(conf=named, sparkContext=SimpleNamespace(master="yarn"))) == "hdfs://x/shared"


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_prefix_sums(spark, width):
    rows = [(g, k, (g * 7 + k * k) % 5) for g in range(3) for k in range(0, 20, g + 1)]
    df = spark.createDataFrame(rows, "g long, k long, v long").repartition(3)
    got = {(r.g, r.k): r.before for r in common.prefix_sums(df, "k", "v", "before", ("g",), width).collect()}
    assert got == {(g, k): sum(v for h, j, v in rows if h == g and j < k) for g, k, _ in rows}
    whole = common.prefix_sums(df.groupBy("k").agg(F.sum("v").alias("v")), "k", "v", "before", (), width).collect()
    assert {r.k: r.before for r in whole} == {k: sum(v for _, j, v in rows if j < k) for _, k, _ in rows}


def test_row_keys_and_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "b"), (None, None), (1, None)]
    df = spark.createDataFrame(rows, "i long, t string").select("*", *common.row_keys("i", "t"), common.row_ids("i", "t").alias("own"))
    got = df.collect()
    assert len({(r.k1, r.k2) for r in got}) == len(set(rows))
    assert all((r.own == r.i) if r.i is not None else (-(2**63) <= r.own < common.NULL_IDS) for r in got)
    assert len({r.own for r in got if r.i is None}) == 3


def test_small_tables_are_told_from_large_ones(spark):
    small = common.materialize(spark.range(10), "small")
    assert common.small(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        assert not common.small(small)
        assert "hint" in common.build_side(small)._jdf.queryExecution().logical().toString().lower()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
